from linekeeper.llm import warc


def test_every_row_of_pages_comes_back(spark, tmp_path):
    rows = [(None, None, None), (None, "http://a/1", None), (None, "http://a/2", None), (None, "http://a/2", None), (1, "http://a", "x"), (1, "http://a", "x"), (2, "http://b", "x"), (None, "http://c", "x"), (None, "http://c", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op7_warc(spark, str(tmp_path)).collect()]
    want = [(None, 0, "response", None)] * 4 + [(1, 1, "response", None)] * 2 + [(2, 1, "revisit", 1)] + [(None, 1, "revisit", 1)] * 2
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_ids_may_be_texts(spark, tmp_path):
    rows = [("b: 1\r\n", "u", "x"), ("a", "u", "x"), ("é", None, "y"), (None, "u", "x")]
    spark.createDataFrame(rows, "page_id string, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.op7_warc(spark, str(tmp_path)).collect()}
    assert got == {("b: 1\r\n", "revisit", "a"), ("a", "response", None), ("é", "response", None), (None, "revisit", "a")}
