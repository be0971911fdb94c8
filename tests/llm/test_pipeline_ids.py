"""Rows with a null id, or with an id that others have too, are judged each by itself."""

from tests.llm.conftest import prose

import corpus_pipeline


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_leaks_by_row(spark, tmp_path):
    item = prose(500, 40)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, prose(1, 80)), (7, prose(2, 80)), (8, prose(3, 80))]
    held = [(None, prose(4, 30) + " " + item), (7, prose(5, 30) + " " + item)]
    got = corpus_pipeline.drop_leaks(spark, docs_of(spark, clean + held), str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(clean, key=repr)


def test_near_copies_by_row(spark):
    a, b, c = prose(11, 90), prose(12, 90), prose(13, 90)
    rows = [(1, a), (None, a + " tail"), (None, prose(14, 90)), (None, b), (None, b + " tail"), (5, c), (5, c + " tail"), (1, prose(15, 90)), (9, prose(15, 90)), (9, prose(16, 90))]
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs_of(spark, rows), "").collect()]
    assert sorted(x for x in got if x[0]) == sorted([(1, a), *[x for x in got if x[0] == 5], (1, prose(15, 90)), (9, prose(16, 90))])
    assert len([x for x in got if x[0] == 5]) == 1
    none = [t for d, t in got if d is None]
    assert len(none) == 2 and prose(14, 90) in none and len({b, b + " tail"} & set(none)) == 1
