import csv
import io

import pytest
from pyspark.sql import functions as F

from linekeeper.operators.metrics import positional_eval
from linekeeper.sources import files, lrc, reports


def docs(spark, *contents):
    return spark.createDataFrame(list(enumerate(contents)), "doc_id int, content string")


def entries(df):
    return [(r.lines, r.time_cs) for r in df.orderBy("doc_id", "entry").collect()]


def test_lyrics_with_times(spark):
    text = "﻿[ti:x]\n[00:01.00]one\r\n[00:01.00]eins\n\n# kept\n[00:02.5][00:09.00]two  zwei\n[00:01.00]again\n[00:03]\n"
    got = entries(lrc.parse_lyrics(docs(spark, text)))
    assert got == [(["one", "eins"], 100), (["# kept"], None), (["two", "zwei"], 250), (["again"], 100)]
    assert entries(lrc.parse_lyrics(docs(spark, text), skip_comments=True))[1] == (["two", "zwei"], 250)


def test_translations_merge_only_without_times(spark):
    assert entries(lrc.parse_lyrics(docs(spark, "かな\n漢字\nlatin\n漢字"))) == [(["かな", "漢字"], None), (["latin", "漢字"], None)]
    assert entries(lrc.parse_lyrics(docs(spark, "かな\nかな"))) == [(["かな"], None), (["かな"], None)]
    assert entries(lrc.parse_lyrics(docs(spark, "漢字\nかな\n漢字"))) == [(["漢字", "かな"], None), (["漢字"], None)]
    assert entries(lrc.parse_lyrics(docs(spark, "[00:01]かな\n漢字"))) == [(["かな"], 100), (["漢字"], None)]


def test_no_lyrics(spark):
    assert entries(lrc.parse_lyrics(docs(spark, "", "[ti:x]\n\n", None))) == []


def test_evaluation_parser_differs(spark):
    got = entries(lrc.parse_for_evaluation(docs(spark, "[by:x]\n[00:01.00]a  b\nloose\n[00:01.00]c\n[00:02.00]")))
    assert got == [(["a  b", "c"], 100), ([""], 200)]


def test_title_card_is_not_an_entry(spark):
    ref = lrc.for_evaluation(lrc.parse_for_evaluation(docs(spark, "[00:05.00]line")))
    gen = lrc.for_evaluation(lrc.parse_for_evaluation(docs(spark, "[00:00.00]Artist - Title\n[00:05.00]line")))
    r = positional_eval(ref, gen, "doc_id").first()
    assert (r.reference_entries, r.generated_entries, r.text_mismatches, r.max_abs_delta_cs) == (1, 1, 0, 0)


def test_title_cards_of_lyrics(spark):
    parsed = lrc.parse_lyrics(docs(spark, "[00:00.00]Someone - My Song\n[00:05.00]line", "My Song\nline"))
    titles = spark.createDataFrame([(0, "My Song"), (1, "My Song")], "doc_id int, title string")
    assert entries(lrc.drop_title_cards(parsed, titles)) == [(["line"], 500), (["line"], None)]


def test_markers_renumber(spark):
    got = lrc.drop_markers(lrc.parse_lyrics(docs(spark, "one\n♪\n(Interlude)\ntwo")))
    assert [(r.entry, r.lines) for r in got.orderBy("entry").collect()] == [(1, ["one"]), (2, ["two"])]


def test_anchors(spark):
    got = lrc.parse_anchors(docs(spark, "# a note\n# entry=3\n[00:12.34]again\n[00:20.00]x\n[00:20.00]y\nloose")).orderBy("hint_idx").collect()
    assert [(r.entry_number, r.lines, r.time_cs, r.error) for r in got] == [(3, ["again"], 1234, None), (None, ["x", "y"], 2000, None), (None, ["loose"], None, "untimed line")]


def test_written_files_parse_again(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, ["one", "eins"], 1.234), ("s", 2, ["two"], 59.996)], "doc_id string, entry int, lines array<string>, t double")
    heads = spark.createDataFrame([("s", "Someone", "Song", 75.0), ("t", None, "Bare", 5.0)], "doc_id string, artist string, title string, duration double")
    out = f"{tmp_path}/out"
    texts = lrc.lrc_text(rows, heads)
    lrc.write_texts(texts.filter("doc_id = 's'"), out)
    with pytest.raises(FileExistsError):
        lrc.write_texts(texts, out)
    with pytest.raises(ValueError):
        lrc.write_texts(texts.union(texts), f"{tmp_path}/other")
    lrc.write_texts(texts.filter("doc_id = 's'"), out, overwrite=True)
    assert [r.path.rsplit("/", 1)[-1] for r in files.listing(spark, out).collect()] == ["s"]
    back = spark.read.text(out, wholetext=True).select(F.lit("s").alias("doc_id"), F.col("value").alias("content"))
    assert entries(lrc.for_evaluation(lrc.parse_for_evaluation(back))) == [(["one", "eins"], 123), (["two"], 6000)]
    assert texts.filter("doc_id = 't'").first().content.startswith("﻿[ti:Bare]\n")


def test_newest_report_wins(spark):
    schema = "path string, output_path string, title string, mtime int, value int"
    rep = spark.createDataFrame([("r/a.json", "o/Song.lrc", "Song", 1, 1), ("r/b.json", "o/Song.lrc", "Song", 2, 2)], schema)
    assert {r.key: r.value for r in reports.newest_reports(rep).collect()} == {"a": 1, "b": 2, "song": 2}
    refs = spark.createDataFrame([("x/Song.checked.lrc",), ("x/None.lrc",)], "reference string")
    got = reports.cases(refs, rep).collect()
    assert [(r.key, r.value, r.category) for r in got] == [("song", 2, "standard / Japanese vocal")]


ASSIGNED = "song string, entry int, ordinal int, score double, ctc_score double, chosen_time double, confidence double, reasons array<string>, penalties array<struct<kind: string, value: double>>, split string, timing_trusted boolean, trust_reason string, trust_sources array<string>, trust_times map<string,double>"


def test_audit(spark):
    e = spark.createDataFrame([("s", 1, ["one", " ", "eins"], 2250), ("s", 2, ["two"], 100)], "song string, entry int, lines array<string>, time_cs int")
    made = [("s", 1, 1, 0.5, None, None, None, None, None, None, False, None, None, None, [], []), ("s", 1, 2, 0.9, 0.125, 23.0, 0.75, ["why"], [("p", 0.25), ("q", None)], "on", True, "votes", ["ctc"], None, [("s", 22.5, 22.6, 0.8)], [])]
    a = spark.createDataFrame(made, f"{ASSIGNED}, token_spans {reports.SPANS}, peaks {reports.PEAKS}")
    k = spark.createDataFrame([("s", 1, 1, ["ctc", "raw"], "high", True, {"ctc": 1.0, "selected": 62.5}, None, [(22.5, 0.8)])], f"song string, entry int, ordinal int, flags array<string>, severity string, review_required boolean, cand_ts map<string,double>, token_spans {reports.SPANS}, peaks {reports.PEAKS}")
    audit = reports.audit_rows(e, a, k)
    assert audit.columns == ["song", "__n", *reports.AUDIT_COLUMNS]
    got = {r.entry: r for r in audit.collect()}
    assert (got["1"].time, got["1"].text, got["1"].ctc_tokens, got["1"].flags, got["1"].spread, got["1"].score) == ("00:22.50", "one / eins", "s@00:22.50/0.800", "ctc;raw;timing_trusted", "61.500", "0.900")
    # the risk's peaks stand in for an empty list; the output is the risk's selected time
    assert (got["1"].ctc_first_token_candidates, got["1"].output, got["1"].decision_penalties, got["1"].ctc_score) == ("00:22.50/0.800", "01:02.50", "p:0.25;q", "0.125000")
    assert (got["2"].review, got["2"].output, got["2"].score, got["2"].timing_trusted, got["2"].spread) == ("no", "00:01.00", "", "no", "")
    assert reports.audit_rows(e, a, k, review_only=True).count() == 1
    assert reports.markdown(audit.filter("entry = 1"), "entry", "text").first().value == "| 1 | one / eins |"
    page = reports.audit_csv(audit).first().content
    assert page.startswith("\ufeffentry,time,") and page.endswith(",two\r\n") and len(list(csv.reader(io.StringIO(page)))) == 3
    head = spark.createDataFrame([("s", "ctc", "x", 2, 50.0, 1, 1), ("t", "ctc", None, 0, 0.0, 0, 0)], "song string, backend string, strategy string, timing_entries int, trusted_percent double, timing_trusted_entries int, review_required_count int")
    pages = {r.song: r.content for r in reports.audit_markdown(audit, head).collect()}
    assert pages["s"].count("\n") == 13 and "- strategy: ``\n" in pages["t"] and pages["t"].count("\n") == 11
    paths = spark.createDataFrame([("s", "/r/a.md", "/r/a.lrc")], "song string, audit_path string, template_path string")
    assert {r.doc_id for r in reports.review_files(e, a, k, head, paths).collect()} == {"/r/a.md", "/r/a.lrc"}


def test_reports_are_indented_json(spark, tmp_path):
    df = spark.createDataFrame([("/x/a.align-report.json", "ctc", None, 1.5)], "doc_id string, backend string, note string, trusted_percent double")
    lrc.write_texts(reports.report_json(df), str(tmp_path))
    back = reports.read_evidence(spark, str(tmp_path), "backend string, note string, trusted_percent double")
    assert [tuple(r) for r in back.collect()] == [("ctc", None, 1.5)]


def test_anchor_files(spark):
    songs = spark.createDataFrame([("s", "/a/x.flac")], "song string, audio_path string")
    there = spark.createDataFrame([("/a/x.anchor.txt",), ("/t/y.anchor-template.lrc",), ("/t/z.lrc",)], "path string")
    ask = lambda **k: tuple(files.find_anchors(songs, there, **k).select("anchor_path", "error").first())
    assert ask() == ("/a/x.anchor.txt", None) and ask(search=False) == (None, None) and ask(explicit="/t/z.lrc") == ("/t/z.lrc", None)
    assert "Refusing" in ask(explicit="/t/y.anchor-template.lrc")[1] and "not found" in ask(explicit="/none")[1]


def test_category_map(spark, tmp_path):
    (tmp_path / "m.json").write_text('{\n "Song A": "x", "B": "y"\n}')
    assert {tuple(r) for r in reports.read_category_map(spark, str(tmp_path / "m.json")).collect()} == {("Song A", "x"), ("B", "y")}
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(Exception):
        reports.read_category_map(spark, str(tmp_path / "bad.json")).collect()


def test_source_times_are_all_or_none(spark):
    df = spark.createDataFrame([("a", 1, 150), ("a", 2, 200), ("b", 1, 100), ("b", 2, None)], "doc_id string, entry int, time_cs int")
    got = {(r.doc_id, r.entry): (r.t, r.error is None) for r in files.source_times(df).collect()}
    assert got == {("a", 1): (1.5, True), ("a", 2): (2.0, True), ("b", 1): (None, False), ("b", 2): (None, False)}


def test_rollup(spark):
    schema = "category string, status string, entries int, within_25cs_percent double, within_50cs_percent double, trusted_percent double, review_required_percent double"
    df = spark.createDataFrame([("a", "OK", 10, 50.0, 100.0, 80.0, None), ("a", "OK", 30, 100.0, 100.0, 100.0, 10.0), ("a", "SKIP", 5, 0.0, 0.0, 0.0, 0.0)], schema)
    r = reports.corpus_rollup(df).first()
    assert (r.songs, r.entries, r.within_25cs_percent, r.trusted_percent, r.review_required_percent) == (2, 40, 87.5, 95.0, 10.0)
