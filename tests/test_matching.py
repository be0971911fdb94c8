import pytest
from pyspark.sql import functions as F

from linekeeper.operators import matching, repairs

ONSETS = "array<struct<t: double, onset: double>>"
PEAKS = "array<struct<time: double, score: double>>"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize(
    "norm,chars,want",
    [("cd", [("a", 1.0), ("b", 1.5), ("c", 2.0), ("d", 2.5)], 2.0), ("cd", [], 2.0), ("xx", [], 1.0), ("ab", [], 1.0), ("cd", [("a", 1.0), ("b", 1.5), ("c", 9.0), ("d", 9.5)], 1.0)],
)
def test_place_in_segment(spark, norm, chars, want):
    df = rows(spark, [(norm, 1.0, 3.0, "abcd", chars)], "n string, s double, e double, x string, c array<struct<ch: string, t: double>>")
    got = df.select(matching.place_in_segment(*[F.col(c) for c in "nsexc"]).alias("t")).first().t
    assert got == pytest.approx(want)


LINES = "song string, entry int, norm string, marker boolean, segment int, score double, t double, duration double"
SEGS = "song string, seg_idx int, start double, end double, norm string"


def line(entry, segment=None, t=None, score=0.9, norm="abcdef"):
    return ("a", entry, norm, False, segment, score if segment is not None else 0.0, t, 60.0)


def times(spark, lines, segs):
    got = matching.times_from_segments(rows(spark, lines, LINES), rows(spark, segs, SEGS)).orderBy("entry").collect()
    return [(round(r.time, 3), r.how, r.segment) for r in got]


def test_missing_lines(spark):
    segs = [("a", 1, 10.0, 12.0, "abcdef"), ("a", 2, 30.0, 32.0, "abcdef"), ("a", 3, 33.0, 36.0, "ghijkl")]
    got = times(spark, [line(1, 1, 10.0), line(2), line(3, 2, 30.0), line(4), line(5, 3, 33.0, norm="ghijkl"), line(6)], segs)
    assert got[1] == (14.8, "tail", None)
    assert got[3][1:] == ("borrowed", 3) and got[3][0] == 33.0 and got[4][0] >= 33.0 + 0.55 * 3
    assert got[5][1] == "after"
    assert times(spark, [line(1), line(2)], segs[:1])[0] == (0.0, "none", None)


def test_shared_segment_is_spread(spark):
    segs = [("a", 1, 10.0, 12.0, "abcdef"), ("a", 2, 20.0, 22.0, "abcdef")]
    got = times(spark, [line(1, 1, 10.0), line(2, 1, 10.0), line(3, 2, 20.0)], segs)
    assert [g[0] for g in got] == [10.0, 14.95, 20.0]


def test_times_rise_and_stay_in_the_song(spark):
    segs = [("a", 1, 59.0, 61.0, "abcdef"), ("a", 2, 58.0, 59.0, "abcdef")]
    got = [g[0] for g in times(spark, [line(1, 1, 59.0), line(2, 2, 58.0), line(3)], segs)]
    assert got == sorted(got) and got[-1] <= 60.0


def test_opening_backtrack(spark):
    schema = f"song string, entry int, timestamp double, duration double, fused boolean, ctc_score double, token_scores array<double>, onsets {ONSETS}"
    weak, on = [0.01, 0.02, 0.05, 0.08, 0.4], [(9.5, 0.9)]
    data = [("a", 1, 10.0, 60.0, True, 0.2, weak, on), ("b", 1, 10.0, 60.0, False, 0.2, weak, on), ("c", 1, 10.0, 60.0, True, 0.2, [0.2, *weak[1:]], on)]
    assert {r.song: r.time for r in repairs.opening_backtrack(rows(spark, data, schema)).collect()} == {"a": 9.5, "b": 10.0, "c": 10.0}


def test_late_onset(spark):
    schema = f"song string, entry int, timestamp double, duration double, score double, forced double, onsets {ONSETS}"
    data = [("a", 1, 10.0, 60.0, 0.7, 9.0, [(10.6, 0.9)]), ("b", 1, 10.0, 60.0, 0.7, 9.9, [(10.6, 0.9)]), ("c", 1, 10.0, 60.0, 0.85, 9.0, [(10.6, 0.9)])]
    assert {r.song: r.time for r in repairs.late_onset(rows(spark, data, schema)).collect()} == {"a": 10.6, "b": 10.0, "c": 10.0}


BACK = f"song string, entry int, timestamp double, duration double, romaji string, ctc_score double, first_score double, peaks {PEAKS}, onsets {ONSETS}, norm_len int"


@pytest.mark.parametrize(
    "romaji,ctc,first,peaks,onsets,want",
    [
        ("ri", 0.1, 0.0, [], [(19.4, 0.9)], 19.4),
        ("sono", 0.1, 0.0, [], [(19.4, 0.9)], 20.0),
        ("mou", 0.12, 0.0, [(19.7, 0.10), (18.6, 0.008)], [], 18.6),
        ("tomosu", 0.12, 0.0, [(19.7, 0.10), (18.6, 0.009)], [], 20.0),
        ("sen", 0.04, 0.0, [], [(19.6, 0.9)], 19.6),
        ("sen", 0.04, 0.08, [], [(19.6, 0.9)], 20.0),
    ],
)
def test_initial_backtrack(spark, romaji, ctc, first, peaks, onsets, want):
    data = [("a", 1, 10.0, 60.0, "a", 0.9, 0.9, [], onsets, 5), ("a", 2, 20.0, 60.0, romaji, ctc, first, peaks, onsets, 5), ("a", 3, 30.0, 60.0, "a", 0.9, 0.9, [], onsets, 5)]
    assert repairs.initial_backtrack(rows(spark, data, BACK)).filter("entry = 2").first().time == want


def test_anchors_must_lie_between(spark):
    schema = "song string, entry int, timestamp double, duration double, anchor double"
    got = {r.entry: (r.time, r.error) for r in repairs.apply_anchors(rows(spark, [("a", 1, 10.0, 60.0, 9.0), ("a", 2, 20.0, 60.0, 30.0), ("a", 3, 30.0, 60.0, 20.0), ("a", 4, 40.0, 60.0, None)], schema)).collect()}
    assert got == {1: (9.0, None), 2: (20.0, "not before the next line"), 3: (30.0, "not after the line before"), 4: (40.0, None)}
