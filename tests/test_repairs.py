import pytest
from pyspark.sql import functions as F

from linekeeper.operators import diagnostics, planning, repairs

ONSETS = "array<struct<t: double, onset: double>>"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_path_tiers(spark):
    data = [("a", i, s, False) for i, s in enumerate([0.02, 0.02, 0.02, 0.5], 1)] + [("b", i, 0.005, False) for i in range(1, 5)] + [("b", 5, 0.05, True)]
    df = diagnostics.path_tiers(rows(spark, data, "song string, entry int, ctc_score double, missing boolean"))
    got = {r.song: r for r in diagnostics.path_report(df).collect()}
    assert (got["a"].ctc_low_score_count, got["a"].review_required_count, got["a"].collapse_detected) == (3, 0, False)
    assert (got["b"].ctc_very_low_score_count, got["b"].review_required_count, got["b"].collapse_detected) == (4, 5, True)
    assert {r.score for r in df.collect()} == {0.35, 0.90, 0.70}
    assert df.filter("song = 'b' and entry = 5").first().flags == ["ctc_missing_alignment"]


def test_disagreements(spark):
    a = rows(spark, [("a", 1, 10.0, False), ("a", 2, 20.0, False), ("a", 3, 30.0, True)], "song string, entry int, timestamp double, settled boolean")
    b = rows(spark, [("a", 1, 10.2), ("a", 2, 21.2), ("a", 3, 33.0)], "song string, entry int, timestamp double")
    assert [(r.entry, r.severity, r.delta) for r in diagnostics.disagreements(a, b).collect()] == [(2, "high", 1.2)]


def test_diagnostics(spark):
    schema = "song string, entry int, timestamp double, duration double, forced double, score double, segment int, borrowed boolean, norm string, text string"
    data = [("a", 1, 5.0, 60.0, None, 0.9, 1, True, "ab", "ab"), ("a", 2, 20.0, 60.0, 15.5, 0.9, 2, False, "x" * 20, "x"), ("a", 3, 23.0, 60.0, 23.0, 0.9, 3, False, "abcdef", "abcdef"), ("a", 4, 26.0, 60.0, None, 0.9, 4, False, "abc", "abc"), ("a", 5, 50.0, 60.0, None, 0.9, 5, False, "", "")]
    got = {r.entry: r for r in diagnostics.alignment_diagnostics(rows(spark, data, schema)).collect()}
    assert got[1].flags == ["possible_instrumental_intro_hallucination"] and got[1].severity == "high"
    assert got[2].flags == ["candidate_disagreement", "possible_midline_anchor", "long_line_close_to_next_entry"] and got[2].severity == "high"
    assert got[3].flags == ["follows_suspicious_long_line", "possible_bad_split_boundary"] and got[3].severity == "high"
    assert got[4].severity == "medium" and got[5].flags == [] and got[5].severity is None and not got[5].review


LINE = f"song string, entry int, timestamp double, duration double, score double, flags array<string>, norm_len int, onsets {ONSETS}, settled boolean"


@pytest.mark.parametrize("flags,onset,settled,want", [(["candidate_disagreement"], 19.5, False, 19.5), (["candidate_disagreement", "x"], 19.5, False, 20.0), (["candidate_disagreement"], 19.7, False, 20.0), (["close_neighbor_onset_uncertain"], 20.5, False, 20.5), (["candidate_disagreement"], 19.5, True, 20.0)])
def test_acoustic_boundaries(spark, flags, onset, settled, want):
    data = [("a", 1, 10.0, 60.0, 0.9, [], 9, [(onset, 0.9)], False), ("a", 2, 20.0, 60.0, 0.96, flags, 9, [(onset, 0.9)], settled), ("a", 3, 30.0, 60.0, 0.9, [], 9, [(onset, 0.9)], False)]
    assert repairs.acoustic_boundaries(rows(spark, data, LINE)).filter("entry = 2").first().time == want


def test_first_line_goes_to_its_onset(spark):
    data = [("a", 1, 0.9, 60.0, 0.5, None, 9, [(0.6, 0.9)], False)]
    got = repairs.acoustic_boundaries(rows(spark, data, LINE)).first()
    assert (got.time, got.reason) == (0.6, "first-line-acoustic-onset")


@pytest.mark.parametrize("suspicious,raw,first,want", [(True, None, 0.0, 20.05), (False, 20.4, 0.3, 20.05), (False, 20.4, 0.1, 20.4), (False, None, 0.3, 20.4)])
def test_micro_refinement(spark, suspicious, raw, first, want):
    data = [("a", 1, 20.4, 60.0, 0.96, 20.05, 0.2, first, raw, 0.9, suspicious)]
    df = rows(spark, data, "song string, entry int, timestamp double, duration double, score double, ctc double, ctc_score double, first_score double, raw double, raw_score double, suspicious boolean")
    assert repairs.micro_refinement(df).first().time == want


def test_vocal_tiebreak(spark):
    schema = "song string, entry int, timestamp double, duration double, ctc double, near_onset double, ctc_onset double"
    df = rows(spark, [("a", 1, 20.0, 60.0, 18.8, 0.40, 0.95), ("b", 1, 20.0, 60.0, 18.8, 0.85, 0.95)], schema)
    assert {r.song: r.time for r in repairs.vocal_tiebreak(df).collect()} == {"a": 18.8, "b": 20.0}


def test_intro_repair(spark):
    schema = f"song string, entry int, timestamp double, duration double, score double, segment int, borrowed boolean, onsets {ONSETS}"
    on = [(20.5, 0.9)]
    data = [("a", 1, 1.0, 90.0, 0.1, None, True, on), ("a", 2, 15.0, 90.0, 0.2, 1, False, on), ("a", 3, 30.0, 90.0, 0.9, 2, False, on)]
    got = [(r.time, r.reason is not None) for r in repairs.intro_repair(rows(spark, data, schema)).orderBy("entry").collect()]
    assert got == [(20.5, True), (25.25, True), (30.0, False)]
    good = [(s, e, t, d, 0.9, g, b, o) for s, e, t, d, _, g, b, o in data]
    assert [r.time for r in repairs.intro_repair(rows(spark, good, schema)).orderBy("entry").collect()] == [1.0, 15.0, 30.0]


def test_long_segment_repair(spark):
    schema = "song string, entry int, timestamp double, duration double, score double, segment_start double, segment_end double, norm_len int"
    data = [("a", 1, 5.0, 90.0, 0.9, 5.0, 9.0, 10), ("a", 2, 10.0, 90.0, 0.9, 10.0, 30.0, 30), ("a", 3, 30.0, 90.0, 0.9, 30.0, 33.0, 10)]
    assert [round(r.time, 3) for r in repairs.long_segment_repair(rows(spark, data, schema)).orderBy("entry").collect()] == [5.0, 28.35, 30.0]


def test_tail_repair(spark):
    schema = "song string, entry int, timestamp double, duration double, weight double, tail_entry int, repeated_tail boolean, tail_onset double, voice_end double"
    data = [("a", i, 10.0 + i, 80.0, 1.0, 2, True, 30.0, 60.0) for i in range(1, 5)]
    assert [r.time for r in repairs.tail_repair(rows(spark, data, schema)).orderBy("entry").collect()] == [11.0, 30.0, 40.0, 50.0]
    other = rows(spark, data, schema).withColumn("repeated_tail", F.lit(False))
    assert [r.time for r in repairs.tail_repair(other).orderBy("entry").collect()] == [11.0, 12.0, 13.0, 14.0]


def test_planning(spark):
    songs = rows(spark, [("a", 100.0), ("b", 100.0)], "song string, duration double")
    segs = rows(spark, [("a", 10.0, 20.0), ("a", 30.0, 40.0), ("a", 50.0, 60.0), ("a", 70.0, 95.0)], "song string, start double, end double")
    got = {r.song: (r.start, r.end) for r in planning.active_bounds(songs, segs).collect()}
    assert got == {"a": (10.0, 95.0), "b": (8.0, 94.0)}
    lines = rows(spark, [(s, i, "two words") for s in "ab" for i in range(1, 5)], "song string, entry int, line string")
    bounds = planning.active_bounds(songs, segs)
    even = {(r.song, r.entry): r.t for r in planning.weighted_times(lines, bounds).collect()}
    assert even["b", 1] == 8.0 and even["b", 3] == pytest.approx(51.0)
    guided = {(r.song, r.entry): r.t for r in planning.guided_times(lines, bounds, segs).collect()}
    assert [guided["a", i] for i in range(1, 5)] == [10.0, 30.0, 50.0, 70.0] and guided["b", 3] == pytest.approx(51.0)
    frames = rows(spark, [("a", 30.3, 0.9)], "song string, t double, onset double")
    plan = {(r.song, r.entry): r.time for r in planning.plan(lines, songs, segs, frames).collect()}
    assert plan["a", 2] == 30.3 and plan["a", 1] == 10.0


def test_windows_to_realign(spark):
    data = [("a", i, 10.0 * i, i in (2, 4, 9, 10, 11, 12, 13, 14, 15)) for i in range(1, 20)]
    got = planning.windows_to_realign(rows(spark, data, "song string, entry int, timestamp double, target boolean")).collect()
    assert sorted((r.start, r.end) for r in got) == [(2, 4), (9, 13), (14, 15)]
