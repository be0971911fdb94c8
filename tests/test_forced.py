import pytest
from pyspark.sql import functions as F

from linekeeper.functions import text as tx
from linekeeper.operators import candidates, forced, joins, metrics, repairs

ROW = "song string, entry int, timestamp double, duration double, norm string, text string, score double, segment int, segment_end double, asr_norm string, asr_text string, borrowed boolean, forced double, settled boolean"


def row(entry, t, forced_time, norm="abcdefgh", score=0.5, segment=None, end=None, heard="", borrowed=False, settled=False, text=None):
    return ("a", entry, t, 100.0, norm, text or norm, score, entry if segment is None else segment, t if end is None else end, heard, heard, borrowed, forced_time, settled)


@pytest.mark.parametrize(
    "before,line,time,reason",
    [
        # a short line that is late goes back by 2.8 s at most, unless its segment begins with it
        (row(1, 10.0, None), row(2, 20.0, 12.0, "ab"), 17.2, "short-line-late-asr"),
        (row(1, 10.0, None), row(2, 20.0, 12.0, "ab", heard="abc"), 12.0, "short-line-late-asr"),
        (row(1, 10.0, None), row(2, 11.0, 10.0, "ab"), 11.0, None),
        (row(1, 10.0, None), row(2, 20.0, 19.0, text="私と", heard="と"), 19.0, "line-spans-next-segment"),
        (row(1, 10.0, None, end=10.5), row(2, 12.2, 11.5, "abcd"), 11.5, "close-following-line"),
        (row(1, 10.0, None), row(2, 20.0, 18.5, score=0.54), 18.5, "low-confidence-late-asr-forced"),
        (row(1, 10.0, None, borrowed=True), row(2, 20.0, 18.0, score=0.9), 17.75, "post-borrowed-line-forced"),
        (row(1, 10.0, None, score=0.05, segment=2), row(2, 20.0, 19.0, score=0.9, heard="xabcdefgh"), 19.0, "suffix-after-unmatched-same-segment"),
        (row(1, 10.0, None), row(2, 20.0, 18.5, score=0.7), 18.5, "medium-confidence-forced"),
        (row(1, 10.0, None), row(2, 20.0, 19.7, score=0.95), 19.7, "high-confidence-small-forced"),
        (row(1, 10.0, None, segment=2), row(2, 20.0, 19.3, score=0.6), 19.3, "low-confidence-same-segment-forced"),
        # no rule holds: a part of the way
        (row(1, 10.0, None), row(2, 20.0, 18.0, score=0.8), 19.6, "bounded-forced-asr-blend"),
        (row(1, 10.0, None), row(2, 20.0, 18.9, score=0.6), 19.615, "bounded-forced-asr-blend"),
        (row(1, 10.0, None), row(2, 20.0, 17.9, score=0.8), 20.0, None),
        (row(1, 10.0, None), row(2, 20.0, 19.7, score=0.95, settled=True), 20.0, None),
        (row(1, 10.0, None), row(2, 20.0, None, score=0.95), 20.0, None),
    ],
)
def test_forced_rules(spark, before, line, time, reason):
    got = forced.lyric_refinement(spark.createDataFrame([before, line], ROW)).filter("entry = 2").first()
    assert (got.time, got.reason) == (pytest.approx(time), reason)


def test_windows_move_their_targets(spark):
    schema = "song string, entry int, timestamp double, duration double, ctc double, wx double, first_score double, ctc_score double, token_spans array<struct<start: double, end: double, score: double>>, peaks array<struct<time: double, score: double>>"
    rows = [("a", i, 10.0 * i, 100.0, 10.0 * i, 10.0 * i + (1.2 if i in (3, 4) else 0.45 if i == 7 else 0.0), 0.05 if i == 7 else 0.5, 0.3, None, None) for i in range(1, 9)]
    lines = spark.createDataFrame(rows, schema)
    windows = forced.hybrid_windows(lines)
    got = [(r.first_target, r.last_target, r.first_entry, r.last_entry, round(r.start, 2), round(r.end, 2)) for r in windows.orderBy("run").collect()]
    assert got == [(3, 4, 2, 5, 19.92, 59.95), (7, 7, 6, 8, 59.92, 100.0)]
    results = spark.createDataFrame(
        [("a", 1, 3, 31.0, 0.5, [(31.0, 31.5, 0.9)], []), ("a", 1, 4, 70.0, 0.5, [(70.0, 71.0, 0.9)], []), ("a", 1, 5, 51.0, 0.5, [(51.0, 52.0, 0.9)], [(50.0, 0.05)]), ("a", 1, 2, 21.0, 0.5, [], [])],
        "song string, run int, entry int, start double, ctc_score double, token_spans array<struct<start: double, end: double, score: double>>, peaks array<struct<time: double, score: double>>",
    )
    moved = {r.entry: r.timestamp for r in forced.apply_windows(lines, windows, results).collect() if r.realigned}
    assert moved == {3: 31.0, 5: 51.0}  # a time out of the window, and the line before it, stay


def test_boundaries(spark):
    schema = "song string, entry int, timestamp double, duration double, ctc_score double, token_end double, local_time double, local_score double, local_end double"
    df = spark.createDataFrame([("a", 1, 5.0, 60.0, 0.5, 10.0, None, None, None), ("a", 2, 10.03, 60.0, 0.2, 14.0, 10.4, 0.22, 16.0), ("a", 3, 16.03, 60.0, 0.2, 20.0, 16.5, 0.3, 21.0), ("a", 4, 30.0, 60.0, 0.2, 33.0, 31.0, 0.9, 33.0)], schema)
    assert {r.entry: r.time for r in forced.apply_boundaries(df).collect()} == {1: 5.0, 2: 10.4, 3: 16.5, 4: 30.0}


def test_short_duplicates_go_back(spark):
    schema = "song string, entry int, timestamp double, duration double, short_duplicate boolean, flags array<string>, evidence map<string,double>"
    flag = ["short_duplicate_asr_consensus_untrusted"]
    lines = spark.createDataFrame([("a", 1, 10.0, 60.0, False, None, {"raw": 14.8}), ("a", 2, 20.0, 60.0, True, flag, {"raw": 15.0}), ("a", 3, 25.0, 60.0, True, [], {"raw": 21.0})], schema)
    frames = spark.createDataFrame([("a", 14.0 + 0.1 * k, 0.9 if k in (11, 12) else 0.1) for k in range(60)], "song string, t double, onset double")
    got = {r.entry: r for r in repairs.short_duplicate_recovery(repairs.with_peaks(lines, frames)).collect()}
    assert got[2].time == pytest.approx(15.15) and list(got[2].supporting) == [1, 2] and got[3].time == 25.0  # the middle of a plateau


def test_plateaus_end_with_the_span(spark):
    frames = spark.createDataFrame([("a", float(t), v) for t, v in enumerate((0.0, 0.8, 0.8, 0.8, 0.1, 0.9))], "song string, t double, onset double")
    ask = lambda end: joins.first_peak(spark.createDataFrame([("a", 1, 0.0, end)], "song string, entry int, start double, end double"), frames, 0.55, 0.2, middle=True).first().peak_time
    assert (ask(4.0), ask(2.5), ask(1.0), ask(0.9)) == (2.0, 1.5, 1.0, None)


def test_failed_attempts_keep_their_error_alone(spark):
    rep = spark.createDataFrame([("a", "x", 90.0, None), ("b", "x", 80.0, "no evidence")], "song string, backend string, trusted_percent double, error string")
    lines = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], "song string, entry int, timestamp double")
    kept, times = candidates.attempted(rep, lines, "ctc")
    assert {tuple(r) for r in kept.select("song", "backend", "trusted_percent", "error").collect()} == {("a", "ctc", 90.0, None), ("b", "ctc", None, "no evidence")}
    assert [r.song for r in times.collect()] == ["a"]


def test_raw_diagnostics_and_splices(spark):
    rep = spark.createDataFrame([("a", 1.0)], "song string, trusted_percent double")
    seg = spark.createDataFrame([("a", 1, 5.0, 9.5, "y"), ("a", 0, 1.0, 2.0004, "x")], "song string, seg_idx int, start double, end double, text string")
    got = candidates.raw_diagnostic(rep, seg, spark.createDataFrame([("a", True)], "song string, repeated boolean")).first()
    assert (got.backend, got.raw_asr_max_segment_seconds, got.asr_repeated_tail_after_0s, [tuple(x) for x in got.raw_asr_segments]) == ("whispercpp_raw", 4.5, True, [(1.0, 2.0, "x"), (5.0, 9.5, "y")])
    lines = spark.createDataFrame([("a", 1, 1.00049, "normal"), ("a", 2, 2.0, "retry")], "song string, entry int, time double, source string")
    side = lambda v: spark.createDataFrame([("a", 1, 0.0, v), ("a", 2, 0.0, v)], "song string, entry int, timestamp double, score double")
    assert {(r.entry, r.timestamp, r.score) for r in candidates.spliced_assignments(lines, side(0.1), side(0.9)).collect()} == {(1, 1.0, 0.1), (2, 2.0, 0.9)}


def test_gates_of_a_review(spark):
    df = spark.createDataFrame([(0, 99.5, False), (2, 100.0, True), (0, 100.0, True), (0, 100.0, False)], "review_required_count int, trusted_percent double, collapse_detected boolean")
    ask = lambda **k: [r[0] for r in df.select(metrics.review_failure(**k)).collect()]
    assert ask(strict=True) == ["trusted_percent=99.5 < required 100.0", "review_required_count=2", "collapse_detected=true", None]
    assert ask() == [None] * 4 and ask(fail_on_review=True) == [None, "review_required_count=2", None, None]
    assert ask(min_trusted=100) == ["trusted_percent=99.5 < required 100.0", None, None, None]


def test_profiles(spark):
    df = spark.createDataFrame([("君が代は、千代", "kimigayowachiyo"), ("Hello, World 12", None), ("…", None), ("ｆｏｏ", "")], "text string, romaji string")
    got = [r.p for r in df.select(tx.anchor_profile(F.col("text"), F.col("romaji")).alias("p")).collect()]
    assert (got[0].phonetic_system, got[0].first_mora, got[0].last_mora, got[0].romaji_prefix, got[0].normalized_suffix) == ("ja-hepburn-pykakasi", "ki", "yo", "kimigayowach", "君が代は千代")
    assert (got[1].phonetic_system, got[1].romaji, got[1].romaji_suffix, got[1].normalized_prefix, got[1].first_mora) == ("latin-fallback", "helloworld12", "helloworld12", "HelloWor", None)
    assert got[2].phonetic_system == "unavailable" and got[3].romaji == "foo"
