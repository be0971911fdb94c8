import random

import pytest
from pyspark.sql import functions as F

from linekeeper.operators import folds, joins, metrics, scoring, windows

SPAN = "array<struct<start: double, end: double, score: double>>"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_boundary_clear_and_not(spark):
    df = rows(spark, [("a", 1, [(47.0, 48.60, 0.9)]), ("a", 2, [(49.82, 50.0, 0.5)]), ("b", 1, [(47.0, 48.60, 0.9)]), ("b", 2, [(48.68, 50.0, 0.5)]), ("c", 1, None), ("c", 2, [(1.0, 2.0, None)])], f"song string, entry int, token_spans {SPAN}")
    got = {(r.song, r.entry): (r.clear, r.gap) for r in windows.boundary_evidence(df).collect()}
    assert got["a", 2] == (True, pytest.approx(1.22))
    assert got["b", 2][0] is False and got["c", 1] == (None, None) and got["c", 2] == (False, None)


def test_crossline_recovery_and_its_twin(spark):
    def song(name, second):
        return [(name, 1, 40.0, [(40.0, 43.72, 0.9)]), (name, 2, 43.74, [(43.74, 43.8, 0.1), (second[1], 46.5, 0.9)] if second[0] else [(46.15, 46.2, 0.1), (46.32, 46.5, 0.9)]), (name, 3, 60.0, None)]

    df = rows(spark, song("a", (True, 46.32)) + song("b", (False, 0)), f"song string, entry int, timestamp double, token_spans {SPAN}")
    got = {(r.song, r.entry): r.recovered for r in windows.crossline_recovery(df).collect()}
    assert got["a", 2] == 46.32 and got["b", 2] is None


def test_drift(spark):
    raw = [9.05, 19.10, 29.00, 39.08, 49.02]
    df = rows(spark, [("a", i + 1, 10.0 * (i + 1), raw[i], 0.9, False) for i in range(5)], "song string, entry int, current double, raw double, raw_score double, borrowed boolean")
    got = windows.drift_runs(df).collect()
    assert [(r.start_entry, r.end_entry, r.length) for r in got] == [(1, 5, 5)]
    assert got[0].median_delta == pytest.approx(-0.95)
    assert windows.drift_runs(df.withColumn("raw_score", F.lit(0.0))).count() == 0


def test_collapse_runs(spark):
    data = [("a", i, s, x) for i, (s, x) in enumerate([(1, 0.1), (1, 0.2), (1, 0.0), (1, 0.29), (2, 0.1), (2, 0.9)], 1)]
    df = rows(spark, data, "song string, entry int, segment int, score double")
    assert [(r.segment, r.start_entry, r.end_entry) for r in windows.segment_collapse(df).collect()] == [(1, 1, 4)]
    zero = df.withColumn("score", F.lit(0.0)).withColumn("segment", F.lit(None).cast("int"))
    assert [(r.start_entry, r.length) for r in windows.zero_collapse(zero).collect()] == [(1, 6)]


def test_merge_segments(spark):
    df = rows(spark, [("a", 0.0, 1.0), ("a", 1.45, 2.0), ("a", 2.46, 3.0), ("a", 9.0, 9.5)], "song string, start double, end double")
    assert sorted((r.start, r.end) for r in windows.merge_segments(df, "start", "end").collect()) == [(0.0, 2.0)]
    assert sorted((r.start, r.end) for r in windows.merge_segments(df, "start", "end", 0.47).collect()) == [(0.0, 3.0)]


def test_followers_chain(spark):
    data = [("a", 1, 0.0, True, True), ("a", 2, 3.0, False, False), ("a", 3, 6.0, False, False), ("a", 4, 10.0, False, False)]
    got = {r.entry: (r.follows, r.follows_high) for r in windows.follower_flags(rows(spark, data, "song string, entry int, timestamp double, flagged boolean, high boolean")).collect()}
    assert got == {1: (False, False), 2: (True, True), 3: (True, False), 4: (False, False)}


def test_metrics_count_trusted_repairs(spark):
    df = rows(spark, [("a", 1, 1, 0.9, None, False), ("a", 2, 2, 0.48, None, True), ("b", 1, None, 0.9, None, True)], "song string, entry int, segment int, score double, timing_repair string, timing_trusted boolean")
    got = {r.song: r for r in metrics.confidence_metrics(df, "song").collect()}
    assert got["a"].trusted_percent == 100.0 and got["a"].low_confidence_count == 0 and got["b"].trusted_entries == 0


REPORT = "song string, backend string, timing_entries int, trusted_percent double, low_confidence_count int, low_confidence_percent double, review_required_count int, review_required_percent double, ctc_missing_count int, ctc_low_score_count int, ctc_very_low_score_count int, high_risk_count int, collapse_detected boolean, error string, ordinal int"


def test_choice_of_candidate(spark):
    data = [("a", "ctc", 20, 100.0, 0, 0.0, 16, 0.0, 0, 0, 0, 0, False, None, 1), ("a", "whispercpp", 22, 90.91, 2, 0.0, 2, 0.0, 0, 0, 0, 0, False, None, 2)]
    df = rows(spark, data, REPORT).withColumn("quality", metrics.selection_quality())
    assert {r.backend: round(r.quality, 2) for r in df.collect()} == {"ctc": 68.0, "whispercpp": 79.91}
    assert metrics.choose_candidate(df).first().selected == "whispercpp"
    near = df.withColumn("quality", F.when(F.col("backend") == "ctc", 80.0).otherwise(84.0))
    assert metrics.choose_candidate(near).first().selected == "ctc"
    assert metrics.choose_candidate(df.withColumn("error", F.lit("x"))).count() == 0


def test_review_explosion(spark):
    got = spark.range(1).select(*[metrics.prefer_ctc(F.lit(c), F.lit(m), F.lit(3), F.lit(44)).alias(n) for n, c, m in (("x", False, 0), ("y", False, 1), ("z", True, 0))]).first()
    assert tuple(got) == (True, False, False)


@pytest.mark.parametrize("args,time,reason", [((40.0, 0.01, 39.75, 0.5, 39.85), 39.8, "whisperx-japanese-ctc-onset-consensus"), ((90.0, 0.1, 90.5, 0.8, 90.6), 90.55, "whisperx-japanese-ctc-over-ctc-onset-consensus"), ((61.0, 0.0, 60.5, 0.8, 61.25), 60.5, "high-confidence-whisperx-over-weak-ctc-initial"), ((61.0, 0.0, 60.5, 0.79, 61.25), None, None), ((90.0, 0.11, 90.5, 0.8, 90.6), None, None)])
def test_onset_consensus(spark, args, time, reason):
    got = spark.range(1).select(metrics.onset_consensus(*map(F.lit, args)).alias("x")).first().x
    assert got.reason == reason and (got.time is None if time is None else got.time == pytest.approx(time))


def test_zero_gap(spark):
    got = spark.range(1).select(metrics.accept_zero_gap(*map(F.lit, (0.04, 0.40, 5.0, 5.5, 0.43))).alias("a"), metrics.accept_zero_gap(*map(F.lit, (0.05, 0.40, 5.0, 5.5, 0.43))).alias("b")).first()
    assert tuple(got) == (True, False)


def test_risks_merge(spark):
    data = [("a", 1, 1, ["x", "y"], "medium", False, 0.5, {"raw": 1.0}), ("a", 1, 2, ["y", "z"], "high", True, None, {"raw": 2.0, "ctc": 3.0}), ("a", 1, 3, ["w"], "resolved", False, None, None)]
    got = metrics.dedupe_risks(rows(spark, data, "song string, entry int, ordinal int, flags array<string>, severity string, review_required boolean, delta double, cand_ts map<string,double>"), "song", "entry").first()
    assert (got.flags, got.severity, got.review_required, got.delta, got.cand_ts) == (["x", "y", "z", "w"], "high", True, 0.5, {"raw": 2.0, "ctc": 3.0})


def test_evaluation_counts_missing_entries(spark):
    schema = "doc_id string, entry int, time_cs int, lines array<string>"
    a = rows(spark, [("d", 1, 100, ["x"]), ("d", 2, 200, ["y"]), ("d", 3, 300, ["z"])], schema)
    b = rows(spark, [("d", 1, 100, ["x"]), ("d", 2, 230, ["q"])], schema)
    got = metrics.positional_eval(a, b, "doc_id").first()
    assert (got.reference_display_lines, got.generated_display_lines) == (3, 2)
    assert (got.text_mismatches, got.text_mismatch_indices, got.max_abs_delta_cs, got.within_25cs, got.within_50cs_percent, got.nonzero_time_diffs, got.entry_count_match) == (2, [2], 30, 1, 66.67, 2, False)


def test_prefix_and_duplicates(spark):
    data = [("a", 1, "abcdefghijklmnop"), ("a", 2, "abcdefghijklzzzz"), ("a", 3, "zzzz"), ("a", 4, "abcdefgh"), ("b", 1, "abcdefghijklmnop")]
    df = rows(spark, data, "song string, entry int, norm string")
    assert sorted(r.entry for r in joins.ambiguous_prefix(df).collect()) == [1, 2]
    assert sorted(r.entry for r in joins.short_duplicates(df).collect()) == [3, 4]


def test_anchors(spark):
    lines = rows(spark, [("a", i, n) for i, n in enumerate(["again", "middle", "again"], 1)], "song string, entry int, norm string")
    hints = rows(spark, [("a", 1, 3, "again"), ("a", 2, 2, "again"), ("a", 3, None, "again"), ("a", 4, None, "other"), ("a", 5, 9, "x")], "song string, hint_idx int, entry_number int, norm string")
    got = {r.hint_idx: (r.entry, r.error) for r in joins.match_anchors(lines, hints).collect()}
    assert got == {1: (3, None), 2: (None, "text mismatch"), 3: (1, None), 4: (None, "no match"), 5: (None, "out of range")}


def test_nearest_onset_has_the_strongest_in_reach(spark):
    import random

    rng = random.Random(2)
    frames = [("a", round(rng.uniform(0, 20), 3), round(rng.random(), 2)) for _ in range(300)]
    lines = [("a", i, round(rng.uniform(-1, 21), 3)) for i in range(60)]
    got = {r.entry: (r.onset_time, r.onset) for r in joins.nearest_onset(rows(spark, lines, "song string, entry int, t double"), rows(spark, frames, "song string, t double, onset double")).collect()}
    for _, i, t in lines:
        near = [(o, -ft) for _, ft, o in frames if t - 0.35 <= ft <= t + 0.35]
        want = max(near, default=None)
        assert got[i] == ((None, None) if want is None else (-want[1], want[0]))


def test_first_peak_and_sustained(spark):
    frames = rows(spark, [("a", 0.1 * i, o, r) for i, (o, r) in enumerate([(0.1, -50.0), (0.9, -50.0), (0.2, -50.0), (0.8, -10.0), (0.3, -10.0), (0.1, -10.0)])], "song string, t double, onset double, rms_db double")
    spans = rows(spark, [("a", 1, 0.0, 9.0)], "song string, entry int, start double, end double")
    assert joins.first_peak(spans, frames, 0.55).first().peak_time == pytest.approx(0.1)
    assert joins.first_peak(spans, frames, 0.55, 0.20).first().peak_time == pytest.approx(0.3)
    assert joins.sustained_onset(frames, seconds=0.15).first().onset_time == pytest.approx(0.3)


def test_fuzzy_match_is_monotone(spark):
    lines = rows(spark, [("a", 1, "hello world"), ("a", 2, "something else"), ("a", 3, "hello world")], "song string, entry int, norm string")
    segs = rows(spark, [("a", 1, "hello world"), ("a", 2, "something"), ("a", 3, " else"), ("a", 4, "hello worle")], "song string, seg_idx int, norm string")
    got = [(r.entry, r.segment, r.span) for r in joins.fuzzy_match(lines, segs).orderBy("entry").collect()]
    assert got == [(1, 1, 1), (2, 2, 2), (3, 4, 1)]


def test_repeated_tail_compares_with_the_head(spark):
    texts = ["aaaaaaaaaa"] * 6
    df = rows(spark, [("a", i, float(i), t) for i, t in enumerate(texts)] + [("b", i, float(i), t) for i, t in enumerate([*texts[:3], "short", *texts[:3]])], "song string, seg_idx int, start double, norm string")
    assert {r.song: r.repeated for r in joins.repeated_tail(df).collect()} == {"a": True, "b": False}


def test_weak_prefix_and_twins(spark):
    schema = "song string, entry int, timestamp double, duration double, ctc_score double, first_score double, token_end double, peaks array<struct<time: double, score: double>>, window_realigned boolean"

    def song(name, tail, score):
        return [(name, 1, 48.0, 90.0, 0.5, 0.9, tail, None, False), (name, 2, 52.0, 90.0, 0.3, 0.05, 54.0, [(50.0, score), (51.0, 0.03)], False)]

    got = {(r.song, r.entry): r.time for r in folds.weak_prefix_recovery(rows(spark, song("a", 49.0, 0.05) + song("b", 49.0, 0.049) + song("c", 49.99, 0.5), schema)).collect()}
    assert (got["a", 2], got["b", 2], got["c", 2]) == (50.0, 52.0, 52.0)


def test_fold_reads_the_revised_neighbour(spark):
    df = rows(spark, [("a", 1, 10.0, 10.0), ("a", 2, 20.0, 24.0), ("a", 3, 25.0, 23.0)], "song string, entry int, t double, p double")
    got = {r.entry: r.accepted for r in folds.bounded_accept(df, F.col("p"), 0.5).collect()}
    assert got == {1: 10.0, 2: 24.0, 3: 25.0}


@pytest.mark.parametrize("block", [None, 1, 3, 50])
def test_bounded_accept_as_a_fold(spark, block):
    """Random songs with missing proposals and gaps in their numbers; blocks of any size end in the state that the next one enters with."""
    rng = random.Random(11)
    data = []
    for s in range(40):
        t, e = 0.0, 0
        for _ in range(rng.randint(1, 60)):
            t, e = t + rng.choice([0.2, 1.0, 3.0]), e + rng.choice([1, 1, 1, 4])
            data.append((f"s{s}", e, t, rng.choice([None, float("nan"), *[t + rng.uniform(-3, 3) for _ in range(6)]])))
    want, last = {}, {}
    for k, (s, e, t, p) in enumerate(data):
        after = data[k + 1][2] if k + 1 < len(data) and data[k + 1][0] == s else float("inf")
        fits = p is not None and last.get(s, float("-inf")) + 0.5 < p < after - 0.5
        last[s] = want[s, e] = p if fits else t
    df = rows(spark, data, "song string, entry int, t double, p double").repartition(3)
    out = folds.bounded_accept(df, F.col("p"), 0.5, block=block)
    assert out.columns == ["song", "entry", "t", "p", "accepted"]
    assert {(r.song, r.entry): r.accepted for r in out.collect()} == want


def test_one_very_long_song_in_many_tasks(spark):
    """A million lines of one song, whose every decision hangs on the one before."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("a").alias("song"), F.col("id").cast("int").alias("entry"), (F.col("id") * 1.0).alias("t"), (F.col("id") * 1.0 + F.when(F.xxhash64("id") % 3 == 0, 0.45).otherwise(-0.45)).alias("p"))
    out = folds.bounded_accept(df, F.col("p"), 0.3, block=10_000)
    got = out.agg(F.sum("accepted"), F.count_if(F.col("accepted") == F.col("p"))).first()
    draws = [r.x for r in df.select((F.col("p") > F.col("t")).alias("x"), "entry").orderBy("entry").collect()]
    last, total, took = float("-inf"), 0.0, 0
    for k, up in enumerate(draws):
        p = k + (0.45 if up else -0.45)
        fits = last + 0.3 < p < (k + 1 - 0.3 if k + 1 < n else float("inf"))
        last = p if fits else float(k)
        total, took = total + last, took + fits
    assert got[1] == took and got[0] == pytest.approx(total)


def test_fusion(spark):
    schema = "song string, entry int, wx double, wx_score double, ctc double, ctc_score double, raw double, raw_score double, duration double, prefix boolean, crossline boolean, clear boolean, shared_low_segment boolean"
    df = rows(spark, [("a", 1, 20.0, 0.55, 22.5, 0.1, 22.3, 0.76, 60.0, False, False, False, False), ("b", 1, 20.0, 0.95, 20.9, 0.9, None, None, 60.0, False, False, False, False)], schema)
    got = {r.song: (r.time, r.reason) for r in folds.fuse(df).collect()}
    assert got == {"a": (22.5, "ctc-raw-consensus-over-whisperx"), "b": (20.0, None)}


LINE = "song string, entry int, timestamp double, duration double, score double, norm_len int, manual boolean, raw double, raw_score double, forced double, risk_review boolean, window_realigned boolean, ctc_score double, spans array<struct<start: double, end: double, score: double>>, peaks array<struct<time: double, score: double>>, repeats int, ambiguous boolean, duplicate boolean, asr_only_trust boolean, mora_known boolean"


def line(entry, t, score=0.5, n=8, manual=False, raw=None, raw_score=None, forced=None, spans=None, peaks=None, repeats=0, ctc=0.5, realigned=False, ambiguous=False, risk=False):
    return ("a", entry, t, 300.0, score, n, manual, raw, raw_score, forced, risk, realigned, ctc, spans, peaks, repeats, ambiguous, False, False, False)


@pytest.mark.parametrize(
    "lines,want",
    [
        # a raw time within the token tail before it counts little
        ([line(1, 9.0, spans=[(9.0, 11.0, 0.9)]), line(2, 12.0, raw=11.03, raw_score=0.99)], (12.0, "selected_path")),
        # a weak first token of a window aligned anew gives way to a strong raw time, not to a repeated text's
        ([line(1, 10.0), line(2, 20.0, raw=20.5, raw_score=0.8, realigned=True, spans=[(20.0, 20.1, 0.12), (20.2, 20.4, 0.5)])], (20.5, "raw_asr")),
        ([line(1, 10.0), line(2, 20.0, raw=20.5, raw_score=0.8, realigned=True, ambiguous=True, spans=[(20.0, 20.1, 0.12), (20.2, 20.4, 0.5)])], (20.0, "selected_path")),
        # a detached first token
        ([line(1, 30.0), line(2, 40.0, raw=40.5, raw_score=0.9, spans=[(40.0, 40.1, 0.5), (40.45, 41.0, 0.9)])], (40.5, "raw_asr")),
        ([line(1, 30.0), line(2, 40.0, spans=[(40.0, 40.1, 0.019), (40.5, 41.0, 0.9)])], (40.5, "ctc_detached_initial_token_recovery")),
        ([line(1, 30.0), line(2, 40.0, spans=[(40.0, 40.1, 0.02), (40.5, 41.0, 0.9)])], (40.0, "selected_path")),
        # a repeated first word begins earlier, but not in the tail before it
        ([line(1, 50.0), line(2, 65.0, ctc=0.18, spans=[(65.0, 65.2, 0.05), (65.2, 65.3, 0.4)], peaks=[(62.0, 0.02), (63.0, 0.03)], repeats=2)], (62.0, "ctc_repeated_leading_term_onset")),
        ([line(1, 50.0, spans=[(50.0, 62.0, 0.9)]), line(2, 65.0, ctc=0.18, spans=[(65.0, 65.2, 0.05), (65.2, 65.3, 0.4)], peaks=[(62.03, 0.02)], repeats=2)], (65.0, "selected_path")),
        ([line(1, 10.0), line(2, 16.0, manual=True, ctc=0.01, peaks=[(15.9, 0.9)])], (16.0, "manual_anchor")),
    ],
)
def test_line_scoring(spark, lines, want):
    got = scoring.score_lines(rows(spark, lines, LINE)).filter("entry = 2").first()
    assert (got.time, got.chosen) == want


@pytest.mark.parametrize(
    "kwargs,review,resolution",
    [
        # a rescue that isn't adopted (out of bounds) does not clear a review
        ({"raw": 25.0, "raw_score": 0.95, "spans": [(20.0, 20.1, 0.5), (20.5, 21.0, 0.9)], "risk": True}, True, None),
        ({"raw": 20.5, "raw_score": 0.95, "spans": [(20.0, 20.1, 0.5), (20.5, 21.0, 0.9)], "risk": True}, False, "high-confidence-raw-resolves-detached-ctc-initial-token"),
        # nor does the second token's time
        ({"spans": [(20.0, 20.1, 0.01), (20.5, 21.0, 0.9)], "risk": True}, True, None),
        ({"spans": [(20.0, 20.1, 0.5), (20.2, 21.0, 0.9)], "risk": True, "realigned": True}, False, "local-vocal-ctc-confirms-first-token"),
        # a lone weak path is no defect by itself
        ({"ctc": 0.02, "score": 0.1}, False, None),
        ({"ctc": 0.03, "score": 0.1}, True, None),
        # a score of 0 counts as missing, that is as 1
        ({"ctc": 0.0, "score": 0.1}, True, None),
    ],
)
def test_reviews(spark, kwargs, review, resolution):
    got = scoring.score_lines(rows(spark, [line(1, 10.0), line(2, 20.0, **kwargs), line(3, 24.0)], LINE)).filter("entry = 2").first()
    assert (got.review, got.resolution) == (review, resolution)


def test_long_disagreement_is_reviewed_and_split(spark):
    df = rows(spark, [line(1, 10.0), line(2, 20.0, n=20, forced=17.5)], LINE).withColumn("text", F.lit("abcdefghi")).withColumn("timing_trusted", F.lit(True))
    got = scoring.score_lines(df).filter("entry = 2").first()
    assert got.review and "long_line_disagreement" in got.penalties and got.split == "abcd"
    assert not got.trusted and "timing_trust_removed_for_review" in got.flags and got.severity == "high"


def test_cases_apply_their_own_gates(spark):
    schema = "name string, text_mismatches long, within_25cs_percent double, backend string, review_entries array<int>, require_text_mismatches long, require_within_25cs double, require_backend string, require_review_entries array<int>"
    df = rows(spark, [("a", 0, 100.0, "ctc", [2, 1], 0, 100.0, "ctc", [1, 2]), ("b", 1, 99.0, "ctc", [], 0, 100.0, "hybrid", [1]), ("c", 5, None, None, None, None, None, None, None)], schema)
    got = {r.name: (r.passed, r.failures) for r in metrics.evaluate_cases(df).collect()}
    assert got == {"a": (True, []), "b": (False, ["text_mismatches", "within_25cs", "backend", "review_entries"]), "c": (True, [])}
