"""Forced alignment in windows against all paths, and rounds of it against a plain loop."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from linekeeper.operators import forced, trellis

LINES = "song string, entry int, tokens array<int>, timestamp double"


def collapsed(path, blank=0):
    """(token, begin, end) of a path's runs; equal tokens in a row are one."""
    out, t = [], 0
    for token, run in itertools.groupby(path):
        n = len(list(run))
        if token != blank:
            out.append((token, t, t + n))
        t += n
    return out


def every_path(logp, tokens, low=None, high=None):
    """(best score, spans) over all labelings of the frames."""
    best = (-np.inf, None)
    for path in itertools.product(range(logp.shape[1]), repeat=len(logp)):
        spans = collapsed(path)
        if [s[0] for s in spans] == list(tokens) and (low is None or all(a >= x and b - 1 <= y for (_, a, b), x, y in zip(spans, low, high, strict=True))):
            score = sum(logp[t, c] for t, c in enumerate(path))
            if score > best[0]:
                best = (score, [list(s[1:]) for s in spans])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_best_path_of_all(seed):
    rng = np.random.default_rng(seed)
    logp = np.log(rng.dirichlet(np.ones(3), size=int(rng.integers(1, 8))))
    tokens = rng.integers(1, 3, int(rng.integers(1, 5)))
    got = trellis.best_path(logp, tokens)
    score, want = every_path(logp, tokens)
    assert (got is None) == (want is None) and (got is None or got.tolist() == want)
    low = np.maximum(0, np.arange(len(tokens)) * 2 - 2)
    high = low + 3
    got, (_, want) = trellis.best_path(logp, tokens, first=low, last=high), every_path(logp, tokens, low, high)
    assert (got is None) == (want is None) and (got is None or got.tolist() == want)


def test_equal_tokens_need_a_blank_and_frames():
    sure = np.log(np.array([[0.1, 0.9], [0.2, 0.8], [0.1, 0.9]]))
    assert trellis.best_path(sure, np.array([1, 1])).tolist() == [[0, 1], [2, 3]]
    assert trellis.best_path(sure[:2], np.array([1, 1])) is None
    assert trellis.best_path(sure, np.array([], np.int64)) is None and trellis.best_path(sure[:0], np.array([1])) is None


def test_of_equal_paths_the_latest():
    """A frame in which all tokens are as likely: a token that rings through it, one that begins after it, and one that follows another without a blank."""
    at = lambda *frames: np.log(np.array([[0.9, 0.05, 0.05], [0.05, 0.9, 0.05], [0.05, 0.05, 0.9], [1 / 3] * 3])[list(frames)])
    assert trellis.best_path(at(1, 3, 0), np.array([1])).tolist() == [[0, 2]]
    assert trellis.best_path(at(0, 3, 1), np.array([1])).tolist() == [[2, 3]]
    assert trellis.best_path(at(1, 3, 2), np.array([1, 2])).tolist() == [[0, 2], [2, 3]]


def sounds(spark, songs, frames, places, seed=0):
    """Emissions in which each (song, frame) of ``places`` has its token loud, all others the blank."""
    rng = np.random.default_rng(seed)
    rows = []
    for s in songs:
        for f in range(frames):
            p = np.full(4, 0.02) + rng.uniform(0, 0.01, 4)
            p[places.get((s, f), 0)] = 0.9
            rows.append((s, f, [float(x) for x in np.log(p / p.sum())]))
    return spark.createDataFrame(rows, "song string, frame int, logp array<double>").repartition(4)


def test_windows(spark):
    places = {("a", 10): 1, ("a", 11): 1, ("a", 14): 2, ("a", 30): 3, ("b", 5): 1, ("a", 3): 1}
    emissions = sounds(spark, "ab", 60, places)
    lines = spark.createDataFrame([("a", 1, [1, 2], 0.2), ("a", 2, [3], 0.6), ("a", 3, [], 0.9), ("b", 1, [1], 0.1), ("b", 2, None, 0.2), ("c", 1, [1], 0.0)], LINES)
    windows = spark.createDataFrame([("a", 1, 1, 3, 0.1, 1.0), ("b", 1, 1, 2, 0.0, 0.2), ("c", 1, 1, 1, 0.0, 0.2), ("b", 2, 1, 1, 1.1, 9.0)], "song string, run int, first_entry int, last_entry int, start double, end double")
    got = {(r.song, r.run, r.entry): r for r in trellis.align_windows(windows, lines, emissions, 0.02).collect()}
    one, two = got["a", 1, 1], got["a", 1, 2]
    assert (one.start, round(one.end, 6), [round(s.start, 6) for s in one.token_spans]) == (pytest.approx(0.2), 0.3, [0.2, 0.28]) and one.ctc_score > 0.8
    assert (two.start, round(two.end, 6)) == (pytest.approx(0.6), 0.62)
    assert [round(p.time, 6) for p in one.peaks][:1] != [] and all(p.time < 0.6 for p in one.peaks)
    assert got["a", 1, 3].start is None and got["b", 1, 2].start is None and got["b", 1, 1].start == pytest.approx(0.1)
    assert got["c", 1, 1].start is None  # a song without frames
    assert got["b", 2, 1].start is None  # frames are missing at the window's end
    assert len(got) == 7
    # a band around the line's time: the token at frame 3 is out of the other's reach
    banded = {r.entry: r for r in trellis.align_windows(windows.filter("song = 'a'").withColumn("start", F.lit(0.0)), lines, emissions, 0.02, reach=0.08).collect()}
    assert banded[1].start == pytest.approx(0.2) and banded[2].start == pytest.approx(0.6)
    far = lines.withColumn("timestamp", F.lit(5.0))
    assert {r.start for r in trellis.align_windows(windows.filter("song = 'a'"), far, emissions, 0.02, reach=0.1).collect()} == {None}


def test_letters(spark):
    row = spark.createDataFrame([("ab-éc",)], "t string").select(trellis.letters(F.col("t"), "abc").alias("x")).first()
    assert row.x == [1, 2, 3]


def test_realignment_until_nothing_moves(spark):
    """Song a has a line a second off, whose window finds it; song b agrees and is never touched; song c can't be aligned."""
    places = {("a", 50): 1, ("a", 100): 2, ("a", 200): 3, ("b", 50): 1, ("b", 100): 2, ("b", 200): 3}
    emissions = sounds(spark, "ab", 300, places)
    schema = "song string, entry int, timestamp double, duration double, ctc double, wx double, first_score double, ctc_score double, tokens array<int>, token_spans array<struct<start: double, end: double, score: double>>, peaks array<struct<time: double, score: double>>"
    made = lambda s, off: [(s, k + 1, t + (off if k == 1 else 0.0), 6.0, t + (off if k == 1 else 0.0), t, 0.9, 0.5, [k + 1], [(t, t + 0.02, 0.9)], []) for k, t in enumerate((1.0, 2.0, 4.0))]
    lines = spark.createDataFrame(made("a", 1.2) + made("b", 0.0) + made("c", 1.2), schema)
    out = trellis.realign(lines, emissions, 0.02)
    got = {(r.song, r.entry): (round(r.timestamp, 3), r.rounds_done) for r in out.collect()}
    assert got == {("a", 1): (1.0, 0), ("a", 2): (2.0, 1), ("a", 3): (4.0, 0), ("b", 1): (1.0, 0), ("b", 2): (2.0, 0), ("b", 3): (4.0, 0), ("c", 1): (1.0, 0), ("c", 2): (3.2, 0), ("c", 3): (4.0, 0)}
    assert out.columns == [*lines.columns, "rounds_done"]
    assert forced.hybrid_windows(out.filter("song = 'a'")).count() == 0
    assert trellis.realign(lines.filter("song = 'b'"), emissions, 0.02).count() == 3
