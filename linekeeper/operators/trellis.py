"""Forced alignment of lines within windows, from a table of frames and token probabilities.

A window's frames and the tokens of its lines make a trellis: a path goes through the tokens
in order, each for a frame or more, with blanks between as it likes (between equal tokens it
must).  The best path is found for all states of a frame at a time.  Windows are short, so
they are the groups; frames reach them by song and number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linekeeper.operators.forced import apply_windows, hybrid_windows
from linekeeper.sources.shared import stored

# Seconds before a line's first token in which its other places are looked for, and how many are kept.
LOOK_BACK, PLACES = 2.5, 8


def best_path(logp: np.ndarray, tokens: np.ndarray, blank: int = 0, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray | None:
    """(begin, end) in frames of each token on the best path, ends exclusive; None if there is no path.

    logp: frames x vocabulary.  ``first``, ``last``: a token's frames lie in this range (its
    band), where given.  Of equal paths that counts which comes to its states latest.
    """
    frames, n = len(logp), len(tokens)
    if not n or not frames:
        return None
    labels = np.full(2 * n + 1, blank, np.int64)
    labels[1::2] = tokens
    # a token may follow a token without a blank if it is another one
    jumps = np.zeros(2 * n + 1, bool)
    jumps[3::2] = labels[3::2] != labels[1:-2:2]
    low, high = np.zeros(2 * n + 1, np.int64), np.full(2 * n + 1, frames - 1, np.int64)
    if first is not None:
        low[1::2] = first
    if last is not None:
        high[1::2] = last
    score = np.full(2 * n + 1, -np.inf)
    came = np.zeros((frames, 2 * n + 1), np.int8)
    for t in range(frames):
        if t:
            # from two states before, from the one before, staying: the first of equals, which comes to its state latest
            ways = np.full((3, 2 * n + 1), -np.inf)
            ways[0, 2:] = np.where(jumps[2:], score[:-2], -np.inf)
            ways[1, 1:], ways[2] = score[:-1], score
            came[t] = 2 - ways.argmax(axis=0)
            score = ways.max(axis=0)
        else:
            score[:2] = 0.0
        score = np.where((t >= low) & (t <= high), score + logp[t, labels], -np.inf)
    state = 2 * n if score[2 * n] > score[2 * n - 1] else 2 * n - 1
    if score[state] == -np.inf:
        return None
    spans = np.zeros((n, 2), np.int64)
    for t in range(frames - 1, -1, -1):
        if state & 1:
            spans[state >> 1, 0] = t
            spans[state >> 1, 1] = max(spans[state >> 1, 1], t + 1)
        state -= int(came[t, state])
    return spans


def _places(probability: np.ndarray, begin: int, end: int) -> list[int]:
    """Frames of the highest local maxima in a range, the later first on ties; beyond its ends counts as less than any."""
    part = probability[begin:end]
    if not len(part):
        return []
    edges = np.concatenate([[-1.0], part, [-1.0]])
    top = np.flatnonzero((part >= edges[:-2]) & (part >= edges[2:]))
    return [begin + int(k) for k in sorted(top, key=lambda k: (-part[k], -k))[:PLACES]]


SPAN = "array<struct<start: double, end: double, score: double>>"
PEAK = "array<struct<time: double, score: double>>"


def align_windows(windows: DataFrame, lines: DataFrame, emissions: DataFrame, seconds: float, blank: int = 0, reach: float | None = None) -> DataFrame:
    """(song, run, entry, start, end, ctc_score, token_spans, peaks) of the lines of windows.

    windows: song, run, first_entry, last_entry, start, end (seconds); lines: song, entry,
    tokens (array of int), and timestamp where ``reach`` is given: tokens then lie within so
    many seconds of their line's time.  emissions: song, frame, logp (array over the
    vocabulary); a frame begins at its number times ``seconds``.  A line's score is the mean
    of its tokens', a token's the mean probability of its frames.  Lines without tokens have
    no time; where a window has no path (too few frames, missing ones, a band that excludes
    it) none of its lines has.
    """
    keys = ["song", "run"]
    entries = windows.select(*keys, F.explode(F.sequence("first_entry", "last_entry")).alias("entry"))
    at = F.col("timestamp").cast("double") if reach is not None else F.lit(None).cast("double")
    told = entries.join(lines.select("song", "entry", "tokens", at.alias("at")), ["song", "entry"])
    told = told.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("entry", "tokens", "at"))).alias("lines"))
    begin, end = F.ceil(F.col("start") / seconds - 1e-9), F.ceil(F.col("end") / seconds - 1e-9) - 1
    wanted = windows.filter(end >= begin).select(*keys, begin.cast("long").alias("begin"), end.cast("long").alias("final")).select(*keys, "begin", "final", F.explode(F.sequence("begin", "final")).alias("frame"))
    frames = wanted.join(emissions.select("song", F.col("frame").cast("long").alias("frame"), "logp"), ["song", "frame"])
    frames = frames.select(*[F.col(c).alias(c) for c in frames.columns])  # both sides stem from the windows
    kind = windows.schema["song"].dataType.simpleString()
    run_kind = windows.schema["run"].dataType.simpleString()

    def one(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = ["song", "run", "entry", "start", "end", "ctc_score", "token_spans", "peaks"]
        if not len(asked):
            return pd.DataFrame(columns=names)
        rows = asked["lines"].iloc[0]
        tokens = [np.asarray([] if r["tokens"] is None else r["tokens"], np.int64) for r in rows]
        flat = np.concatenate([*tokens, np.zeros(0, np.int64)])
        spans = None
        if len(held):
            held = held.sort_values("frame")
            begin = int(held["begin"].iloc[0])
            if len(held) == int(held["final"].iloc[0]) - begin + 1:  # no frame is missing
                logp = np.stack(held["logp"].to_list()).astype(np.float64)
                first = last = None
                if reach is not None:
                    middle = np.concatenate([np.full(len(x), np.nan if r["at"] is None else r["at"] / seconds - begin) for x, r in zip(tokens, rows, strict=True)] or [np.zeros(0)])
                    first = np.where(np.isnan(middle), 0, np.ceil(middle - reach / seconds))
                    last = np.where(np.isnan(middle), len(logp), np.floor(middle + reach / seconds))
                spans = best_path(logp, flat, blank, first, last)
        out, at, ended = [], 0, 0
        for r, own in zip(rows, tokens, strict=True):
            if spans is None or not len(own):
                out.append((*key, r["entry"], None, None, None, None, None))
                continue
            mine = spans[at : at + len(own)]
            at += len(own)
            time = lambda f: float((begin + f) * seconds)  # noqa: B023, E731
            sure = [float(np.exp(logp[a:b, c]).mean()) for (a, b), c in zip(mine.tolist(), own.tolist(), strict=True)]
            held_at = np.exp(logp[:, own[0]])
            a = int(mine[0, 0])
            places = _places(held_at, max(0, a - round(LOOK_BACK / seconds)), max(ended + 1, a))
            ended = int(mine[-1, 1])
            out.append((
                *key, r["entry"], time(a), time(ended), float(np.mean(sure)),
                [{"start": time(x), "end": time(y), "score": s} for (x, y), s in zip(mine.tolist(), sure, strict=True)], [{"time": time(f), "score": float(held_at[f])} for f in places],
            ))
        return pd.DataFrame(out, columns=names)

    schema = f"song {kind}, run {run_kind}, entry int, start double, end double, ctc_score double, token_spans {SPAN}, peaks {PEAK}"
    return told.groupBy(*keys).cogroup(frames.groupBy(*keys)).applyInPandas(one, schema)


def realign(lines: DataFrame, emissions: DataFrame, seconds: float, blank: int = 0, rounds: int = 3, moved: float = 0.005) -> DataFrame:
    """``lines`` after their windows were aligned anew until nothing moves, ``rounds`` times at most; adds rounds_done.

    lines: song, entry, timestamp, duration, ctc, wx, first_score, ctc_score, tokens,
    token_spans, peaks.  Each round proposes windows where the two paths disagree, aligns
    them, takes the results over and judges the new times; only songs in which a line has
    moved by more than ``moved`` seconds go into the next round.  Every round is stored.
    """
    open_, done, kept = lines.withColumn("rounds_done", F.lit(0)), None, [*lines.columns, "rounds_done"]
    for number in range(1, rounds + 1):
        windows = stored(hybrid_windows(open_), "windows")
        if windows.isEmpty():
            break
        results = align_windows(windows, open_, emissions, seconds, blank)
        out = apply_windows(open_.withColumn("was", F.col("timestamp")), windows, results)
        # what a window has found is the token-level path from now on
        first = F.coalesce(F.try_element_at("token_spans", F.lit(1))["score"], F.col("first_score"))
        out = out.withColumns({"ctc": F.when(F.col("realigned"), F.col("timestamp")).otherwise(F.col("ctc")), "first_score": F.when(F.col("realigned"), first).otherwise(F.col("first_score"))})
        out = stored(out.withColumn("rounds_done", F.when(F.col("realigned"), F.lit(number)).otherwise(F.col("rounds_done"))), "realigned")
        again = out.filter(F.col("realigned") & (F.abs(F.col("timestamp") - F.col("was")) > moved)).select("song").distinct()
        settled = out.join(again, "song", "left_anti").select(*kept)
        done = settled if done is None else done.unionByName(settled)
        open_ = out.join(again, "song", "left_semi").select(*kept)
    return open_ if done is None else done.unionByName(open_.select(*kept))


def letters(text: Column, vocabulary: str) -> Column:
    """Token ids of a text's letters: places in ``vocabulary``, from 1 on; letters that it lacks are left out."""
    each = F.filter(F.split(text, ""), lambda c: (c != "") & (F.instr(F.lit(vocabulary), c) > 0))
    return F.transform(each, lambda c: F.instr(F.lit(vocabulary), c))
