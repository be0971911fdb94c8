"""Joins of the alignment domain: nearest and first onsets, prefixes, short duplicates, anchors, fuzzy matches.

Range joins carry an equality (song and a time bucket), so that Spark hashes them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.functions import blocks
from linekeeper.functions.text import segment_score
from linekeeper.operators.folds import fold_pairs


def nearest_onset(lines: DataFrame, frames: DataFrame, reach: float = 0.35) -> DataFrame:
    """Adds onset_time and onset (strength) of the strongest frame within ``reach`` of each line's ``t``, the first on ties; nulls without one.

    lines: song, entry, t; frames: song, t, onset.
    """
    near = frames.select("song", F.col("t").alias("ft"), "onset", F.explode(F.array(*[F.floor(F.col("t") / (2 * reach) + s).cast("long") for s in (-0.5, 0.5)])).alias("b"))
    keyed = lines.withColumn("b", F.floor(F.col("t") / (2 * reach)).cast("long"))
    # a frame is in the bucket of its line or a neighbour: half a bucket to either side covers the reach
    found = keyed.join(near, ["song", "b"]).filter(F.col("ft").between(F.col("t") - reach, F.col("t") + reach))
    best = found.groupBy("song", "entry").agg(F.max_by(F.struct("ft", "onset"), F.struct("onset", -F.col("ft"))).alias("o"))
    return lines.join(best, ["song", "entry"], "left").select(*lines.columns, F.col("o.ft").alias("onset_time"), F.col("o.onset").alias("onset"))


def peaks(frames: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Frames that are local maxima of ``threshold`` or more; beyond the ends counts as zero."""
    order = Window.partitionBy("song").orderBy("t")
    left, right = F.lag("onset", 1, 0.0).over(order), F.lead("onset", 1, 0.0).over(order)
    return frames.withColumn("__l", left).withColumn("__r", right).filter((F.col("onset") >= threshold) & (F.col("onset") >= F.col("__l")) & (F.col("onset") >= F.col("__r"))).drop("__l", "__r")


def plateaus(frames: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(song, t, onset, times): peaks with the times of the frames from there on that are as high (within 1e-6) without a break."""
    order = Window.partitionBy("song").orderBy("t")
    rows = frames.withColumns({"__l": F.lag("onset", 1, 0.0).over(order), "__r": F.lead("onset", 1, 0.0).over(order)})
    level = F.coalesce(F.abs(F.col("onset") - F.lag("onset").over(order)) > 1e-6, F.lit(True))
    rows = rows.withColumn("run", F.sum(level.cast("int")).over(order)).filter(F.col("onset") >= threshold)
    rest = Window.partitionBy("song", "run").orderBy("t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("times", F.collect_list("t").over(rest))
    return rows.filter((F.col("onset") >= F.col("__l")) & (F.col("onset") >= F.col("__r"))).select("song", "t", "onset", "times")


def first_peak(spans: DataFrame, frames: DataFrame, threshold: float = 0.55, lead_in: float = 0.0, middle: bool = False) -> DataFrame:
    """Adds peak_time: the first peak in [start + lead_in, end] of each row (song, entry, start, end); ``middle``: of a plateau the middle of its part up to ``end``.

    Spans and peaks are put in one order by time and each span looks ahead to the next peak: no pairs are formed.
    """
    none = F.lit(None)
    top = plateaus(frames, threshold) if middle else peaks(frames, threshold).select("song", "t", F.array("t").alias("times"))
    marks = top.select("song", F.col("t").alias("__at"), F.lit(1).alias("__kind"), none.cast("int").alias("entry"), none.cast("double").alias("__end"), F.col("times").alias("__times"))
    asks = spans.select("song", (F.col("start") + lead_in).alias("__at"), F.lit(0).alias("__kind"), F.col("entry").cast("int").alias("entry"), F.when(F.col("end") > F.col("start"), F.col("end")).alias("__end"), none.cast("array<double>").alias("__times"))
    ahead = Window.partitionBy("song").orderBy("__at", "__kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = asks.unionByName(marks).withColumn("__next", F.first("__times", ignorenulls=True).over(ahead)).filter("__kind = 0")
    held = F.filter("__next", lambda x: x <= F.col("__end"))
    # the first time is the peak's own
    found = both.filter(F.col("__next")[0] <= F.col("__end")).select("song", "entry", ((held[0] + F.element_at(held, -1)) / 2 if middle else held[0]).alias("peak_time"))
    return spans.join(found, ["song", "entry"], "left")


def sustained_onset(frames: DataFrame, threshold: float = 0.70, floor: float = -18.0, seconds: float = 3.0) -> DataFrame:
    """(song, onset_time): the first strong frame whose next ``seconds`` have a median level of ``floor`` or more.

    Frames meet strong ones by song and time bucket, as long as the reach: a frame is in the bucket of a strong one or the next.
    """
    bucket = F.floor(F.col("t") / seconds).cast("long")
    strong = frames.filter(F.col("onset") >= threshold).select("song", F.col("t").alias("at"), bucket.alias("b"))
    near = frames.select("song", "t", "rms_db", F.explode(F.array(bucket, bucket - 1)).alias("b"))
    after = strong.join(near, ["song", "b"]).filter(F.col("t").between(F.col("at"), F.col("at") + seconds))
    held = after.groupBy("song", "at").agg(F.median("rms_db").alias("level")).filter(F.col("level") >= floor)
    return held.groupBy("song").agg(F.min("at").alias("onset_time"))


def ambiguous_prefix(lines: DataFrame, text: str = "norm") -> DataFrame:
    """(song, entry) of lines that share a long prefix with another: min(12, max(8, half the shorter)) characters, both 12 long.

    At least 8 are shared, so equal first 8 characters are the join's key.
    """
    long = lines.filter(F.length(text) >= 12).select("song", "entry", F.col(text).alias("x"), F.left(text, F.lit(8)).alias("head"))
    other = long.select("song", "head", F.col("entry").alias("other"), F.col("x").alias("y"))
    need = F.least(F.lit(12), F.greatest(F.lit(8), F.floor(F.least(F.length("x"), F.length("y")) / 2).cast("int")))
    pairs = long.join(other, ["song", "head"]).filter((F.col("entry") != F.col("other")))
    return pairs.filter(F.left("x", need) == F.left("y", need)).select("song", "entry").distinct()


def short_duplicates(lines: DataFrame, text: str = "norm", window: int = 8) -> DataFrame:
    """(song, entry) of lines of 4 to 12 characters that a longer line within ``window`` entries holds."""
    short = lines.filter(F.length(text).between(4, 12)).select("song", "entry", F.col(text).alias("x"), F.explode(F.sequence(F.col("entry") - window, F.col("entry") + window)).alias("other"))
    other = lines.select("song", F.col("entry").alias("other"), F.col(text).alias("y"))
    return short.join(other, ["song", "other"]).filter((F.length("y") > F.length("x")) & F.contains("y", "x")).select("song", "entry").distinct()


def outside_regions(lines: DataFrame, regions: DataFrame, slack: float = 0.05) -> DataFrame:
    """Lines at a time ``t`` outside all regions (song, start, end) of a song that has some.

    In one order by time a line sees the latest end of the regions that have begun: no pairs are formed.
    """
    none = F.lit(None)
    starts = regions.select("song", (F.col("start") - slack).alias("__at"), F.lit(0).alias("__kind"), (F.col("end") + slack).alias("__end"), none.cast("struct<%s>" % ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in lines.schema)).alias("__line"))
    asks = lines.select("song", F.col("t").alias("__at"), F.lit(1).alias("__kind"), none.cast("double").alias("__end"), F.struct(*lines.columns).alias("__line"))
    begun = Window.partitionBy("song").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = F.max(F.col("__kind") == 0).over(Window.partitionBy("song"))
    both = asks.unionByName(starts).withColumns({"__last": F.max("__end").over(begun), "__some": some})
    return both.filter((F.col("__kind") == 1) & F.col("__some") & (F.col("__last").isNull() | (F.col("__last") < F.col("__at")))).select("__line.*")


def match_anchors(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """(song, hint_idx, entry, error): the entry that each anchor names, by number or else by text.

    entries: song, entry, norm; anchors: song, hint_idx, entry_number, norm.  By text it is
    the first unused equal line after the last match, else the first unused one.
    """

    def one(key: tuple, lines: pd.DataFrame, hints: pd.DataFrame) -> pd.DataFrame:
        lines = lines.sort_values("entry")
        text, by_text = dict(zip(lines["entry"], lines["norm"], strict=True)), {}
        for e, n in zip(lines["entry"], lines["norm"], strict=True):
            by_text.setdefault(n, []).append(e)
        used, last, out = set(), 0, []
        for h in hints.sort_values("hint_idx").itertuples():
            entry, error = None, None
            if h.entry_number == h.entry_number and h.entry_number is not None:
                entry = int(h.entry_number)
                error = "out of range" if entry not in text else "duplicate" if entry in used else "text mismatch" if text[entry] != h.hint else None
            else:
                free = [e for e in by_text.get(h.hint, []) if e not in used]
                entry = next((e for e in free if e > last), free[0] if free else None)
                error = "no match" if entry is None else None
            if error is None:
                used.add(entry)
                last = entry
            out.append((key[0], h.hint_idx, None if error else entry, error))
        return pd.DataFrame(out, columns=["song", "hint_idx", "entry", "error"])

    kind = entries.schema["song"].dataType.simpleString()
    anchors = anchors.select("song", "hint_idx", "entry_number", F.col("norm").alias("hint"))  # the two sides may stem from one table
    return entries.groupBy("song").cogroup(anchors.groupBy("song")).applyInPandas(one, f"song {kind}, hint_idx int, entry int, error string")


class _Song:
    """Where the matching of a song's lines with its segments stands."""

    __slots__ = ("key", "entries", "lines", "numbers", "texts", "at", "line", "best")

    def __init__(self, key) -> None:
        self.key, self.entries, self.lines, self.numbers, self.texts = key, [], [], [], []
        self.at, self.line, self.best = 0, 0, (0.0, -1, 0)


def _side_by_side(songs: list[_Song], ahead: int, spans: int, accept: float, stop: float) -> list[tuple]:
    """(song, entry, segment, span, score) of the songs' lines: the next line of every song at a time, so that many pairs of texts are compared together."""
    out = []
    while songs := [s for s in songs if s.line < len(s.lines)]:
        # the next segment first, which most often is the one; where few songs are left, more of them at a time
        first, reach = 0, 1
        while first < ahead and (looking := [s for s in songs if s.best[0] < stop and s.lines[s.line] and s.at + first < len(s.texts)]):
            scores: list[dict[tuple[int, int], float]] = [{} for _ in looking]
            for k in range(1, spans + 1):
                asked = []
                for s, own in zip(looking, scores, strict=True):
                    line = s.lines[s.line]
                    for i in range(s.at + first, min(len(s.texts) - k + 1, s.at + min(ahead, first + reach))):
                        text = "".join(s.texts[i : i + k])
                        # a ratio is twice the shorter text over both at most, a score 0.96 where the line is held
                        most = max(2 * min(len(line), len(text)) / max(1, len(line) + len(text)), 0.96 if line in text else 0.72 if text in line else 0.0)
                        if most > max([s.best[0], *(own.get((i, j), 0.0) for j in range(1, k))]):
                            asked.append((own, i, line, text))
                for (own, i, _, _), score in zip(asked, blocks.scores([x[2] for x in asked], [x[3] for x in asked]).tolist(), strict=True):
                    own[i, k] = score
            for s, own in zip(looking, scores, strict=True):
                for (i, k), score in sorted(own.items()):
                    # once a score ends the search, segments further on don't count
                    if score > s.best[0] and (s.best[0] < stop or i == s.best[1]):
                        s.best = (score, i, k)
            first, reach = first + reach, 1 if len(looking) >= 64 else 4 if len(looking) >= 16 else ahead
        for s in songs:
            score, i, k = s.best
            hit = i >= 0 and score >= accept
            out.append((s.key, s.entries[s.line], s.numbers[i] if hit else None, k if hit else None, score))
            s.at, s.line, s.best = i + k if hit else s.at, s.line + 1, (0.0, -1, 0)
    return out


def fuzzy_match(lines: DataFrame, segments: DataFrame, ahead: int = 12, spans: int = 3, accept: float = 0.42, stop: float = 0.88) -> DataFrame:
    """(song, entry, segment, span, score): lines matched to segments in order, each from where the last one ended.

    lines: song, entry, norm; segments: song, seg_idx, norm.  Of up to ``ahead`` segments and
    1 to ``spans`` of them together the best is taken, the first of equals; a score of
    ``stop`` ends the search.  Null texts count as empty and match nothing.  Songs pass through
    a task in their order, many of them side by side.
    """

    def many(held: list[tuple]) -> list[tuple]:
        songs = []
        for key, left, right in held:
            own = _Song(key)
            own.entries, own.lines = [r["entry"] for r in left], [r["norm"] or "" for r in left]
            own.numbers, own.texts = [r["seg_idx"] for r in right], [r["norm"] or "" for r in right]
            songs.append(own)
        return _side_by_side(songs, ahead, spans, accept, stop)

    kind = lines.schema["song"].dataType.simpleString()
    left = lines.select("song", F.col("entry").cast("int").alias("entry"), "norm")
    right = segments.select("song", F.col("seg_idx").cast("int").alias("seg_idx"), "norm")
    return fold_pairs(left, right, many, f"song {kind}, entry int, segment int, span int, score double")


def pair_scores(lines: DataFrame, segments: DataFrame, band: int = 12) -> DataFrame:
    """segment_score of each line with the segments at most ``band`` numbers away."""
    near = lines.withColumn("seg_idx", F.explode(F.sequence(F.col("entry") - band, F.col("entry") + band)))
    both = near.join(segments.select("song", "seg_idx", F.col("norm").alias("seg_norm")), ["song", "seg_idx"])
    return both.withColumn("score", segment_score(F.col("norm"), F.col("seg_norm")))


def repeated_tail(segments: DataFrame, after: float = 0.0, least: int = 6, alike: float = 0.86) -> DataFrame:
    """(song, repeated): whether ``least`` segments in a row are like the first of their run; short ones break it."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[~(rows["start"] < after)].sort_values("seg_idx")
        texts = [x if isinstance(x, str) else "" for x in rows["norm"]]
        at, longest = 0, 0
        while at < len(texts) and longest < least:
            if len(texts[at]) < 8:
                at += 1
                continue
            # a run ends at the first text that is short or unlike its head; a few more texts are looked at each time
            run, reach = 1, max(1, least - 1)
            while True:
                near = texts[at + run : at + run + reach]
                like = [len(t) >= 8 for t in near]
                like = [x and r >= alike for x, r in zip(like, blocks.ratios([texts[at]] * len(near), near), strict=True)]
                more = like.index(False) if False in like else len(like)
                run, reach = run + more, 2 * reach
                if more < len(near) or not near or run >= least:
                    break
            longest = max(longest, run)
            at += run
        return pd.DataFrame([(key[0], longest >= least)], columns=["song", "repeated"])

    kind = segments.schema["song"].dataType.simpleString()
    return segments.groupBy("song").applyInPandas(one, f"song {kind}, repeated boolean")
