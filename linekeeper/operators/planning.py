"""Heuristic timing from text weights, voiced segments and onsets, and the windows to align anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.functions.text import text_weight
from linekeeper.operators.folds import snap_to_onsets
from linekeeper.operators.joins import nearest_onset
from linekeeper.operators.windows import interval_union


def active_bounds(songs: DataFrame, segments: DataFrame) -> DataFrame:
    """(song, start, end): where singing is, from its segments within 18 % and 82 % of the duration, or 8 % and 94 % without any."""
    ends = segments.groupBy("song").agg(F.min("start").alias("first"), F.max_by("end", "start").alias("last"))
    d = F.col("duration")
    start = F.when(F.col("first").isNull(), F.least(F.lit(12.0), d * 0.08)).otherwise(F.greatest(F.lit(0.0), F.least("first", d * 0.18)))
    joined = songs.join(ends, "song", "left").withColumn("start", start)
    end = F.when(F.col("last").isNull(), F.greatest(F.col("start") + 1.0, d * 0.94)).otherwise(F.least(d, F.greatest("last", d * 0.82)))
    return joined.withColumn("end", end).select("song", "duration", "start", "end")


def weighted_times(lines: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds t: the start plus the share of the text weight before each line (line: its sung text)."""
    order = Window.partitionBy("song").orderBy("entry")
    rows = lines.withColumn("__w", text_weight(F.col("line"))).join(bounds, "song")
    before = F.coalesce(F.sum("__w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("__w").over(Window.partitionBy("song"))
    usable = F.greatest(F.lit(1.0), F.col("end") - F.col("start"))
    return rows.withColumn("t", F.when(before == 0, F.col("start")).otherwise(F.least("end", F.col("start") + usable * before / total))).drop("__w")


def guided_times(lines: DataFrame, bounds: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds t and guided: from the starts of segments where their number suits the lines, else by weights.

    With as many segments as lines or more, evenly spaced starts (half to even); with fewer,
    the nearest start within 2 s of the weighted time.
    """
    rough = weighted_times(lines, bounds)
    counts = lines.groupBy("song").agg(F.count(F.lit(1)).alias("n")).join(segments.groupBy("song").agg(F.array_sort(F.collect_list("start")).alias("starts")), "song", "left")
    rows = rough.join(counts, "song").withColumn("s", F.coalesce(F.size("starts"), F.lit(0)))
    suits = (F.col("s") >= F.greatest(F.lit(3), F.floor(F.col("n") / 3).cast("int"))) & (F.col("s") <= F.greatest(F.lit(4), F.col("n").cast("int") * 2))
    place = F.row_number().over(Window.partitionBy("song").orderBy("entry")) - 1
    rows = rows.withColumn("i", F.bround(place * (F.col("s") - 1) / F.greatest(F.lit(1), F.col("n") - 1), 0).cast("int"))
    near = F.array_min(F.transform("starts", lambda x: F.struct(F.abs(x - F.col("t")).alias("d"), x.alias("x"))))
    t = F.when(~suits | F.col("starts").isNull(), F.col("t")).when(F.col("s") >= F.col("n"), F.col("starts")[F.col("i")]).when(near["d"] <= 2.0, near["x"]).otherwise(F.col("t"))
    return rows.withColumn("guided", F.coalesce(suits, F.lit(False))).withColumn("t", t).drop("n", "starts", "s", "i")


def plan(lines: DataFrame, songs: DataFrame, segments: DataFrame, frames: DataFrame, mode: str = "energy") -> DataFrame:
    """(song, entry, time): ``even`` by weights alone, ``energy`` guided and moved to onsets."""
    bounds = active_bounds(songs, segments)
    if mode == "even":
        return weighted_times(lines, bounds).select("song", "entry", F.col("t").alias("time"))
    guided = guided_times(lines, bounds, segments).select("song", "entry", "t", "duration")
    return snap_to_onsets(nearest_onset(guided, frames, 0.70))


def windows_to_realign(lines: DataFrame, longest: float = 45.0, reach: int = 2) -> DataFrame:
    """(song, start, end, part): entry ranges around lines with ``target``, joined if close, split where their time is too long."""
    marked = lines.filter("target").select("song", F.col("entry").alias("start"), F.col("entry").alias("end"))
    ranges = interval_union(marked, "start", "end", reach)
    inside = ranges.join(lines.select("song", "entry", "timestamp"), "song").filter(F.col("entry").between(F.col("start"), F.col("end")))
    first = F.min("timestamp").over(Window.partitionBy("song", "start"))
    parts = inside.withColumn("part", F.floor((F.col("timestamp") - first) / longest).cast("int"))
    return parts.groupBy("song", F.col("start").alias("range_start"), "part").agg(F.min("entry").alias("start"), F.max("entry").alias("end")).drop("range_start")
