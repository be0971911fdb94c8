"""Ordered-window operators over rows keyed by (song, entry) or (song, frame).

All take a DataFrame and the names of its key and order columns, and partition by the key,
so songs run in parallel and operators in a row share one exchange and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Score from which a line is trusted, and under which lines on one segment may collapse.
TRUSTED, COLLAPSE = 0.62, 0.30


def _order(song: str, entry: str):
    return Window.partitionBy(song).orderBy(entry)


def smooth(df: DataFrame, value: str, width: int, out: str, song: str = "song", entry: str = "entry") -> DataFrame:
    """Centred moving average over ``width`` (odd) rows; beyond the ends counts as zero."""
    w = _order(song, entry).rowsBetween(-(width // 2), width // 2)
    return df.withColumn(out, F.sum(value).over(w) / width)


#: Steps between a song's least and largest value in which its values are counted.
STEPS = 1024


def percentiles(df: DataFrame, value: str, shares: tuple[float, ...], song: str = "song") -> DataFrame:
    """(song, p): array of the exact percentiles of a song's values, between two neighbours in proportion; nulls don't count.

    Values are counted in steps first; those of the steps that hold the wanted ranks alone
    are sorted then.  No task holds a song's values, and a long song is counted by many.
    """
    rows = df.select(song, F.col(value).cast("double").alias("__x")).filter("__x is not null and not isnan(__x)")
    ends = rows.groupBy(song).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    width = F.col("__hi") - F.col("__lo")
    step = F.when(width > 0, F.least(F.lit(STEPS - 1), F.floor((F.col("__x") - F.col("__lo")) / width * STEPS).cast("int"))).otherwise(0)
    placed = rows.join(ends, song).withColumn("__s", step)
    counts = placed.groupBy(song, "__s").agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(song).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = [F.struct(F.lit(k).alias("k"), (F.lit(float(p)) * (F.col("__n") - 1)).alias("h")) for k, p in enumerate(shares)]
    ranks = ends.select(song, "__n", F.explode(F.array(*at)).alias("__a")).select(song, "__a.k", "__a.h", F.explode(F.array(F.floor("__a.h").cast("long"), F.least(F.floor("__a.h").cast("long") + 1, F.col("__n") - 1))).alias("__r"))
    held = counts.withColumn("__b", before).join(ranks, song).filter((F.col("__r") >= F.col("__b")) & (F.col("__r") < F.col("__b") + F.col("__c")))
    held = held.select(song, "__s", "k", "h", (F.col("__r") - F.col("__b") + 1).alias("__i"), "__r")
    few = placed.join(held.select(song, "__s").distinct(), [song, "__s"], "left_semi")
    few = few.withColumn("__i", F.row_number().over(Window.partitionBy(song, "__s").orderBy("__x")).cast("long")).select(song, "__s", "__i", "__x")
    found = held.join(few, [song, "__s", "__i"]).groupBy(song, "k").agg(F.first("h").alias("h"), F.min("__x").alias("a"), F.max("__x").alias("b"))
    found = found.withColumn("p", F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h")))
    return found.groupBy(song).agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("__p")).select(song, F.col("__p.p").alias("p"))


def normalize(df: DataFrame, value: str, out: str, song: str = "song") -> DataFrame:
    """(x - p5) / (p95 - p5) of the song, from 0 to 1; 0 where these are equal."""
    ends = percentiles(df, value, (0.05, 0.95), song).select(song, F.col("p")[0].alias("__lo"), F.col("p")[1].alias("__hi"))
    scaled = (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    level = F.when(F.col("__hi") <= F.col("__lo"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))
    return df.join(ends, song, "left").withColumn(out, level).drop("__lo", "__hi")


def islands(df: DataFrame, breaks: Column, out: str, song: str = "song", entry: str = "entry") -> DataFrame:
    """Number of the run of rows that each row is in; ``breaks``: true on the first row of one."""
    return df.withColumn(out, F.sum(breaks.cast("int")).over(_order(song, entry)))


def merge_segments(df: DataFrame, start: str, end: str, gap: float = 0.45, least: float = 0.70, song: str = "song") -> DataFrame:
    """Intervals joined where the next begins at most ``gap`` after the last one's end, and ``least`` long then."""
    order = Window.partitionBy(song).orderBy(start, end)
    reached = F.lag(end).over(order)
    runs = df.withColumn("__new", F.coalesce(F.col(start) - reached > gap, F.lit(True)))
    runs = runs.withColumn("run", F.sum(F.col("__new").cast("int")).over(order))
    merged = runs.groupBy(song, "run").agg(F.min(start).alias(start), F.max_by(end, F.struct(start, end)).alias(end), F.count(F.lit(1)).alias("parts"))
    return merged.filter(F.col(end) - F.col(start) >= least).drop("run")


def interval_union(df: DataFrame, start: str, end: str, reach: int = 2, song: str = "song") -> DataFrame:
    """Entry ranges joined where they begin at most ``reach`` after any earlier one's end."""
    order = Window.partitionBy(song).orderBy(start, end)
    far = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = df.withColumn("__new", F.coalesce(F.col(start) - far > reach, F.lit(True)).cast("int"))
    runs = runs.withColumn("__run", F.sum("__new").over(order))
    return runs.groupBy(song, "__run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__run")


def runs_of(df: DataFrame, member: Column, least: int, same: str | None = None, song: str = "song", entry: str = "entry") -> DataFrame:
    """(song, start_entry, end_entry, length) of the runs of ``least`` rows or more that are members, with equal ``same`` values."""
    order = _order(song, entry)
    marked = df.withColumn("__in", F.coalesce(member, F.lit(False)))
    changed = ~F.lag("__in", 1, False).over(order)
    if same:
        changed = changed | ~F.lag(same).over(order).eqNullSafe(F.col(same))
    runs = islands(marked.withColumn("__new", F.col("__in") & changed), F.col("__new"), "__run", song, entry).filter("__in")
    keys = [song, "__run"] + ([same] if same else [])
    found = runs.groupBy(*keys).agg(F.min(entry).alias("start_entry"), F.max(entry).alias("end_entry"), F.count(F.lit(1)).cast("int").alias("length"))
    return found.filter(F.col("length") >= least).drop("__run")


def segment_collapse(df: DataFrame, least: int = 4) -> DataFrame:
    """Runs of lines on one segment with scores under COLLAPSE."""
    return runs_of(df, F.col("segment").isNotNull() & (F.coalesce("score", F.lit(0.0)) < COLLAPSE), least, "segment")


def zero_collapse(df: DataFrame, least: int = 6) -> DataFrame:
    """Runs of lines with score 0 or none."""
    return runs_of(df, F.coalesce("score", F.lit(0.0)) == 0.0, least)


def low_run_start(df: DataFrame, length: int = 4) -> DataFrame:
    """(song, first_entry) of the first ``length`` lines in a row without segment or trust; null if there are none."""
    order = _order("song", "entry")
    low = (F.col("segment").isNull() | (F.coalesce("score", F.lit(0.0)) < TRUSTED)).cast("int")
    ahead = order.rowsBetween(0, length - 1)
    marked = df.withColumn("__low", F.sum(low).over(ahead))
    return marked.groupBy("song").agg(F.min(F.when(F.col("__low") == length, F.col("entry"))).alias("first_entry"))


def tail_start(df: DataFrame, least: int = 4, last: int = 12) -> DataFrame:
    """(song, tail_entry): where, among the last lines, a tail begins of which 55 % (3 at least) and the first two are low; null if nowhere."""
    order = _order("song", "entry")
    low = (F.coalesce("score", F.lit(0.0)) < TRUSTED).cast("int")
    marked = df.withColumn("__low", low)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    marked = (
        marked.withColumn("__rest", F.count(F.lit(1)).over(rest))
        .withColumn("__lows", F.sum("__low").over(rest))
        .withColumn("__next", F.lead("__low", 1, 0).over(order))
        .withColumn("__at", F.row_number().over(order))
    )
    fits = (F.col("__rest") <= last) & (F.col("__rest") >= least) & (F.col("__at") > 1)
    fits = fits & (F.col("__lows") >= F.greatest(F.lit(3), F.ceil(F.col("__rest") * 0.55))) & (F.col("__low") + F.col("__next") == 2)
    return marked.groupBy("song").agg(F.min(F.when(fits, F.col("entry"))).alias("tail_entry"))


def drift_runs(df: DataFrame, least: int = 3) -> DataFrame:
    """Runs of lines whose raw time is off in one direction: (song, start_entry, end_entry, length, median_delta, spread, mean_score).

    Rows: entry, current and raw time, raw_score, borrowed.  A line drifts if it isn't
    borrowed, scores 0.5 and is off by 0.75; the next one if it follows at once, on the same
    side, within 0.65 of it.
    """
    order = _order("song", "entry")
    far = df.withColumn("delta", F.col("raw") - F.col("current"))
    far = far.filter(~F.coalesce("borrowed", F.lit(False)) & (F.col("raw_score") >= 0.5) & (F.abs("delta") >= 0.75))
    last, before = F.lag("entry").over(order), F.lag("delta").over(order)
    joined = (F.col("entry") == last + 1) & (F.signum("delta") == F.signum(before)) & (F.abs(F.col("delta") - before) <= 0.65)
    runs = islands(far.withColumn("__new", ~F.coalesce(joined, F.lit(False))), F.col("__new"), "__run")
    found = runs.groupBy("song", "__run").agg(
        F.min("entry").alias("start_entry"),
        F.max("entry").alias("end_entry"),
        F.count(F.lit(1)).cast("int").alias("length"),
        F.median("delta").alias("median_delta"),
        (F.max("delta") - F.min("delta")).alias("spread"),
        F.avg("raw_score").alias("mean_score"),
    )
    return found.filter(F.col("length") >= least).drop("__run")


def boundary_evidence(df: DataFrame) -> DataFrame:
    """Adds first_start, first_score, previous_end, gap and clear from ``token_spans``.

    The line before counts only if it has usable spans; clear: a gap of 0.35 s or more and a
    first score of 0.25 or more.
    """
    order = _order("song", "entry")
    spans = F.col("token_spans")
    ends = F.array_max(F.transform(spans, lambda s: s["end"]))
    df = df.withColumn("first_start", F.try_element_at(spans, F.lit(1))["start"])
    df = df.withColumn("__end", F.when(F.col("first_start").isNotNull(), ends))
    df = df.withColumn("first_score", F.when(F.col("__end").isNotNull(), F.coalesce(F.try_element_at(spans, F.lit(1))["score"], F.lit(0.0))))
    usable = F.col("__end").isNotNull()
    df = df.withColumn("previous_end", F.when(usable, F.lag("__end").over(order)))
    df = df.withColumn("gap", F.col("first_start") - F.col("previous_end"))
    clear = F.coalesce((F.col("gap") >= 0.35) & (F.col("first_score") >= 0.25), F.lit(False))
    return df.withColumn("clear", F.when(usable, clear)).drop("__end")


def crossline_recovery(df: DataFrame, duration: Column | None = None) -> DataFrame:
    """Adds recovered: the second token's start where a line's first token is the tail of the line before.

    Reads only the lines before and after as they were.  ``duration``: the song's end.
    """
    order = _order("song", "entry")
    spans = F.col("token_spans")
    start, second = F.try_element_at(spans, F.lit(1))["start"], F.try_element_at(spans, F.lit(2))["start"]
    df = df.withColumn("__end", F.array_max(F.transform(spans, lambda s: s["end"])))
    before = F.lag("__end").over(order)
    after = F.coalesce(F.lead("timestamp").over(order), duration if duration is not None else F.lit(float("inf")))
    tail = (start <= before + 0.06) & (second - start >= 0.70) & (second > before + 0.05) & (second < after - 0.10)
    return df.withColumn("recovered", F.when(tail, second)).drop("__end")


def alignment_windows(df: DataFrame, duration: Column) -> DataFrame:
    """Adds window_start and window_end, the stretch of sound for a line, from ``timestamp`` and ``norm`` (matching text)."""
    order = _order("song", "entry")
    t = F.col("timestamp")
    before, after = F.lag("timestamp").over(order), F.coalesce(F.lead("timestamp").over(order), F.least(duration, t + 4.0))
    back = F.when((F.length("norm") <= 3) & (t - F.coalesce(before, F.lit(0.0)) >= 4.0), 4.2).otherwise(1.2)
    start = F.least(t - back, F.coalesce((before + t) / 2, t - back))
    return df.withColumn("window_start", F.greatest(F.lit(0.0), start)).withColumn("window_end", F.least(duration, F.greatest(after + 0.5, t + 1.2)))


def follower_flags(df: DataFrame, gap: float = 3.5) -> DataFrame:
    """Adds follows (a flagged line comes before it in a chain of gaps up to ``gap``) and follows_high (directly after a high one).

    Rows: timestamp, flagged and high of the first pass.  A chain passes flags on, high only once.
    """
    order = _order("song", "entry")
    df = df.withColumn("__new", F.coalesce(F.col("timestamp") - F.lag("timestamp").over(order) > gap, F.lit(True)))
    df = islands(df, F.col("__new"), "__chain")
    chain = Window.partitionBy("song", "__chain").orderBy("entry")
    seen = F.max(F.col("flagged").cast("int")).over(chain.rowsBetween(Window.unboundedPreceding, -1))
    direct = F.lag("high").over(chain)
    return df.withColumn("follows", F.coalesce(seen == 1, F.lit(False))).withColumn("follows_high", F.coalesce(direct, F.lit(False))).drop("__new", "__chain")
