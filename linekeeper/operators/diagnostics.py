"""What is suspicious about an alignment: flags, severities, score tiers, disagreements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.operators.windows import follower_flags, runs_of, segment_collapse, zero_collapse

# Score tiers of token-level paths, from the highest.
TIERS = ((0.08, 0.90), (0.03, 0.70))
LOWEST_TIER, LOW, VERY_LOW = 0.35, 0.03, 0.01


def _mark(df: DataFrame, runs: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: whether an entry is within one of the runs (song, start_entry, end_entry)."""
    inside = runs.select("song", F.explode(F.sequence("start_entry", "end_entry")).alias("entry"), F.lit(True).alias(name)).distinct()
    return df.join(inside, ["song", "entry"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def path_tiers(df: DataFrame, least: int = 4) -> DataFrame:
    """Adds score (tier), low, very_low, collapsed, flags, severity and review of token-level paths (ctc_score, missing).

    A lone low path counts as low only; a run of ``least`` or a missing one is for review.
    """
    x = F.coalesce("ctc_score", F.lit(0.0))
    tier = F.lit(LOWEST_TIER)
    for limit, value in reversed(TIERS):
        tier = F.when(x >= limit, value).otherwise(tier)
    df = df.withColumn("score", tier).withColumn("low", x < LOW).withColumn("very_low", x < VERY_LOW)
    df = _mark(df, runs_of(df, F.col("low"), least), "collapsed")
    review = F.col("missing") | F.col("collapsed")
    flags = F.array_compact(F.array(F.when(F.col("missing"), "ctc_missing_alignment"), F.when(F.col("low"), "ctc_low_path_confidence"), F.when(F.col("collapsed"), "ctc_confidence_collapse")))
    return df.withColumn("review", review).withColumn("flags", F.when(review, flags)).withColumn("severity", F.when(review, "high"))


def validated_path(df: DataFrame, gap: float = 0.10) -> DataFrame:
    """Adds timestamp, missing, ctc_score and score of an aligner's rows (song, entry, start, ctc_score, duration).

    A row without a start follows the line before by ``gap`` (0 at first), has a score of 0
    and counts as missing, not as low; times are within the song and then rise by ``gap`` at
    least, as a running maximum.
    """
    order = Window.partitionBy("song").orderBy("entry")
    place = F.row_number().over(order)
    rows = df.withColumns({"missing": F.col("start").isNull(), "__i": place, "ctc_score": F.coalesce("ctc_score", F.lit(0.0))})
    inside = F.greatest(F.lit(0.0), F.least("duration", "start"))
    rows = rows.withColumn("__t", F.when(~F.col("missing"), inside).when(F.col("__i") == 1, 0.0))
    rows = rows.withColumn("timestamp", F.max(F.col("__t") - gap * F.col("__i")).over(order) + gap * F.col("__i"))
    tier = F.lit(LOWEST_TIER)
    for limit, value in reversed(TIERS):
        tier = F.when(F.col("ctc_score") >= limit, value).otherwise(tier)
    return rows.withColumn("score", F.when(F.col("missing"), 0.0).otherwise(tier)).drop("__i", "__t")


def path_report(df: DataFrame) -> DataFrame:
    """Counts of path_tiers for each song."""
    return df.groupBy("song").agg(
        F.count(F.lit(1)).alias("timing_entries"),
        F.count_if("missing").alias("ctc_missing_count"),
        F.count_if("low").alias("ctc_low_score_count"),
        F.count_if("very_low").alias("ctc_very_low_score_count"),
        F.count_if("review").alias("review_required_count"),
        F.min("ctc_score").alias("ctc_score_min"),
        F.avg("ctc_score").alias("ctc_score_mean"),
        F.bool_or("collapsed").alias("collapse_detected"),
    )


def disagreements(selected: DataFrame, other: DataFrame, least: float = 0.35, high: float = 1.0, flag: str = "unresolved_ctc_disagreement") -> DataFrame:
    """Risks (song, entry, flags, severity, review_required, delta, cand_ts) where another source is ``least`` seconds off; settled ties are left out."""
    both = selected.join(other.select("song", "entry", F.col("timestamp").alias("other")), ["song", "entry"])
    delta = F.abs(F.col("other") - F.col("timestamp"))
    found = both.filter((delta >= least) & ~F.coalesce("settled", F.lit(False)))
    return found.select(
        "song",
        "entry",
        F.array(F.lit(flag)).alias("flags"),
        F.when(delta >= high, "high").otherwise("medium").alias("severity"),
        F.lit(True).alias("review_required"),
        F.round(delta, 3).alias("delta"),
        F.create_map(F.lit("output"), F.round("timestamp", 3), F.lit("ctc"), F.round("other", 3)).alias("cand_ts"),
    )


def _line_flags() -> list[tuple[str, Column]]:
    """(flag, condition) over a line's gaps, forced time and text, in the order of listing."""
    off, long = F.abs(F.col("timestamp") - F.col("forced")), F.col("is_long")
    before, after = F.col("gap_before"), F.col("gap_after")
    return [
        ("candidate_disagreement", off >= F.when(long, 2.0).otherwise(1.25)),
        ("possible_midline_anchor", long & (F.col("timestamp") - F.col("forced") >= 3.0)),
        ("close_neighbor_onset_uncertain", ~long & (before <= 3.5) & (off >= 0.70)),
        ("forced_time_overlaps_previous_line", F.col("forced") <= F.col("previous") + 0.20),
        ("possible_instrumental_intro_hallucination", (F.col("entry") == 1) & F.coalesce("borrowed", F.lit(False)) & (F.col("timestamp") < 10.0) & F.coalesce(F.col("next") - F.col("timestamp") >= 10.0, F.lit(False))),
        ("long_line_close_to_next_entry", long & (after <= 3.5)),
        ("long_line_wide_window", long & (before >= 8.0) & (after >= 6.0)),
        ("long_line_not_high_confidence", long & (F.coalesce("score", F.lit(0.0)) < 0.88)),
    ]


HIGH_FLAGS = ("possible_midline_anchor", "forced_time_overlaps_previous_line", "possible_instrumental_intro_hallucination")
MEDIUM_FLAGS = ("long_line_close_to_next_entry", "close_neighbor_onset_uncertain")
FOLLOWER_FLAGS = ("follows_suspicious_long_line", "possible_bad_split_boundary")


def alignment_diagnostics(df: DataFrame) -> DataFrame:
    """Adds flags, severity and review to lines (timestamp, duration, forced, score, segment, borrowed, norm, text).

    First each line's own flags, then lines that closely follow a flagged one (a chain), then
    runs on one segment or without a score.  Lines without matching text are not judged.
    """
    order = Window.partitionBy("song").orderBy("entry")
    df = df.withColumn("previous", F.coalesce(F.lag("timestamp").over(order), F.lit(0.0))).withColumn("next", F.lead("timestamp").over(order))
    df = df.withColumn("gap_before", F.col("timestamp") - F.col("previous")).withColumn("gap_after", F.coalesce("next", F.col("duration")) - F.col("timestamp"))
    df = df.withColumn("is_long", (F.length("norm") >= 18) | (F.length("text") >= 24))
    own = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in _line_flags()]))
    df = df.withColumn("own", F.when(F.length("norm") > 0, own).otherwise(F.array().cast("array<string>")))
    has = lambda names: F.arrays_overlap("own", F.array(*map(F.lit, names)))
    level = F.when(F.size("own") == 0, None).when(has(HIGH_FLAGS), "high").when(has(MEDIUM_FLAGS), "medium").otherwise("low")
    df = df.withColumn("own_level", level).withColumn("flagged", F.size("own") > 0).withColumn("high", F.coalesce(level == "high", F.lit(False)))
    df = follower_flags(df)
    follows = F.col("follows") & ~F.col("flagged")
    df = _mark(_mark(df, segment_collapse(df), "__segment"), zero_collapse(df), "__zero")
    flags = F.concat(
        "own",
        F.when(follows, F.array(*map(F.lit, FOLLOWER_FLAGS))).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(F.when(F.col("__segment"), "segment_collapse"), F.when(F.col("__zero"), "alignment_collapse"))),
    )
    severity = F.when(F.col("__segment") | F.col("__zero"), "high").when(follows, F.when(F.col("follows_high"), "high").otherwise("medium")).otherwise(F.col("own_level"))
    df = df.withColumn("flags", flags).withColumn("severity", severity).withColumn("review", F.coalesce(severity.isin("high", "medium"), F.lit(False)))
    return df.drop("previous", "next", "is_long", "own", "own_level", "flagged", "high", "follows", "follows_high", "__segment", "__zero")
