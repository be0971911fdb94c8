"""Confidence metrics, quality scores, candidate choice, risks and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.functions.timing import percent
from linekeeper.operators.windows import TRUSTED

# Severities in rising order; any other ranks as the first.
SEVERITIES = ("low", "medium", "high")


def has_timing() -> Column:
    return F.col("segment").isNotNull() | F.col("timing_repair").isNotNull()


def is_trusted() -> Column:
    return has_timing() & ((F.coalesce("score", F.lit(0.0)) >= TRUSTED) | F.coalesce("timing_trusted", F.lit(False)))


def confidence_metrics(df: DataFrame, *keys: str, reviews: str | None = None) -> DataFrame:
    """Counts and percents of assigned, trusted and low lines for each key."""
    total = F.count(F.lit(1))
    review = F.max(reviews) if reviews else F.lit(0)
    counted = df.groupBy(*keys).agg(
        total.alias("timing_entries"),
        F.count_if(has_timing()).alias("assigned_entries"),
        F.count_if(is_trusted()).alias("trusted_entries"),
        F.count_if(~is_trusted()).alias("low_confidence_count"),
        F.count_if(F.coalesce("timing_trusted", F.lit(False))).alias("timing_trusted_entries"),
        review.cast("long").alias("review_required_count"),
    )
    for part, name in (("assigned_entries", "assigned"), ("trusted_entries", "trusted"), ("low_confidence_count", "low_confidence"), ("review_required_count", "review_required")):
        counted = counted.withColumn(f"{name}_percent", percent(F.col(part), F.col("timing_entries")))
    return counted


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def report_quality() -> Column:
    """Trusted percent less 2.5 a low line, 3 a review and 80 for a collapse."""
    return _n("trusted_percent") - 2.5 * _n("low_confidence_count") - 3.0 * _n("review_required_count") - F.when(F.coalesce("collapse_detected", F.lit(False)), 80.0).otherwise(0.0)


def selection_quality() -> Column:
    """Quality by which candidates of several backends compete, from -100 to 100; other backends by report_quality."""
    collapse = F.when(F.coalesce("collapse_detected", F.lit(False)), 100.0).otherwise(0.0)
    missing = F.when((_n("timing_entries") > 0) & (_n("ctc_missing_count") >= F.ceil(_n("timing_entries") * 0.20)), 50.0).otherwise(0.0)
    ctc = 100.0 - 30.0 * _n("ctc_missing_count") - 6.0 * _n("ctc_low_score_count") - 8.0 * _n("ctc_very_low_score_count") - 2.0 * _n("review_required_count") - missing - collapse
    short = F.when((_n("timing_entries") >= 8) & (_n("trusted_percent") < 85.0), 10.0).otherwise(0.0)
    high = _n("high_risk_count") * F.when(F.col("backend") == "hybrid", 2.5).otherwise(1.0)
    words = _n("trusted_percent") - 0.40 * _n("low_confidence_percent") - 0.15 * _n("review_required_percent") - high - short - collapse

    def clip(x: Column) -> Column:
        return F.greatest(F.lit(-100.0), F.least(F.lit(100.0), x))

    return F.when(F.col("error").isNotNull() & (F.col("error") != ""), -100.0).when(F.col("backend") == "ctc", clip(ctc)).when(F.col("backend").isin("whisperx", "hybrid"), clip(words)).otherwise(report_quality())


def choose_candidate(df: DataFrame, song: str = "song", backend: str = "backend", quality: str = "quality", ordinal: str = "ordinal", prefer: str = "ctc") -> DataFrame:
    """(song, selected, quality): the best usable candidate, the first on ties; the preferred backend with 80 or more and within 5 of the best.

    A quality of exactly 0 sorts as -100.
    """
    usable = df.filter(F.col("error").isNull()).withColumn("__q", F.when(F.col(quality) == 0, -100.0).otherwise(F.coalesce(F.col(quality), F.lit(-100.0))))
    one = F.struct(F.col("__q").alias("q"), (-F.col(ordinal)).alias("o"), F.col(backend).alias("b"), F.col(quality).alias("v"))
    best = usable.groupBy(song).agg(F.max(one).alias("best"), F.max(F.when(F.col(backend) == prefer, one)).alias("own"))
    pick = F.when((F.col("own.q") >= 80.0) & (F.col("own.q") >= F.col("best.q") - 5.0), F.col("own")).otherwise(F.col("best"))
    return best.select(song, pick["b"].alias("selected"), pick["v"].alias("quality"))


def needs_retry() -> Column:
    return (_n("trusted_percent") < 90.0) | (_n("low_confidence_count") > F.greatest(F.lit(6), F.ceil(_n("timing_entries") * 0.20)))


def is_unusable() -> Column:
    n = _n("timing_entries")
    return (n <= 0) | (_n("trusted_entries") == 0) | (_n("trusted_percent") < 35.0) | ((n >= 6) & (_n("low_confidence_count") >= F.ceil(n * 0.80)))


def is_untrusted() -> Column:
    n = _n("timing_entries")
    bad = (_n("trusted_percent") < 85.0) | (_n("low_confidence_percent") >= 50.0) | (_n("max_post_long_uncertain_run") >= 4) | (_n("high_risk_count") >= F.ceil(n * 0.25))
    return is_unusable() | F.coalesce("collapse_detected", F.lit(False)) | ((n >= 8) & bad)


def strict_failure(least_trusted: float = 100.0) -> Column:
    """The first gate that a report fails, or null."""
    return (
        F.when(_n("review_required_count") > 0, "review_required")
        .when(_n("trusted_percent") < least_trusted, "trusted_percent")
        .when(F.coalesce("collapse_detected", F.lit(False)), "collapse_detected")
    )


def review_failure(strict: bool = False, fail_on_review: bool = False, min_trusted: float | None = None) -> Column:
    """The first gate that a report fails, with its figures, or null; a strict run asks for 100 % trust unless told otherwise."""
    least = 100.0 if strict and min_trusted is None else min_trusted
    reviews, trusted = _n("review_required_count").cast("long"), F.coalesce(F.col("trusted_percent").cast("double"), F.lit(0.0))
    gates = []
    if strict or fail_on_review:
        gates.append(F.when(reviews > 0, F.concat(F.lit("review_required_count="), reviews.cast("string"))))
    if least is not None:
        gates.append(F.when(trusted < least, F.concat(F.lit("trusted_percent="), trusted.cast("string"), F.lit(f" < required {float(least)}"))))
    if strict:
        gates.append(F.when(F.coalesce("collapse_detected", F.lit(False)), F.lit("collapse_detected=true")))
    return F.coalesce(*gates, F.lit(None).cast("string"))


def prefer_ctc(ctc_collapsed: Column, ctc_missing: Column, ctc_reviews: Column, hybrid_reviews: Column) -> Column:
    """Whether a patched candidate has so many more reviews than a clean one that it isn't worth it."""
    return ~ctc_collapsed & (ctc_missing == 0) & (hybrid_reviews >= F.greatest(F.lit(8), ctc_reviews * 3 + 5))


# The reasons and limits here are fixed values.
def onset_consensus(ctc: Column, first: Column, words: Column, score: Column, other: Column) -> Column:
    """(time, reason) of a narrow rescue of a line's onset from three sources; nulls where no rule holds."""
    off, near, middle = F.abs(ctc - words), F.abs(words - other), (words + other) / 2

    def pick(t: Column, why: str) -> Column:
        return F.struct(t.alias("time"), F.lit(why).alias("reason"))

    return (
        F.when((first <= 0.01) & (score >= 0.80) & off.between(0.35, 0.80) & near.between(0.60, 1.00), pick(words, "high-confidence-whisperx-over-weak-ctc-initial"))
        .when((first <= 0.01) & (score >= 0.50) & (off >= 0.20) & (near <= 0.15), pick(middle, "whisperx-japanese-ctc-onset-consensus"))
        .when(first.between(0.05, 0.10) & (score >= 0.80) & (near <= 0.15) & (off >= 0.20), pick(middle, "whisperx-japanese-ctc-over-ctc-onset-consensus"))
        .otherwise(pick(F.lit(None).cast("double"), "").withField("reason", F.lit(None).cast("string")))
    )


def accept_zero_gap(gap: Column, score: Column, time: Column, local_time: Column, local_score: Column) -> Column:
    return (gap <= 0.04) & (local_time - time >= 0.30) & (local_score >= F.greatest(F.lit(0.05), score * 1.05))


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for k, name in enumerate(SEVERITIES):
        out = F.when(severity == name, k).otherwise(out)
    return out


def dedupe_risks(df: DataFrame, *keys: str, order: str = "ordinal") -> DataFrame:
    """One risk for each key: flags in the order of first sight, the first highest severity, any review, maps merged (later wins), the last delta."""
    rank = severity_rank(F.coalesce("severity", F.lit("low")))
    # maps have no order: their entries are sorted along
    entries = F.map_entries(F.coalesce("cand_ts", F.create_map().cast("map<string,double>")))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "flags", entries.alias("e"))))
    merged = df.groupBy(*keys).agg(
        rows.alias("__rows"),
        F.max_by("severity", F.struct(rank, -F.col(order))).alias("severity"),
        F.bool_or(F.coalesce("review_required", F.lit(False))).alias("review_required"),
        F.max_by("delta", F.when(F.col("delta").isNotNull(), F.col(order))).alias("delta"),
    )
    flags = F.array_distinct(F.flatten(F.transform("__rows", lambda r: F.coalesce(r["flags"], F.array().cast("array<string>")))))
    entries = F.flatten(F.transform("__rows", lambda r: r["e"]))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"])
    return merged.withColumn("flags", flags).withColumn("cand_ts", F.map_from_arrays(names, last)).drop("__rows")


def weighted_percent(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """sum(value * weight) / sum(weight) over rows that have a value, two digits."""
    kept = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    return kept.groupBy(*keys).agg(F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 2).alias("weighted"), F.sum(weight).alias("weight"))


def latest(df: DataFrame, key: str, order: Column, *values: str) -> DataFrame:
    """For each key the values of the row that comes last."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v")).select(key, "v.*")


def gate_failures(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Adds failures: the names of the gates whose condition is true; a null gate is not applied."""
    return df.withColumn("failures", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in gates.items()])))


def positional_eval(reference: DataFrame, generated: DataFrame, *keys: str) -> DataFrame:
    """Metrics of pairs of entry lists joined by position: rows (keys, entry, time_cs, lines).

    Percents are of the reference's entries; entries without a partner count as mismatches.
    """
    pos = [*keys, "entry"]
    a = reference.select(*pos, F.col("time_cs").alias("a_cs"), F.col("lines").alias("a_lines"))
    b = generated.select(*pos, F.col("time_cs").alias("b_cs"), F.col("lines").alias("b_lines"))
    both = a.join(b, pos, "full_outer")
    off = F.abs(F.col("b_cs") - F.col("a_cs"))
    lonely = F.col("a_cs").isNull() | F.col("b_cs").isNull()
    differs = F.when(~lonely, F.col("a_lines") != F.col("b_lines"))
    out = both.groupBy(*keys).agg(
        F.count("a_cs").alias("reference_entries"),
        F.count("b_cs").alias("generated_entries"),
        F.sum(F.coalesce(F.size("a_lines"), F.lit(0))).alias("reference_display_lines"),
        F.sum(F.coalesce(F.size("b_lines"), F.lit(0))).alias("generated_display_lines"),
        F.count_if(differs | lonely).alias("text_mismatches"),
        F.slice(F.array_sort(F.collect_list(F.when(differs, F.col("entry")))), 1, 25).alias("text_mismatch_indices"),
        F.max(off).alias("max_abs_delta_cs"),
        F.round(F.avg(off), 2).alias("mean_abs_delta_cs"),
        *[F.count_if(off <= k).alias(f"within_{k}cs") for k in (10, 25, 50, 100)],
        F.count_if((off != 0) | lonely).alias("nonzero_time_diffs"),
    )
    for k in (10, 25, 50, 100):
        out = out.withColumn(f"within_{k}cs_percent", percent(F.col(f"within_{k}cs"), F.col("reference_entries")))
    return out.withColumn("entry_count_match", F.col("reference_entries") == F.col("generated_entries"))


def number_entries(df: DataFrame, *order: str, song: str = "song") -> DataFrame:
    """Adds entry: the row's number in its song, from 1."""
    return df.withColumn("entry", F.row_number().over(Window.partitionBy(song).orderBy(*order)))


#: Gates of a benchmark case: (name, metric, comparison); a case's null requirement is not applied.
CASE_GATES = (
    ("text_mismatches", "text_mismatches", "equal"),
    ("within_25cs", "within_25cs_percent", "least"),
    ("within_50cs", "within_50cs_percent", "least"),
    ("max_abs_delta_cs", "max_abs_delta_cs", "equal"),
    ("max_abs_delta_cs_at_most", "max_abs_delta_cs", "most"),
    ("backend", "backend", "equal"),
    ("selected_backend", "selected_backend", "equal"),
    ("report_device", "report_device", "equal"),
    ("trusted_percent", "trusted_percent", "least"),
    ("review_required_count", "review_required_count", "equal"),
    ("ctc_local_fusion_count", "ctc_local_fusion_count", "equal"),
)


def evaluate_cases(df: DataFrame) -> DataFrame:
    """Adds failures and passed to rows with metrics and requirements (``require_`` and a gate's name, where the column exists)."""
    tests = {"equal": lambda v, r: ~v.eqNullSafe(r), "least": lambda v, r: F.coalesce(v, F.lit(0.0)) < r, "most": lambda v, r: v > r}
    gates = {}
    for name, metric, kind in CASE_GATES:
        need = f"require_{name}"
        if need in df.columns and metric in df.columns:
            gates[name] = F.col(need).isNotNull() & tests[kind](F.col(metric), F.col(need))
    if {"require_review_entries", "review_entries"} <= set(df.columns):
        gates["review_entries"] = F.col("require_review_entries").isNotNull() & ~F.array_sort("review_entries").eqNullSafe(F.array_sort("require_review_entries"))
    out = gate_failures(df, gates)
    return out.withColumn("passed", F.size("failures") == 0)
