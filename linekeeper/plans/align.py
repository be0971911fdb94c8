"""The alignment's main path as one plan over evidence tables: candidates, choice, fusion, scoring, report; README lists what it leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.functions.text import leading_term
from linekeeper.operators import diagnostics, folds, joins, metrics, scoring, windows

# The sources of timing that can be asked for; audio is another name of heuristic.
SOURCES = ("auto", "lyrics", "ctc", "jactc", "whisperx", "whispercpp", "heuristic", "audio")


def choose_source(songs: DataFrame, asked: str = "auto") -> DataFrame:
    """Adds source and error: how a song is timed.  songs: timed (its lyrics have times), checked (a checked file agrees), backends (array of names that can run)."""
    if asked not in SOURCES:
        raise ValueError(f"no source of timing: {asked}")
    wanted = "heuristic" if asked == "audio" else asked
    if wanted == "auto":
        source = F.when(F.col("timed"), "lyrics").when(F.col("checked"), "checked_lrc").when(F.size("backends") > 0, "competition")
    elif wanted == "lyrics":
        source = F.when(F.col("timed"), "lyrics")
    else:
        source = F.when((F.lit(wanted) == "heuristic") | F.array_contains("backends", wanted), wanted)
    return songs.withColumn("source", source).withColumn("error", F.when(F.col("source").isNull(), f"no evidence for timing source {wanted}"))


def line_context(lines: DataFrame) -> DataFrame:
    """(song, entry, repeats, ambiguous, duplicate, repeated): what a line's text has in common with its own and other lines."""
    order = Window.partitionBy("song").orderBy("entry")
    near = F.collect_list("norm").over(order.rowsBetween(-12, -1))
    rows = lines.select("song", "entry", leading_term(F.col("text"))["count"].alias("repeats"), F.coalesce(F.array_contains(near, F.col("norm")), F.lit(False)).alias("repeated"))
    for name, found in (("ambiguous", joins.ambiguous_prefix(lines)), ("duplicate", joins.short_duplicates(lines))):
        rows = rows.join(found.withColumn(name, F.lit(True)), ["song", "entry"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return rows


def recovered_tokens(tiers: DataFrame, lines: DataFrame) -> DataFrame:
    """Token-level lines after the cross-line and weak-prefix recoveries, with crossline and prefix."""
    rows = windows.crossline_recovery(tiers).withColumns({"crossline": F.col("recovered").isNotNull(), "timestamp": F.coalesce("recovered", "timestamp")}).drop("recovered")
    first = F.try_element_at("token_spans", F.lit(1))["score"]
    ends = F.array_max(F.transform("token_spans", lambda s: s["end"]))
    asked = rows.filter("timestamp is not null").join(lines.select("song", "entry", "duration"), ["song", "entry"])
    moved = folds.weak_prefix_recovery(asked.select("song", "entry", "timestamp", "duration", "ctc_score", first.alias("first_score"), ends.alias("token_end"), "peaks", F.lit(False).alias("window_realigned")))
    rows = rows.join(moved.select("song", "entry", F.col("time").alias("__t"), F.col("moved").alias("prefix")), ["song", "entry"], "left")
    return rows.withColumns({"timestamp": F.coalesce("__t", "timestamp"), "prefix": F.coalesce("prefix", F.lit(False))}).drop("__t")


def align(lines: DataFrame, words: DataFrame, tokens: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, reports) of songs.

    lines: song, entry, text, norm, duration.  words: song, entry, timestamp, score, segment,
    borrowed (word-level candidate).  tokens: song, entry, timestamp, ctc_score, missing,
    token_spans, peaks (token-level candidate).  raw: song, entry, timestamp, score.

    Every line has a decision.  A line without a row in a candidate counts as missing there;
    where the time of the chosen candidate is missing, it takes the other candidate's, the raw
    one or else that of the last line with any (0 at first), untrusted and, unless scoring resolves it, for review.
    """
    keys = lines.select("song", "entry")
    tokens = keys.join(tokens, ["song", "entry"], "left").withColumn("missing", F.coalesce("missing", F.lit(True)))
    words = keys.join(words, ["song", "entry"], "left")
    tiers = diagnostics.path_tiers(tokens)
    token_report = diagnostics.path_report(tiers).withColumns({"backend": F.lit("ctc"), "trusted_percent": F.lit(100.0), "ordinal": F.lit(1)})
    word_lines = words.withColumns({"timing_repair": F.lit(None).cast("string"), "timing_trusted": F.lit(False)})
    collapsed = windows.segment_collapse(words).select("song").union(windows.zero_collapse(words).select("song")).distinct().withColumn("collapse_detected", F.lit(True))
    word_report = metrics.confidence_metrics(word_lines, "song").join(collapsed, "song", "left").withColumns({"backend": F.lit("whisperx"), "ordinal": F.lit(2)})
    reports = token_report.unionByName(word_report, allowMissingColumns=True)
    reports = reports.withColumns({"high_risk_count": F.lit(0), "low_confidence_count": F.coalesce("low_confidence_count", F.lit(0)), "error": F.lit(None).cast("string")})
    reports = reports.withColumn("quality", metrics.selection_quality())
    chosen = metrics.choose_candidate(reports)
    order = Window.partitionBy("song").orderBy("entry")
    evidence = windows.boundary_evidence(recovered_tokens(tiers.drop("score"), lines))
    t = evidence.select("song", "entry", F.col("timestamp").alias("ctc"), "ctc_score", "first_score", "clear", "prefix", "crossline", "token_spans", "peaks", F.col("review").alias("token_review"))
    w = words.select("song", "entry", F.col("timestamp").alias("wx"), F.col("score").alias("wx_score"), "segment")
    r = raw.select("song", "entry", F.col("timestamp").alias("raw"), F.col("score").alias("raw_score"))
    rows = lines.join(t, ["song", "entry"]).join(w, ["song", "entry"]).join(r, ["song", "entry"], "left").join(chosen, "song")
    same_low = F.coalesce((F.col("segment") == F.lag("segment").over(order)) & (F.lag("wx_score").over(order) < metrics.TRUSTED), F.lit(False))
    known = F.coalesce("wx", "ctc", "raw")
    before = F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("word_missing", F.col("wx").isNull()).withColumn("wx", F.coalesce(known, before, F.lit(0.0)))
    rows = rows.withColumns({**{c: F.coalesce(c, F.lit(False)) for c in ("prefix", "crossline", "clear")}, "shared_low_segment": same_low}).join(line_context(lines), ["song", "entry"])
    fused = folds.fuse(rows.select("song", "entry", "wx", "wx_score", "ctc", "ctc_score", "raw", "raw_score", "duration", "prefix", "crossline", "clear", "shared_low_segment"))
    rows = rows.join(fused.select("song", "entry", F.col("time").alias("fused"), "reason"), ["song", "entry"])
    by_tokens = F.col("selected") == "ctc"
    spans = F.transform("token_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    scored = rows.select(
        "song",
        "entry",
        F.when(by_tokens, F.coalesce("ctc", "wx")).otherwise(F.col("fused")).alias("timestamp"),
        "duration",
        F.when(by_tokens, F.when(F.col("ctc_score") >= 0.08, 0.90).when(F.col("ctc_score") >= 0.03, 0.70).otherwise(0.35)).when(F.col("word_missing"), 0.0).otherwise(F.col("wx_score")).alias("score"),
        F.length("norm").alias("norm_len"),
        F.lit(False).alias("manual"),
        "raw",
        "raw_score",
        F.lit(None).cast("double").alias("forced"),
        F.when(by_tokens, F.col("token_review") | F.col("ctc").isNull()).otherwise(F.col("word_missing")).alias("risk_review"),
        F.lit(False).alias("window_realigned"),
        "ctc_score",
        spans.alias("spans"),
        "peaks",
        "repeats",
        "ambiguous",
        "duplicate",
        "repeated",
        F.lit(False).alias("asr_only_trust"),
        F.lit(False).alias("mora_known"),
        "text",
    )
    decisions = scoring.score_lines(scored).join(rows.select("song", "entry", "selected", "reason"), ["song", "entry"])
    final = decisions.groupBy("song", "selected").agg(
        F.count(F.lit(1)).alias("timing_entries"), F.count_if("trusted").alias("trusted_entries"), F.count_if("review").alias("review_required_count"), F.avg("confidence").alias("mean_confidence")
    )
    return decisions, final
