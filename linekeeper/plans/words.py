"""The word-level candidate of a song as one plan: match, place, fill, refine by forced times, report, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linekeeper.operators import candidates, forced, joins, matching, metrics


def word_candidate(lines: DataFrame, segments: DataFrame, forced_times: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines, reports) of songs whose text is matched with recognised segments.

    lines: song, entry, text, norm, duration.  segments: song, seg_idx, start, end, text,
    norm, chars (ch, t).  forced_times: song, entry, chars, start of each line's forced
    segment.  An unusable candidate has its error in the report; songs without segments have
    lines at interpolated times and an error.
    """
    matched = joins.fuzzy_match(lines.select("song", "entry", "norm"), segments.select("song", "seg_idx", "norm")).drop("span")
    named = matched.join(lines.select("song", "entry", "norm"), ["song", "entry"])
    moved = matching.earlier_duplicates(named.select("song", "entry", "norm", "segment", "score"), segments.select("song", "seg_idx", "start", "norm"))
    heard = segments.select("song", F.col("seg_idx").alias("segment"), "start", "end", F.col("norm").alias("asr_norm"), F.col("text").alias("asr_text"), "chars")
    rows = lines.join(moved, ["song", "entry"], "left").join(heard, ["song", "segment"], "left")
    place = F.when(F.col("start").isNotNull(), matching.place_in_segment(F.col("norm"), F.col("start"), F.col("end"), F.col("asr_norm"), F.col("chars")))
    rows = rows.select("song", "entry", "norm", F.lit(False).alias("marker"), "segment", F.coalesce("score", F.lit(0.0)).alias("score"), place.alias("t"), "duration")
    timed = matching.times_from_segments(rows, segments.select("song", "seg_idx", "start", "end", "norm"))
    if forced_times is not None:
        first = forced_times.select("song", "entry", forced.first_char_time(F.col("chars"), F.col("start")).alias("forced"))
        asked = timed.join(lines, ["song", "entry"]).join(heard.select("song", "segment", F.col("end").alias("segment_end"), "asr_norm", "asr_text"), ["song", "segment"], "left").join(first, ["song", "entry"], "left")
        refined = forced.lyric_refinement(asked.withColumn("timestamp", F.col("time")).withColumn("settled", F.lit(False)))
        timed = timed.drop("time").join(refined.select("song", "entry", "time", F.col("reason").alias("refinement")), ["song", "entry"])
    else:
        timed = timed.withColumn("refinement", F.lit(None).cast("string"))
    report = metrics.confidence_metrics(timed.withColumns({"timing_repair": F.lit(None).cast("string"), "timing_trusted": F.lit(False)}), "song").withColumn("backend", F.lit("whisperx"))
    error = F.when(metrics.is_unusable(), F.concat(F.lit("unusable alignment: "), candidates.unusable_reason()))
    return timed, report.withColumn("error", error)
