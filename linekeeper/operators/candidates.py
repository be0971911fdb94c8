"""Candidates of a song's timing: summaries, reasons, retries and splices.

A candidate is a report row (song, backend, ...) and lines (song, entry, timestamp, ...).  A
candidate that failed has an error and no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linekeeper.functions.timing import millis
from linekeeper.operators.folds import fold_by_song
from linekeeper.operators.metrics import needs_retry, report_quality, selection_quality
from linekeeper.operators.windows import low_run_start


def said(value: Column) -> Column:
    """A value as report texts spell it: None, True, False."""
    return F.coalesce(value.cast("string"), F.lit("None"))


def said_bool(value: Column) -> Column:
    return F.when(value.isNull(), "None").when(value, "True").otherwise("False")


def _listed(parts: tuple) -> Column:
    return F.concat_ws(", ", *[F.concat(F.lit(f"{name}="), text) for name, text in parts])


def _trust() -> tuple:
    columns = ("trusted_entries", "timing_entries", "trusted_percent", "assigned_percent")
    return tuple((c, said(F.col(c))) for c in columns)


def unusable_reason() -> Column:
    """What makes a report unusable, in its figures."""
    return _listed((*_trust(), ("low_confidence_count", said(F.col("low_confidence_count")))))


def untrusted_reason() -> Column:
    """What makes a report untrusted, in its figures."""
    more = tuple((c, said(F.col(c))) for c in ("low_confidence_percent", "review_required_percent"))
    runs = tuple((c, said(F.col(c))) for c in ("max_post_long_uncertain_run", "segment_collapse_runs", "alignment_collapse_runs"))
    return _listed((*_trust(), *more, ("collapse_detected", said_bool(F.col("collapse_detected"))), *runs))


def raw_is_eligible() -> Column:
    """Whether raw recognition may stand in: its longest segment is not a merged section."""
    longest = F.coalesce(F.expr("try_cast(cast(raw_asr_max_segment_seconds as string) as double)"), F.lit(0.0))
    return (longest > 0.0) & (longest <= 12.0)


# Fields that a summary has of every candidate, and of some backends besides.
SUMMARY = ("backend", "strategy", "assigned_percent", "trusted_percent", "low_confidence_percent", "review_required_percent", "error")
SUMMARY_OF = {
    "ctc": ("ctc_device", "ctc_score_min", "ctc_score_mean", "ctc_low_score_count", "ctc_very_low_score_count", "ctc_missing_count"),
    "whisperx": ("whisper_suppress_nst", "whisperx_device"),
}


def summaries(reports: DataFrame) -> DataFrame:
    """(song, SUMMARY, quality, collapse_detected and the fields of SUMMARY_OF): those of other backends are null."""
    none = lambda c: F.col(c) if c in reports.columns else F.lit(None).cast("string")
    own = {c: F.when(F.col("backend") == kind, none(c)) for kind, columns in SUMMARY_OF.items() for c in columns}
    own["legacy_quality"] = F.when(F.col("backend") == "whisperx", F.round(report_quality(), 3))
    quality, collapse = F.round(selection_quality(), 3).alias("quality"), F.coalesce("collapse_detected", F.lit(False)).alias("collapse_detected")
    return reports.select("song", *[none(c).alias(c) for c in SUMMARY], quality, collapse, *[v.alias(k) for k, v in own.items()])


def _tenths(x: Column) -> Column:
    """One digit, ties to even as in the reports."""
    return F.format_string("%.1f", F.bround(x, 1))


def selection_reason(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """(song, reason): why a candidate was selected, with the figures of all in their order.

    chosen: song, selected, quality; candidates: song, ordinal, backend, error, quality and
    the figures of their reports.  A quality of 0 reads as -100 in the first part.
    """
    q = F.concat(F.lit("quality="), _tenths(F.col("quality")))
    review = F.concat(F.lit("review="), said(F.col("review_required_percent")))
    trust = F.concat(F.lit("trusted="), said(F.col("trusted_percent")))
    figures = {
        "ctc": (q, *[F.concat(F.lit(f"{k}="), said(F.col(c))) for k, c in (("low", "ctc_low_score_count"), ("very_low", "ctc_very_low_score_count"), ("missing", "ctc_missing_count"))]),
        "whisperx": (q, trust, review, F.concat(F.lit("collapse="), said_bool(F.col("collapse_detected")))),
        "whispercpp": (q, trust, review),
    }
    part = F.when(F.coalesce("error", F.lit("")) != "", F.concat("backend", F.lit(" error="), "error"))
    for kind, texts in figures.items():
        part = part.when(F.col("backend") == kind, F.concat(F.lit(f"{kind} "), F.concat_ws(", ", *texts)))
    told = candidates.select("song", F.struct("ordinal", part.alias("p")).alias("x")).filter("x.p is not null").groupBy("song").agg(F.array_sort(F.collect_list("x"))["p"].alias("parts"))
    rows = chosen.join(told, "song", "left")
    quality = F.when(F.col("quality") == 0, -100.0).otherwise(F.coalesce("quality", F.lit(-100.0)))
    head = F.concat(F.lit("selected "), F.coalesce("selected", F.lit("unknown")), F.lit(" quality="), _tenths(quality))
    tail = F.when(F.col("selected") == "ctc", "ctc is preferred on near-ties because it is forced to the known lyric order")
    return rows.select("song", F.concat_ws("; ", head, F.array_join("parts", "; "), tail).alias("reason"))


def attempted(reports: DataFrame, lines: DataFrame, backend: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Reports and lines of attempts: a failed one keeps its error (and the backend, if named) alone, and has no lines."""
    failed = F.coalesce("error", F.lit("")) != ""
    keep = {c: F.when(~failed, F.col(c)) for c in reports.columns if c not in ("song", "error", "backend", "whisper_suppress_nst", "diagnostic_only")}
    kept = reports.withColumns(keep)
    if backend is not None:
        kept = kept.withColumn("backend", F.lit(backend))
    return kept, lines.join(reports.filter(failed).select("song"), "song", "left_anti")


def raw_diagnostic(reports: DataFrame, segments: DataFrame, repeated: DataFrame) -> DataFrame:
    """Reports of raw recognition as a diagnostic: its segments, the longest of them, and whether its tail repeats itself.

    segments: song, seg_idx, start, end, text; repeated: song, repeated.
    """
    told = segments.groupBy("song").agg(
        F.array_sort(F.collect_list(F.struct("seg_idx", millis(F.col("start")).alias("start"), millis(F.col("end")).alias("end"), "text"))).alias("s"),
        millis(F.max(F.col("end") - F.col("start"))).alias("longest"),
    )
    told = told.select("song", F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))).alias("raw_asr_segments"), "longest")
    rows = reports.join(told, "song", "left").join(repeated.withColumnRenamed("repeated", "asr_repeated_tail_after_0s"), "song", "left")
    fixed = {"backend": F.lit("whispercpp_raw"), "strategy": F.lit("whispercpp-raw-diagnostic"), "diagnostic_only": F.lit(True), "raw_asr_max_segment_seconds": F.coalesce("longest", F.lit(0.0))}
    return rows.withColumns(fixed).drop("longest")


def sync_times(assignments: DataFrame, times: DataFrame) -> DataFrame:
    """Assignments with the final times, rounded to 3 digits; an entry without a time keeps its own.  times: song, entry, time."""
    rows = assignments.join(times.select("song", "entry", F.col("time").alias("__t")), ["song", "entry"], "left")
    return rows.withColumn("timestamp", F.coalesce(F.round("__t", 3), "timestamp")).drop("__t")


def choose_retry(normal: DataFrame, retry: DataFrame, normal_lines: DataFrame, gap: float = 15.0) -> DataFrame:
    """(song, use, splice_from, error): whether the normal candidate, the retry with suppressed tokens or a splice of both goes on.

    normal and retry: one report a song; normal_lines: song, entry, segment, score.  The
    retry is asked only where the normal one failed or is poor; it replaces it if better by
    ``gap``, is spliced on from the first run of four low lines if better at all, else
    replaces it if better.
    """
    a = normal.select("song", F.coalesce("error", F.lit("")).alias("error_a"), report_quality().alias("qa"), needs_retry().alias("poor"))
    b = retry.select("song", F.coalesce("error", F.lit("")).alias("error_b"), report_quality().alias("qb"))
    rows = a.join(b, "song", "left").join(low_run_start(normal_lines), "song", "left")
    failed, other = F.col("error_a") != "", F.col("qb").isNotNull() & (F.col("error_b") == "")
    better = F.col("poor") & other & (F.col("qb") > F.col("qa"))
    use = (
        F.when(failed & other, "retry")
        .when(failed, None)
        .when(F.col("poor") & other & (F.col("qb") - F.col("qa") >= gap), "retry")
        .when(better & F.col("first_entry").isNotNull(), "splice")
        .when(better, "retry")
        .otherwise("normal")
    )
    error = F.when(failed & ~F.coalesce(other, F.lit(False)), F.concat_ws(" | ", "error_a", F.when(F.col("error_b") != "", F.col("error_b"))))
    return rows.select("song", use.alias("use"), F.when(use == "splice", F.col("first_entry")).alias("splice_from"), error.alias("error"))


def splice(normal: DataFrame, retry: DataFrame, choice: DataFrame, blended: DataFrame) -> DataFrame:
    """(song, entry, time, source, adopted): lines of the chosen candidate; of a splice the retry's from ``splice_from`` on, and before it blended lines that are 0.40 to 1.60 s earlier there and fit.

    normal and retry: song, entry, timestamp; choice: song, use, splice_from; blended: song,
    entry of the retry's bounded blends.
    """
    mark = blended.select("song", "entry", F.lit(True).alias("blended")).distinct()
    both = normal.select("song", "entry", F.col("timestamp").alias("n")).join(retry.select("song", "entry", F.col("timestamp").alias("r")), ["song", "entry"], "full_outer")
    rows = both.join(choice.filter("use is not null").select("song", "use", "splice_from"), "song").join(mark, ["song", "entry"], "left")
    kind = normal.schema["song"].dataType.simpleString()

    def step(lines: list[dict]) -> list[dict]:
        use, tail = lines[0]["use"], lines[0]["splice_from"]
        later = [use == "retry" or (use == "splice" and x["entry"] >= tail) for x in lines]
        times = [x["r"] if late else x["n"] for x, late in zip(lines, later, strict=True)]
        out = []
        for i, x in enumerate(lines):
            adopted = False
            if use == "splice" and not later[i] and x["blended"] is True and 0.40 <= x["n"] - x["r"] <= 1.60:
                after = i + 1 >= len(times) or x["r"] < times[i + 1] - 0.10
                adopted = after and (not i or times[i - 1] + 0.10 < x["r"])
                if adopted:
                    times[i] = x["r"]
            out.append({"song": x["song"], "entry": x["entry"], "time": times[i], "source": "retry" if later[i] or adopted else "normal", "adopted": adopted})
        return out

    return fold_by_song(rows, step, f"song {kind}, entry int, time double, source string, adopted boolean")


def spliced_assignments(lines: DataFrame, normal: DataFrame, retry: DataFrame) -> DataFrame:
    """Assignments of a splice: each line's from its source, with the spliced time to 3 digits.  lines: as splice gives them; the others with equal columns."""
    columns = [c for c in normal.columns if c not in ("song", "entry", "timestamp")]
    every = normal.select("song", "entry", F.lit("normal").alias("source"), *columns).unionByName(retry.select("song", "entry", F.lit("retry").alias("source"), *columns))
    return lines.select("song", "entry", "source", F.round("time", 3).alias("timestamp")).join(every, ["song", "entry", "source"], "left")
