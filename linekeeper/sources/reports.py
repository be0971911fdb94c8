"""Evidence and reports: schemas, newest per key, audit rows, corpus roll-up, Markdown and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.functions.text import file_stem, match_text, report_key
from linekeeper.functions.timing import audit_clock, truthy
from linekeeper.operators.metrics import weighted_percent
from linekeeper.sources.shared import dealt

SEGMENTS = "song STRING, source STRING, seg_idx INT, start DOUBLE, end DOUBLE, text STRING, score DOUBLE, chars ARRAY<STRUCT<ch: STRING, t: DOUBLE>>"
SPANS = "ARRAY<STRUCT<char: STRING, start: DOUBLE, end: DOUBLE, score: DOUBLE>>"
PEAKS = "ARRAY<STRUCT<time: DOUBLE, score: DOUBLE>>"
ASSIGNMENTS = f"song STRING, backend STRING, entry INT, segment INT, score DOUBLE, timestamp DOUBLE, ctc_score DOUBLE, token_spans {SPANS}, peaks {PEAKS}, timing_repair STRING, timing_trusted BOOLEAN"


def read_evidence(spark: SparkSession, path: str, schema: str, indented: bool = True) -> DataFrame:
    """JSON evidence under a fixed schema: nothing is inferred.  ``indented``: a file is one value over many lines, else each line is one."""
    return spark.read.schema(schema).option("multiLine", indented).json(path)


def asr_segments(raw: DataFrame) -> DataFrame:
    """Segments of a recogniser's JSON (song, transcription: array of offsets in ms and text), blank texts dropped."""
    rows = raw.select("song", F.posexplode("transcription").alias("seg_idx", "x"))
    out = rows.select("song", "seg_idx", (F.col("x.offsets.from") / 1000.0).alias("start"), (F.col("x.offsets.to") / 1000.0).alias("end"), F.trim("x.text").alias("text"))
    return out.filter("text <> ''")


ALIGNED = "song STRING, segments ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, chars: ARRAY<STRUCT<char: STRING, start: DOUBLE>>>>"


def aligned_segments(raw: DataFrame) -> DataFrame:
    """(song, seg_idx, start, end, text, chars) of an aligner's JSON (ALIGNED): characters in normal form, each with its own time.

    Blank segments, and those without characters that are shorter than 0.05 s, are dropped.
    A missing start is 0, a missing end the start; a character without a start is left out.
    """
    rows = raw.select("song", F.posexplode("segments").alias("seg_idx", "x")).select("song", "seg_idx", "x.*")
    start = F.coalesce("start", F.lit(0.0))
    rows = rows.withColumns({"text": F.trim("text"), "start": start, "end": truthy(F.col("end"), start)}).filter("text <> ''")
    marks = rows.select("song", "seg_idx", "start", F.posexplode("chars").alias("k", "c")).filter("c.start is not null")
    marks = marks.select("song", "seg_idx", "k", truthy(F.col("c.start"), F.col("start")).alias("t"), match_text(F.col("c.char")).alias("ch"))
    marks = marks.select("song", "seg_idx", "k", "t", F.posexplode(F.split("ch", "")).alias("j", "ch")).filter("ch <> ''")
    spelled = marks.groupBy("song", "seg_idx").agg(F.array_sort(F.collect_list(F.struct("k", "j", "ch", "t"))).alias("r"))
    spelled = spelled.select("song", "seg_idx", F.transform("r", lambda c: F.struct(c["ch"].alias("ch"), c["t"].alias("t"))).alias("chars"))
    out = rows.drop("chars").join(spelled, ["song", "seg_idx"], "left").filter(F.col("chars").isNotNull() | (F.col("end") - F.col("start") >= 0.05))
    order = Window.partitionBy("song").orderBy("seg_idx")
    return out.select("song", (F.row_number().over(order) - 1).alias("seg_idx"), "start", "end", "text", F.coalesce("chars", F.array().cast("array<struct<ch:string,t:double>>")).alias("chars"))


def transcript(segments: DataFrame) -> DataFrame:
    """(song, transcript): start, end and text of a song's segments in order, blank ones left out."""
    kept = segments.filter(F.trim("text") != "")
    one = F.array_sort(F.collect_list(F.struct("seg_idx", "start", "end", "text")))
    return kept.groupBy("song").agg(one.alias("r")).select("song", F.transform("r", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))).alias("transcript"))


def newest_reports(reports: DataFrame) -> DataFrame:
    """The newest report under each of its names.  reports: path, output_path, mtime, ... and, where they exist, audio_path and title; a later file wins."""
    names = [c for c in ("path", "output_path", "audio_path", "title") if c in reports.columns]
    keys = F.array_distinct(F.filter(F.transform(F.array(*names), report_key), lambda k: k.isNotNull() & (k != "")))
    named = reports.withColumn("key", F.explode(keys))
    columns = [c for c in reports.columns]
    return named.groupBy("key").agg(F.max_by(F.struct(*columns), F.struct("mtime", "path")).alias("r")).select("key", "r.*")


def cases(references: DataFrame, reports: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Checked references joined with the newest report of their key; category by map, else inferred from the title."""
    refs = references.withColumn("key", report_key(F.col("reference")))
    joined = refs.join(newest_reports(reports).withColumnRenamed("title", "report_title"), "key")
    if categories is not None:
        joined = joined.join(categories.select(report_key(F.col("name")).alias("key"), F.col("category").alias("mapped")), "key", "left")
    else:
        joined = joined.withColumn("mapped", F.lit(None).cast("string"))
    return joined.withColumn("category", F.coalesce("mapped", infer_category(F.col("reference")))).drop("mapped")


def read_category_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, category) of a JSON object {name: category}; a file that is none is an error."""
    text = spark.read.text(path, wholetext=True)
    held = text.select(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("m"))
    return held.select(F.explode("m").alias("name", "category"))


# Words of a title that tell its category, the first rule that applies, and the category of all others.
CATEGORIES = (
    (("ツユ", "雨", "過去", "終点", "バス", "朧月夜"), "high-density / complex Japanese"),
    (("MyGO", "影色舞", "春日影"), "band / dense mix"),
    (("鸣潮", "OST", "Original Soundtrack"), "OST / sparse vocal"),
    (("Elegy", "Reveries"), "standard / English vocal"),
)
OTHER_CATEGORY = "standard / Japanese vocal"


def infer_category(title: Column) -> Column:
    rules = [(F.greatest(*[F.contains(title, F.lit(w)) for w in words], F.lit(False)), name) for words, name in CATEGORIES]
    return F.coalesce(*[F.when(hit, F.lit(name)) for hit, name in rules], F.lit(OTHER_CATEGORY))


# Columns of an audit and of a roll-up, in order.
AUDIT_COLUMNS = (
    "entry", "time", "review", "severity", "score", "ctc_score", "spread", "output", "whisperx", "ctc", "raw", "forced_first", "chosen_time", "confidence",
    "decision_reasons", "decision_penalties", "split_suggestion", "timing_trusted", "timing_trust_reason", "timing_trust_sources", "ctc_tokens",
    "ctc_first_token_candidates", "flags", "text",
)
ROW_COLUMNS = (
    "case", "category", "mode", "status", "backend", "selected_backend", "ctc_audio_source", "ctc_device", "reference_entries", "generated_entries", "text_mismatches",
    "max_abs_delta_cs", "mean_abs_delta_cs", "within_10cs_percent", "within_25cs_percent", "within_50cs_percent", "within_100cs_percent", "trusted_percent",
    "assigned_percent", "low_confidence_percent", "review_required_percent", "review_required_count", "error", "reference", "generated", "report",
)


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def fixed(c: Column, digits: int) -> Column:
    """Digits after the point without separators; '' for null."""
    return F.when(c.isNull(), "").otherwise(F.format_string(f"%.{digits}f", c))


def flat_lines(lines: Column) -> Column:
    """Display lines in a row, blank ones left out."""
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), " / ")


def joined(values: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(values, lambda x: x.cast("string")), ";"), F.lit(""))


def candidate_value(times: Column, key: str) -> Column:
    """Clock text of a candidate's time, '' without one."""
    return audit_clock(F.try_element_at(times, F.lit(key)))


def candidate_spread(times: Column) -> Column:
    """Seconds between the first and the last of two times or more, else null."""
    values = F.filter(F.map_values(times), lambda x: x.isNotNull())
    return F.when(F.size(values) >= 2, F.array_max(values) - F.array_min(values))


def token_spans_text(spans: Column, limit: int = 6) -> Column:
    """``char@time/score`` of the first spans; those without a character or a start are left out."""
    kept = F.filter(F.slice(spans, 1, limit), lambda s: (F.coalesce(s["char"], F.lit("")) != "") & s["start"].isNotNull())
    parts = F.transform(kept, lambda s: F.concat(s["char"], F.lit("@"), audit_clock(s["start"]), F.when(s["score"].isNull(), "").otherwise(F.concat(F.lit("/"), fixed(s["score"], 3)))))
    return F.coalesce(F.array_join(parts, ";"), F.lit(""))


def token_candidates_text(peaks: Column, limit: int = 4) -> Column:
    """``time/score`` of the first peaks."""
    kept = F.filter(F.slice(peaks, 1, limit), lambda p: p["time"].isNotNull())
    parts = F.transform(kept, lambda p: F.concat(audit_clock(p["time"]), F.when(p["score"].isNull(), "").otherwise(F.concat(F.lit("/"), fixed(p["score"], 3)))))
    return F.coalesce(F.array_join(parts, ";"), F.lit(""))


def penalties_text(penalties: Column) -> Column:
    """``kind:value`` of each penalty (kind, value); the kind alone without a value."""
    parts = F.transform(penalties, lambda p: F.concat(F.coalesce(p["kind"], F.lit("penalty")), F.when(p["value"].isNull(), "").otherwise(F.concat(F.lit(":"), fixed(p["value"], 2)))))
    return F.coalesce(F.array_join(parts, ";"), F.lit(""))


def selected_backend() -> Column:
    """The backend that the choice of candidates names, else the report's own."""
    return F.coalesce("candidate_selection.selected_backend", "backend", F.lit(""))


def metric_float(name: str) -> Column:
    """A metric as a number; null where it is none."""
    return F.expr(f"try_cast(cast({name} as string) as double)")


def last_by_entry(items: DataFrame, *keys: str) -> DataFrame:
    """The last of the items of each entry, as struct ``item``; items: keys, entry, ordinal, ..."""
    columns = [c for c in items.columns if c not in (*keys, "entry", "ordinal")]
    return items.filter("entry is not null").groupBy(*keys, "entry").agg(F.max_by(F.struct(*columns), "ordinal").alias("item"))


def audit_rows(entries: DataFrame, assignments: DataFrame, risks: DataFrame, review_only: bool = False) -> DataFrame:
    """(song, AUDIT_COLUMNS as texts): entries with their last assignment and risk.

    entries: song, entry, time_cs, lines.  assignments: song, entry, ordinal, score, ctc_score,
    chosen_time, confidence, reasons, penalties (kind, value), split, timing_trusted,
    trust_reason, trust_sources, trust_times (map), token_spans, peaks.  risks: song, entry,
    ordinal, flags, severity, review_required, cand_ts (map), token_spans, peaks.
    """
    # wide rows that compress to a few bytes: tasks sized by those would sort gigabytes
    entries, assignments, risks = (dealt(x, "song", "entry", each=8) for x in (entries, assignments, risks))
    rows = entries.join(last_by_entry(assignments, "song").withColumnRenamed("item", "a"), ["song", "entry"], "left")
    rows = rows.join(last_by_entry(risks, "song").withColumnRenamed("item", "k"), ["song", "entry"], "left")
    risky = F.col("k").isNotNull()
    times = F.when(risky, F.col("k.cand_ts")).otherwise(F.col("a.trust_times"))
    # an empty list of an assignment gives way to the risk's
    own = lambda name: F.when(F.size(f"a.{name}") > 0, F.col(f"a.{name}")).otherwise(F.col(f"k.{name}"))
    trusted = F.coalesce("a.timing_trusted", F.lit(False))
    clock = audit_clock(F.col("time_cs") / 100.0)
    first = lambda *c: F.coalesce(*[F.when(x != "", x) for x in c], clock)
    flags = F.concat_ws(";", F.when(joined(F.col("k.flags")) != "", joined(F.col("k.flags"))), F.when(trusted, F.lit("timing_trusted")))
    values = {
        "entry": F.col("entry").cast("string"),
        "time": clock,
        "review": F.when(risky & F.coalesce("k.review_required", F.lit(False)), "yes").otherwise("no"),
        "severity": blank(F.col("k.severity")),
        "score": fixed(F.col("a.score"), 3),
        "ctc_score": fixed(F.col("a.ctc_score"), 6),
        "spread": fixed(candidate_spread(times), 3),
        "output": first(candidate_value(times, "output"), candidate_value(times, "selected")),
        "whisperx": candidate_value(times, "whisperx"),
        "ctc": candidate_value(times, "ctc"),
        "raw": candidate_value(times, "raw"),
        "forced_first": candidate_value(times, "whisperx_forced_first"),
        "chosen_time": F.when(F.col("a.chosen_time").isNotNull(), audit_clock(F.col("a.chosen_time"))).otherwise(clock),
        "confidence": fixed(F.col("a.confidence"), 3),
        "decision_reasons": joined(F.col("a.reasons")),
        "decision_penalties": penalties_text(F.col("a.penalties")),
        "split_suggestion": blank(F.col("a.split")),
        "timing_trusted": F.when(trusted, "yes").otherwise("no"),
        "timing_trust_reason": F.when(trusted, blank(F.col("a.trust_reason"))).otherwise(""),
        "timing_trust_sources": F.when(trusted, joined(F.col("a.trust_sources"))).otherwise(""),
        "ctc_tokens": token_spans_text(own("token_spans")),
        "ctc_first_token_candidates": token_candidates_text(own("peaks")),
        "flags": flags,
        "text": flat_lines(F.col("lines")),
    }
    out = rows.select("song", F.col("entry").alias("__n"), *[values[c].alias(c) for c in AUDIT_COLUMNS])
    return out.filter("review = 'yes'") if review_only else out


def by_document(rows: DataFrame, line: Column, order: Column, *keys: str) -> DataFrame:
    """(keys, lines): each document's lines in order."""
    made = rows.select(*keys, order.alias("__o"), line.alias("__l")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__o", "__l"))).alias("__r"))
    return made.select(*keys, F.col("__r.__l").alias("lines"))


BOM = "\ufeff"


def csv_text(rows: DataFrame, columns: tuple[str, ...], order: Column, *keys: str) -> DataFrame:
    """(keys, content): one CSV file with a byte-order mark, a head and CRLF line ends for each document."""
    quoted = lambda v: F.when(v.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    line = F.concat_ws(",", *[quoted(blank(F.col(c))) for c in columns])
    out = by_document(rows, line, order, *keys)
    return out.select(*keys, F.concat(F.lit(BOM + ",".join(columns) + "\r\n"), F.array_join("lines", "\r\n"), F.lit("\r\n")).alias("content"))


def audit_csv(audit: DataFrame) -> DataFrame:
    """(song, content) of audit_rows' rows."""
    return csv_text(audit, AUDIT_COLUMNS, F.col("__n"), "song")


def audit_markdown(audit: DataFrame, reports: DataFrame) -> DataFrame:
    """(song, content): six bullets on the report and a table of the rows; a song without rows has an empty table.

    reports: song, backend, strategy, timing_entries, trusted_percent, timing_trusted_entries, review_required_count.
    """
    named = (("out ", "output"), ("wx ", "whisperx"), ("ctc ", "ctc"), ("raw ", "raw"), ("ff ", "forced_first"), ("ctc-tok ", "ctc_tokens"), ("ctc-first ", "ctc_first_token_candidates"))
    held = F.concat_ws(", ", *[F.when(F.col(c) != "", F.concat(F.lit(k), F.col(c))) for k, c in named])
    held = F.concat(held, F.when(F.col("flags") != "", F.concat(F.lit("<br>"), "flags")).otherwise(""))
    trust = F.concat_ws("<br>", F.when(F.col("timing_trusted") == "yes", "trusted"), *[F.when(F.col(c) != "", F.col(c)) for c in ("timing_trust_reason", "timing_trust_sources")])
    cells = [*map(F.col, ("entry", "time", "chosen_time", "confidence", "review")), trust, *map(F.col, ("severity", "spread", "score")), held, F.replace("text", F.lit("|"), F.lit("\\|"))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    bullets = (("backend", "backend"), ("strategy", "strategy"), ("timing entries", "timing_entries"), ("trusted percent", "trusted_percent"), ("timing-trusted entries", "timing_trusted_entries"), ("review required", "review_required_count"))
    head = F.array(F.lit("# Alignment Audit"), F.lit(""), *[F.concat(F.lit(f"- {k}: `"), blank(F.col(c)), F.lit("`")) for k, c in bullets], F.lit(""))
    table = F.array(F.lit("| # | time | chosen | confidence | review | trust | severity | spread | score | candidates | text |"), F.lit("|---:|---:|---:|---:|:---:|---|:---:|---:|---:|---|---|"))
    both = reports.join(by_document(audit, line, F.col("__n"), "song"), "song", "left")
    every = F.concat(head, table, F.coalesce("lines", F.array().cast("array<string>")))
    return both.select("song", F.concat(F.array_join(every, "\n"), F.lit("\n")).alias("content"))


def anchor_template(audit: DataFrame) -> DataFrame:
    """(song, content): rows as anchors for a person to check; the name of the file keeps it from being applied.  Rows without text are left out."""
    first = F.trim(F.element_at(F.split("text", " / "), 1))
    rows = audit.withColumn("__first", first).filter("__first <> ''")
    line = F.concat(F.lit("# entry="), "entry", F.lit("\n["), "time", F.lit("]"), "__first")
    notes = (
        "# Review these timestamps manually, then rename/copy to .anchors.lrc only after checking.",
        "# This file is intentionally named .anchor-template.lrc so it is not auto-applied.",
        "# Lines starting with # are ignored when this is copied to .anchors.lrc.",
    )
    every = audit.select("song").distinct().join(by_document(rows, line, F.col("__n"), "song"), "song", "left")
    lines = F.concat(F.array(*map(F.lit, notes)), F.coalesce("lines", F.array().cast("array<string>")))
    return every.select("song", F.concat(F.lit(BOM), F.array_join(lines, "\n"), F.lit("\n")).alias("content"))


def report_paths(songs: DataFrame, folder: str) -> DataFrame:
    """Adds report_path, audit_path and template_path: the audio's stem and ten digits of the hash of both paths.  songs: audio_path, output_path."""
    digest = F.left(F.sha2(F.encode(F.lower(F.concat("audio_path", F.lit("\0"), "output_path")), "UTF-8"), 256), F.lit(10))
    stem = F.concat(F.lit(folder.rstrip("/") + "/"), file_stem(F.col("audio_path")), F.lit("--"), digest)
    ends = {"report_path": ".align-report.json", "audit_path": ".review-audit.md", "template_path": ".anchor-template.lrc"}
    return songs.withColumns({k: F.concat(stem, F.lit(v)) for k, v in ends.items()})


def report_json(reports: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, content): each row's other columns as indented JSON, nulls kept."""
    columns = [c for c in reports.columns if c != key]
    text = F.to_json(F.struct(*columns), {"pretty": "true", "ignoreNullFields": "false"})
    return reports.select(key, F.concat(text, F.lit("\n")).alias("content"))


def review_files(entries: DataFrame, assignments: DataFrame, risks: DataFrame, reports: DataFrame, paths: DataFrame, review_only: bool = True) -> DataFrame:
    """(doc_id, content) of the audit and the anchor template of songs; doc_id is the file's path.  paths: song, audit_path, template_path."""
    audit = audit_rows(entries, assignments, risks, review_only)
    pages = audit_markdown(audit, reports).join(paths, "song").select(F.col("audit_path").alias("doc_id"), "content")
    return pages.unionByName(anchor_template(audit).join(paths, "song").select(F.col("template_path").alias("doc_id"), "content"))


def existing_output(cases: DataFrame, files: DataFrame, use_reference: bool = False) -> DataFrame:
    """Adds generated, error and mode: the file that a case is judged by.  cases: reference, output_path; files: path."""
    if use_reference:
        return cases.withColumns({"generated": F.col("reference"), "error": F.lit(""), "mode": F.lit("checked-reference-as-final-output")})
    there = files.select(F.col("path").alias("__path"), F.lit(True).alias("__there")).distinct()
    rows = cases.join(there, F.col("output_path") == F.col("__path"), "left")
    error = F.when(F.col("output_path").isNull(), "missing output_path in report").when(F.col("__there").isNull(), F.concat(F.lit("missing generated output: "), "output_path")).otherwise("")
    return rows.withColumns({"generated": F.col("output_path"), "error": error, "mode": F.lit("existing-report-output")}).drop("__path", "__there")


METRICS = ("reference_entries", "generated_entries", "text_mismatches", "max_abs_delta_cs", "mean_abs_delta_cs", "within_10cs_percent", "within_25cs_percent", "within_50cs_percent", "within_100cs_percent")


def evaluate_rows(cases: DataFrame, metrics: DataFrame) -> DataFrame:
    """ROW_COLUMNS of each case: SKIP with its error, ERROR where no metrics came of it, else OK with them.

    cases: case, category, mode, error, reference, generated, report and the report's fields;
    metrics: case and METRICS, as positional_eval gives them.
    """
    rows = cases.join(metrics.select("case", *METRICS, F.lit(True).alias("__judged")), "case", "left")
    failed = (F.col("error") == "") & F.col("generated").isNotNull() & F.col("__judged").isNull()
    status = F.when(F.col("error") != "", "SKIP").when(failed, "ERROR").otherwise("OK")
    device = F.coalesce("ctc_device", "whisperx_device", F.lit(""))
    rows = rows.withColumns(
        {
            "status": status,
            "error": F.when(failed, "no metrics").otherwise(F.col("error")),
            "selected_backend": selected_backend(),
            "backend": F.coalesce("backend", F.lit("")),
            "ctc_audio_source": F.coalesce("ctc_audio_source", F.lit("")),
            "ctc_device": device,
            **{c: metric_float(c) for c in ("trusted_percent", "assigned_percent", "low_confidence_percent", "review_required_percent")},
            "generated": F.coalesce("generated", F.lit("")),
            **{c: F.when(F.col("error") == "", F.col(c)) for c in METRICS},
        }
    )
    return rows.select(*ROW_COLUMNS)


def rows_csv(rows: DataFrame) -> DataFrame:
    """(content): evaluate_rows as one CSV file, in the order of cases."""
    return csv_text(rows.withColumn("__all", F.lit(1)), ROW_COLUMNS, F.col("case"), "__all").drop("__all")


def summary_markdown(rows: DataFrame) -> DataFrame:
    """(content): roll-up by category and results by song of the OK rows, and a list of the others."""
    good = rows.filter("status = 'OK'")
    entries = F.coalesce(F.col("reference_entries"), F.lit(0))
    share = lambda c: fixed(F.coalesce(F.round(F.sum(F.when(entries > 0, F.col(c) * entries)) / F.sum(F.when((entries > 0) & F.col(c).isNotNull(), entries)), 2), F.lit(0.0)), 2)
    shares = ("within_10cs_percent", "within_25cs_percent", "within_50cs_percent", "trusted_percent", "review_required_percent")
    kinds = good.groupBy("category").agg(
        F.count(F.lit(1)).cast("string").alias("n"), F.sum(entries).cast("string").alias("entries"), *[F.concat(share(c), F.lit("%")).alias(c) for c in shares],
        F.concat(fixed(F.max(F.coalesce("max_abs_delta_cs", F.lit(0))) / 100.0, 2), F.lit("s")).alias("worst"),
    )
    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *c), F.lit(" |"))
    percent = lambda c: F.concat(fixed(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 2), F.lit("%"))
    worst = F.when(F.col("max_abs_delta_cs").isNull(), "").otherwise(F.concat(fixed(F.col("max_abs_delta_cs") / 100.0, 2), F.lit("s")))
    backend = F.coalesce(F.when(F.col("selected_backend") != "", F.col("selected_backend")), "backend", F.lit(""))
    song = cells(F.replace("case", F.lit("|"), F.lit("\\|")), "category", backend, F.when(entries > 0, entries.cast("string")).otherwise(""), percent("within_25cs_percent"), worst, percent("trusted_percent"), F.coalesce(F.col("review_required_count").cast("string"), F.lit("0")))
    parts = [
        by_document(kinds.withColumn("__all", F.lit(1)), cells("category", "n", "entries", *shares, "worst"), F.col("category"), "__all").withColumnRenamed("lines", "kinds"),
        by_document(good.withColumn("__all", F.lit(1)), song, F.col("case"), "__all").withColumnRenamed("lines", "songs"),
        by_document(rows.filter("status <> 'OK'").withColumn("__all", F.lit(1)), F.concat(F.lit("- "), "case", F.lit(": "), "error"), F.col("case"), "__all").withColumnRenamed("lines", "others"),
    ]
    one = rows.sparkSession.range(1).select(F.lit(1).alias("__all"))
    for part in parts:
        one = one.join(part, "__all", "left")
    none = F.array().cast("array<string>")
    head = (
        "# Quantitative Alignment Summary", "", "Generated from local checked references and alignment reports. Audio, lyrics, generated LRCs, and reports are not committed.", "",
        "| Category | Songs | Entries | <=0.10s | <=0.25s | <=0.50s | Trusted | Review required | Max error |", "|---|---:|---:|---:|---:|---:|---:|---:|---:|",
    )
    middle = ("", "## Per-Song Results", "", "| Song | Category | Backend | Entries | <=0.25s | Max error | Trusted | Review count |", "|---|---|---|---:|---:|---:|---:|---:|")
    tail = F.when(F.col("others").isNull(), none).otherwise(F.concat(F.array(*map(F.lit, ("", "## Skipped / Errors", ""))), F.col("others")))
    every = F.concat(F.array(*map(F.lit, head)), F.coalesce("kinds", none), F.array(*map(F.lit, middle)), F.coalesce("songs", none), tail)
    return one.select(F.concat(F.array_join(every, "\n"), F.lit("\n")).alias("content"))


def markdown(rows: DataFrame, *columns: str) -> DataFrame:
    """One column ``value`` of table lines, cells escaped."""
    cells = [F.concat(F.lit(" "), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit(" ")) for c in columns]
    return rows.select(F.concat(F.lit("|"), F.concat_ws("|", *cells), F.lit("|")).alias("value"))


def corpus_rollup(rows: DataFrame) -> DataFrame:
    """Songs, entries and weighted percents of each category, of rows with status OK."""
    good = rows.filter("status = 'OK'")
    out = good.groupBy("category").agg(F.count(F.lit(1)).alias("songs"), F.sum("entries").alias("entries"))
    for name in ("within_25cs_percent", "within_50cs_percent", "trusted_percent", "review_required_percent"):
        part = weighted_percent(good, name, "entries", "category").select("category", F.col("weighted").alias(name))
        out = out.join(part, "category", "left")
    return out


def write_csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)
