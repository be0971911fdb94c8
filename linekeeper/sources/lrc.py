"""Timed-text files: two parsers, anchors, a writer.

Files come in as rows (doc_id, content); ``read_texts`` makes them from a path.  The parsers
are plans over their lines, so a corpus of files is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.functions.text import is_marker, line_script, match_text, split_group
from linekeeper.functions.timing import TAG, clock, tag_cs
from linekeeper.operators.windows import islands
from linekeeper.sources.keyed import write_files

META = r"^\[[a-zA-Z]+:.*\]$"
# Fixed value: a line with one time tag or more, and its text.
TIMED = r"^\s*((?:\[[0-9]{1,3}:[0-9]{2}(?:\.[0-9]{1,3})?\])+)(.*)$"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, content) of text files; doc_id is the path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("content"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, raw, line) of the lines that aren't blank; a byte-order mark is dropped."""
    text = F.regexp_replace(F.coalesce("content", F.lit("")), "^﻿", "")
    rows = docs.select("doc_id", F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("idx", "raw"))
    return rows.withColumn("line", F.regexp_replace("raw", r"^\s+|\s+$", "")).filter("line <> ''")


def parse_lyrics(docs: DataFrame, skip_comments: bool = False) -> DataFrame:
    """(doc_id, entry, lines, time_cs) of lyric files.

    Lines with the same first tag in a row are one entry; lines without a tag are entries of
    their own, split into display lines; in a file without any tag, neighbours in two scripts
    that are a translation of each other are one entry.  Files without lyrics give no rows.
    """
    rows = _lines(docs)
    if skip_comments:
        rows = rows.filter(~F.col("line").startswith("#"))
    rows = rows.filter(~F.col("line").rlike(META))
    timed = F.col("raw").rlike(TIMED)
    shown = F.when(timed, split_group(F.regexp_extract("raw", TIMED, 2), keep_single=True)).otherwise(split_group(F.col("line")))
    rows = rows.select("doc_id", "idx", F.when(timed, tag_cs(F.regexp_extract("raw", TIMED, 1))).alias("time_cs"), shown.alias("shown")).filter(F.size("shown") > 0)
    order = Window.partitionBy("doc_id").orderBy("idx")
    joined = F.col("time_cs").isNotNull() & F.col("time_cs").eqNullSafe(F.lag("time_cs").over(order))
    rows = rows.withColumn("__new", ~F.coalesce(joined, F.lit(False)))
    rows = islands(rows, F.col("__new"), "entry", "doc_id", "idx")
    entries = rows.groupBy("doc_id", "entry").agg(F.array_sort(F.collect_list(F.struct("idx", "shown"))).alias("r"), F.first("time_cs").alias("time_cs"))
    entries = entries.select("doc_id", F.col("entry").cast("int").alias("entry"), F.flatten("r.shown").alias("lines"), "time_cs")
    return merge_translations(entries)


def merge_translations(entries: DataFrame) -> DataFrame:
    """Joins neighbours of one line each in {japanese, han} or {latin, han}, left to right, in files without times.

    Greedy pairing takes every other edge of a run of edges that qualify.
    """
    order = Window.partitionBy("doc_id").orderBy("entry")
    untimed = F.max(F.col("time_cs").isNotNull()).over(Window.partitionBy("doc_id")) == F.lit(False)
    script = F.when(untimed & (F.size("lines") == 1), line_script(F.element_at("lines", 1)))
    rows = entries.withColumn("script", script).withColumn("next_script", F.lead("script").over(order))
    pair = F.array_sort(F.array("script", "next_script"))
    edge = F.coalesce((pair == F.array(F.lit("han"), F.lit("japanese"))) | (pair == F.array(F.lit("han"), F.lit("latin"))), F.lit(False))
    rows = rows.withColumn("edge", edge).withColumn("__new", ~F.lag("edge", 1, False).over(order))
    rows = islands(rows, F.col("__new"), "run", "doc_id", "entry")
    place = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("entry"))
    rows = rows.withColumn("takes", F.col("edge") & (place % 2 == 1))
    taken, after = F.lag("takes", 1, False).over(order), F.lead("lines").over(order)
    rows = rows.withColumn("__gone", taken).withColumn("lines", F.when(F.col("takes"), F.concat("lines", after)).otherwise(F.col("lines")))
    kept = rows.filter(~F.col("__gone"))
    return kept.select("doc_id", F.row_number().over(order).alias("entry"), "lines", "time_cs")


def parse_for_evaluation(docs: DataFrame) -> DataFrame:
    """(doc_id, entry, time_cs, lines) by the evaluator's rules: lines without a leading tag are ignored, texts are kept as they are."""
    tag = "^" + TAG + "(.*)$"
    rows = _lines(docs).filter(~F.col("line").rlike(r"^\[[A-Za-z]+:") & F.col("line").rlike(tag))
    rows = rows.select("doc_id", "idx", tag_cs(F.col("line")).alias("time_cs"), F.regexp_extract("line", tag, 4).alias("text"))
    order = Window.partitionBy("doc_id").orderBy("idx")
    rows = rows.withColumn("__new", ~F.coalesce(F.col("time_cs") == F.lag("time_cs").over(order), F.lit(False)))
    rows = islands(rows, F.col("__new"), "entry", "doc_id", "idx")
    out = rows.groupBy("doc_id", "entry").agg(F.first("time_cs").alias("time_cs"), F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("r"))
    return out.select("doc_id", F.col("entry").cast("int").alias("entry"), "time_cs", F.col("r.text").alias("lines"))


def title_card() -> Column:
    """A zero-time entry of one line with ' - '."""
    return (F.col("time_cs") == 0) & (F.size("lines") == 1) & F.contains(F.element_at("lines", 1), F.lit(" - "))


def for_evaluation(entries: DataFrame, ignore_markers: bool = False) -> DataFrame:
    """Entries without title cards (and markers), numbered anew."""
    kept = entries.filter(~title_card())
    if ignore_markers:
        kept = kept.filter(~is_marker(F.element_at("lines", 1), strict=False, normal=False))
    return kept.withColumn("entry", F.row_number().over(Window.partitionBy("doc_id").orderBy("entry")))


def drop_title_cards(entries: DataFrame, titles: DataFrame) -> DataFrame:
    """Lyric entries without generated cards: a zero-time line with '-' and the title, or a first untimed line equal to it.  titles: doc_id, title."""
    norm, title = match_text(F.element_at("lines", 1)), match_text(F.col("title"))
    card = (F.col("time_cs") == 0) & (F.size("lines") == 1) & F.contains(F.element_at("lines", 1), F.lit("-")) & F.contains(norm, title)
    head = (F.col("entry") == 1) & F.col("time_cs").isNull() & (norm == title)
    kept = entries.join(titles, "doc_id", "left").filter(~F.coalesce(card | head, F.lit(False))).drop("title")
    return kept.withColumn("entry", F.row_number().over(Window.partitionBy("doc_id").orderBy("entry")))


def drop_markers(entries: DataFrame) -> DataFrame:
    """Lyric entries that have words, numbered anew."""
    kept = entries.filter(~is_marker(F.element_at("lines", 1)))
    return kept.withColumn("entry", F.row_number().over(Window.partitionBy("doc_id").orderBy("entry")))


def parse_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, hint_idx, entry_number, lines, time_cs, error): a '# entry=N' line names the entry of the next hint; other comments and markers are ignored; an untimed line is an error."""
    note = r"^#\s*entry\s*=\s*([0-9]+)"
    rows = _lines(docs).filter(~F.col("line").rlike(META))
    rows = rows.filter(~F.col("line").startswith("#") | F.col("line").rlike(note))
    named = F.when(F.col("line").rlike(note), F.regexp_extract("line", note, 1).cast("int"))
    order = Window.partitionBy("doc_id").orderBy("idx")
    rows = rows.withColumn("entry_number", F.lag(named).over(order)).filter(~F.col("line").startswith("#"))
    timed = F.col("raw").rlike(TIMED)
    text = F.when(timed, F.regexp_extract("raw", TIMED, 2)).otherwise(F.col("line"))
    rows = rows.select("doc_id", "idx", "entry_number", F.when(timed, tag_cs(F.regexp_extract("raw", TIMED, 1))).alias("time_cs"), split_group(text, True).alias("shown"), F.when(~timed, "untimed line").alias("error"))
    rows = rows.filter((F.size("shown") > 0) & ~is_marker(F.element_at("shown", 1), normal=False))
    same = (F.col("time_cs") == F.lag("time_cs").over(order)) & F.col("entry_number").isNull()
    rows = islands(rows.withColumn("__new", ~F.coalesce(same, F.lit(False))), F.col("__new"), "hint_idx", "doc_id", "idx")
    out = rows.groupBy("doc_id", "hint_idx").agg(
        F.first("entry_number").alias("entry_number"), F.flatten(F.array_sort(F.collect_list(F.struct("idx", "shown"))).getField("shown")).alias("lines"), F.first("time_cs").alias("time_cs"), F.max("error").alias("error")
    )
    return out.withColumn("hint_idx", F.col("hint_idx").cast("int"))


def lrc_text(entries: DataFrame, heads: DataFrame, generator: str = "timeline engine") -> DataFrame:
    """(doc_id, content) of finished files.  entries: doc_id, entry, lines, t (seconds); heads: doc_id, artist, title, duration."""
    body = F.transform("lines", lambda x: F.concat(F.lit("["), clock(F.col("t")), F.lit("]"), x))
    rows = entries.withColumn("body", body).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("entry", "body"))).alias("r"))
    label = F.trim(F.concat_ws(" ", "artist", "title"))
    card = F.when(F.coalesce("artist", F.lit("")) != "", F.concat_ws(" - ", "artist", "title")).otherwise(F.col("title"))
    top = F.array(F.concat(F.lit("[ti:"), label, F.lit("]")), F.lit(f"[re:{generator}]"), F.concat(F.lit("[length:"), clock(F.col("duration")), F.lit("]")), F.lit("[by:timeline engine]"), F.concat(F.lit("[00:00.00]"), card))
    joined = heads.join(rows, "doc_id", "left").select("doc_id", F.concat(top, F.coalesce(F.flatten("r.body"), F.array().cast("array<string>"))).alias("all"))
    return joined.select("doc_id", F.concat(F.lit("﻿"), F.array_join("all", "\n"), F.lit("\n")).alias("content"))


def write_texts(docs: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """One file for each row (doc_id, content), named by the last part of doc_id; returns (doc_id, file).

    An existing file is an error unless ``overwrite``, as are rows that share a name; then,
    and where a task fails, nothing is written.
    """
    name = F.element_at(F.split("doc_id", r"[/\\]"), -1)
    write_files(docs.select(name.alias("name"), "content"), path, overwrite)
    return docs.select("doc_id", F.concat(F.lit(path.rstrip("/") + "/"), name).alias("file"))


def existing_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_name, mtime) of the files of a folder; none if it doesn't exist."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "path string, file_name string, mtime timestamp")
    found = spark.read.format("binaryFile").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("modificationTime").alias("mtime"))
