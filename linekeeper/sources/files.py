"""Which files belong to a song: lyrics, anchors, checked files and reports, by joins with a listing.

A listing has a row (path, mtime) for each file; candidates are rows too, so that a library
of songs is searched in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linekeeper.functions.text import file_name, file_stem, match_text, with_suffix
from linekeeper.operators.metrics import latest

# Endings of the files beside a song, in the order in which they are tried.
LYRICS = (".lyrics.lrc", ".lyrics.txt", ".txt")
ANCHORS = (".anchors.lrc", ".anchors.txt", ".anchor.lrc", ".anchor.txt")
REPORT = ".align-report.json"
TEMPLATE = ".anchor-template."


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, mtime) of the files under a path, found without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*$", "")


def checked_candidates(audio: Column) -> Column:
    """Paths of a checked file: the audio's stem in each folder above it that is named music, the nearest first."""
    parts = F.split(_folder(audio), "/")
    ups = F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))
    named = F.filter(F.transform(ups, lambda n: F.array_join(F.slice(parts, 1, n), "/")), lambda p: F.lower(file_name(p)) == "music")
    return F.transform(named, lambda p: F.concat(p, F.lit("/"), file_stem(audio), F.lit(".lrc")))


def lyrics_candidates(audio: Column) -> Column:
    beside = F.array(*[with_suffix(audio, x) for x in LYRICS], F.concat(_folder(audio), file_stem(audio), F.lit(".lyrics")))
    return F.concat(beside, checked_candidates(audio))


def anchor_candidates(audio: Column) -> Column:
    return F.array(*[with_suffix(audio, x) for x in ANCHORS])


def first_existing(songs: DataFrame, candidates: Column, files: DataFrame, out: str, key: str = "song") -> DataFrame:
    """Adds ``out``: the first of a song's candidates that the listing has, or null."""
    asked = songs.select(key, F.posexplode(candidates).alias("__k", "__path"))
    there = asked.join(files.select(F.col("path").alias("__path")).distinct(), "__path", "left_semi")
    return songs.join(there.groupBy(key).agg(F.min_by("__path", "__k").alias(out)), key, "left")


def find_lyrics(songs: DataFrame, files: DataFrame) -> DataFrame:
    """Adds lyrics_path and error (null, or that nothing was found and under which names).  songs: song, audio_path."""
    audio = F.col("audio_path")
    rows = first_existing(songs, lyrics_candidates(audio), files, "lyrics_path")
    names = F.array_join(F.transform(lyrics_candidates(audio), file_name), ", ")
    missing = F.concat(F.lit("No lyric text found for "), file_name(audio), F.lit(". Expected one of: "), names)
    return rows.withColumn("error", F.when(F.col("lyrics_path").isNull(), missing))


def find_anchors(songs: DataFrame, files: DataFrame, explicit: str | None = None, search: bool = True) -> DataFrame:
    """Adds anchor_path and error.  A given path must exist and must not be an unreviewed template; else the files beside the song are tried, if ``search``."""
    if explicit is not None:
        there = not files.filter(F.col("path") == explicit).isEmpty()
        error = None if there else f"Anchor hints not found: {explicit}"
        if there and TEMPLATE in explicit.rsplit("/", 1)[-1].lower():
            error = f"Refusing to use unreviewed anchor template as confirmed anchor hints: {explicit}."
        return songs.withColumns({"anchor_path": F.lit(None if error else explicit).cast("string"), "error": F.lit(error).cast("string")})
    if not search:
        return songs.withColumns({"anchor_path": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    return first_existing(songs, anchor_candidates(F.col("audio_path")), files, "anchor_path").withColumn("error", F.lit(None).cast("string"))


def report_beside(path: Column) -> Column:
    return with_suffix(path, REPORT)


def report_for_output(outputs: DataFrame, reports: DataFrame) -> DataFrame:
    """Adds report: path of the newest report that names the output.  outputs: output_path; reports: path, mtime, output_path."""
    newest = latest(reports.filter("output_path is not null"), "output_path", F.struct("mtime", "path"), "path").withColumnRenamed("path", "report")
    return outputs.join(newest, "output_path", "left")


def report_path(outputs: DataFrame, reports: DataFrame, files: DataFrame) -> DataFrame:
    """Adds report: the file beside the output if it exists, else the newest report that names it, else the path beside it."""
    beside = report_beside(F.col("output_path"))
    there = files.select(F.col("path").alias("__beside"), F.lit(True).alias("__there")).distinct()
    rows = report_for_output(outputs, reports).withColumn("__beside", beside).join(there, "__beside", "left")
    return rows.withColumn("report", F.when(F.col("__there"), F.col("__beside")).otherwise(F.coalesce("report", "__beside"))).drop("__beside", "__there")


def checked_references(files: DataFrame) -> DataFrame:
    """(path, position) of timed-text files, numbered by name without case."""
    kept = files.filter(file_name(F.col("path")).endswith(".lrc")).select("path").distinct()
    one = F.array_sort(F.collect_list(F.struct(F.lower(file_name(F.col("path"))).alias("n"), "path")))
    return kept.groupBy(_folder(F.col("path")).alias("folder")).agg(one.alias("r")).select(F.posexplode("r.path").alias("position", "path")).select("path", "position")


def sung_text(lines: Column, whole: Column | None = None) -> Column:
    """What is sung of an entry: its first display line."""
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("") if whole is None else whole)


def signatures(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, signature, times, timed): the normal forms of a file's sung lines in order, their times and whether it has any."""
    rows = entries.withColumn("__norm", match_text(sung_text(F.col("lines"))))
    one = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("entry", "__norm", "time_cs"))).alias("r"), F.max(F.col("time_cs").isNotNull()).alias("timed"))
    return one.select(key, F.col("r.__norm").alias("signature"), F.transform("r.time_cs", lambda x: x / 100.0).alias("times"), "timed")


def checked_hint(songs: DataFrame, entries: DataFrame, checked: DataFrame) -> DataFrame:
    """(song, checked_lrc, times and report fields): songs whose sung lines equal a checked file's, in order; the first candidate counts.

    songs: song, audio_path, lyrics_path; entries: the songs' lyrics (doc_id = lyrics_path)
    without markers; checked: entries of checked files (doc_id = path) without markers.  A
    file that is the song's own lyrics, or has no times, is no hint.
    """
    own = signatures(entries).select(F.col("doc_id").alias("lyrics_path"), "signature")
    asked = songs.join(own, "lyrics_path").select("song", "lyrics_path", "signature", F.posexplode(checked_candidates(F.col("audio_path"))).alias("k", "path"))
    held = signatures(checked).filter("timed").select(F.col("doc_id").alias("path"), F.col("signature").alias("theirs"), "times")
    same = asked.filter("path <> lyrics_path").join(held, "path").filter(F.col("signature") == F.col("theirs"))
    best = same.groupBy("song").agg(F.min_by(F.struct("path", "lyrics_path", "times"), "k").alias("b"))
    n = F.size("b.times")
    full = {c: n for c in ("timing_entries", "assigned_entries", "trusted_entries", "matched_entries")}
    full |= {c: F.lit(100.0) for c in ("assigned_percent", "trusted_percent", "matched_percent")}
    full |= {"low_confidence_count": F.lit(0), "low_confidence_percent": F.lit(0.0), "review_required_count": F.lit(0), "review_required_percent": F.lit(0.0), "review_required": F.lit(False)}
    return best.select("song", F.lit("checked-lrc-hint").alias("backend"), F.col("b.path").alias("checked_lrc"), F.col("b.lyrics_path").alias("lyric_source"), F.col("b.times").alias("times"), *[v.alias(k) for k, v in full.items()])


def source_times(entries: DataFrame) -> DataFrame:
    """(doc_id, entry, t) in seconds; a file with an entry without a time is an error in column ``error``, with no times."""
    some = F.max(F.col("time_cs").isNull()).over(_of_document())
    rows = entries.withColumn("error", F.when(some, "entry without a time"))
    return rows.select("doc_id", "entry", F.when(F.col("error").isNull(), F.col("time_cs") / 100.0).alias("t"), "error")


def _of_document():
    from pyspark.sql.window import Window

    return Window.partitionBy("doc_id")


def audio_path(reports: DataFrame, files: DataFrame, fallback: str = "audio_path") -> DataFrame:
    """Adds aligned_audio: the sound that a path was aligned on, if it still exists, else ``fallback``."""
    there = files.select(F.col("path").alias("ctc_audio_path"), F.lit(True).alias("__there")).distinct()
    return reports.join(there, "ctc_audio_path", "left").withColumn("aligned_audio", F.when(F.col("__there"), F.col("ctc_audio_path")).otherwise(F.col(fallback))).drop("__there")
