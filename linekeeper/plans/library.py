"""Registered queries on files, reports, audits, candidates and repairs, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.functions import text as tx
from linekeeper.operators import candidates, diagnostics, forced, joins, matching, metrics, planning, repairs, scoring
from linekeeper.plans.catalogue import BASE, CANDIDATES, CONV, REPORT, _candidates, _fold_sql, _reports, conversation_lines, lines, query, table
from linekeeper.sources import audio, files, lrc, reports
from linekeeper.sources.keyed import write_files
from linekeeper.sources.shared import dealt, passing, shared_folder

# -- Names and files ------------------------------------------------------------

NAME = "regexp_extract(url, '([^/\\\\]*)$', 1)"
STEM = f"CASE WHEN regexp_matches({NAME}, '^.+[.][^.]*$') THEN regexp_replace({NAME}, '[.][^.]*$', '') ELSE {NAME} END"


@query(f"""WITH s AS (SELECT page_id, coalesce(url, '') AS url FROM pages), t AS (SELECT page_id, {STEM} AS stem FROM s)
SELECT page_id, stem, lower(regexp_replace(regexp_replace(regexp_replace(stem, '--.*$', '', 's'), '(?i)[.]checked$', ''), '[ \\t\\n\\r]+', '', 'g')) AS key FROM t""")
def report_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", tx.file_stem(url).alias("stem"), tx.report_key(url).alias("key"))


@query(r"""WITH s AS (SELECT page_id, trim(regexp_replace(coalesce(url, ''), '[<>:"/\\|?*\x00-\x1f]', '_', 'g')) AS x FROM pages)
SELECT page_id, CASE WHEN regexp_replace(x, '^[.]+|[.]+$', '', 'g') = '' THEN 'case' ELSE regexp_replace(x, '^[.]+|[.]+$', '', 'g') END AS name FROM s""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_stem(F.coalesce("url", F.lit(""))).alias("name"))


@query(f"WITH {BASE} SELECT song, entry, list_sort([segment, entry, segment % 7]) AS numbers FROM base")
def number_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" , ", "segment", F.lit(""), "entry", F.col("segment") % 7)
    return lines(spark, sf_dir).select("song", "entry", tx.number_list(text).alias("numbers"))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '雨 OST' WHEN 1 THEN 'Elegy ' WHEN 2 THEN 'x OST' WHEN 3 THEN 'MyGO' WHEN 4 THEN 'ost' ELSE '' END || coalesce(lang, '') AS title FROM documents)
SELECT doc_id, CASE WHEN contains(title, '雨') THEN 'high-density / complex Japanese' WHEN contains(title, 'MyGO') THEN 'band / dense mix' WHEN contains(title, 'OST') THEN 'OST / sparse vocal'
 WHEN contains(title, 'Elegy') THEN 'standard / English vocal' ELSE 'standard / Japanese vocal' END AS category FROM t""")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.create_map(*[F.lit(x) for kv in {0: "雨 OST", 1: "Elegy ", 2: "x OST", 3: "MyGO", 4: "ost"}.items() for x in kv])
    title = F.concat(F.coalesce(F.try_element_at(head, (F.col("doc_id") % 7).cast("int")), F.lit("")), F.coalesce("lang", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", reports.infer_category(title).alias("category"))


def _songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A song for each user: its sound in a library, its output and what it is aligned from."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("song")).distinct()
    path = lambda head, tail: F.concat(F.lit(head), F.col("song").cast("string"), F.lit(tail))
    return users.select("song", path("/lib/Music/in/S", ".flac").alias("audio_path"), path("/out/S", ".lrc").alias("output_path"))


SONGS = "songs AS (SELECT DISTINCT user_id AS song, '/lib/Music/in/S' || user_id || '.flac' AS audio_path, '/out/S' || user_id || '.lrc' AS output_path FROM events)"


def _listing(songs: DataFrame, *kinds: tuple[int, int, str]) -> DataFrame:
    """A file for each (divisor, remainder, path with {s} for the song) and song that it holds for."""
    out = None
    for n, k, path in kinds:
        one = songs.filter(F.col("song") % n == k).select(F.replace(F.lit(path), F.lit("{s}"), F.col("song").cast("string")).alias("path"), F.lit(None).cast("timestamp").alias("mtime"))
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH {SONGS} SELECT song, CASE WHEN song % 6 = 0 THEN '/lib/Music/in/S' || song || '.lyrics.lrc' WHEN song % 3 = 0 THEN '/lib/Music/in/S' || song || '.lyrics.txt' WHEN song % 3 = 1 THEN '/lib/Music/in/S' || song || '.lyrics' WHEN song % 5 = 0 THEN '/lib/Music/S' || song || '.lrc' END AS lyrics_path,
 CASE WHEN song % 3 = 2 AND song % 5 <> 0 THEN 'No lyric text found for S' || song || '.flac. Expected one of: S' || song || '.lyrics.lrc, S' || song || '.lyrics.txt, S' || song || '.txt, S' || song || '.lyrics, S' || song || '.lrc' END AS error FROM songs""")
def lyrics_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs, home = _songs(spark, sf_dir), "/lib/Music/in/S{s}"
    there = _listing(songs, (6, 0, home + ".lyrics.lrc"), (3, 0, home + ".lyrics.txt"), (3, 0, home + ".txt"), (3, 1, home + ".lyrics"), (5, 0, "/lib/Music/S{s}.lrc"))
    return files.find_lyrics(songs, there).select("song", "lyrics_path", "error")


@query(f"""WITH {SONGS} SELECT song, CASE WHEN song % 2 = 0 THEN '/lib/Music/in/S' || song || '.anchors.txt' WHEN song % 3 = 0 THEN '/lib/Music/in/S' || song || '.anchor.lrc' END AS anchor_path FROM songs""")
def anchor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs, home = _songs(spark, sf_dir), "/lib/Music/in/S{s}"
    there = _listing(songs, (2, 0, home + ".anchors.txt"), (3, 0, home + ".anchor.lrc"), (5, 0, home + ".anchor-template.lrc"))
    return files.find_anchors(songs, there).select("song", "anchor_path")


@query(f"""WITH {SONGS}, h AS (SELECT song, '/r/S' || song || '--' || left(sha256(lower(audio_path || chr(0) || output_path)), 10) AS x FROM songs)
SELECT song, x || '.align-report.json' AS report_path, x || '.review-audit.md' AS audit_path, x || '.anchor-template.lrc' AS template_path FROM h""")
def report_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.report_paths(_songs(spark, sf_dir), "/r").drop("audio_path", "output_path")


def _report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a report on its user's output, some without one."""
    ev = table(spark, sf_dir, "events")
    out = F.when(F.col("event_id") % 9 != 0, F.concat(F.lit("/out/S"), F.col("user_id").cast("string"), F.lit(".lrc")))
    return ev.select(F.format_string("/r/%08d.align-report.json", F.col("event_id")).alias("path"), F.col("ts").alias("mtime"), out.alias("output_path"), F.col("event_type").alias("title"), "value")


REPORT_ROWS = "reps AS (SELECT printf('/r/%08d.align-report.json', event_id) AS path, ts AS mtime, CASE WHEN event_id % 9 <> 0 THEN '/out/S' || user_id || '.lrc' END AS output_path, event_type AS title, value FROM events)"


@query(f"""WITH {SONGS}, {REPORT_ROWS}, n AS (SELECT output_path, arg_max(path, (mtime, path)) AS newest FROM reps WHERE output_path IS NOT NULL GROUP BY 1)
SELECT song, coalesce(CASE WHEN song % 4 = 0 THEN '/out/S' || song || '.align-report.json' END, newest, '/out/S' || song || '.align-report.json') AS report, newest FROM songs LEFT JOIN n USING (output_path)""")
def report_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs, rows = _songs(spark, sf_dir), _report_rows(spark, sf_dir)
    there = _listing(songs, (4, 0, "/out/S{s}.align-report.json"))
    found = files.report_path(songs.select("song", "output_path"), rows, there).select("song", "report")
    return found.join(files.report_for_output(songs.select("song", "output_path"), rows).select("song", F.col("report").alias("newest")), "song")


@query(f"""WITH {REPORT_ROWS}, k AS (SELECT DISTINCT lower(x) AS key, path, mtime, value FROM (SELECT unnest([regexp_replace(path, '^/r/|[.]json$', '', 'g'), regexp_replace(output_path, '^/out/|[.]lrc$', '', 'g'), title]) AS x, path, mtime, value FROM reps) WHERE x IS NOT NULL),
w AS (SELECT key, arg_max(path, (mtime, path)) AS path, arg_max(value, (mtime, path)) AS value FROM k GROUP BY key)
SELECT 's' || c_custkey AS key, path, round(value, 6) AS value, CASE WHEN c_custkey % 2 = 0 THEN 'mapped' ELSE 'standard / Japanese vocal' END AS category FROM customer JOIN w ON w.key = 's' || c_custkey""")
def matched_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked files of customers met with the newest report of their key; half of the categories are given."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    refs = keys.select(F.concat(F.lit("/ref/S"), "k", F.lit(".checked.lrc")).alias("reference"))
    given = keys.filter("k % 2 = 0").select(F.concat(F.lit("S "), "k").alias("name"), F.lit("mapped").alias("category"))
    return reports.cases(refs, _report_rows(spark, sf_dir), given).select("key", "path", F.round("value", 6).alias("value"), "category")


@query(f"""WITH {SONGS} SELECT song, CASE WHEN song % 5 > 0 THEN output_path END AS generated, CASE WHEN song % 5 = 0 THEN 'missing output_path in report' WHEN song % 3 > 0 THEN 'missing generated output: ' || output_path ELSE '' END AS error, 'existing-report-output' AS mode FROM songs""")
def existing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = _songs(spark, sf_dir)
    rows = songs.withColumn("output_path", F.when(F.col("song") % 5 > 0, F.col("output_path"))).withColumn("reference", F.col("audio_path"))
    return reports.existing_output(rows, _listing(songs, (3, 0, "/out/S{s}.lrc"))).select("song", "generated", "error", "mode")


@query(f"""WITH {CONV}, s AS (SELECT song, list(norm ORDER BY entry) AS sig, count(*) AS n FROM conv GROUP BY song), c AS (SELECT s.*, song % 3 <> 1 AS there, CASE WHEN song % 2 = 0 THEN sig ELSE list_append(sig, 'x') END AS theirs FROM s)
SELECT song, '/lib/Music/S' || song || '.lrc' AS checked_lrc, CAST(n AS INTEGER) AS timing_entries, 100.0::DOUBLE AS trusted_percent, CAST(n AS DOUBLE) AS last_time FROM c WHERE there AND sig = theirs AND n > 0""")
def checked_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs whose lines equal a checked file's: every second one's has one line more, every third has none."""
    rows = conversation_lines(spark, sf_dir).withColumn("text", F.col("norm"))
    path = F.concat(F.lit("/lib/Music/S"), F.col("song").cast("string"), F.lit(".lrc"))
    own = rows.select(F.concat(F.lit("/l/"), F.col("song").cast("string")).alias("doc_id"), "entry", F.array("text").alias("lines"), F.lit(None).cast("int").alias("time_cs"))
    theirs = rows.filter("song % 3 <> 1").select(path.alias("doc_id"), "entry", F.array("text").alias("lines"), (F.col("entry") * 100).alias("time_cs"), "song")
    more = theirs.filter("song % 2 = 1").groupBy("doc_id").agg((F.max("entry") + 1).alias("entry")).select("doc_id", "entry", F.array(F.lit("x")).alias("lines"), (F.col("entry") * 100).alias("time_cs"))
    songs = rows.select("song").distinct().select("song", F.concat(F.lit("/lib/Music/in/S"), F.col("song").cast("string"), F.lit(".flac")).alias("audio_path"), F.concat(F.lit("/l/"), F.col("song").cast("string")).alias("lyrics_path"))
    got = files.checked_hint(songs, own, theirs.drop("song").unionByName(more))
    return got.select("song", "checked_lrc", "timing_entries", "trusted_percent", F.element_at("times", -1).alias("last_time"))


# -- Lyrics -----------------------------------------------------------------------


@query(f"""WITH {BASE}, r AS (SELECT *, CASE WHEN segment % 10 = 0 THEN '(Intro)' WHEN segment % 10 = 1 THEN '♪' ELSE backend || ' ' || segment END AS line FROM base), k AS (SELECT * FROM r WHERE segment % 10 > 1)
SELECT song, CAST(row_number() OVER (PARTITION BY song ORDER BY entry) AS INTEGER) AS entry, line FROM k""")
def sung_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("segment") % 10 == 0, "(Intro)").when(F.col("segment") % 10 == 1, "♪").otherwise(F.concat_ws(" ", "backend", F.col("segment").cast("string")))
    rows = lines(spark, sf_dir).select(F.col("song").alias("doc_id"), "entry", F.array(text).alias("lines"), F.lit(None).cast("int").alias("time_cs"))
    kept = lrc.drop_markers(rows)
    return kept.select(F.col("doc_id").alias("song"), "entry", files.sung_text(F.col("lines")).alias("line"))


@query(f"""WITH {BASE}, r AS (SELECT song, entry, CAST(floor(value * 20) AS BIGINT) AS cs, backend || ' ' || segment AS x FROM base), l AS (SELECT song, entry, cs, CASE WHEN entry % 4 = 0 THEN '# note' WHEN entry % 4 = 1 THEN '[ar:x]' ELSE x END AS x FROM r WHERE entry % 4 > 1),
g AS (SELECT *, CASE WHEN cs = lag(cs) OVER (PARTITION BY song ORDER BY entry) THEN 0 ELSE 1 END AS n FROM l), e AS (SELECT *, sum(n) OVER (PARTITION BY song ORDER BY entry) AS e FROM g)
SELECT song, CAST(e AS INTEGER) AS entry, CAST(min(cs) AS INTEGER) AS time_cs, string_agg(x || '|left|right', '|' ORDER BY entry) AS lines FROM e GROUP BY song, e""")
def lyric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lyric files with comments, metadata and two tags a line, parsed."""
    cs = F.floor(F.col("value") * 20)
    tag = F.format_string("[%02d:%02d.%02d]", (cs / 6000).cast("long"), (F.pmod(cs, F.lit(6000)) / 100).cast("long"), F.pmod(cs, F.lit(100)))
    line = F.when(F.col("entry") % 4 == 0, "# note").when(F.col("entry") % 4 == 1, "[ar:x]").otherwise(F.concat(tag, F.lit("[99:00.00]"), "backend", F.lit(" "), F.col("segment").cast("string"), F.lit("  left / right ")))
    docs = lines(spark, sf_dir).select("song", F.struct("entry", line.alias("line")).alias("r")).groupBy("song").agg(F.array_sort(F.collect_list("r")).alias("r"))
    docs = docs.select(F.col("song").alias("doc_id"), F.concat(F.lit("﻿"), F.array_join("r.line", "\r\n")).alias("content"))
    return lrc.parse_lyrics(docs, skip_comments=True).select(F.col("doc_id").alias("song"), "entry", "time_cs", F.array_join("lines", "|").alias("lines"))


@query(f"""WITH {BASE}, r AS (SELECT song, entry, CASE segment % 4 WHEN 0 THEN 'かな' WHEN 1 THEN '漢字' WHEN 2 THEN 'latin' ELSE '漢' END AS x, CASE segment % 4 WHEN 0 THEN 'j' WHEN 1 THEN 'h' WHEN 2 THEN 'l' ELSE 'h' END AS s FROM base),
n AS (SELECT *, lead(s) OVER w AS s2, lead(x) OVER w AS x2 FROM r WINDOW w AS (PARTITION BY song ORDER BY entry)), e AS (SELECT *, coalesce((s = 'h' AND s2 IN ('j', 'l')) OR (s2 = 'h' AND s IN ('j', 'l')), false) AS edge FROM n),
g AS (SELECT *, CASE WHEN lag(edge) OVER (PARTITION BY song ORDER BY entry) THEN 0 ELSE 1 END AS nw FROM e), u AS (SELECT *, sum(nw) OVER (PARTITION BY song ORDER BY entry) AS run FROM g),
p AS (SELECT *, edge AND row_number() OVER (PARTITION BY song, run ORDER BY entry) % 2 = 1 AS takes FROM u), z AS (SELECT *, coalesce(lag(takes) OVER (PARTITION BY song ORDER BY entry), false) AS gone FROM p)
SELECT song, CAST(row_number() OVER (PARTITION BY song ORDER BY entry) AS INTEGER) AS entry, CASE WHEN takes THEN x || '|' || x2 ELSE x END AS lines FROM z WHERE NOT gone""")
def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("かな", "漢字", "latin", "漢"))), F.col("segment") % 4 + 1)
    rows = lines(spark, sf_dir).select(F.col("song").alias("doc_id"), "entry", F.array(text).alias("lines"), F.lit(None).cast("int").alias("time_cs"))
    return lrc.merge_translations(rows).select(F.col("doc_id").alias("song"), "entry", F.array_join("lines", "|").alias("lines"))


@query(f"""WITH {CONV}, w AS (SELECT song, entry, text, greatest(1.0::DOUBLE, len(regexp_extract_all(text, '[A-Za-z0-9'']+')) * 1.7::DOUBLE + greatest(0, length(regexp_replace(text, '[ \\t\\n\\r\\f\\x{{0b}}]+', '', 'g')) - length(array_to_string(regexp_extract_all(text, '[A-Za-z0-9'']+'), ''))) * 0.5::DOUBLE) AS wt FROM conv),
s AS (SELECT *, coalesce(sum(wt) OVER (PARTITION BY song ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(wt) OVER (PARTITION BY song) AS total FROM w)
SELECT song, entry, round(CASE WHEN b = 0 THEN 16.0 ELSE least(188.0::DOUBLE, 16 + 172 * b / total) END, 6) AS rough FROM s""")
def planned_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without any evidence: between 8 % and 94 % of 200 seconds, by text weight."""
    rows = conversation_lines(spark, sf_dir).withColumnRenamed("text", "line")
    songs = rows.select("song").distinct().withColumn("duration", F.lit(200.0))
    none = spark.createDataFrame([], f"song {rows.schema['song'].dataType.simpleString()}, start double, end double")
    return planning.weighted_times(rows, planning.active_bounds(songs, none).withColumn("start", F.lit(16.0))).select("song", "entry", F.round("t", 6).alias("rough"))


# -- Reports and audits --------------------------------------------------------------


@query(REPORT + """ SELECT song, backend, CASE WHEN segs > 0 THEN 'review_required_count=' || segs WHEN trusted_percent < 60 THEN 'trusted_percent=' || trusted_percent || ' < required 60.0' WHEN timing_entries % 3 = 0 THEN 'collapse_detected=true' END AS failure FROM (SELECT *, greatest(0, timing_entries - 12) AS segs FROM m)""")
def strict_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reports(spark, sf_dir).withColumns({"review_required_count": F.greatest(F.lit(0), F.col("timing_entries") - 12), "collapse_detected": F.col("timing_entries") % 3 == 0})
    return rows.select("song", "backend", metrics.review_failure(strict=True, min_trusted=60.0).alias("failure"))


@query(REPORT + """ SELECT song, backend, 'trusted_entries=' || trusted_entries || ', timing_entries=' || timing_entries || ', trusted_percent=' || trusted_percent || ', assigned_percent=' || assigned_percent || ', low_confidence_count=' || low_confidence_count AS unusable,
 'trusted_entries=' || trusted_entries || ', timing_entries=' || timing_entries || ', trusted_percent=' || trusted_percent || ', assigned_percent=' || assigned_percent || ', low_confidence_percent=' || low_confidence_percent || ', review_required_percent=0.0, collapse_detected=' || CASE WHEN timing_entries % 3 = 0 THEN 'True' WHEN timing_entries % 3 = 1 THEN 'False' ELSE 'None' END || ', max_post_long_uncertain_run=None, segment_collapse_runs=None, alignment_collapse_runs=[]' AS untrusted,
 low_confidence_count BETWEEN 1 AND 12 AS eligible FROM m""")
def report_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    collapse = F.when(F.col("timing_entries") % 3 == 0, True).when(F.col("timing_entries") % 3 == 1, False)
    rows = _reports(spark, sf_dir).withColumns({"collapse_detected": collapse, "max_post_long_uncertain_run": none, "segment_collapse_runs": none, "alignment_collapse_runs": F.lit("[]"), "raw_asr_max_segment_seconds": F.col("low_confidence_count").cast("string")})
    return rows.select("song", "backend", candidates.unusable_reason().alias("unusable"), candidates.untrusted_reason().alias("untrusted"), candidates.raw_is_eligible().alias("eligible"))


@query(CANDIDATES + """ SELECT song, kind, backend, round(CAST(quality AS DOUBLE), 3) AS quality, coll AS collapse_detected, CASE WHEN backend = 'ctc' THEN low4 END AS ctc_low_score_count,
 round(CASE WHEN backend = 'whisperx' THEN trusted_percent - 2.5 * low_confidence_count - CASE WHEN coll THEN 80 ELSE 0 END END::DOUBLE, 3) AS legacy_quality, error FROM q""")
def candidate_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).withColumn("strategy", F.col("kind"))
    out = candidates.summaries(rows)
    return out.select("song", F.col("strategy").alias("kind"), "backend", "quality", "collapse_detected", F.col("ctc_low_score_count").cast("long").alias("ctc_low_score_count"), "legacy_quality", "error")


@query(CANDIDATES + """, p AS (SELECT song, kind, CASE WHEN error IS NOT NULL THEN backend || ' error=' || error WHEN backend = 'ctc' THEN 'ctc quality=' || printf('%.1f', quality::DOUBLE + 0.013) || ', low=' || low4 || ', very_low=' || miss || ', missing=' || miss
 WHEN backend = 'whisperx' THEN 'whisperx quality=' || printf('%.1f', quality::DOUBLE + 0.013) || ', trusted=' || trusted_percent || ', review=0.0, collapse=' || CASE WHEN coll THEN 'True' ELSE 'False' END
 WHEN backend = 'whispercpp' THEN 'whispercpp quality=' || printf('%.1f', quality::DOUBLE + 0.013) || ', trusted=' || trusted_percent || ', review=0.0' END AS part FROM q),
a AS (SELECT song, string_agg(part, '; ' ORDER BY kind DESC) AS parts FROM p WHERE part IS NOT NULL GROUP BY song)
SELECT song, 'selected ctc quality=90.0; ' || parts || '; ctc is preferred on near-ties because it is forced to the known lyric order' AS reason FROM a""")
def selection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).withColumn("ordinal", -F.row_number().over(Window.partitionBy("song").orderBy("kind")))
    rows = rows.withColumn("quality", F.col("quality") + 0.013)  # no ties of the last digit: they round by the binary value
    chosen = rows.select("song").distinct().withColumns({"selected": F.lit("ctc"), "quality": F.lit(90.0)})
    return candidates.selection_reason(chosen, rows)


@query(REPORT + """, q AS (SELECT *, trusted_percent - 2.5 * low_confidence_count AS ql, trusted_percent < 90 OR low_confidence_count > greatest(6, ceil(timing_entries * 0.2)) AS poor, CASE WHEN timing_entries % 8 = 0 THEN 'no evidence' ELSE '' END AS err FROM m),
own AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY entry) AS pos FROM r4 WHERE backend = 'click'), f AS (SELECT song, pos, sum(CASE WHEN segment IS NULL OR score < 0.62 THEN 1 ELSE 0 END) OVER (PARTITION BY song ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM own),
l AS (SELECT song, min(CASE WHEN s = 4 THEN pos END) AS first FROM f GROUP BY song),
j AS (SELECT a.song, a.err AS ea, b.err AS eb, a.ql AS qa, b.ql AS qb, a.poor, l.first FROM q a LEFT JOIN q b ON a.song = b.song AND b.backend = 'view' LEFT JOIN l ON l.song = a.song WHERE a.backend = 'click'),
u AS (SELECT *, CASE WHEN ea <> '' THEN CASE WHEN qb IS NOT NULL AND eb = '' THEN 'retry' END WHEN poor AND qb IS NOT NULL AND eb = '' AND qb - qa >= 15 THEN 'retry' WHEN poor AND eb = '' AND qb > qa THEN CASE WHEN first IS NOT NULL THEN 'splice' ELSE 'retry' END ELSE 'normal' END AS use FROM j)
SELECT song, use, CASE WHEN use = 'splice' THEN CAST(first AS INTEGER) END AS splice_from, CASE WHEN use IS NULL THEN CASE WHEN eb <> '' THEN 'no evidence | no evidence' ELSE 'no evidence' END END AS error FROM u""")
def retry_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reports(spark, sf_dir).withColumns({"collapse_detected": F.lit(False), "error": F.when(F.col("timing_entries") % 8 == 0, "no evidence")})
    own = lines(spark, sf_dir).filter("backend = 'click'").withColumn("segment", F.when(F.col("segment") % 3 != 0, F.col("segment"))).drop("entry")
    own = metrics.number_entries(own, "t", "event_id")
    return candidates.choose_retry(rows.filter("backend = 'click'"), rows.filter("backend = 'view'"), own)


@query(
    _fold_sql(", t - segment / 50.0::DOUBLE AS p, lead(t) OVER w AS nt", "n.entry < 9 AND segment % 2 = 0 AND n.t - p BETWEEN 0.40 AND 1.60 AND lo + 0.10 < p AND (nt IS NULL OR p < (CASE WHEN n.entry = 8 THEN nt - nseg / 50.0::DOUBLE ELSE nt END) - 0.10)", "p", first="-1e18::DOUBLE").replace("lag(t) OVER w AS pt", "lag(t) OVER w AS pt, lead(segment) OVER w AS nseg").replace("ELSE t END AS v", "WHEN n.entry >= 9 THEN p ELSE t END AS v").replace("ELSE n.t END", "WHEN n.entry >= 9 THEN n.p ELSE n.t END")
    + " SELECT song, entry, round(v, 6) AS time FROM f"
)
def spliced_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    normal = rows.select("song", "entry", F.col("t").alias("timestamp"))
    retry = rows.select("song", "entry", (F.col("t") - F.col("segment") / 50.0).alias("timestamp"))
    choice = rows.select("song").distinct().withColumns({"use": F.lit("splice"), "splice_from": F.lit(9)})
    return candidates.splice(normal, retry, choice, rows.filter("segment % 2 = 0")).select("song", "entry", F.round("time", 6).alias("time"))


@query(f"WITH {BASE} SELECT song, entry, CASE WHEN segment % 2 = 0 THEN round(value / 7, 3) ELSE t END AS time FROM base")
def synced_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    out = candidates.sync_times(rows.withColumn("timestamp", F.col("t")), rows.filter("segment % 2 = 0").select("song", "entry", (F.col("value") / 7).alias("time")))
    return out.select("song", "entry", F.col("timestamp").alias("time"))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit of lines: some have an assignment, a risk, or two of either."""
    rows, k = lines(spark, sf_dir), F.col("segment")
    own = rows.select("song", "entry", F.floor(F.col("value") * 20).cast("int").alias("time_cs"), F.array(F.col("backend"), F.lit(" "), F.concat(F.lit(" a|"), k.cast("string"))).alias("lines"))
    span = F.struct(F.lit("c").alias("char"), F.col("segment").cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.lit(0.25).alias("score"))
    peak = F.struct(F.col("segment").cast("double").alias("time"), F.lit(None).cast("double").alias("score"))
    made = rows.filter("segment % 4 <> 0").select(
        "song", "entry", F.lit(1).alias("ordinal"), (k / 8.0).alias("score"), F.when(k % 2 == 0, k / 16.0).alias("ctc_score"), F.when(k % 3 == 0, k + 0.5).alias("chosen_time"), F.when(k % 5 == 0, k / 4.0).alias("confidence"),
        F.array(F.lit("r1"), F.lit("r2")).alias("reasons"), F.array(F.struct(F.lit("p").alias("kind"), F.when(k % 2 == 0, 0.25).alias("value"))).alias("penalties"), F.when(k % 6 == 0, "half").alias("split"),
        (k % 5 == 0).alias("timing_trusted"), F.lit("why").alias("trust_reason"), F.array(F.lit("ctc"), F.lit("raw")).alias("trust_sources"), F.create_map(F.lit("selected"), k.cast("double")).alias("trust_times"),
        F.when(k % 7 > 0, F.array(span, span)).alias("token_spans"), F.array(peak).alias("peaks"),
    )
    older = made.withColumns({"ordinal": F.lit(0), "score": F.lit(0.0), "reasons": F.array(F.lit("old"))})
    risk = rows.filter("segment % 3 = 1").select(
        "song", "entry", F.lit(1).alias("ordinal"), F.array(F.lit("f1"), F.lit("f2")).alias("flags"), F.when(k % 2 == 0, "high").otherwise("low").alias("severity"), (k % 4 == 1).alias("review_required"),
        F.create_map(F.lit("ctc"), k + 0.25, F.lit("whisperx"), k * 2.0).alias("cand_ts"), F.array(span).alias("token_spans"), F.array(peak).alias("peaks"),
    )
    return reports.audit_rows(own, made.unionByName(older), risk)


def _clock_sql(x: str) -> str:
    """mm:ss.ss of seconds that are whole quarters."""
    return f"printf('%02d:%05.2f', CAST(floor(({x}) / 60) AS INTEGER), ({x}) - floor(({x}) / 60) * 60)"


AUDIT = f"""WITH {BASE}, x AS (SELECT *, segment AS k, CAST(floor(value * 20) AS INTEGER) AS cs, segment % 4 <> 0 AS a, segment % 3 = 1 AS r FROM base),
y AS (SELECT *, printf('%02d:%05.2f', cs // 6000, (cs / 100.0::DOUBLE) - (cs // 6000) * 60) AS tm FROM x),
audit AS (SELECT song, entry AS n, CAST(entry AS VARCHAR) AS entry, tm AS time, CASE WHEN r AND k % 4 = 1 THEN 'yes' ELSE 'no' END AS review, CASE WHEN r THEN CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END ELSE '' END AS severity,
 CASE WHEN a THEN printf('%.3f', k / 8.0::DOUBLE) ELSE '' END AS score, CASE WHEN a AND k % 2 = 0 THEN printf('%.6f', k / 16.0::DOUBLE) ELSE '' END AS ctc_score, CASE WHEN r THEN printf('%.3f', abs(k * 2.0::DOUBLE - k - 0.25)) ELSE '' END AS spread,
 CASE WHEN NOT r AND a THEN {_clock_sql('k::DOUBLE')} ELSE tm END AS output, CASE WHEN r THEN {_clock_sql('k * 2.0::DOUBLE')} ELSE '' END AS whisperx, CASE WHEN r THEN {_clock_sql('k + 0.25::DOUBLE')} ELSE '' END AS ctc, '' AS raw, '' AS forced_first,
 CASE WHEN a AND k % 3 = 0 THEN {_clock_sql('k + 0.5::DOUBLE')} ELSE tm END AS chosen_time, CASE WHEN a AND k % 5 = 0 THEN printf('%.3f', k / 4.0::DOUBLE) ELSE '' END AS confidence, CASE WHEN a THEN 'r1;r2' ELSE '' END AS decision_reasons,
 CASE WHEN a THEN CASE WHEN k % 2 = 0 THEN 'p:0.25' ELSE 'p' END ELSE '' END AS decision_penalties, CASE WHEN a AND k % 6 = 0 THEN 'half' ELSE '' END AS split_suggestion, CASE WHEN a AND k % 5 = 0 THEN 'yes' ELSE 'no' END AS timing_trusted,
 CASE WHEN a AND k % 5 = 0 THEN 'why' ELSE '' END AS timing_trust_reason, CASE WHEN a AND k % 5 = 0 THEN 'ctc;raw' ELSE '' END AS timing_trust_sources,
 CASE WHEN a AND k % 7 > 0 THEN 'c@' || {_clock_sql('k::DOUBLE')} || '/0.250;c@' || {_clock_sql('k::DOUBLE')} || '/0.250' WHEN r THEN 'c@' || {_clock_sql('k::DOUBLE')} || '/0.250' ELSE '' END AS ctc_tokens, CASE WHEN a OR r THEN {_clock_sql('k::DOUBLE')} ELSE '' END AS ctc_first_token_candidates,
 concat_ws(';', CASE WHEN r THEN 'f1;f2' END, CASE WHEN a AND k % 5 = 0 THEN 'timing_trusted' END) AS flags, backend || ' / a|' || k AS text FROM y)"""


@query(AUDIT + " SELECT * EXCLUDE (n) FROM audit")
def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir).drop("__n")


@query(AUDIT + f""" SELECT song, md5(chr(65279) || '{','.join(reports.AUDIT_COLUMNS)}' || chr(13) || chr(10) || string_agg(concat_ws(',', {', '.join(reports.AUDIT_COLUMNS)}), chr(13) || chr(10) ORDER BY n) || chr(13) || chr(10)) AS content FROM audit GROUP BY song""")
def audit_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.audit_csv(_audit(spark, sf_dir)).select("song", F.md5("content").alias("content"))


@query(AUDIT + """, l AS (SELECT song, n, '| ' || concat_ws(' | ', entry, time, chosen_time, confidence, review, concat_ws('<br>', CASE WHEN timing_trusted = 'yes' THEN 'trusted' END, CASE WHEN timing_trust_reason <> '' THEN timing_trust_reason END, CASE WHEN timing_trust_sources <> '' THEN timing_trust_sources END), severity, spread, score,
 concat_ws(', ', 'out ' || output, CASE WHEN whisperx <> '' THEN 'wx ' || whisperx END, CASE WHEN ctc <> '' THEN 'ctc ' || ctc END, CASE WHEN ctc_tokens <> '' THEN 'ctc-tok ' || ctc_tokens END, CASE WHEN ctc_first_token_candidates <> '' THEN 'ctc-first ' || ctc_first_token_candidates END) || CASE WHEN flags <> '' THEN '<br>' || flags ELSE '' END,
 replace(text, '|', '\\|')) || ' |' AS line FROM audit)
SELECT song, md5('# Alignment Audit' || chr(10) || chr(10) || '- backend: `ctc`' || chr(10) || '- strategy: `` ' [1:14] || chr(10) || '- timing entries: `' || count(*) || '`' || chr(10) || '- trusted percent: `50.0`' || chr(10) || '- timing-trusted entries: `1`' || chr(10) || '- review required: `2`' || chr(10) || chr(10)
 || '| # | time | chosen | confidence | review | trust | severity | spread | score | candidates | text |' || chr(10) || '|---:|---:|---:|---:|:---:|---|:---:|---:|---:|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY n) || chr(10)) AS content FROM l GROUP BY song""")
def audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = _audit(spark, sf_dir)
    told = audit.groupBy("song").agg(F.count(F.lit(1)).alias("timing_entries")).withColumns({"backend": F.lit("ctc"), "strategy": F.lit(None).cast("string"), "trusted_percent": F.lit(50.0), "timing_trusted_entries": F.lit(1), "review_required_count": F.lit(2)})
    return reports.audit_markdown(audit, told).select("song", F.md5("content").alias("content"))


@query(AUDIT + """ SELECT song, md5(chr(65279) || '# Review these timestamps manually, then rename/copy to .anchors.lrc only after checking.' || chr(10) || '# This file is intentionally named .anchor-template.lrc so it is not auto-applied.' || chr(10) || '# Lines starting with # are ignored when this is copied to .anchors.lrc.' || chr(10)
 || string_agg('# entry=' || entry || chr(10) || '[' || time || ']' || split_part(text, ' / ', 1), chr(10) ORDER BY n) || chr(10)) AS content FROM audit WHERE review = 'yes' GROUP BY song""")
def anchor_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.anchor_template(_audit(spark, sf_dir).filter("review = 'yes'")).select("song", F.md5("content").alias("content"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each customer as a case: some without output, some without metrics."""
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    cases = c.select(
        F.col("c_name").alias("case"), F.col("c_mktsegment").alias("category"), F.lit("existing-report-output").alias("mode"), F.when(k % 7 == 0, "gone").otherwise("").alias("error"), F.lit("ref").alias("reference"), F.when(k % 7 != 0, "gen").alias("generated"), F.lit("rep").alias("report"),
        F.when(k % 2 == 0, F.struct(F.lit("hybrid").alias("selected_backend"))).alias("candidate_selection"), F.lit("ctc").alias("backend"), F.lit(None).cast("string").alias("ctc_audio_source"), F.when(k % 3 == 0, "cuda").alias("ctc_device"), F.lit("cpu").alias("whisperx_device"),
        *[n.cast("string").alias(x) for x in ("trusted_percent", "assigned_percent", "low_confidence_percent")], F.lit("none").alias("review_required_percent"), n.alias("review_required_count"),
    )
    judged = c.filter("c_custkey % 5 <> 0").select(F.col("c_name").alias("case"), (n + 1).cast("long").alias("reference_entries"), n.cast("long").alias("generated_entries"), F.lit(0).cast("long").alias("text_mismatches"), (n * 3).cast("long").alias("max_abs_delta_cs"), (n / 2).alias("mean_abs_delta_cs"), *[(n * 4.0).alias(f"within_{x}cs_percent") for x in (10, 25, 50, 100)])
    return reports.evaluate_rows(cases, judged)


JUDGED = """c AS (SELECT *, c_custkey AS k, c_nationkey AS n, c_custkey % 5 <> 0 AS judged, c_custkey % 7 = 0 AS skip FROM customer),
judged AS (SELECT c_name AS "case", c_mktsegment AS category, 'existing-report-output' AS mode, CASE WHEN skip THEN 'SKIP' WHEN NOT judged THEN 'ERROR' ELSE 'OK' END AS status, 'ctc' AS backend, CASE WHEN k % 2 = 0 THEN 'hybrid' ELSE 'ctc' END AS selected_backend, '' AS ctc_audio_source, CASE WHEN k % 3 = 0 THEN 'cuda' ELSE 'cpu' END AS ctc_device,
 CASE WHEN judged AND NOT skip THEN CAST(n + 1 AS BIGINT) END AS reference_entries, CASE WHEN judged AND NOT skip THEN CAST(n AS BIGINT) END AS generated_entries, CASE WHEN judged AND NOT skip THEN 0::BIGINT END AS text_mismatches, CASE WHEN judged AND NOT skip THEN CAST(n * 3 AS BIGINT) END AS max_abs_delta_cs, CASE WHEN judged AND NOT skip THEN n / 2.0::DOUBLE END AS mean_abs_delta_cs,
 CASE WHEN judged AND NOT skip THEN n * 4.0::DOUBLE END AS within_10cs_percent, CASE WHEN judged AND NOT skip THEN n * 4.0::DOUBLE END AS within_25cs_percent, CASE WHEN judged AND NOT skip THEN n * 4.0::DOUBLE END AS within_50cs_percent, CASE WHEN judged AND NOT skip THEN n * 4.0::DOUBLE END AS within_100cs_percent,
 CAST(n AS DOUBLE) AS trusted_percent, CAST(n AS DOUBLE) AS assigned_percent, CAST(n AS DOUBLE) AS low_confidence_percent, NULL::DOUBLE AS review_required_percent, n AS review_required_count, CASE WHEN skip THEN 'gone' WHEN NOT judged THEN 'no metrics' ELSE '' END AS error, 'ref' AS reference, CASE WHEN skip THEN '' ELSE 'gen' END AS generated, 'rep' AS report FROM c)"""


@query(f"WITH {JUDGED} SELECT * FROM judged")
def judged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)


_PCT = "printf('%.2f', round(coalesce(sum({0} * reference_entries) / nullif(sum(CASE WHEN {0} IS NOT NULL THEN reference_entries END), 0), 0), 2)) || '%'"


@query(f"""WITH {JUDGED}, g AS (SELECT category, '| ' || concat_ws(' | ', category, count(*), sum(reference_entries), {', '.join(_PCT.format(c) for c in ('within_10cs_percent', 'within_25cs_percent', 'within_50cs_percent', 'trusted_percent', 'review_required_percent'))}, printf('%.2f', max(max_abs_delta_cs) / 100.0::DOUBLE) || 's') || ' |' AS line FROM judged WHERE status = 'OK' GROUP BY category),
s AS (SELECT "case" AS c, '| ' || concat_ws(' | ', "case", category, selected_backend, CAST(reference_entries AS VARCHAR), printf('%.2f', within_25cs_percent) || '%', printf('%.2f', max_abs_delta_cs / 100.0::DOUBLE) || 's', printf('%.2f', trusted_percent) || '%', CAST(review_required_count AS VARCHAR)) || ' |' AS line FROM judged WHERE status = 'OK'),
o AS (SELECT "case" AS c, '- ' || "case" || ': ' || error AS line FROM judged WHERE status <> 'OK')
SELECT md5('# Quantitative Alignment Summary' || chr(10) || chr(10) || 'Generated from local checked references and alignment reports. Audio, lyrics, generated LRCs, and reports are not committed.' || chr(10) || chr(10) || '| Category | Songs | Entries | <=0.10s | <=0.25s | <=0.50s | Trusted | Review required | Max error |' || chr(10) || '|---|---:|---:|---:|---:|---:|---:|---:|---:|' || chr(10)
 || (SELECT string_agg(line, chr(10) ORDER BY category) FROM g) || chr(10) || chr(10) || '## Per-Song Results' || chr(10) || chr(10) || '| Song | Category | Backend | Entries | <=0.25s | Max error | Trusted | Review count |' || chr(10) || '|---|---|---|---:|---:|---:|---:|---:|' || chr(10)
 || (SELECT string_agg(line, chr(10) ORDER BY c) FROM s) || chr(10) || chr(10) || '## Skipped / Errors' || chr(10) || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY c) FROM o) || chr(10)) AS content""")
def summary_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary_markdown(_judged(spark, sf_dir)).select(F.md5("content").alias("content"))


@query(REPORT + """ SELECT song, backend, array_to_string(list_filter([CASE WHEN timing_entries % 4 <> 0 THEN 'text_mismatches' END, CASE WHEN trusted_percent < 50 THEN 'within_25cs' END, CASE WHEN low_confidence_count > 8 THEN 'max_abs_delta_cs_at_most' END, CASE WHEN backend <> 'click' THEN 'backend' END, CASE WHEN timing_entries % 2 = 0 AND trusted_percent < 80 THEN 'trusted_percent' END], lambda x: x IS NOT NULL), ',') AS failures FROM m""")
def case_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reports(spark, sf_dir).withColumns({"text_mismatches": F.col("timing_entries") % 4, "within_25cs_percent": F.col("trusted_percent"), "max_abs_delta_cs": F.col("low_confidence_count")})
    need = {"text_mismatches": F.lit(0), "within_25cs": F.lit(50.0), "max_abs_delta_cs_at_most": F.lit(8), "backend": F.lit("click"), "trusted_percent": F.when(F.col("timing_entries") % 2 == 0, 80.0)}
    out = metrics.evaluate_cases(rows.withColumns({f"require_{k}": v for k, v in need.items()}))
    return out.select("song", "backend", F.array_join("failures", ",").alias("failures"))


# -- Segments, peaks and windows ----------------------------------------------------------


@query(f"""WITH {BASE}, x AS (SELECT song, entry, CASE WHEN segment % 5 = 0 THEN '' ELSE 'a' || segment END AS text, t, CASE WHEN segment % 3 = 0 THEN 0.01 ELSE 2 END AS d, segment % 2 = 0 AS has FROM base), k AS (SELECT * FROM x WHERE text <> '' AND (has OR t + d - t >= 0.05))
SELECT song, CAST(row_number() OVER (PARTITION BY song ORDER BY entry) - 1 AS INTEGER) AS seg_idx, text, CASE WHEN has THEN text ELSE '' END AS spelled FROM k""")
def recogniser_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("segment")
    text = F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit(" a"), k.cast("string")))
    char = lambda c: F.struct(c.alias("char"), F.col("t").alias("start"))
    chars = F.when(k % 2 == 0, F.array(char(F.lit("a")), char(F.concat(k.cast("string"), F.lit("!"))), F.struct(F.lit("z").alias("char"), F.lit(None).cast("double").alias("start"))))
    one = F.struct("entry", F.col("t").alias("start"), (F.col("t") + F.when(k % 3 == 0, 0.01).otherwise(2.0)).alias("end"), text.alias("text"), chars.alias("chars"))
    raw = lines(spark, sf_dir).groupBy("song").agg(F.array_sort(F.collect_list(one)).alias("r"))
    raw = raw.select("song", F.transform("r", lambda x: F.struct(*[x[c].alias(c) for c in ("start", "end", "text", "chars")])).alias("segments"))
    return reports.aligned_segments(raw).select("song", "seg_idx", "text", F.array_join(F.transform("chars", lambda c: c["ch"]), "").alias("spelled"))


@query(f"""WITH {BASE}, x AS (SELECT song, entry, substr('abcdefghij', 1 + segment % 10, 10) AS norm, t, instr('abcdefghij', substr('abcdefghij', 1 + segment % 10, 10)) AS pos, 10 - segment % 10 AS n FROM base)
SELECT song, entry, round(CASE WHEN n >= 0.375 * (n + 10) AND pos > 1 AND 2 * n >= 0.75 * (n + 10) AND (pos - 1) * 0.25 <= 1 THEN t + (pos - 1) * 0.25 END, 6) AS suffix, round(t + (pos - 1) * 0.25, 6) AS exact, round(CASE WHEN pos = 1 THEN t ELSE t + 3 * least(0.95, (pos - 1) / 10.0::DOUBLE) END, 6) AS share FROM x""")
def segment_char_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, whole = F.col("t"), F.lit("abcdefghij")
    norm = F.substr(whole, 1 + F.col("segment") % 10, F.lit(10))
    chars = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(F.substr(whole, i + 1, F.lit(1)).alias("ch"), (t + i * 0.25).alias("t")))
    rows = lines(spark, sf_dir)
    got = {"suffix": matching.suffix_time(norm, t, t + 3, chars), "exact": matching.char_time(norm, t, t + 3, chars), "share": matching.text_time(norm, t, t + 3, whole)}
    return rows.select("song", "entry", *[F.round(v, 6).alias(k) for k, v in got.items()])


@query(f"""WITH {BASE}, p AS (SELECT song, entry, list_filter([instr('kimigayowa', left('yowaxyz', 8 - k)) FOR k IN range(1, 4)], lambda v: v > 0) AS a, segment FROM base)
SELECT song, entry, round(CASE WHEN segment % 2 = 0 THEN t + 4 * least(0.95, 2 / 10.0::DOUBLE) END, 6) AS place FROM p JOIN base USING (song, entry, segment)""")
def romaji_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    latin = F.when(F.col("segment") % 2 == 0, "migayoxxxx").otherwise("migaxxxx")
    got = matching.text_time(F.lit("見"), t, t + 4, F.lit("君が代は"), latin, F.lit("kimigayowa"))
    return lines(spark, sf_dir).select("song", "entry", F.round(got, 6).alias("place"))


@query(f"""WITH {BASE}, b AS (SELECT song, entry // 20 AS e, entry, round(score, 1) AS v FROM base), n AS (SELECT *, coalesce(lag(v) OVER w, -1) AS l, coalesce(lead(v) OVER w, -1) AS r FROM b WINDOW w AS (PARTITION BY song, e ORDER BY entry)),
k AS (SELECT *, row_number() OVER (PARTITION BY song, e ORDER BY v DESC, entry DESC) AS rn FROM n WHERE v >= l AND v >= r)
SELECT song, CAST(e AS INTEGER) AS entry, string_agg(round(5 + entry * 0.02, 3)::DOUBLE || '/' || round(v, 6)::DOUBLE, ' ' ORDER BY rn) AS peaks FROM k WHERE rn <= 4 GROUP BY song, e""")
def posterior_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = lines(spark, sf_dir).select("song", F.floor(F.col("entry") / 20).cast("int").alias("line"), F.col("entry").alias("frame"), F.round("score", 1).alias("value")).withColumnRenamed("line", "entry")
    out = matching.token_peaks(frames, 0.02, 5.0, 4)
    return out.select("song", "entry", F.array_join(F.transform("peaks", lambda p: F.concat(p["time"].cast("string"), F.lit("/"), p["score"].cast("string"))), " ").alias("peaks"))


@query(f"""WITH {BASE}, x AS (SELECT song, entry, t / 10000 AS t, segment % 4 = 0 OR (segment % 4 = 1 AND score <= 0.25) AS tg, lag(t / 10000) OVER w AS pt, lead(t / 10000, 2) OVER w AS nt, max(entry) OVER (PARTITION BY song) AS m, max(t / 10000) OVER (PARTITION BY song) + 10 AS d FROM base WINDOW w AS (PARTITION BY song ORDER BY entry)),
r AS (SELECT *, entry - row_number() OVER (PARTITION BY song ORDER BY entry) AS run FROM x WHERE tg),
g AS (SELECT song, min(entry) AS f, max(entry) AS l, max(m) AS m, max(d) AS d, arg_min(coalesce(pt, t), entry) AS s, arg_max(nt, entry) AS e FROM r GROUP BY song, run),
z AS (SELECT song, f AS first_target, l AS last_target, greatest(0, s - 0.08) AS st, CASE WHEN least(m, l + 1) >= m THEN d ELSE greatest(greatest(0, s - 0.08) + 1, e - 0.05) END AS en FROM g)
SELECT song, first_target, last_target, round(st, 6) AS start, round(en, 6) AS "end" FROM z WHERE en - st BETWEEN 1 AND 45""")
def hybrid_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, t, k = lines(spark, sf_dir).withColumn("t", F.col("t") / 10000), F.col("t"), F.col("segment")
    off = F.when(k % 4 == 0, 1.5).when(k % 4 == 1, 0.5).otherwise(0.0)
    made = rows.select("song", "entry", t.alias("timestamp"), (F.max("t").over(Window.partitionBy("song")) + 10).alias("duration"), (t + 1 + off).alias("ctc"), (t + 1).alias("wx"), (F.col("score") / 5).alias("first_score"))
    return forced.hybrid_windows(made).select("song", "first_target", "last_target", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(f"""WITH {BASE}, x AS (SELECT song, entry, t / 1000 AS t, t / 1000 + segment / 10.0::DOUBLE AS te, segment FROM base), y AS (SELECT *, lag(t) OVER w AS pt, lag(CASE WHEN segment % 5 > 0 THEN te END) OVER w AS pe, lead(t) OVER w AS nt, max(t) OVER (PARTITION BY song) + 10 AS d FROM x WINDOW w AS (PARTITION BY song ORDER BY entry)),
z AS (SELECT song, entry, greatest(0, pt - 0.5) AS s, least(d, coalesce(nt + 0.75, t + 5)) AS e FROM y WHERE segment % 5 > 0 AND t - pe <= 0.04) SELECT song, entry, round(s, 6) AS start, round(e, 6) AS "end" FROM z WHERE e - s BETWEEN 1 AND 16""")
def boundary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t") / 1000
    rows = lines(spark, sf_dir).select("song", "entry", t.alias("timestamp"), F.when(F.col("segment") % 5 > 0, t + F.col("segment") / 10.0).alias("token_end"))
    rows = rows.withColumn("duration", F.max("timestamp").over(Window.partitionBy("song")) + 10)
    return forced.boundary_windows(rows).select("song", "entry", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


_LEAD = "(n.t - (n.t - (segment - 20) / 10.0::DOUBLE))"


@query(
    _fold_sql(
        ", t - (segment - 20) / 10.0::DOUBLE AS fc",
        f"segment % 2 = 0 AND lo + 0.35 < fc AND fc < hi - 0.35 AND {_LEAD} <= 6.0 AND {_LEAD} >= -0.35 AND (CASE WHEN {_LEAD} <= 0.35 THEN fc ELSE n.t - least(1.6, {_LEAD} * 0.34) END) > lo + 0.35 AND (CASE WHEN {_LEAD} <= 0.35 THEN fc ELSE n.t - least(1.6, {_LEAD} * 0.34) END) < hi - 0.35",
        f"CASE WHEN {_LEAD} <= 0.35 THEN fc ELSE n.t - least(1.6, {_LEAD} * 0.34) END",
    )
    + " SELECT song, entry, round(v, 6) AS time FROM f"
)
def tail_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, t, k = lines(spark, sf_dir), F.col("t"), F.col("segment")
    made = rows.select("song", "entry", t.alias("timestamp"), (F.max("t").over(Window.partitionBy("song")) + 10).alias("duration"), F.when(k % 2 == 0, "tail-hallucination-acoustic").alias("timing_repair"), (t - (k - 20) / 10.0).alias("forced"))
    return forced.tail_blend(made).select("song", "entry", F.round("time", 6).alias("time"))


@query(f"""WITH {BASE}, x AS (SELECT *, lag(t) OVER w AS pt, lag(segment) OVER w AS ps, max(t) OVER (PARTITION BY song) + 10 AS d FROM base WINDOW w AS (PARTITION BY song ORDER BY entry)), y AS (SELECT *, t - segment / 200.0::DOUBLE AS fc, segment / 200.0::DOUBLE AS late FROM x)
SELECT song, entry, CASE WHEN pt IS NOT NULL AND t - pt >= 10 THEN CASE WHEN score < 0.55 AND late BETWEEN 1.2 AND 2.2 THEN NULL WHEN score BETWEEN 0.64 AND 0.75 AND late BETWEEN 1.2 AND 1.8 THEN 'medium-confidence-forced' WHEN score >= 0.90 AND late BETWEEN 0.25 AND 0.45 THEN 'high-confidence-small-forced' END END AS reason FROM y WHERE pt IS NULL OR t - pt >= 10""")
def forced_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short late lines have no rule here, and a line's segment is its own: the rules on the score alone decide.  Lines close to the one before are left out of the result."""
    rows, t, k = lines(spark, sf_dir), F.col("t"), F.col("segment")
    made = rows.select("song", "entry", t.alias("timestamp"), (F.max("t").over(Window.partitionBy("song")) + 10).alias("duration"), F.lit("abcd").alias("norm"), F.lit("abcd").alias("text"), "score", F.col("entry").alias("segment"), (t + 0.5).alias("segment_end"), F.lit("abcd").alias("asr_norm"), F.lit("abcd").alias("asr_text"), F.lit(False).alias("borrowed"), (t - k / 200.0).alias("forced"), F.lit(False).alias("settled"))
    gap = rows.withColumn("gap", t - F.lag("t").over(Window.partitionBy("song").orderBy("entry"))).filter("gap is null or gap >= 10").select("song", "entry")
    return forced.lyric_refinement(made).join(gap, ["song", "entry"]).select("song", "entry", "reason")


# -- Repairs from sound -----------------------------------------------------------------


def _repair_lines(spark: SparkSession, sf_dir: str, onset, level, **columns) -> DataFrame:
    """Lines with their song's end, one onset and what a repair asks for besides."""
    rows = lines(spark, sf_dir).withColumn("duration", F.max("t").over(Window.partitionBy("song")) + 10)
    one = F.struct(onset.alias("t"), level.alias("onset"), F.array(onset).alias("times"))
    return rows.select("song", "entry", F.col("t").alias("timestamp"), "duration", F.array(one).alias("onsets"), *[v.alias(k) for k, v in columns.items()])


def _times(out: DataFrame) -> DataFrame:
    return out.select("song", "entry", F.round("time", 6).alias("time"))


@query(
    _fold_sql(
        ", t + (0.43 + segment % 10 * 0.05)::DOUBLE AS p, segment / 40.0::DOUBLE AS lead",
        "lead BETWEEN 0.45 AND 3.0 AND NOT (score > 0.80 AND lead > 2.10) AND hi - n.t >= 1.0 AND score + 0.3 >= 0.55 AND p >= n.t + 0.42 AND p <= least(n.t + 0.90, hi - 0.12) AND ((score <= 0.80 AND p - n.t <= 0.65) OR (score > 0.90 AND lead < 0.90 AND p - n.t <= 0.75) OR (score > 0.90 AND lead >= 1.60 AND p - n.t <= 0.50)) AND lo + 0.10 < p AND p < hi - 0.10",
        "p",
    )
    + " SELECT song, entry, round(v, 6) AS time FROM f"
)
def late_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("t"), F.col("segment")
    rows = _repair_lines(spark, sf_dir, t + (0.43 + k % 10 * 0.05), F.col("score") + 0.3, score=F.col("score"), forced=t - k / 40.0)
    return _times(repairs.late_onset(rows))


_PRE = "greatest(lo + 0.10, hi - least(2.2, greatest(1.4, segment * 0.055::DOUBLE)))"


@query(
    _fold_sql("", f"n.entry > 1 AND segment % 2 = 0 AND score >= 0.80 AND hi - n.t >= 12 AND segment % 5 < 4 AND {_PRE} > n.t + 5 AND {_PRE} < hi - 0.20 AND {_PRE} > lo AND {_PRE} < hi", _PRE).replace("THEN " + _PRE, "THEN " + _PRE.replace("lo", "0.0::DOUBLE"), 1).replace("THEN " + _PRE, "THEN " + _PRE.replace("lo", "f.v"), 1)
    + " SELECT song, entry, round(v, 6) AS time FROM f"
)
def long_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("t"), F.col("segment")
    rows = lines(spark, sf_dir).withColumn("duration", F.max("t").over(Window.partitionBy("song")) + 10)
    after = F.coalesce(F.lead("t").over(Window.partitionBy("song").orderBy("entry")), F.col("duration"))
    end = after + k % 5 * 0.09
    rows = rows.withColumn("segment_end", end).select("song", "entry", t.alias("timestamp"), "duration", "score", F.when(k % 2 == 0, t - 20).otherwise(F.col("segment_end") - 5).alias("segment_start"), "segment_end", k.alias("norm_len"))
    return _times(repairs.long_segment_repair(rows))


@query(
    _fold_sql(
        ", t - (0.1 + segment % 10 * 0.083)::DOUBLE AS p",
        "segment % 2 = 0 AND score >= 0.30 AND (n.t - 0.08) - greatest(lo + 0.20, n.t - 0.90) >= 0.20 AND p >= greatest(lo + 0.20, n.t - 0.90) + 0.20 AND p <= n.t - 0.08 AND n.t - p BETWEEN 0.25 AND 0.80 AND lo + 0.05 < p AND p < hi - 0.05",
        "p",
    )
    + " SELECT song, entry, round(v, 6) AS time FROM f"
)
def opening_backtracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("t"), F.col("segment")
    scores = F.array(*[F.lit(0.05)] * 4, F.col("score"))
    rows = _repair_lines(spark, sf_dir, t - (0.1 + k % 10 * 0.083), F.lit(0.6), fused=k % 2 == 0, ctc_score=F.col("score"), token_scores=scores)
    return _times(repairs.opening_backtrack(rows))


@query(
    _fold_sql(
        ", t - (0.3 + segment % 10 * 0.051)::DOUBLE AS p",
        "n.entry > 1 AND segment % 2 = 0 AND score * 0.4 <= 0.22 AND hi - n.t >= 1.2 AND p >= greatest(lo + 0.80, n.t - 0.90) + 0.20 AND p <= n.t - 0.10 AND n.t - p BETWEEN 0.45 AND 0.75 AND lo + 0.20 < p AND p < hi - 0.20",
        "p",
    )
    + " SELECT song, entry, round(v, 6) AS time FROM f"
)
def initial_backtracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("t"), F.col("segment")
    none = F.lit(None).cast("array<struct<time: double, score: double>>")
    rows = _repair_lines(spark, sf_dir, t - (0.3 + k % 10 * 0.051), F.lit(0.5), romaji=F.when(k % 2 == 0, "ra").otherwise("ka"), ctc_score=F.col("score") * 0.4, first_score=F.lit(0.0), peaks=none, norm_len=F.lit(5))
    return _times(repairs.initial_backtrack(rows))


@query(f"""WITH {BASE}, x AS (SELECT song, entry, t / 5000 + 1 AS t, CASE WHEN entry < 4 THEN 0.1 ELSE score END AS s FROM base), a AS (SELECT song, min(entry) AS e, arg_min(t, entry) AS ta FROM x WHERE entry > 1 AND s >= 0.62 AND t >= 20 GROUP BY song),
c AS (SELECT song, count(*) AS n FROM x GROUP BY song), o AS (SELECT a.*, e - 1 AS k, greatest(0, ta - least(12, 4 + 4 * (e - 1))) AS st FROM a JOIN c USING (song) WHERE n >= 3 AND e >= 3),
p AS (SELECT *, ceil(st + 0.2) AS onset FROM o WHERE ceil(st + 0.2) <= greatest(st + 0.2, ta - 6) AND ceil(st + 0.2) > 2)
SELECT x.song, x.entry, round(CASE WHEN x.entry <= p.k THEN least(onset + greatest(0.2, ta - onset) * (x.entry - 1) / p.k, ta - 0.10 * (p.k - x.entry + 1)) ELSE t END, 6) AS time FROM x LEFT JOIN p USING (song)""")
def intro_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines are poor; there is an onset at every whole second."""
    every = F.transform(F.sequence(F.lit(0), F.lit(2000)), lambda i: F.struct(i.cast("double").alias("t"), F.lit(0.9).alias("onset"), F.array(i.cast("double")).alias("times")))
    rows = lines(spark, sf_dir).select("song", "entry", (F.col("t") / 5000 + 1).alias("timestamp"), F.when(F.col("entry") < 4, 0.1).otherwise(F.col("score")).alias("score"), F.lit(1).alias("segment"), F.lit(False).alias("borrowed"), F.when(F.col("entry") == 1, every).alias("onsets"))
    return _times(repairs.intro_repair(rows.withColumn("duration", F.max("timestamp").over(Window.partitionBy("song")) + 10)))


@query(f"""WITH {BASE}, x AS (SELECT *, max(t) OVER w + 100 AS d, count(*) OVER w AS n FROM base WINDOW w AS (PARTITION BY song)), y AS (SELECT *, n - 3 AS first FROM x), z AS (SELECT song, max(CASE WHEN entry = first - 1 THEN t END) AS pt FROM y GROUP BY song)
SELECT y.song, entry, round(CASE WHEN first > 1 AND entry >= first AND pt > 0 AND d - pt - 13 >= 8 THEN least(d, pt + 13 + (d - pt - 13) * (entry - first) / 4.0::DOUBLE) ELSE t END, 6) AS time FROM y JOIN z USING (song)""")
def tail_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last four lines are a tail that repeats itself; singing goes on 13 s after the line before them."""
    whole, order = Window.partitionBy("song"), Window.partitionBy("song").orderBy("entry")
    rows = lines(spark, sf_dir).withColumns({"n": F.count(F.lit(1)).over(whole), "duration": F.max("t").over(whole) + 100})
    rows = rows.withColumn("tail_entry", (F.col("n") - 3).cast("int"))
    onset = F.max(F.when(F.col("entry") == F.col("tail_entry") - 1, F.col("t"))).over(whole) + 13
    made = rows.select("song", "entry", F.col("t").alias("timestamp"), "duration", F.lit(1.0).alias("weight"), "tail_entry", F.lit(True).alias("repeated_tail"), onset.alias("tail_onset"), F.lit(None).cast("double").alias("voice_end"))
    return _times(repairs.tail_repair(made))


@query(
    _fold_sql(
        ", segment % 9 AS q, t - (1.3 + segment % 9 * 0.6)::DOUBLE AS p",
        "n.entry > 1 AND segment % 2 = 0 AND n.t - lo >= 3.5 AND p - 0.25 >= greatest(lo + 0.40, n.t - 7.0) AND p <= n.t - 0.45 AND p <= least(n.t - 0.45, p + 0.2) AND n.t - p BETWEEN 1.20 AND 6.80 AND lo + 0.05 < p AND p < hi - 0.05",
        "p",
    )
    + " SELECT song, entry, round(v, 6) AS time FROM f"
)
def duplicate_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged short lines whose raw time is a quarter of a second before an onset."""
    t, k = F.col("t"), F.col("segment")
    p = t - (1.3 + k % 9 * 0.6)
    flag = F.when(k % 2 == 0, F.array(F.lit("short_duplicate_asr_consensus_untrusted")))
    rows = _repair_lines(spark, sf_dir, p, F.lit(0.9), short_duplicate=F.lit(True), flags=flag, evidence=F.create_map(F.lit("raw"), p - 0.25))
    return _times(repairs.short_duplicate_recovery(rows))


# -- What is left of files and gates -------------------------------------------------------


@query(f"""WITH {BASE}, e AS (SELECT song, entry, CASE WHEN segment % 4 = 0 THEN 0 ELSE 100 END AS cs, CASE WHEN segment % 3 = 0 THEN backend || ' - song' WHEN segment % 3 = 1 THEN 'song' ELSE 'x - y' END AS x FROM base),
k AS (SELECT * FROM e WHERE NOT (cs = 0 AND contains(x, '-') AND contains(regexp_replace(x, '[^0-9A-Za-z]+', '', 'g'), 'song')))
SELECT song, CAST(row_number() OVER (PARTITION BY song ORDER BY entry) AS INTEGER) AS entry, x AS line FROM k""")
def title_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("segment")
    text = F.when(k % 3 == 0, F.concat("backend", F.lit(" - song"))).when(k % 3 == 1, "song").otherwise("x - y")
    rows = lines(spark, sf_dir).select(F.col("song").alias("doc_id"), "entry", F.when(k % 4 == 0, 0).otherwise(100).alias("time_cs"), F.array(text).alias("lines"))
    out = lrc.drop_title_cards(rows, rows.select("doc_id").distinct().withColumn("title", F.lit("so ng!")))
    return out.select(F.col("doc_id").alias("song"), "entry", F.element_at("lines", 1).alias("line"))


def _mmss(cs: str) -> str:
    return f"printf('%02d:%02d.%02d', {cs} // 6000, {cs} % 6000 // 100, {cs} % 100)"


@query(f"""WITH {BASE}, e AS (SELECT song, entry, CAST(round_even(greatest(0.0, value / 3) * 100, 0) AS BIGINT) AS cs, backend || segment AS x FROM base), b AS (SELECT song, string_agg('[' || {_mmss('cs')} || ']' || x || chr(10) || '[' || {_mmss('cs')} || ']second', chr(10) ORDER BY entry) AS body FROM e GROUP BY song)
SELECT song, md5(chr(65279) || '[ti:' || CASE WHEN song % 2 = 0 THEN 'Some One ' ELSE '' END || 'Title]' || chr(10) || '[re:timeline engine]' || chr(10) || '[length:03:20.00]' || chr(10) || '[by:timeline engine]' || chr(10) || '[00:00.00]' || CASE WHEN song % 2 = 0 THEN 'Some One - ' ELSE '' END || 'Title' || chr(10) || body || chr(10)) AS content FROM b""")
def lrc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select(F.col("song").alias("doc_id"), "entry", F.array(F.concat("backend", F.col("segment").cast("string")), F.lit("second")).alias("lines"), (F.col("value") / 3).alias("t"))
    heads = rows.select("doc_id").distinct().select("doc_id", F.when(F.col("doc_id") % 2 == 0, "Some One").alias("artist"), F.lit("Title").alias("title"), F.lit(200.0).alias("duration"))
    return lrc.lrc_text(rows, heads).select(F.col("doc_id").alias("song"), F.md5("content").alias("content"))


@query(f"""WITH {BASE}, o AS (SELECT song, entry, backend || segment AS x, CAST(floor(value * 20) AS BIGINT) AS cs FROM base), g AS (SELECT *, CASE WHEN cs = lag(cs) OVER (PARTITION BY song ORDER BY entry) THEN 0 ELSE 1 END AS n FROM o),
r AS (SELECT *, sum(n) OVER (PARTITION BY song ORDER BY entry) AS e FROM g)
SELECT song, CAST(e AS INTEGER) AS entry, CAST(min(cs) AS INTEGER) AS time_cs, string_agg(x || '|second', '|' ORDER BY entry) AS lines FROM r WHERE cs > 0 GROUP BY song, e""")
def lrc_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished files, written through the sink, read from the folder and parsed as the evaluator does; entries at zero, where the title card is, are left out."""
    t = F.floor(F.col("value") * 20) / 100.0
    rows = lines(spark, sf_dir).select(F.concat(F.lit("S"), F.col("song").cast("string"), F.lit(".lrc")).alias("doc_id"), "entry", F.array(F.concat("backend", F.col("segment").cast("string")), F.lit("second")).alias("lines"), t.alias("t"))
    heads = rows.select("doc_id").distinct().select("doc_id", F.lit("Some One").alias("artist"), F.lit("Title").alias("title"), F.lit(200.0).alias("duration"))
    folder = shared_folder(spark, "lrc")
    lrc.write_texts(lrc.lrc_text(rows, heads), folder)
    song = F.regexp_extract("doc_id", r"S(\d+)\.lrc$", 1).cast(table(spark, sf_dir, "events").schema["user_id"].dataType)
    back = lrc.for_evaluation(lrc.parse_for_evaluation(lrc.read_texts(spark, folder))).filter("time_cs > 0")
    return back.select(song.alias("song"), "entry", "time_cs", F.array_join("lines", "|").alias("lines"))


#: Bytes of the WAV files that lie in the shared folder at a time; sound is some thousand times as large as the events that it is made of.
ROUND_BYTES = 2 << 30


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song, steps: the loudness of each tenth of a second, one for each event, by its values."""
    loud = 1000 + F.pmod(F.col("segment") * 300 + F.floor(F.col("value") * 10), F.lit(30000))
    return lines(spark, sf_dir).groupBy("song").agg(F.transform(F.array_sort(F.collect_list(F.struct("entry", loud.alias("a")))), lambda x: x["a"].cast("int")).alias("steps"))


def _sounds(spark: SparkSession, sf_dir: str, steps: DataFrame | None = None) -> str:
    """A folder with a WAV file for each user, or for those of ``steps``, written through the sink."""
    # few bytes an event here, but many in the files: they are dealt out to all tasks
    steps = dealt(_steps(spark, sf_dir) if steps is None else steps, "song")

    def sound(parts):
        import io
        import wave

        for part in parts:
            for song, heights in zip(part["song"], part["steps"], strict=True):
                there = np.repeat(np.asarray(heights, np.int16), audio.RATE // 10)
                wave_of = np.where(np.arange(len(there)) // 20 % 2 == 0, there, -there).astype("<i2")
                with wave.open(held := io.BytesIO(), "wb") as f:
                    f.setparams((1, 2, audio.RATE, 0, "NONE", ""))
                    f.writeframes(wave_of.tobytes())
                # one file at a time: a part has the songs of thousands
                yield pd.DataFrame({"name": [f"S{song}.wav"], "content": [held.getvalue()]})

    folder = shared_folder(spark, "sounds")
    write_files(steps.mapInPandas(sound, "name string, content binary"), folder)
    return folder


def _heard(spark: SparkSession, sf_dir: str, hear: Callable[[str], DataFrame]) -> DataFrame:
    """What ``hear`` tells of the WAV files of a folder, of all users: in rounds of whole users, some ROUND_BYTES each, whose files go when what they tell is stored."""
    rounds = max(1, math.ceil(table(spark, sf_dir, "events").count() * (audio.RATE // 10) * 2 / ROUND_BYTES))
    told, kind = shared_folder(spark, "told"), table(spark, sf_dir, "events").schema["user_id"].dataType
    with passing(spark):
        steps, kept = _steps(spark, sf_dir).withColumn("round", F.pmod(F.xxhash64("song"), F.lit(rounds))), shared_folder(spark, "steps")
        steps.write.partitionBy("round").parquet(kept)
        steps = spark.read.schema(steps.schema).parquet(kept)
        # a round that no user falls into has no files
        for number in sorted(r["round"] for r in steps.select("round").distinct().collect()) or [0]:
            with passing(spark):
                out = hear(_sounds(spark, sf_dir, steps.filter(F.col("round") == number).select("song", "steps")))
                out = out.withColumn("song", F.regexp_extract("song", r"S(\d+)\.wav$", 1).cast(kind))
                out.write.mode("append").parquet(told)
    return spark.read.schema(out.schema).parquet(told)


@query(f"""WITH {BASE}, a AS (SELECT song, entry - 1 AS k, count(*) OVER (PARTITION BY song) AS n, power((1000 + (segment * 300 + CAST(floor(value * 10) AS BIGINT)) % 30000) / 32768.0::DOUBLE, 2) AS e FROM base),
f AS (SELECT song, n, unnest(range(0, 1 + (n * 1600 - 960) // 320)) AS f FROM (SELECT DISTINCT song, n FROM a) WHERE n >= 10),
l AS (SELECT f.song, f.f, sqrt((x.e + y.e + z.e) / 3 + 1e-12) AS level FROM f JOIN a x ON x.song = f.song AND x.k = f.f // 5 JOIN a y ON y.song = f.song AND y.k = (f.f + 1) // 5 JOIN a z ON z.song = f.song AND z.k = (f.f + 2) // 5)
SELECT song, CAST(f AS INTEGER) AS frame_idx, round(f * 0.02::DOUBLE, 6) AS t, round(20 * log10(level + 1e-9), 6) AS rms_db FROM l""")
def sound_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the frames of WAV files; users with under a second of sound have none."""
    return _heard(spark, sf_dir, lambda folder: audio.read_frames(spark, folder, range_frames=50).select("song", "frame_idx", F.round("t", 6).alias("t"), F.round("rms_db", 6).alias("rms_db")))


@query()
def sound_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voiced stretches of the same files; spectra are not for SQL."""
    heard = _heard(spark, sf_dir, lambda folder: audio.vocal_segments(audio.onset_frames(audio.read_frames(spark, folder))))
    return heard.select("song", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(f"""WITH {BASE}, b AS (SELECT song, string_agg(CAST(segment AS VARCHAR), ';' ORDER BY entry) AS x, count(*) AS n FROM base GROUP BY song)
SELECT song, kind, CASE kind WHEN 'csv' THEN CAST(n AS BIGINT) + 1 WHEN 'json' THEN 4 ELSE n END AS n_lines, md5(CASE kind WHEN 'json' THEN x ELSE '' END) AS held FROM b CROSS JOIN (SELECT unnest(['csv', 'json']) AS kind)""")
def report_files_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report and an audit of every song as JSON and CSV files, written through the sink and read from the folder."""
    rows = lines(spark, sf_dir)
    made = rows.groupBy("song").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("entry", "segment"))), lambda x: x["segment"].cast("string")), ";").alias("segments"), F.count(F.lit(1)).alias("n"))
    named = lambda end: F.concat(F.lit("S"), F.col("song").cast("string"), F.lit(end))
    tables = reports.csv_text(rows.select("song", F.col("entry").cast("string").alias("entry"), F.col("segment").cast("string").alias("segment"), F.col("entry").alias("at")), ("entry", "segment"), F.col("at"), "song")
    folder = shared_folder(spark, "reports")
    write_files(reports.report_json(made, "song").select(named(".json").alias("name"), "content").unionByName(tables.select(named(".csv").alias("name"), "content")), folder)
    back = lrc.read_texts(spark, folder)
    song = F.regexp_extract("doc_id", r"S(\d+)\.\w+$", 1).cast(made.schema["song"].dataType)
    text = F.when(F.col("doc_id").endswith(".json"), F.get_json_object("content", "$.segments")).otherwise("")
    parts = F.size(F.split(F.regexp_replace("content", r"\r?\n$", ""), r"\r?\n")).cast("long")
    return back.select(song.alias("song"), F.regexp_extract("doc_id", r"(\w+)$", 1).alias("kind"), parts.alias("n_lines"), F.md5(text).alias("held"))


@query(f"""WITH {BASE}, r AS (SELECT song, entry, segment, CAST(floor(value * 20) AS BIGINT) AS cs FROM base), l AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY entry) AS pos FROM r WHERE segment % 5 <> 1 AND segment % 5 <> 2),
g AS (SELECT *, CASE WHEN segment % 5 = 0 THEN entry END AS num, CASE WHEN segment % 5 <> 0 AND cs = lag(cs) OVER (PARTITION BY song ORDER BY entry) THEN 0 ELSE 1 END AS nw FROM l), h AS (SELECT *, sum(nw) OVER (PARTITION BY song ORDER BY entry) AS i FROM g)
SELECT song, CAST(i AS INTEGER) AS hint_idx, CAST(arg_min(num, entry) AS INTEGER) AS entry_number, CAST(min(cs) AS INTEGER) AS time_cs, string_agg('a' || segment, '|' ORDER BY entry) AS lines FROM (SELECT *, coalesce(num, -1) AS z FROM h) GROUP BY song, i""")
def anchor_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor files with numbered hints, comments and markers, parsed."""
    cs, k = F.floor(F.col("value") * 20), F.col("segment")
    tag = F.format_string("[%02d:%02d.%02d]", (cs / 6000).cast("long"), (F.pmod(cs, F.lit(6000)) / 100).cast("long"), F.pmod(cs, F.lit(100)))
    hint = F.concat(tag, F.lit("a"), k.cast("string"))
    line = F.when(k % 5 == 0, F.concat(F.lit("# entry = "), F.col("entry").cast("string"), F.lit("\n"), hint)).when(k % 5 == 1, "# a note").when(k % 5 == 2, F.concat(tag, F.lit("♪"))).otherwise(hint)
    docs = lines(spark, sf_dir).filter("segment % 5 <> 2").select("song", F.struct("entry", line.alias("line")).alias("r")).groupBy("song").agg(F.array_sort(F.collect_list("r")).alias("r"))
    docs = docs.select(F.col("song").alias("doc_id"), F.array_join("r.line", "\n").alias("content"))
    return lrc.parse_anchors(docs).select(F.col("doc_id").alias("song"), "hint_idx", "entry_number", "time_cs", F.array_join("lines", "|").alias("lines"))


@query(REPORT + """ SELECT song, backend, trusted_entries = 0 OR trusted_percent < 35 OR (timing_entries >= 6 AND low_confidence_count >= ceil(timing_entries * 0.8)) OR timing_entries % 5 = 0 OR (timing_entries >= 8 AND (trusted_percent < 85 OR low_confidence_percent >= 50 OR timing_entries % 6 >= 4 OR timing_entries % 4 >= ceil(timing_entries * 0.25))) AS untrusted FROM m""")
def untrusted_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("timing_entries")
    rows = _reports(spark, sf_dir).withColumns({"collapse_detected": n % 5 == 0, "max_post_long_uncertain_run": n % 6, "high_risk_count": n % 4})
    return rows.select("song", "backend", metrics.is_untrusted().alias("untrusted"))


@query(f"WITH {BASE} SELECT song, entry, segment % 10 / 100.0::DOUBLE <= 0.04 AND value / 500 >= 0.30 AND score * 0.9 >= greatest(0.05, score * 0.8 * 1.05) AS accepted FROM base")
def zero_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metrics.accept_zero_gap(F.col("segment") % 10 / 100.0, F.col("score") * 0.8, F.lit(0.0), F.col("value") / 500, F.col("score") * 0.9)
    return lines(spark, sf_dir).select("song", "entry", got.alias("accepted"))


@query(f"""WITH {BASE}, x AS (SELECT *, lag(entry) OVER w AS le FROM base WINDOW w AS (PARTITION BY song ORDER BY entry)), p AS (SELECT song, entry, t FROM base WHERE score >= 0.55)
SELECT b.song, b.entry, round(min(p.t), 6) AS peak_time FROM base b LEFT JOIN p ON p.song = b.song AND p.t BETWEEN b.t AND b.t + 50000 WHERE b.backend = 'click' GROUP BY 1, 2""")
def late_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame of 0.55 or more, where every second frame is silent: each is a peak, with no lead-in."""
    rows = lines(spark, sf_dir)
    loud = rows.select("song", F.explode(F.array(F.struct(F.col("t").alias("t"), F.col("score").alias("onset")), F.struct((F.col("t") + 1e-4).alias("t"), F.lit(0.0).alias("onset")))).alias("f")).select("song", "f.*")
    spans = rows.filter("backend = 'click'").select("song", "entry", F.col("t").alias("start"), (F.col("t") + 50000).alias("end"))
    return joins.first_peak(spans, loud, 0.55).select("song", "entry", F.round("peak_time", 6).alias("peak_time"))


@query(f"""WITH {BASE}, x AS (SELECT song, entry, CASE WHEN segment % 6 > 0 THEN t + segment - 50 END AS st, CASE WHEN segment % 4 > 0 THEN score * 0.2 ELSE 0 END AS c, max(t) OVER (PARTITION BY song) + 10 AS d FROM base),
y AS (SELECT *, CASE WHEN st IS NOT NULL THEN greatest(0.0, least(d, st)) WHEN entry = 1 THEN 0.0 END AS v FROM x)
SELECT song, entry, st IS NULL AS missing, round(max(v - 0.10 * entry) OVER (PARTITION BY song ORDER BY entry) + 0.10 * entry, 6) AS timestamp, CASE WHEN st IS NULL THEN 0.0 WHEN c >= 0.08 THEN 0.9 WHEN c >= 0.03 THEN 0.7 ELSE 0.35 END::DOUBLE AS score FROM y""")
def validated_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("t"), F.col("segment")
    rows = lines(spark, sf_dir).select("song", "entry", F.when(k % 6 > 0, t + k - 50).alias("start"), F.when(k % 4 > 0, F.col("score") * 0.2).alias("ctc_score"), (F.max("t").over(Window.partitionBy("song")) + 10).alias("duration"))
    return diagnostics.validated_path(rows).select("song", "entry", "missing", F.round("timestamp", 6).alias("timestamp"), "score")


@query(f"""WITH {BASE}, x AS (SELECT *, segment % 3 = 0 AS old, segment % 4 = 0 AS rev, segment % 4 = 1 AS fixed FROM base)
SELECT song, entry, array_to_string(CASE WHEN rev AND old THEN ['f', 'g'] WHEN rev THEN ['g', 'f'] WHEN fixed THEN ['f', 'settled'] ELSE ['f'] END, ';') AS flags, CASE WHEN old AND fixed THEN 'resolved' WHEN old THEN 'low' WHEN score >= 0.45 THEN 'medium' ELSE 'high' END AS severity,
 CASE WHEN rev THEN true WHEN fixed THEN false ELSE segment % 2 = 0 END AS review_required, CASE WHEN fixed THEN 'why' END AS resolution, round(CASE WHEN rev THEN t END, 6) AS chosen_time FROM x WHERE old OR rev""")
def risk_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = lines(spark, sf_dir), F.col("segment")
    review, fixed = k % 4 == 0, k % 4 == 1
    risks = rows.filter("segment % 3 = 0").select("song", "entry", F.array(F.lit("f")).alias("flags"), F.lit("low").alias("severity"), (k % 2 == 0).alias("review_required"))
    made = rows.select(
        "song", "entry", F.col("t").alias("time"), F.col("score").alias("confidence"), review.alias("review"), F.when(fixed, F.array(F.lit("x"), F.lit("settled"))).otherwise(F.array(F.lit("g"), F.lit("f"))).alias("flags"),
        F.when(review, F.when(F.col("score") >= 0.45, "medium").otherwise("high")).when(fixed, "resolved").alias("severity"), F.when(fixed, "why").alias("resolution"),
    )
    out = scoring.upsert_risks(risks, made)
    return out.select("song", "entry", F.array_join("flags", ";").alias("flags"), "severity", "review_required", "resolution", F.round("chosen_time", 6).alias("chosen_time"))
