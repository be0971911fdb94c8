"""Registered queries on reports, attempts and profiles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.functions import text as tx
from linekeeper.operators import candidates, diagnostics, planning, repairs
from linekeeper.plans.catalogue import BASE, CONV, conversation_lines, lines, query
from linekeeper.plans.words import word_candidate
from linekeeper.sources import files, reports
from linekeeper.sources.shared import stored


@query(f"""WITH {BASE} SELECT song, count(*) AS timing_entries, count_if(segment % 7 = 0) AS ctc_missing_count, count_if(score < 0.4) AS ctc_low_score_count, count_if(score < 0.1) AS ctc_very_low_score_count, count_if(segment % 5 = 0) AS review_required_count,
 round(min(CASE WHEN segment % 7 > 0 THEN score * 0.2 END), 6) AS ctc_score_min, round(avg(CASE WHEN segment % 7 > 0 THEN score * 0.2 END), 6) AS ctc_score_mean, bool_or(segment = 13) AS collapse_detected FROM base GROUP BY song""")
def path_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("segment"), F.col("score")
    rows = lines(spark, sf_dir).select("song", (k % 7 == 0).alias("missing"), (s < 0.4).alias("low"), (s < 0.1).alias("very_low"), (k % 5 == 0).alias("review"), F.when(k % 7 > 0, s * 0.2).alias("ctc_score"), (k == 13).alias("collapsed"))
    out = diagnostics.path_report(rows)
    return out.withColumns({c: F.round(c, 6) for c in ("ctc_score_min", "ctc_score_mean")})


@query(f"""WITH {BASE}, g AS (SELECT song, md5(string_agg(round(t, 3)::DECIMAL(20, 3) || '-' || round(t + value, 3)::DECIMAL(20, 3) || ' ' || backend, ';' ORDER BY entry)) AS held, round(max(t + value - t), 3) AS longest FROM base WHERE segment % 2 = 0 GROUP BY song)
SELECT DISTINCT b.song, 'whispercpp_raw' AS backend, true AS diagnostic_only, coalesce(longest, 0) AS raw_asr_max_segment_seconds, CASE WHEN b.song % 4 > 0 THEN b.song % 3 = 0 END AS asr_repeated_tail_after_0s, held FROM base b LEFT JOIN g ON g.song = b.song""")
def raw_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw recognition as a diagnostic, with its segments' digest; some songs have no repeat told."""
    rows = lines(spark, sf_dir)
    songs = rows.select("song").distinct()
    told = songs.withColumns({"backend": F.lit("x"), "strategy": F.lit("y")})
    segments = rows.filter("segment % 2 = 0").select("song", F.col("entry").alias("seg_idx"), F.col("t").alias("start"), (F.col("t") + F.col("value")).alias("end"), F.col("backend").alias("text"))
    out = candidates.raw_diagnostic(told, segments, songs.filter("song % 4 > 0").withColumn("repeated", F.col("song") % 3 == 0))
    clock = lambda c: c.cast("decimal(20,3)").cast("string")
    held = F.md5(F.array_join(F.transform("raw_asr_segments", lambda x: F.concat(clock(x["start"]), F.lit("-"), clock(x["end"]), F.lit(" "), x["text"])), ";"))
    return out.select("song", "backend", "diagnostic_only", "raw_asr_max_segment_seconds", "asr_repeated_tail_after_0s", held.alias("held"))


@query(f"""WITH {BASE}, r AS (SELECT song, song % 3 = 0 AS failed, count(*) AS n FROM base GROUP BY song)
SELECT r.song, 'ctc' AS backend, CASE WHEN failed THEN 'no path' ELSE '' END AS error, CASE WHEN NOT failed THEN n END AS timing_entries, CASE WHEN failed THEN 0 ELSE n END AS lines FROM r""")
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of which every third failed: these keep their error alone and have no lines."""
    rows = lines(spark, sf_dir)
    told = rows.groupBy("song").agg(F.count(F.lit(1)).alias("timing_entries")).withColumns({"error": F.when(F.col("song") % 3 == 0, "no path").otherwise(""), "backend": F.lit("other")})
    kept, held = candidates.attempted(told, rows.select("song", "entry"), "ctc")
    counts = held.groupBy("song").agg(F.count(F.lit(1)).alias("lines"))
    return kept.join(counts, "song", "left").select("song", "backend", "error", "timing_entries", F.coalesce("lines", F.lit(0)).alias("lines"))


@query(f"""WITH {BASE} SELECT song, entry, CASE WHEN entry > segment THEN 'retry' ELSE 'normal' END AS source, round(t, 3) AS timestamp, CASE WHEN entry > segment THEN segment + 1000 ELSE segment END AS segment, CASE WHEN entry > segment THEN score / 2 ELSE score END AS score FROM base""")
def spliced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments of a splice: each line's from the candidate that its time is from."""
    rows = lines(spark, sf_dir)
    spliced = rows.select("song", "entry", F.col("t").alias("time"), F.when(F.col("entry") > F.col("segment"), "retry").otherwise("normal").alias("source"))
    normal = rows.select("song", "entry", F.col("t").alias("timestamp"), "segment", "score")
    retry = normal.withColumns({"segment": F.col("segment") + 1000, "score": F.col("score") / 2})
    return candidates.spliced_assignments(spliced, normal, retry).select("song", "entry", "source", "timestamp", "segment", "score")


_WEIGHTED = "coalesce(round(sum(CASE WHEN entries > 0 THEN {c} * entries END) / sum(CASE WHEN entries > 0 AND {c} IS NOT NULL THEN entries END), 2), 0)"


@query(f"""WITH {BASE}, r AS (SELECT backend AS category, CASE WHEN segment % 4 > 0 THEN 'OK' ELSE 'SKIP' END AS status, segment % 9 AS entries, CASE WHEN segment % 5 > 0 THEN value END AS a, score * 10 AS b FROM base)
SELECT category, count(*) AS songs, CAST(sum(entries) AS BIGINT) AS entries, {_WEIGHTED.format(c='a')} AS within_25cs_percent, {_WEIGHTED.format(c='b')} AS within_50cs_percent, {_WEIGHTED.format(c='a')} AS trusted_percent, {_WEIGHTED.format(c='b')} AS review_required_percent FROM r WHERE status = 'OK' GROUP BY category""")
def category_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("segment")
    a, b = F.when(k % 5 > 0, F.col("value")), F.col("score") * 10
    rows = lines(spark, sf_dir).select(F.col("backend").alias("category"), F.when(k % 4 > 0, "OK").otherwise("SKIP").alias("status"), (k % 9).alias("entries"), a.alias("within_25cs_percent"), b.alias("within_50cs_percent"), a.alias("trusted_percent"), b.alias("review_required_percent"))
    return reports.corpus_rollup(rows).withColumn("entries", F.col("entries").cast("long"))


@query(f"""WITH {CONV} SELECT song, md5(string_agg(entry || ':' || (entry + 1) || ' ' || text, '|' ORDER BY entry)) AS transcript, count(*) AS n FROM conv WHERE trim(text, ' ') <> '' GROUP BY song""")
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a song's recognised segments, in order."""
    rows = conversation_lines(spark, sf_dir)
    out = reports.transcript(rows.select("song", F.col("entry").alias("seg_idx"), F.col("entry").cast("double").alias("start"), (F.col("entry") + 1.0).alias("end"), "text"))
    each = F.transform("transcript", lambda x: F.concat(x["start"].cast("int").cast("string"), F.lit(":"), x["end"].cast("int").cast("string"), F.lit(" "), x["text"]))
    return out.select("song", F.md5(F.array_join(each, "|")).alias("transcript"), F.size("transcript").cast("long").alias("n"))


@query(f"""WITH {BASE}, x AS (SELECT song, entry, CASE WHEN NOT (song % 3 = 0 AND entry = 2) THEN segment * 7 END AS cs FROM base), y AS (SELECT *, bool_or(cs IS NULL) OVER (PARTITION BY song) AS bad FROM x)
SELECT song AS doc_id, entry, CASE WHEN NOT bad THEN cs / 100.0::DOUBLE END AS t, CASE WHEN bad THEN 'entry without a time' END AS error FROM y""")
def lyric_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that the lyrics bring; every third file has an entry without one."""
    cs = F.when(~((F.col("song") % 3 == 0) & (F.col("entry") == 2)), F.col("segment") * 7)
    return files.source_times(lines(spark, sf_dir).select(F.col("song").alias("doc_id"), "entry", cs.alias("time_cs")))


@query(f"""WITH {CONV}, x AS (SELECT song, entry, text, norm, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS latin FROM conv)
SELECT song, entry, md5(text) AS entry_text, left(norm, 8) AS normalized_prefix, right(norm, 8) AS normalized_suffix, CASE WHEN latin <> '' THEN 'latin-fallback' ELSE 'unavailable' END AS phonetic_system,
 CASE WHEN latin <> '' THEN left(latin, 12) END AS romaji_prefix, CASE WHEN latin <> '' THEN right(latin, 12) END AS romaji_suffix FROM x""")
def anchor_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn begins and ends with."""
    rows = conversation_lines(spark, sf_dir).select("song", "entry", tx.anchor_profile(F.col("text")).alias("p")).select("song", "entry", "p.*")
    return rows.select("song", "entry", F.md5("entry_text").alias("entry_text"), "normalized_prefix", "normalized_suffix", "phonetic_system", "romaji_prefix", "romaji_suffix")


@query(f"""WITH RECURSIVE {CONV}, w AS (SELECT song, entry, text, greatest(1.0::DOUBLE, len(regexp_extract_all(text, '[A-Za-z0-9'']+')) * 1.7::DOUBLE + greatest(0, length(regexp_replace(text, '[ \\t\\n\\r\\f\\x{{0b}}]+', '', 'g')) - length(array_to_string(regexp_extract_all(text, '[A-Za-z0-9'']+'), ''))) * 0.5::DOUBLE) AS wt FROM conv),
seg AS (SELECT song, entry * 19.0::DOUBLE + unnest(CASE song % 5 WHEN 0 THEN [1.0, 9.0] WHEN 1 THEN [1.0] WHEN 2 THEN CASE WHEN entry % 2 = 1 THEN [4.0] ELSE [] END WHEN 3 THEN CASE WHEN entry = 1 THEN [2.0] ELSE [] END ELSE [] END)::DOUBLE AS start FROM conv),
g AS (SELECT song, count(*) AS s, list(start ORDER BY start) AS starts, min(start) AS first, max(start) + 3 AS last FROM seg GROUP BY song),
b AS (SELECT *, coalesce(sum(wt) OVER (PARTITION BY w.song ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(wt) OVER (PARTITION BY w.song) AS total, count(*) OVER (PARTITION BY w.song) AS n, row_number() OVER (PARTITION BY w.song ORDER BY entry) AS pos FROM w),
r AS (SELECT b.song, entry, pos, n, before, total, coalesce(s, 0) AS s, starts, CASE WHEN first IS NULL THEN 12.0 ELSE greatest(0.0, least(first, 36.0)) END AS st, CASE WHEN last IS NULL THEN 188.0 ELSE least(200.0, greatest(last, 164.0)) END AS en FROM b LEFT JOIN g ON g.song = b.song),
q AS (SELECT *, CASE WHEN before = 0 THEN st ELSE least(en, st + greatest(1.0, en - st) * before / total) END::DOUBLE AS t FROM r),
p AS (SELECT *, CASE WHEN NOT (s >= greatest(3, n // 3) AND s <= greatest(4, n * 2)) THEN t WHEN s >= n THEN starts[CAST(round_even((pos - 1) * (s - 1) / greatest(1, n - 1)::DOUBLE, 0) AS INTEGER) + 1]
 ELSE CASE WHEN list_min([abs(x - t) FOR x IN starts]) <= 2.0 THEN list_min([{{'d': abs(x - t), 'x': x}} FOR x IN starts]).x ELSE t END END AS v FROM q),
f AS (SELECT song, pos, entry, n, greatest(0.0, least(200.0, CASE WHEN n > 1 THEN least(v, 200 - 0.28 * (n - 1)) ELSE v END))::DOUBLE AS time FROM p WHERE pos = 1 UNION ALL
 SELECT p.song, p.pos, p.entry, p.n, greatest(0.0, least(200.0, CASE WHEN p.pos < p.n THEN least(greatest(p.v, f.time + 0.28), 200 - 0.28 * (p.n - p.pos)) ELSE greatest(p.v, f.time + 0.28) END))::DOUBLE FROM f JOIN p ON p.song = f.song AND p.pos = f.pos + 1)
SELECT song, entry, round(time, 6) AS time FROM f""")
def guided_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heuristic times of turns: from voiced segments where there are about as many as turns, else by text weights; no onsets are near."""
    rows = conversation_lines(spark, sf_dir).withColumnRenamed("text", "line")
    k, none = F.col("song") % 5, F.array().cast("array<double>")
    at = F.when(k == 0, F.array(F.lit(1.0), F.lit(9.0))).when(k == 1, F.array(F.lit(1.0))).when((k == 2) & (F.col("entry") % 2 == 1), F.array(F.lit(4.0))).when((k == 3) & (F.col("entry") == 1), F.array(F.lit(2.0))).otherwise(none)
    segments = rows.select("song", "entry", F.explode(at).alias("x")).select("song", (F.col("entry") * 19.0 + F.col("x")).alias("start"), (F.col("entry") * 19.0 + F.col("x") + 3).alias("end"))
    songs = rows.select("song").distinct().withColumn("duration", F.lit(200.0))
    frames = spark.createDataFrame([], f"song {rows.schema['song'].dataType.simpleString()}, t double, onset double")
    return planning.plan(rows.select("song", "entry", "line"), songs, segments, frames).select("song", "entry", F.round("time", 6).alias("time"))


def _boundary_sql(before: str) -> str:
    """The time of a line where the line before is at ``before``: the first rule whose conditions hold, its span, limits and strength."""
    rule = f"""CASE WHEN n.entry = 1 AND t <= 1.0 THEN 1 WHEN NOT sure THEN 0 WHEN kind = 0 THEN 2 WHEN kind = 1 THEN 3 WHEN kind = 2 AND t - {before} >= 2.5 AND hi - t >= 2.5 THEN 4
 WHEN kind = 3 AND t - {before} >= 3.5 AND hi - t <= 2.2 THEN 5 WHEN kind IN (3, 4) AND hi - t <= 2.2 THEN 6 ELSE 0 END"""
    start = f"[0.2, greatest({before} + 0.10, t - 0.85), greatest({before} + 0.10, t - 0.85), t + 0.20, greatest({before} + 0.40, t - 6.80), t + 0.10][({rule})]"
    end = f"[greatest(0.21, t - 0.10), t - 0.12, t - 0.12, least(hi - 0.10, t + 0.70), t - 0.45, least(hi - 0.10, t + 0.85)][({rule})]"
    limits = f"t - p >= [0.12, 0.45, 0.45, -0.60, 1.20, -0.45][({rule})] AND t - p <= [0.35, 0.65, 0.65, -0.35, 6.50, -0.25][({rule})]"
    return f"CASE WHEN ({rule}) > 0 AND {end} > {start} AND {start} + 0.20 <= p AND p <= {end} AND strength >= CASE WHEN ({rule}) = 5 THEN 0.55 ELSE 0.65 END AND {limits} AND {before} + 0.05 < p AND p < hi - 0.05 THEN p ELSE t END"


@query(f"""WITH RECURSIVE {BASE}, x AS (SELECT song, entry, entry * 3.0::DOUBLE + entry % 3 * 0.9 - 3.1 AS t, segment % 6 AS kind, segment % 7 > 0 AS sure, 0.5 + segment % 4 * 0.1::DOUBLE AS strength, segment FROM base),
n AS (SELECT *, coalesce(lead(t) OVER w, max(t) OVER (PARTITION BY song) + 10)::DOUBLE AS hi, (t + CASE WHEN entry = 1 THEN -0.25 ELSE [-0.5, -0.5, 0.42, -1.5, 0.34, 0.3][kind + 1] - segment % 3 * 0.06 END)::DOUBLE AS p FROM x WINDOW w AS (PARTITION BY song ORDER BY entry)),
f AS (SELECT song, entry, ({_boundary_sql('0.0::DOUBLE')})::DOUBLE AS v FROM n WHERE entry = 1 UNION ALL SELECT n.song, n.entry, ({_boundary_sql('f.v')})::DOUBLE FROM f JOIN n ON n.song = f.song AND n.entry = f.entry + 1)
SELECT song, entry, round(v, 6) AS time FROM f""")
def boundary_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines some seconds apart with an onset each, and flags by their segment: every rule moves some."""
    k, e = F.col("segment"), F.col("entry")
    t = e * 3.0 + e % 3 * 0.9 - 3.1
    off = F.element_at(F.array(*map(F.lit, (-0.5, -0.5, 0.42, -1.5, 0.34, 0.3))), (k % 6 + 1).cast("int")) - k % 3 * 0.06
    onset = t + F.when(e == 1, -0.25).otherwise(off)
    flags = F.element_at(F.array(*[F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in (("candidate_disagreement",), *[("close_neighbor_onset_uncertain",)] * 2, *[repairs._SPLIT] * 2, ())]), (k % 6 + 1).cast("int"))
    rows = lines(spark, sf_dir).select(
        "song", "entry", t.alias("timestamp"), F.when(k % 7 > 0, 0.97).otherwise(0.5).alias("score"), flags.alias("flags"), F.when(k % 6 == 1, 3).when(k % 6 == 4, 20).otherwise(9).alias("norm_len"), F.lit(False).alias("settled"),
        F.array(F.struct(onset.alias("t"), (0.5 + k % 4 * 0.1).alias("onset"), F.array(onset).alias("times"))).alias("onsets"),
    )
    rows = rows.withColumn("duration", F.max("timestamp").over(Window.partitionBy("song")) + 10)
    return repairs.acoustic_boundaries(rows).select("song", "entry", F.round("time", 6).alias("time"))


def heard_turns(rows: DataFrame) -> DataFrame:
    """What a recogniser would have heard of turns: all but every third, without their first two characters, four seconds apart; every fifth is heard twice."""
    one = rows.filter("entry % 3 > 0").withColumn("k", F.explode(F.when(F.col("entry") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    start = F.col("entry") * 4.0 + F.col("k") * 1.5
    order = Window.partitionBy("song").orderBy("entry", "k")
    text = F.expr("substring(norm, 3)")
    return one.select("song", F.row_number().over(order).alias("seg_idx"), start.alias("start"), (start + 1.4).alias("end"), text.alias("text"), text.alias("norm"), F.array().cast("array<struct<ch: string, t: double>>").alias("chars"))


def _word_candidate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns are stored once their texts are in the form for matching: the plan reads them six times, and the form takes as long as a match."""
    rows = stored(conversation_lines(spark, sf_dir), "turns")
    made = rows.select("song", "entry", "text", "norm", (F.max("entry").over(Window.partitionBy("song")) * 4.0 + 10).alias("duration"))
    return word_candidate(made, heard_turns(rows))


@query()
def word_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word-level candidate of songs of turns as one plan: matches, duplicates, places, times; ratios are not for SQL."""
    out, _ = _word_candidate(spark, sf_dir)
    return out.select("song", "entry", "segment", F.round("time", 6).alias("time"), F.round("score", 6).alias("score"), "how")


@query()
def word_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its report and gate."""
    _, report = _word_candidate(spark, sf_dir)
    return report.select("song", "timing_entries", "assigned_entries", "trusted_entries", "low_confidence_count", "assigned_percent", "trusted_percent", "error")
