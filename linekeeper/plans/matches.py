"""Registered queries on the matching of texts and on alignment in windows, with SQL that finds blocks and paths itself.

Songs are brands, their lines and segments the brand's parts in the order of their keys; a
text is a part's name in the form that matching compares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.functions import kana
from linekeeper.functions import text as tx
from linekeeper.operators import forced, joins, matching, trellis
from linekeeper.plans import incremental
from linekeeper.plans.catalogue import BASE, lines, query, table
from linekeeper.sources import variants
from linekeeper.sources.shared import shared_folder

#: The longest common block of x and y: its length, and less the place where it begins in x.
_BEST = "list_max(flatten([[{'k': k, 'i': -i} for k in range(1, length(x) - i + 2) if contains(y, substr(x, i, k))] for i in range(1, length(x) + 1)]))"
#: r and s of every two names: the ratio of matching blocks, and the score of a segment b for an entry a.
RATIOS = f"""parts AS (SELECT p_brand AS song, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS entry, regexp_replace(p_name, '[^0-9A-Za-z]+', '', 'g') AS norm, p_size AS size FROM part),
names AS (SELECT DISTINCT norm AS n FROM parts),
w AS (SELECT a.n AS a, b.n AS b, a.n AS x, b.n AS y FROM names a CROSS JOIN names b UNION ALL
 SELECT a, b, unnest([left(x, i - 1), substr(x, i + k)]) AS x, unnest([left(y, j - 1), substr(y, j + k)]) AS y FROM
  (SELECT *, instr(y, substr(x, i, k)) AS j FROM (SELECT a, b, x, y, -m.i AS i, m.k AS k FROM (SELECT *, {_BEST} AS m FROM w) WHERE m IS NOT NULL))),
ratio AS (SELECT a, b, coalesce(sum(({_BEST}).k), 0) * 2.0::DOUBLE / (length(a) + length(b)) AS r FROM w GROUP BY a, b),
fit AS (SELECT a, b, r, CASE WHEN contains(b, a) THEN greatest(r, 0.96) WHEN contains(a, b) AND length(b) >= 4 THEN greatest(r, 0.72) ELSE r END AS s FROM ratio)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song, entry, norm, size."""
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("song"), F.row_number().over(order).alias("entry"), tx.match_text(F.col("p_name"), normal=False).alias("norm"), F.col("p_size").alias("size"))


@query(f"WITH RECURSIVE {RATIOS} SELECT a.song, a.entry, b.entry AS seg_idx, s AS score FROM parts a JOIN parts b ON a.song = b.song AND abs(a.entry - b.entry) <= 12 JOIN fit ON fit.a = a.norm AND fit.b = b.norm")
def segment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = names(spark, sf_dir).select("song", "entry", "norm")
    return joins.pair_scores(rows, rows.withColumnRenamed("entry", "seg_idx")).select("song", "entry", "seg_idx", "score")


@query(f"""WITH RECURSIVE {RATIOS}, seg AS (SELECT song, entry AS i, norm FROM parts WHERE size % 3 > 0),
seg2 AS (SELECT song, CAST(row_number() OVER (PARTITION BY song ORDER BY i) AS INTEGER) AS i, norm FROM seg),
f AS (SELECT song, 0 AS entry, 1 AS pos, CAST(NULL AS INTEGER) AS segment, 0.0::DOUBLE AS score FROM (SELECT DISTINCT song FROM parts) UNION ALL
 SELECT song, entry, CASE WHEN best.s >= 0.42 THEN best.i + 1 ELSE pos END, CASE WHEN best.s >= 0.42 THEN best.i END, coalesce(best.s, 0) FROM (
  SELECT f.song, p.entry, f.pos, max(CASE WHEN fit.s IS NULL THEN NULL WHEN fit.s >= 0.88 THEN {{'stop': 1, 'o': -q.i::DOUBLE, 'i': q.i, 's': fit.s}} ELSE {{'stop': 0, 'o': fit.s - q.i * 1e-9, 'i': q.i, 's': fit.s}} END) AS best
  FROM f JOIN parts p ON p.song = f.song AND p.entry = f.entry + 1 LEFT JOIN seg2 q ON q.song = f.song AND q.i BETWEEN f.pos AND f.pos + 11 LEFT JOIN fit ON fit.a = p.norm AND fit.b = q.norm GROUP BY ALL))
SELECT song, entry, segment, score FROM f WHERE entry > 0""")
def name_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines matched in order to the two thirds of their texts that were heard, one segment each."""
    rows = names(spark, sf_dir)
    heard = rows.filter("size % 3 > 0").select("song", F.row_number().over(Window.partitionBy("song").orderBy("entry")).alias("seg_idx"), "norm")
    return joins.fuzzy_match(rows.select("song", "entry", "norm"), heard, spans=1).select("song", "entry", "segment", "score")


@query(f"""WITH RECURSIVE {RATIOS}, m AS (SELECT *, entry * 1.25::DOUBLE AS start, 0.5::DOUBLE + size % 3 * 0.1::DOUBLE AS score FROM parts),
near AS (SELECT a.song, a.entry AS pos, b.entry AS k, a.start - b.start AS gap, r, length(b.norm) AS n FROM m a JOIN m b ON a.song = b.song AND b.entry BETWEEN a.entry - 3 AND a.entry - 1 JOIN ratio ON ratio.a = b.norm AND ratio.b = a.norm),
one AS (SELECT m.song, m.entry, m.norm, m.score, max(CASE WHEN near.k >= m.entry - 2 AND gap <= 2.5 AND near.r >= 0.70 AND s >= m.score - 0.05 THEN {{'k': near.k, 's': greatest(m.score, s)}} END) AS x
 FROM m LEFT JOIN near ON near.song = m.song AND near.pos = m.entry LEFT JOIN m b ON b.song = near.song AND b.entry = near.k LEFT JOIN fit ON fit.a = m.norm AND fit.b = b.norm GROUP BY ALL),
two AS (SELECT song, entry, norm, coalesce(x.k, entry) AS pos, coalesce(x.s, score) AS score FROM one),
three AS (SELECT two.*, max(CASE WHEN gap <= 5.0 AND r >= 0.86 AND starts_with(two.norm, b.norm) THEN near.k END) AS k FROM two LEFT JOIN near ON near.song = two.song AND near.pos = two.pos LEFT JOIN m b ON b.song = near.song AND b.entry = near.k GROUP BY ALL)
SELECT song, entry, coalesce(k, pos) AS segment, CASE WHEN k IS NULL THEN score ELSE greatest(score, 0.80) END AS score FROM three""")
def moved_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line on the segment of its own number, 1.25 s apart, moved to nearly equal ones before."""
    rows = names(spark, sf_dir)
    matched = rows.select("song", "entry", "norm", F.col("entry").alias("segment"), (0.5 + F.col("size") % 3 * 0.1).alias("score"))
    return matching.earlier_duplicates(matched, rows.select("song", F.col("entry").alias("seg_idx"), (F.col("entry") * 1.25).alias("start"), "norm"))


@query(f"""WITH RECURSIVE {RATIOS}, f AS (SELECT song, 0 AS entry, '' AS head, 0 AS run FROM (SELECT DISTINCT song FROM parts) UNION ALL
 SELECT p.song, p.entry, CASE WHEN length(p.norm) < 8 THEN '' WHEN r >= 0.6 THEN head ELSE p.norm END, CASE WHEN length(p.norm) < 8 THEN 0 WHEN r >= 0.6 THEN run + 1 ELSE 1 END
 FROM f JOIN parts p ON p.song = f.song AND p.entry = f.entry + 1 LEFT JOIN ratio ON ratio.a = f.head AND ratio.b = p.norm)
SELECT song, max(run) >= 3 AS three, max(run) >= 4 AS four FROM f WHERE entry > 0 GROUP BY song""")
def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether three, and four, texts in a row are like the first of their run (0.6)."""
    rows = names(spark, sf_dir).select("song", F.col("entry").alias("seg_idx"), F.col("entry").cast("double").alias("start"), "norm")
    runs = [joins.repeated_tail(rows, least=n, alike=0.6).withColumnRenamed("repeated", name) for n, name in ((3, "three"), (4, "four"))]
    return runs[0].join(runs[1], "song")


# -- Runs that work on changed songs ---------------------------------------------------


@query(f"WITH {BASE} SELECT song, count(*) AS n, round(sum(value), 4) AS total, CASE WHEN song % 7 = 0 THEN 2 ELSE 1 END AS run FROM base WHERE song % 11 > 0 GROUP BY song")
def changed_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of songs after two runs: before the second, the values of every seventh song change and every eleventh song goes."""
    rows = lines(spark, sf_dir).select("song", "entry", "value")
    folder = shared_folder(spark, "runs")
    plan = lambda e: e["lines"].groupBy("song").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    incremental.run_changed(spark, folder, {"lines": rows.withColumn("value", F.when(F.col("song") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))}, plan)
    incremental.run_changed(spark, folder, {"lines": rows.filter("song % 11 > 0")}, plan)
    return incremental.results(spark, folder).select("song", "n", F.round("total", 4).alias("total"), "run")


# -- Reports of several versions -------------------------------------------------------

def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    number = lambda c: F.format_string("%.2f", c)
    texts = {
        0: F.concat(F.lit('{"backend": "'), "backend", F.lit('", "trusted_percent": '), number(F.col("value")), F.lit(', "assignments": [{"entry": '), F.col("entry").cast("string"), F.lit(', "timestamp": '), F.col("segment").cast("string"), F.lit(".5}]}")),
        1: F.concat(F.lit('{"report": {"backend": "'), "backend", F.lit('", "trusted_percent": "'), number(F.col("value")), F.lit('", "assignments": [{"index": '), F.col("entry").cast("string"), F.lit(', "time": "'), F.col("segment").cast("string"), F.lit('.25"}, {"start": 7}]}}')),
        2: F.concat(F.lit('{"metrics": {"trusted_percent": '), number(F.col("value")), F.lit('}, "candidate_selection": {"selected_backend": "best"}, "backend": "x", "lines": [{"score": 1}, 5]}')),
        3: F.concat(F.lit('{"trusted_percent": "none", "backend": "'), "backend"),
        4: F.concat(F.lit("["), F.col("segment").cast("string"), F.lit("]")),
    }
    content = F.lit("  ")
    for k, text in texts.items():
        content = F.when(F.col("segment") % 6 == k, text).otherwise(content)
    return variants.load_reports(rows.select(F.col("event_id").alias("doc_id"), content.alias("content")))


@query(f"""WITH {BASE} SELECT event_id AS doc_id, CASE segment % 6 WHEN 3 THEN 'malformed' WHEN 4 THEN 'not an object' WHEN 5 THEN 'empty' END AS error, CASE segment % 6 WHEN 0 THEN backend WHEN 1 THEN backend WHEN 2 THEN 'best' END AS backend,
 CASE segment % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 END::BIGINT AS lines, CASE WHEN segment % 6 < 3 THEN round(value, 2) END AS trusted_percent FROM base""")
def mixed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of several versions, some of them cut off, as one table."""
    return variants.summaries(_mixed(spark, sf_dir), ("trusted_percent",)).withColumn("trusted_percent", F.round("trusted_percent", 2))


@query(f"""WITH {BASE}, x AS (SELECT event_id AS doc_id, entry AS e, segment % 6 AS v, segment FROM base)
SELECT doc_id, e AS entry, segment + 0.5::DOUBLE AS timestamp, 0.0::DOUBLE AS score FROM x WHERE v = 0 UNION ALL SELECT doc_id, e + 1, segment + 0.25::DOUBLE, 0.0 FROM x WHERE v = 1
UNION ALL SELECT doc_id, 2, 7.0, 0.0 FROM x WHERE v = 1 UNION ALL SELECT doc_id, 1, NULL, 1.0 FROM x WHERE v = 2 UNION ALL SELECT doc_id, 2, NULL, 0.0 FROM x WHERE v = 2""")
def mixed_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their assignments, wherever a version keeps them."""
    return variants.timestamps(_mixed(spark, sf_dir)).select("doc_id", "entry", "timestamp", "score")


# -- Kana ---------------------------------------------------------------------------

# Syllables and their spelling, beside the table that is made by rule.
SPELT = (
    "あ a い i う u え e お o か ka き ki く ku け ke こ ko が ga ぎ gi ぐ gu げ ge ご go さ sa し shi す su せ se そ so ざ za じ ji ず zu ぜ ze ぞ zo た ta ち chi つ tsu て te と to だ da ぢ ji づ zu で de ど do "
    "な na に ni ぬ nu ね ne の no は ha ひ hi ふ fu へ he ほ ho ば ba び bi ぶ bu べ be ぼ bo ぱ pa ぴ pi ぷ pu ぺ pe ぽ po ま ma み mi む mu め me も mo や ya ゆ yu よ yo ら ra り ri る ru れ re ろ ro わ wa を wo ん n "
    "きゃ kya きゅ kyu きょ kyo ぎゃ gya ぎょ gyo しゃ sha しゅ shu しょ sho じゃ ja じゅ ju じょ jo ちゃ cha ちゅ chu ちょ cho にゃ nya ひゅ hyu びょ byo ぴゃ pya みゅ myu りょ ryo ファ fa ティ ti チェ che カー kaa っか kka っち tchi ッパ ppa"
).split(" ")


@query(f"""WITH {BASE}, s AS (SELECT [{', '.join(f"'{x}'" for x in SPELT[1::2])}] AS r) SELECT song, string_agg(r[1 + segment % {len(SPELT) // 2}], ' ' ORDER BY entry) AS romaji FROM base CROSS JOIN s GROUP BY song""")
def kana_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A syllable for each event, in hiragana and katakana."""
    each = F.element_at(F.array(*map(F.lit, SPELT[::2])), (1 + F.col("segment") % (len(SPELT) // 2)).cast("int"))
    rows = lines(spark, sf_dir).select("song", "entry", each.alias("x")).groupBy("song").agg(F.array_sort(F.collect_list(F.struct("entry", "x"))).alias("r"))
    return rows.select("song", kana.romaji(F.array_join("r.x", " ")).alias("romaji"))


# -- Alignment in windows --------------------------------------------------------------

#: Windows of 24 lines of a song: each line is a frame with a probability for the blank and three tokens, none of them equal to another.
WIDTH, SECONDS = 24, 0.02
_WEIGHT = "((value * {k} * 0.6180339 + segment * 0.137) - floor(value * {k} * 0.6180339 + segment * 0.137)) * 0.98 + 0.01"
_LOGS = "[" + ", ".join(f"ln({_WEIGHT.format(k=k)})" for k in (1, 2, 3, 4)) + "]"
PATHS = f"""{BASE}, fr AS (SELECT song, CAST((entry - 1) // {WIDTH} AS INTEGER) AS run, (entry - 1) % {WIDTH} AS f, entry, {_LOGS} AS lp FROM base),
st AS (SELECT unnest(range(0, 9)) AS s, unnest([1, 2, 1, 3, 1, 3, 1, 4, 1]) AS c, unnest([false, false, false, true, false, false, false, true, false]) AS jump),
v AS (SELECT song, run, 0 AS f, s, lp[c] AS score, [s] AS path FROM fr JOIN st ON s < 2 WHERE f = 0 UNION ALL
 SELECT song, run, f, s, max(score) + any_value(lp[c]), list_append(arg_max(path, score), s) FROM (SELECT v.song, v.run, fr.f, fr.lp, st.s, st.c, v.score, v.path FROM v JOIN fr ON fr.song = v.song AND fr.run = v.run AND fr.f = v.f + 1 JOIN st ON st.s = v.s OR st.s = v.s + 1 OR (st.s = v.s + 2 AND st.jump)) GROUP BY song, run, f, s),
n AS (SELECT song, run, max(f) AS t FROM fr GROUP BY 1, 2), e AS (SELECT v.song, v.run, arg_max(path, score) AS path FROM v JOIN n ON n.song = v.song AND n.run = v.run AND n.t = v.f WHERE s >= 7 GROUP BY 1, 2),
x AS (SELECT song, run, unnest(path) AS s, unnest(range(0, len(path))) AS f FROM e),
k AS (SELECT x.song, x.run, x.s // 2 AS token, min(fr.entry) AS a, max(fr.entry) + 1 AS b, avg(exp(fr.lp[st.c])) AS p FROM x JOIN fr ON fr.song = x.song AND fr.run = x.run AND fr.f = x.f JOIN st ON st.s = x.s WHERE x.s % 2 = 1 GROUP BY ALL),
res AS (SELECT song, run, CAST(run * {WIDTH} + 1 + token // 2 AS INTEGER) AS entry, min(a) * {SECONDS}::DOUBLE AS start, max(b) * {SECONDS}::DOUBLE AS "end", avg(p) AS ctc_score, arg_min(p, token) AS first_score FROM k GROUP BY song, run, token // 2)"""


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, lines with two tokens each at the beginning of a window, emissions)."""
    rows = lines(spark, sf_dir)
    part = lambda k: (F.col("value") * k * 0.6180339 + F.col("segment") * 0.137) - F.floor(F.col("value") * k * 0.6180339 + F.col("segment") * 0.137)
    emissions = rows.select("song", F.col("entry").alias("frame"), F.array(*[F.log(part(k) * 0.98 + 0.01) for k in (1, 2, 3, 4)]).alias("logp"))
    run = F.floor((F.col("entry") - 1) / WIDTH).cast("int")
    first = run * WIDTH + 1
    windows = rows.groupBy("song", run.alias("run")).agg(F.min("entry").alias("first"), F.max("entry").alias("last"))
    windows = windows.select("song", "run", F.col("first").alias("first_entry"), F.least("last", F.col("first") + 1).alias("last_entry"), (F.col("first") * SECONDS).alias("start"), ((F.col("last") + 1) * SECONDS).alias("end"))
    told = rows.select("song", "entry", F.when(F.col("entry") == first, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(3))).alias("tokens"))
    return windows, told, emissions


@query(f"WITH RECURSIVE {PATHS} SELECT song, run, entry, round(start, 6) AS start, round(\"end\", 6) AS \"end\", round(ctc_score, 6) AS ctc_score FROM res")
def window_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines of two tokens, the middle two equal, aligned in every window; the SQL follows all states frame by frame."""
    out = trellis.align_windows(*_windows(spark, sf_dir), SECONDS).filter("start is not null")
    return out.select("song", "run", "entry", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.round("ctc_score", 6).alias("ctc_score"))


@query(f"""WITH RECURSIVE {PATHS}, w AS (SELECT song, run, min(entry) AS first_target, min(entry) * {SECONDS}::DOUBLE AS s, (max(entry) + 1) * {SECONDS}::DOUBLE AS e FROM fr GROUP BY 1, 2),
kept AS (SELECT res.* FROM res JOIN w ON w.song = res.song AND w.run = res.run WHERE res.start BETWEEN s AND e AND (res.entry = first_target OR (res.entry = first_target + 1 AND first_score <= 0.3)))
SELECT base.song, base.entry, kept.song IS NOT NULL AS realigned, round(coalesce(kept.start, base.t), 6) AS timestamp, round(coalesce(kept.ctc_score, base.score), 6) AS ctc_score FROM base LEFT JOIN kept ON kept.song = base.song AND kept.entry = base.entry""")
def windows_taken_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the windows found, taken over for the first line of each, and for the second where its first token is weak (0.3 here)."""
    windows, told, emissions = _windows(spark, sf_dir)
    results = trellis.align_windows(windows, told, emissions, SECONDS)
    targets = windows.withColumns({"first_target": F.col("first_entry"), "last_target": F.col("first_entry")})
    rows = lines(spark, sf_dir).select("song", "entry", F.col("t").alias("timestamp"), F.col("score").alias("ctc_score"), F.lit(None).cast(trellis.SPAN).alias("token_spans"), F.lit(None).cast(trellis.PEAK).alias("peaks"))
    # peaks before a line would ask for it as well
    out = forced.apply_windows(rows, targets, results.withColumn("peaks", F.expr("filter(peaks, p -> false)")), weak=0.3)
    return out.select("song", "entry", "realigned", F.round("timestamp", 6).alias("timestamp"), F.round("ctc_score", 6).alias("ctc_score"))


@query(f"""WITH RECURSIVE {BASE}, n AS (SELECT song, entry, t, t + segment % 9 * 0.1 + 0.5 AS te, t + (segment % 7) * 0.15 AS lt, score * 0.9 AS cs, CASE WHEN segment % 5 > 0 THEN score END AS ls, t + segment % 4 * 0.2 + 0.3 AS le, lag(t + segment % 9 * 0.1 + 0.5) OVER (PARTITION BY song ORDER BY entry) AS pe FROM (SELECT song, entry, entry * 1.0::DOUBLE AS t, segment, score FROM base)),
f AS (SELECT song, entry, t AS time, te AS e FROM n WHERE entry = 1 UNION ALL
 SELECT song, entry, CASE WHEN hit THEN lt ELSE t END, CASE WHEN hit THEN le ELSE te END FROM (SELECT n.*, coalesce(n.t - f.e <= 0.04 AND lt - n.t >= 0.30 AND ls >= greatest(0.05, cs * 1.05), false) AS hit FROM f JOIN n ON n.song = f.song AND n.entry = f.entry + 1))
SELECT song, entry, round(time, 6) AS time FROM f""")
def boundaries_taken_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines a second apart that begin where the one before ends, at their local time where that is late enough and sure; an accepted line's end is the local one."""
    k, t = F.col("segment"), F.col("entry") * 1.0
    rows = lines(spark, sf_dir).select(
        "song", "entry", t.alias("timestamp"), F.lit(1e6).alias("duration"), (F.col("score") * 0.9).alias("ctc_score"), (t + k % 9 * 0.1 + 0.5).alias("token_end"), (t + k % 7 * 0.15).alias("local_time"),
        F.when(k % 5 > 0, F.col("score")).alias("local_score"), (t + k % 4 * 0.2 + 0.3).alias("local_end"),
    )
    return forced.apply_boundaries(rows).select("song", "entry", F.round("time", 6).alias("time"))
