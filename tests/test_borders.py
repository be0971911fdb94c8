"""Values at the limits of rules, and tables on which larger copies differed from their SQL."""

import datetime
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from linekeeper.operators import forced, matching, repairs
from linekeeper.plans import catalogue, evidence, library  # noqa: F401  (registers its queries)
from tests.test_forced import ROW, row


def test_far_lateness_counts_to_the_microsecond(spark):
    t = 2500249.056309
    assert t - (t - 0.45) > 0.45  # what the difference leaves over
    got = forced.lyric_refinement(spark.createDataFrame([row(1, 10.0, None), row(2, t, t - 0.45, score=0.95)], ROW).withColumn("duration", F.lit(3e6))).filter("entry = 2").first()
    assert got.reason == "high-confidence-small-forced"


def test_far_suffix_counts_to_the_microsecond(spark):
    chars = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(F.substring(F.lit("abcdefghij"), i + 1, F.lit(1)).alias("ch"), (F.col("t") + i * 0.25).alias("t")))
    t = F.col("t")
    rows = spark.createDataFrame([(1.999964,)], "t double")
    assert rows.select(matching.suffix_time(F.lit("efghij"), t, t + 3, chars).alias("x")).first().x == 1.999964 + 1.0


def events(tmp_path, rows):
    """A folder with an events table of (user, seconds, value, k), all of one type."""
    began = datetime.datetime(2024, 1, 1)
    made = [{"event_id": i, "ts": began + datetime.timedelta(microseconds=round(s * 1e6)), "user_id": u, "event_type": "view", "value": float(v), "props": f'{{"k": {k}}}'} for i, (u, s, v, k) in enumerate(rows)]
    pq.write_table(pa.Table.from_pylist(made), f"{tmp_path}/events.parquet")
    return str(tmp_path)


def by_both(spark, name, folder):
    """(rows of the query, rows of its SQL), sorted."""
    got = catalogue.QUERIES[name](spark, folder)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS FROM '{os.path.join(folder, 'events.parquet')}'")
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def test_line_flags_of_near_lines(spark, tmp_path):
    got, want = by_both(spark, "line_flags", events(tmp_path, [(1, 0, 5, 2), (1, 20, 5, 2), (1, 21, 5, 1), (1, 60, 5, 1)]))
    assert got == want and len(got) == 4


def test_line_scoring_beyond_one(spark, tmp_path):
    rows = [(1, 30 * i, v, k) for i, (v, k) in enumerate([(560, 1), (555, 2), (560, 7), (5, 5), (560, 52), (590, 25), (551, 62)])]
    got, want = by_both(spark, "line_scoring", events(tmp_path, rows))
    assert got == want and len(got) == 7


def test_raw_diagnostics_round_as_the_sql(spark, tmp_path):
    # 1000 times these times is less than a half by what doubles leave over
    rows = [(1, 0, 5, 2), *[(1, k + 0.0005, 1, 2) for k in (4, 16)]]
    got, want = by_both(spark, "raw_diagnostics", events(tmp_path, rows))
    assert got == want and len(got) == 1


def test_intro_keeps_near_onsets_alone(spark):
    every = [(float(k), 0.9, [float(k)]) for k in range(2001)]
    rows = [("a", i, 1.0 + 10 * (i - 1), 200.0, 0.1 if i < 5 else 0.9, 1, False, every if i == 1 else None) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "song string, entry int, timestamp double, duration double, score double, segment int, borrowed boolean, onsets array<struct<t: double, onset: double, times: array<double>>>")
    assert max(len(r.onsets or ()) for r in repairs._near_intro(df).collect()) <= 15
    got = [(r.entry, r.time) for r in repairs.intro_repair(df).orderBy("entry").collect()]
    # the anchor is at 41 s: its span begins 12 s before, and the first onset 0.2 s on is 30
    assert got[:5] == [(1, 30.0), (2, 32.75), (3, 35.5), (4, 38.25), (5, 41.0)]


def test_audits_are_dealt_out(spark):
    """Wide rows that compress well: adaptive execution must not join tasks by their bytes."""
    assert library._audit(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism
