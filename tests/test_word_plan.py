"""The word-level candidate over many songs: its folds stream, and turns are read in their form for matching."""

from pyspark.sql import functions as F

from linekeeper.functions import blocks
from linekeeper.operators import folds, matching
from linekeeper.plans import evidence
from tests.test_blocks import pairs, plain

SF = "/root/testdata/sf0.001"


def test_folds_stream_through_songs(spark):
    """No pandas group a song."""
    for made in (evidence.word_candidates, evidence.word_reports):
        text = made(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in text and "InPandas" not in text


def test_turns_are_brought_into_form_once(spark):
    for made in (evidence.word_candidates, evidence.word_reports):
        assert "regexp_replace" not in made(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_null_starts_are_near_none(spark):
    segs = [("a", 0, None, "sing"), ("a", 1, 2.0, "sing"), ("a", 2, 3.0, "sing"), ("a", 3, None, "sing")]
    matches = spark.createDataFrame([("a", k, "sing", k, 1.0) for k in range(4)], "song string, entry int, norm string, segment int, score double")
    got = matching.earlier_duplicates(matches, spark.createDataFrame(segs, "song string, seg_idx int, start double, norm string")).collect()
    assert {r.entry: r.segment for r in got} == {0: 0, 1: 1, 2: 1, 3: 3}


def test_at_least_of_random_pairs():
    held = list(pairs(9, 3000, 40, ["ab", "abcdefghij", "aé日\U0001f600xyz"])) + [("a" * 300, "a" * 300), ("ab" * 150, "ab" * 150), ("", ""), ("a", "")]
    for least in (0.5, 0.7, 0.86, 1.0):
        assert blocks.at_least([a for a, _ in held], [b for _, b in held], least).tolist() == [plain(a, b) >= least for a, b in held]


def test_songs_and_rows_held_are_bounded(spark):
    """More songs a task than are held at a time, songs of one side alone, and none on a border lost or cut in two."""
    left = spark.range(40_000).select(F.col("id").alias("song"), F.explode(F.array(F.lit(2), F.lit(1))).alias("entry"))
    right = spark.range(20_000, 50_000).select(F.col("id").alias("song"), F.lit(1).alias("seg_idx"))
    step = lambda songs: [(key, len(songs), 10 * len(a) + len(b) if [r["entry"] for r in a] in ([1, 2], []) else -1) for key, a, b in songs]
    got = folds.fold_pairs(left, right, step, "song long, held int, sides int").groupBy("sides").agg(F.count("*").alias("n"), F.countDistinct("song").alias("d"), F.max("held").alias("most")).collect()
    assert {(r.sides, r.n, r.d) for r in got} == {(20, 20_000, 20_000), (21, 20_000, 20_000), (1, 10_000, 10_000)}
    assert 1 < max(r.most for r in got) <= folds.SONGS
