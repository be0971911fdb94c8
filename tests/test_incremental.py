"""Runs that work on changed songs alone."""

import os

import pytest
from pyspark.sql import functions as F

from linekeeper.plans import incremental


def lines(spark, values):
    return spark.createDataFrame([(s, k, v) for s, own in values.items() for k, v in enumerate(own)], "song string, entry int, score double").repartition(3)


def plan(evidence):
    return evidence["lines"].groupBy("song").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


def held(spark, folder):
    return {r.song: (r.n, r.total, r.run) for r in incremental.results(spark, folder).collect()}


def test_one_of_many_songs_changes(spark, tmp_path):
    folder = f"{tmp_path}/runs"
    values = {f"s{k}": [0.5, k / 10, None] for k in range(50)}
    seen = []

    def counted(evidence):
        out = plan(evidence)
        seen.append(sorted(r.song for r in evidence["lines"].select("song").distinct().collect()))
        return out

    notes = spark.createDataFrame([("s1", "x"), ("s2", "y")], "song string, note string")
    assert incremental.run_changed(spark, folder, {"lines": lines(spark, values), "notes": notes}, counted) == {"worked": 50, "kept": 0, "dropped": 0}
    first = held(spark, folder)
    assert {s: x[0] for s, x in first.items()} == dict.fromkeys(values, 3) and {x[2] for x in first.values()} == {1}
    values["s7"] = [0.5, 0.75, None]
    assert incremental.run_changed(spark, folder, {"lines": lines(spark, values), "notes": notes}, counted) == {"worked": 1, "kept": 49, "dropped": 0}
    assert seen[-1] == ["s7"] and held(spark, folder) == {**first, "s7": (3, 1.25, 2)}
    part = next(p for p in os.listdir(folder) if p.startswith("part-000002"))
    assert [r.song for r in spark.read.parquet(f"{folder}/{part}").collect()] == ["s7"]  # nothing else was written
    # the same rows in another order, a row more in another table, a song less, a song more
    assert incremental.run_changed(spark, folder, {"lines": lines(spark, dict(reversed(values.items()))), "notes": notes}, counted) == {"worked": 0, "kept": 50, "dropped": 0}
    del values["s9"]
    values["new"] = [1.0]
    more = notes.union(notes.filter("song = 's1'"))
    assert incremental.run_changed(spark, folder, {"lines": lines(spark, values), "notes": more}, counted) == {"worked": 2, "kept": 48, "dropped": 1}
    assert seen[-1] == ["new", "s1"] and set(held(spark, folder)) == set(values)
    assert {s for s, x in held(spark, folder).items() if x[2] == 3} == {"new", "s1"}  # the run without changes has no number
    # another version of the plan works on all songs
    assert incremental.run_changed(spark, folder, {"lines": lines(spark, values), "notes": more}, counted, version="2")["worked"] == 50


def test_a_failed_run_changes_nothing(spark, tmp_path):
    folder, values = f"{tmp_path}/runs", {"a": [1.0], "b": [2.0]}
    incremental.run_changed(spark, folder, {"lines": lines(spark, values)}, plan)
    before = held(spark, folder)
    values["b"] = [3.0]
    with pytest.raises(Exception, match="no plan"):
        incremental.run_changed(spark, folder, {"lines": lines(spark, values)}, lambda e: plan(e).withColumn("total", F.raise_error(F.lit("no plan")).cast("double")))
    assert held(spark, folder) == before
    assert incremental.run_changed(spark, folder, {"lines": lines(spark, values)}, plan) == {"worked": 1, "kept": 1, "dropped": 0}
    assert held(spark, folder)["b"][:2] == (1, 3.0)


def test_fingerprints_tell_rows_apart(spark):
    made = lambda rows: {r.song: r.fingerprint for r in incremental.fingerprints({"x": spark.createDataFrame(rows, "song string, a string, b int")}).collect()}
    base = made([("s", "x", 1), ("s", None, 2)])
    assert made([("s", None, 2), ("s", "x", 1)]) == base
    for other in ([("s", "x", 1)], [("s", "x", 1), ("s", "", 2)], [("s", "x", 1), ("s", None, 2), ("s", None, 2)], [("s", "x", None), ("s", None, 2)]):
        assert made(other) != base
    with pytest.raises(FileNotFoundError):
        incremental.results(spark, "/tmp/linekeeper-no-such-folder")
