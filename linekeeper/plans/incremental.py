"""Runs of a plan that work on changed songs alone.

A song's fingerprint is a digest of all its evidence.  The state of a folder lists each
song's fingerprint and the part in which its results lie.  A run works on the songs whose
fingerprint the state lacks, writes their results as a new part and a new state, and then
moves one small file, which names the state that counts: before that move the folder holds
the old results, after it the new ones, and never a mixture.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linekeeper.sources.shared import open_folder

CURRENT = "CURRENT.json"
STATE = "song {kind}, fingerprint string, part string, run int"


def _digest(rows: DataFrame) -> Column:
    """Two sums of hashes of rows and their number: the same for rows in any order, another one for a row more, less, twice or changed."""
    text = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    halves = [F.sum(F.conv(F.substring(F.md5(text), at, 12), 16, 10).cast("decimal(20,0)")) for at in (1, 13)]
    return F.concat_ws("/", *[h.cast("string") for h in halves], F.count(F.lit(1)).cast("string"))


def fingerprints(evidence: Mapping[str, DataFrame]) -> DataFrame:
    """(song, fingerprint) of all songs that some table has rows of; a song's fingerprint changes with its rows in any of them."""
    out = None
    for name in sorted(evidence):
        one = evidence[name].groupBy("song").agg(_digest(evidence[name]).alias("d")).select("song", F.lit(name).alias("name"), "d")
        out = one if out is None else out.unionByName(one)
    told = F.array_sort(F.collect_list(F.struct("name", "d")))
    return out.groupBy("song").agg(F.sha2(F.to_json(told), 256).alias("fingerprint"))


def _current(folder: str) -> dict | None:
    from pyarrow import fs

    disk, path = open_folder(folder)
    if disk.get_file_info(f"{path}/{CURRENT}").type == fs.FileType.NotFound:
        return None
    with disk.open_input_stream(f"{path}/{CURRENT}") as file:
        return json.loads(file.read())


def _point_to(folder: str, told: dict) -> None:
    disk, path = open_folder(folder)
    disk.create_dir(path, recursive=True)
    aside = f"{path}/.{CURRENT}.{uuid.uuid4().hex}"
    with disk.open_output_stream(aside) as file:
        file.write(json.dumps(told).encode())
    disk.move(aside, f"{path}/{CURRENT}")


def state_of(spark: SparkSession, folder: str, kind: str = "string") -> DataFrame:
    """(song, fingerprint, part, run) of the results that count; no rows in a new folder."""
    told = _current(folder)
    return spark.createDataFrame([], STATE.format(kind=kind)) if told is None else spark.read.parquet(f"{folder}/{told['state']}")


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of all songs, each from the part that counts, with the run that made them; a folder without a run is an error."""
    told = _current(folder)
    if told is None:
        raise FileNotFoundError(f"no run in {folder}")
    state = spark.read.parquet(f"{folder}/{told['state']}").select("song", F.col("part").alias("__part"), "run")
    rows = spark.read.parquet(*[f"{folder}/{p}" for p in told["parts"]])
    # the part is told by the rows' files
    rows = rows.withColumn("__part", F.regexp_extract(F.col("_metadata.file_path"), r"(part-\d+-[0-9a-f]+)/[^/]*$", 1))
    return rows.join(state, ["song", "__part"]).drop("__part")


def run_changed(spark: SparkSession, folder: str, evidence: Mapping[str, DataFrame], plan: Callable[[dict[str, DataFrame]], DataFrame], version: str = "") -> dict[str, int]:
    """Bring the results in ``folder`` up to the evidence; returns how many songs were worked on, kept and dropped.

    ``plan`` makes rows with a column song from the evidence of the changed songs alone, so it
    must not look across songs.  ``version`` is part of every fingerprint: another one works on
    all songs anew.  Songs that have no evidence any more are dropped.  Where a run fails, the
    folder's results stay those of the run before.  One run at a time works on a folder.
    """
    folder = folder.rstrip("/")
    told = _current(folder)
    number = 1 if told is None else told["run"] + 1
    name = f"{number:06d}-{uuid.uuid4().hex[:8]}"
    now = fingerprints(evidence).withColumn("fingerprint", F.sha2(F.concat("fingerprint", F.lit(version)), 256))
    kind = now.schema["song"].dataType.simpleString()
    before = state_of(spark, folder, kind)
    now.write.parquet(f"{folder}/fingerprints-{name}")
    now = spark.read.parquet(f"{folder}/fingerprints-{name}")
    changed = now.join(before, ["song", "fingerprint"], "left_anti")
    kept = before.join(now, ["song", "fingerprint"], "left_semi")
    songs = changed.select("song")
    made = plan({k: df.join(songs, "song", "left_semi") for k, df in evidence.items()})
    state = kept.select("song", "fingerprint", "part", "run").unionByName(changed.select("song", "fingerprint", F.lit(f"part-{name}").alias("part"), F.lit(number).alias("run")))
    worked, last = changed.count(), before.count()
    if not worked and kept.count() == last and told is not None:
        return {"worked": 0, "kept": last, "dropped": 0}
    made.write.parquet(f"{folder}/part-{name}")
    state.write.parquet(f"{folder}/state-{name}")
    stored = spark.read.parquet(f"{folder}/state-{name}")
    parts = sorted(r.part for r in stored.select("part").distinct().collect())  # one for each run at most
    _point_to(folder, {"run": number, "state": f"state-{name}", "parts": parts or [f"part-{name}"]})
    return {"worked": worked, "kept": stored.filter(F.col("run") < number).count(), "dropped": before.join(now, "song", "left_anti").count()}
