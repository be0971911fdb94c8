import datetime
import wave

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from linekeeper.plans import catalogue, library, matches
from linekeeper.plans.align import align, choose_source
from linekeeper.plans.words import word_candidate
from linekeeper.sources import audio, shared
from linekeeper.streaming import live

SPAN = "array<struct<char: string, start: double, end: double, score: double>>"
PEAK = "array<struct<time: double, score: double>>"


def test_align(spark):
    lines = spark.createDataFrame([(s, i, "text", "text" * 3, 60.0) for s in ("a", "b") for i in (1, 2, 3)], "song string, entry int, text string, norm string, duration double")
    words = spark.createDataFrame([(s, i, 10.0 * i, 0.9, i, False) for s in ("a", "b") for i in (1, 2, 3)], "song string, entry int, timestamp double, score double, segment int, borrowed boolean")
    tok = [("a", i, 10.0 * i + 0.1, 0.5, False, [("x", 10.0 * i + 0.1, 10.0 * i + 1, 0.6)], []) for i in (1, 2, 3)]
    tok += [("b", i, 10.0 * i + (2.5 if i == 2 else 0), 0.1 if i == 2 else 0.005, i == 3, [("x", 10.0 * i, 10.0 * i + 1, 0.6)], []) for i in (1, 2, 3)]
    tokens = spark.createDataFrame(tok, f"song string, entry int, timestamp double, ctc_score double, missing boolean, token_spans {SPAN}, peaks {PEAK}")
    raw = spark.createDataFrame([("b", 2, 22.3, 0.76)], "song string, entry int, timestamp double, score double")
    decisions, report = align(lines, words, tokens, raw)
    got = {(r.song, r.entry): (round(r.time, 2), r.selected) for r in decisions.collect()}
    assert got["a", 2] == (20.1, "ctc") and got["b", 2] == (22.5, "whisperx") and got["b", 1] == (10.0, "whisperx")
    assert {r.song: r.timing_entries for r in report.collect()} == {"a": 3, "b": 3}


def test_word_candidate(spark):
    texts = ["alphabravo", "charliedelta", "echofoxtrot"]
    lines = spark.createDataFrame([(s, i + 1, t, t, 60.0) for s in "ab" for i, t in enumerate(texts)], "song string, entry int, text string, norm string, duration double")
    segments = spark.createDataFrame([("a", i, 10.0 * i + 5, 10.0 * i + 8, t, t, []) for i, t in enumerate(texts)], "song string, seg_idx int, start double, end double, text string, norm string, chars array<struct<ch: string, t: double>>")
    times = spark.createDataFrame([("a", 2, [("c", 14.7)], 14.0)], "song string, entry int, chars array<struct<ch: string, t: double>>, start double")
    got, report = word_candidate(lines, segments, times)
    assert {(r.entry, r.time, r.refinement) for r in got.filter("song = 'a'").collect()} == {(1, 5.0, None), (2, 14.7, "high-confidence-small-forced"), (3, 25.0, None)}
    errors = {r.song: r.error for r in report.collect()}
    assert errors["a"] is None and errors["b"].startswith("unusable alignment: trusted_entries=0, timing_entries=3")


def test_sources_of_timing(spark):
    df = spark.createDataFrame([(True, True, ["ctc"]), (False, True, []), (False, False, ["ctc"]), (False, False, [])], "timed boolean, checked boolean, backends array<string>")
    ask = lambda x: [r.source for r in choose_source(df, x).collect()]
    assert ask("auto") == ["lyrics", "checked_lrc", "competition", None] and ask("audio") == ["heuristic"] * 4
    assert ask("ctc") == ["ctc", None, "ctc", None] and ask("lyrics") == ["lyrics", None, None, None]
    with pytest.raises(ValueError):
        choose_source(df, "other")


def test_sound(spark, tmp_path):
    rate, rng = audio.RATE, np.random.default_rng(0)
    sound = rng.normal(0, 0.001, rate * 6)
    for start in (1.0, 3.5):
        t = np.arange(int(rate * 1.2)) / rate
        sound[int(rate * start) : int(rate * start) + len(t)] += 0.5 * np.sin(2 * np.pi * 440 * t)
    with wave.open(f"{tmp_path}/x.wav", "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((sound * 32767).astype("<i2").tobytes())
    frames = audio.onset_frames(audio.read_frames(spark, str(tmp_path)))
    segments = sorted((r.start, r.end) for r in audio.vocal_segments(frames).collect())
    assert len(segments) == 2 and segments[0][0] == pytest.approx(1.0, abs=0.15) and segments[1][0] == pytest.approx(3.5, abs=0.15)
    assert frames.agg(F.max("onset")).first()[0] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        audio.frame_features(np.zeros(10))
    voice = audio.vocal_onsets(audio.read_frames(spark, str(tmp_path), voice=True))
    best = voice.orderBy(F.desc("onset"), "t").first()
    assert best.onset == pytest.approx(1.0) and min(abs(best.t - x) for x in (1.0, 2.2, 3.5, 4.7)) < 0.15
    with pytest.raises(ValueError):
        audio.consonant_features(np.zeros(10))


def test_sounds_are_dealt_out(spark, monkeypatch):
    """Sound is some thousand times as large as the events that it is made of: adaptive execution must not join its tasks by the events' bytes."""
    made, tasks = [], 4 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(library, "write_files", lambda files, folder: made.append(files))
    library._sounds(spark, "/root/testdata/sf0.001")
    assert made[0].rdd.getNumPartitions() == tasks
    songs = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy("user_id").count().collect()
    sizes = {r.name: r.n for r in made[0].select("name", F.length("content").alias("n")).collect()}
    assert sizes == {f"S{r.user_id}.wav": 44 + r["count"] * 3200 for r in songs}


@pytest.mark.parametrize("name", ["sound_segments", "sound_levels"])
def test_sounds_in_rounds(spark, monkeypatch, name):
    """The files of a round are gone when the next one's are written, at the end all is gone but what they told, and the rows are those of one round."""
    from pyarrow import fs

    folders, write, at = [], library.write_files, shared.shared_folder(spark, "x").rsplit("/", 1)[0]

    def there(folder):
        disk, path = shared.open_folder(folder)
        return {f.base_name for f in disk.get_file_info(fs.FileSelector(path, allow_not_found=True))}

    def watched(files, folder):
        assert not any(there(f) for f in folders)
        write(files, folder)
        assert there(folder)
        folders.append(folder)

    monkeypatch.setattr(library, "write_files", watched)
    run = lambda: sorted(tuple(r) for r in getattr(library, name)(spark, "/root/testdata/sf0.001").collect())
    before, cleanup = there(at), spark.conf.get(shared.CLEANUP)
    want = run()
    assert want and len(folders) == 1
    monkeypatch.setattr(library, "ROUND_BYTES", 1_100_000)
    assert run() == want and 1 < len(folders) - 1 <= 3
    assert sorted(f.split("-")[0] for f in there(at) - before) == ["told", "told"] and spark.conf.get(shared.CLEANUP) == cleanup


#: value and segment of 24 events, one with a value of 0: all its probabilities are equal.
TIED = [
    (39.37, 61), (25.11, 71), (10.07, 2), (13.15, 87), (62.71, 87), (0.82, 93), (18.15, 56), (3.76, 30), (46.58, 20), (106.05, 50), (88.71, 66), (31.22, 2),
    (45.88, 65), (0.0, 36), (36.2, 39), (109.16, 79), (27.68, 79), (65.1, 78), (22.53, 37), (0.1, 56), (67.63, 41), (33.52, 98), (40.76, 97), (112.67, 22),
]


@pytest.mark.parametrize("name", ["window_paths", "windows_taken_over"])
def test_windows_with_equal_paths_as_their_sql(spark, tmp_path, name):
    began = datetime.datetime(2024, 1, 1)
    rows = [(k, began + datetime.timedelta(seconds=k), 1, "view", value, f'{{"k": {segment}}}') for k, (value, segment) in enumerate(TIED)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect(config={"threads": 1}) as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        want = db.execute(catalogue.ORACLES[name]).fetchall()
    assert want and sorted(tuple(r) for r in getattr(matches, name)(spark, str(tmp_path)).collect()) == sorted(want)


def test_live_metrics(spark, tmp_path):
    schema = "song string, entry int, segment int, score double, timing_repair string, timing_trusted boolean, ts timestamp"
    rows = spark.sql("select 'a' song, int(id) entry, int(id) segment, id / 10.0D score, cast(null as string) timing_repair, false timing_trusted, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, int(id)) ts from range(1, 11)")
    rows.union(rows.limit(2)).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = live.live_metrics(stream).writeStream.format("memory").queryName("live").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("select song, max(timing_entries) n, max(trusted_entries) t from live group by song").collect()
    assert [tuple(r) for r in got] == [("a", 5, 1)] or [r.n for r in got][0] in (4, 5, 6)
    q = live.each_batch(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lambda d: d.groupBy("song").count(), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("count")).first()[0] == 12
