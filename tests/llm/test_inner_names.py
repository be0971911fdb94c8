"""Columns of the input under the names that the operators use inside keep their values."""

import pytest
from tests.llm.conftest import prose

import corpus_pipeline
from linekeeper.llm import cross_tokens, decontaminate, near_copies, packing, prefix_bpe, quality_model, quality_rules, repeats, secrets, sharding, token_files

#: Names that the operators' code gives to columns of its own, and some of their results.
INNER = (
    "__text", "__words", "__n", "__keys", "__sorted", "__repeated", "__lines", "__cells", "__llr", "__r", "__id", "__uid", "__bits", "__rules", "__lower", "__spans", "__found", "__one", "__gone", "__label",
    "__region", "__rack", "__leaf", "own_of_text", "found", "kept", "llr", "n_words", "uid", "key", "row", "bucket", "pairs", "times", "ids", "last", "ends", "gone", "root", "node", "doc", "verdict", "held_out", "score",
    "predicted", "shard", "slot", "n_tokens", "start", "decoded", "spans", "anchor", "words", "base_failed",
)
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in INNER)
SECRET = 'password = "hunter2hunter"'


@pytest.fixture(scope="module")
def rows(spark):
    texts = [prose(k, 80) for k in range(6)] + [prose(9, 60) + " " + SECRET + " end", None, prose(3, 80)]
    return spark.createDataFrame([(k, t, *[f"{c} of {k}" for c in INNER]) for k, t in enumerate(texts)], SCHEMA).repartition(2)


def unchanged(rows, without=()):
    return all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in INNER if c not in without)


def test_redaction_hides_the_secret_and_keeps_the_rest(rows):
    got = secrets.redact(rows)
    assert got.columns == rows.columns and unchanged(got.collect())
    assert not any("hunter2" in (r.text or "") for r in got.collect()) and sum("[SECRET]" in (r.text or "") for r in got.collect()) == 1


def test_scan(rows):
    got = secrets.scan_secrets(rows).collect()
    assert unchanged(got, ["found"]) and sum(len(r.found) for r in got) == 1


def test_quality_rules(spark, rows):
    got = quality_rules.quality_rules(rows).collect()
    assert len(got) == 9 and unchanged(got, quality_rules.RESULTS)
    target = quality_rules.labelled_target(rows, spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int"))
    assert target.columns == rows.columns and unchanged(target.collect()) and target.count() == 2


def test_large_target(spark, rows, monkeypatch):
    monkeypatch.setattr(quality_rules, "BROADCAST_IDS", 0)
    target = quality_rules.labelled_target(rows, spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, quality int"))
    assert target.columns == rows.columns and unchanged(target.collect()) and target.count() == 2


def test_stages(spark, rows, tmp_path):
    item = spark.createDataFrame([(1, prose(2, 80))], "item_id long, text string")
    item.write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, want = rows.union(rows.filter("doc_id = 4")), [{0, 1, 2, 3, 4, 5, 6, 8}, {0, 1, 2, 3, 4, 5, 6}, {0, 1, 3, 4, 5, 6}, {0, 1, 3, 4, 5, 6}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)), f"inner-{k}")
        got = docs.collect()
        assert docs.columns == rows.columns and unchanged(got), name
        assert sorted(r.doc_id for r in got) == sorted([*want[k], 4] if k == 0 else want[k]), name
    assert corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).count() == 6


def test_operators_that_return_no_other_columns(spark, rows):
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id long, quality int")
    assert packing.pack_documents(rows).count() == 9
    assert near_copies.near_copies(rows).filter("component_id <> doc_id").count() == 1
    folder, files = token_files.write_token_files(rows)
    assert token_files.read_token_files(spark, folder, files).count() == 9
    assert sharding.shard_documents(rows).count() == 9
    assert repeats.remove_repeats(rows).count() == 9
    assert decontaminate.leaks(rows, rows.select("doc_id", "text").withColumnRenamed("doc_id", "item_id")).count() >= 8
    assert quality_model.score_quality(rows, quality_model.fit_quality(rows, labels)).count() == 9
    assert prefix_bpe.decode_documents(prefix_bpe.encode_documents(rows, tables=True)).count() == 9
    aligned = cross_tokens.align_documents(rows)
    assert cross_tokens.score_links(aligned, cross_tokens.pair_counts(aligned)).count() == 9
