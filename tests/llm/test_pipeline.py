"""The pipeline's stages against plain re-statements, each on its own input."""

import pytest
from tests.llm import brute
from tests.llm.conftest import prose

import corpus_pipeline
from linekeeper.llm import quality_rules, tokens

LABELS = "doc_id long, quality int, toxic int"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base, item = prose(1, 90), prose(500, 40)
    near = base.split()
    near[44] = "changed"
    texts = [prose(i + 20, 80) for i in range(25)] + [base, base, " ".join(near), base + " tail", None, "", "short text"]
    texts += [" ".join(w.upper() + "!!" for w in prose(60, 80).split()), "word " * 90, prose(61, 60) + " " + item + " " + prose(62, 60), prose(63, 70) + ' password = "hunter2hunter" ' + prose(64, 20), prose(65, 6000)]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[3])
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, int(i != 32), 0) for i, *_ in rows] + [(None, 1, 0)], LABELS).write.parquet(f"{out}/labels.parquet")
    return str(out)


def ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    stored = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), f"test-{k}")
        after = docs.collect()
        stored[name] = after
        if k < 4:
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        if k == 0:
            bad = {r.doc_id for r in before if brute.base_rules(r.text)[5]} | {32}  # 32 shouts
            assert ids(after) == ids([r for r in before if r.doc_id not in bad])
        if k == 1:
            pairs = list(dict.fromkeys((r.doc_id, r.text) for r in before))
            assert ids(after) == sorted(d for d, _, c in brute.components(pairs, 5, 80) if c == d)
            assert {25, 3} <= set(ids(after)) and not {26, 27, 28} & set(ids(after))
        if k == 2:
            assert ids(after) == [i for i in ids(before) if i != 34]
        if k == 3:
            texts = {r.doc_id: r for r in before}
            for r in after:
                old = texts[r.doc_id].text
                assert r.text == (old if r.doc_id != 35 else old.replace('password = "hunter2hunter', "[SECRET]"))
                assert r.n_chars == len(r.text)
        if k == 4:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(tokens.default_path())
            want = set()
            for r in before:
                t = brute.token_ids(own, r.text)
                want |= {(r.doc_id, i, a, len(t[a : a + 4096]), brute.crc(t[a : a + 4096])) for i, a in enumerate(range(0, len(t), 4096))}
            assert {tuple(r[:5]) for r in after} == want
    again = corpus_pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in stored["best-fit packing"])


def test_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_threshold_is_between(spark):
    """The rejected document is rejected by the ratio, not by the base rules."""
    text = " ".join(w.upper() + "!!" for w in prose(60, 80).split())
    docs = spark.createDataFrame([(i, prose(i, 80)) for i in range(25)] + [(99, text)], "doc_id long, text string")
    row = quality_rules.quality_rules(docs).filter("doc_id = 99").first()
    assert not row.base_failed and not row.kept


def test_stages_keep_columns_that_have_names_of_results(spark, folder):
    """Other columns, one id with two texts, and a clean row that shares its id with a leaking one."""
    item, first, other = prose(500, 40), prose(20, 80), " ".join(reversed(prose(20, 80).split()))
    rows = [(1, first, -1, "a", 7), (1, prose(21, 60) + " " + item, -2, "b", 8), (None, other, -3, None, None), (None, prose(22, 60) + " " + item, -4, "d", 9), (2, first, -5, "e", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, kept string, uid int")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "clash")
        kept[name] = sorted((tuple(r) for r in docs.collect()), key=repr)
    assert kept["quality rules"] == sorted(rows, key=repr)
    assert kept["n-gram Jaccard join"] == sorted(rows[:4], key=repr)
    assert kept["secret scans"] == sorted([rows[0], rows[2]], key=repr)
