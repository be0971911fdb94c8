from tests.llm.conftest import prose

from linekeeper.llm import quality_model


def test_fitting_sees_all_passages(spark, monkeypatch):
    texts = [(k, prose(k, 64 * n)) for k, n in ((1, 40), (2, 1), (3, 100), (4, 33))]
    seen = []
    monkeypatch.setattr(quality_model, "held_out", lambda id_col="doc_id": quality_model.F.lit(False))
    monkeypatch.setattr(quality_model.GatedAttention, "fit", classmethod(lambda cls, bags, labels: seen.extend(len(b) for b in bags)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in texts], "doc_id long, quality int")
    quality_model.fit_quality(docs, labels)
    assert seen == [-(-len(t.split()) // 64) for _, t in texts] and max(seen) > 32
