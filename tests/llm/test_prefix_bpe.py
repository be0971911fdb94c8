"""Prefix tables against the tiktoken library: whole texts, appends, edits, round trips."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import prose

from linekeeper.llm import prefix_bpe

BITS = ["a", "b", "the", " ", "  ", "\n", "'re", "'s", "é", "日", "1", "22", "#", "\t", "\x1c", "\x85", "--", "======", "İ", "aaaa", " ", "word.", "Ünï,"]


def joined(rng, most=60):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, most)))


@pytest.fixture(scope="module")
def coder():
    return prefix_bpe.PrefixCoder(prefix_bpe.default_path(), prefix_bpe.default_pattern(), cache=50)


@pytest.fixture(scope="module")
def library(coder):
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=prefix_bpe.default_pattern(), mergeable_ranks=coder.ranks, special_tokens={})
    return lambda text: np.array(encoding.encode_ordinary(text), "<u4").tobytes()


def test_every_token_encodes_to_itself(coder):
    assert all(coder.merged(t) == [r] for t, r in coder.ranks.items())


def test_texts_as_the_library(coder, library):
    rng = random.Random(1)
    texts = ["", " ", "\n", "x  ", " x", "x \n y", *[joined(rng) for _ in range(1500)], *[prose(k, 200) for k in range(20)]]
    for a in range(0, len(texts), 100):  # a cache of 50 pieces gives way all the time
        assert coder.encode(pa.array(texts[a : a + 100])) == [library(t) for t in texts[a : a + 100]]
    assert [coder.decode(x) for x in coder.encode(pa.array(texts))] == [t.encode() for t in texts]
    assert coder.encode(pa.array([], pa.string())) == []


def test_each_prefix_has_the_last_token_of_its_own_encoding(coder):
    rng = random.Random(2)
    for _ in range(60):
        data = "".join(rng.choice(["ab", "the", "ing", "tion", "é", "--", "0"]) for _ in range(rng.randint(1, 30))).encode()
        last, starts = coder.tables([data])
        for n in range(1, len(data) + 1):
            assert last[starts[0] + n - 1] == coder.merged(data[:n])[-1]


def test_appends_and_edits(coder, library):
    rng = random.Random(3)
    for _ in range(400):
        text = joined(rng)
        table = prefix_bpe.PrefixTable(coder, text)
        for _ in range(4):
            a = len(text) if rng.random() < 0.3 else rng.randint(0, len(text))
            b, new = min(len(text), a + rng.choice([0, 0, 1, 3, 10])), joined(rng, 4)
            text = text[:a] + new + text[b:]
            table.edit(a, b, new)
            afresh = prefix_bpe.PrefixTable(coder, text)
            assert table.text == text and table.ids() == library(text)
            assert table.ends.tolist() == afresh.ends.tolist() and table.last.tolist() == afresh.last.tolist()


def test_edits_of_one_long_piece_stay_near(coder, library, monkeypatch):
    text = "ab" * 50_000
    table = prefix_bpe.PrefixTable(coder, text)
    asked = []
    stand = coder.stand
    monkeypatch.setattr(coder, "stand", lambda a, b: asked.append(1) or stand(a, b))
    table.edit(40_000, 40_001, "the")
    text = text[:40_000] + "the" + text[40_001:]
    assert table.ids() == library(text) and len(asked) < 3000
    table.append("xyz")
    assert table.ids() == library(text + "xyz") and len(asked) < 3500


def test_documents(odd, odd_rows, library):
    encoded = prefix_bpe.encode_documents(odd)
    assert encoded.columns == [*odd.columns, "n_tokens", "ids"]
    rows = prefix_bpe.decode_documents(encoded).collect()
    assert sorted((repr((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)))) for r in rows) == sorted(
        repr((d, len(library(t or "")) // 4, library(t or ""), (t or "").encode())) for d, t in odd_rows
    )
    assert {(r.kept, r.found, r.uid) for r in rows} == {(True, "x", "u")}


def test_query_and_clashing_names(spark, odd, odd_rows, library, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, map(tuple, prefix_bpe.op11_prefix_bpe(spark, str(tmp_path)).collect())))
    digest = lambda x: hashlib.sha256(x).hexdigest()
    assert got == sorted(repr((d, len(library(t or "")) // 4, digest(library(t or "")), digest((t or "").encode()))) for d, t in odd_rows)
    own = spark.createDataFrame([(1, "a b", 5, "mine", None)], "doc_id long, text string, n_tokens long, last string, decoded string")
    row = prefix_bpe.decode_documents(prefix_bpe.encode_documents(own)).first()
    assert (row.n_tokens, row.last, bytes(row.decoded)) == (2, "mine", b"a b")


def test_edits_of_documents(spark, odd, odd_rows, library):
    edits = [(9, 1, 0, 4, "New start "), (9, 2, None, None, " and an end"), (10, 1, 100_000, 100_002, "  "), (0, 1, 0, 0, "from nothing"), (3, 1, -5, 99, None), (77, 1, 0, 1, "no such row"), (None, 1, 0, 1, "nobody"), (13, 1, 0, 5, "Then")]
    table = spark.createDataFrame(edits, "doc_id long, seq int, start long, end long, new string")
    rows = prefix_bpe.edit_documents(prefix_bpe.encode_documents(odd, tables=True), table).collect()
    want = []
    for d, t in odd_rows:
        for e, _, a, b, new in edits:
            if e == d and e is not None:
                t, n = t or "", len(t or "")
                a, b = n if a is None else max(0, a), n if b is None else min(n, b)
                t = t[:a] + (new or "") + t[b:]
        want.append((d, t, library(t or "")))
    assert sorted(repr((r.doc_id, r.text, bytes(r.ids))) for r in rows) == sorted(map(repr, want))
    assert {r.found for r in rows} == {"x"}


def test_nothing(empty, spark):
    encoded = prefix_bpe.encode_documents(empty, tables=True)
    assert prefix_bpe.decode_documents(encoded).count() == 0
    assert prefix_bpe.edit_documents(encoded, spark.createDataFrame([], "doc_id long, seq int, start long, end long, new string")).count() == 0
