"""Alignment of two tokenizers against a plain re-statement, text by text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import prose

from linekeeper.llm import cross_tokens


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = cross_tokens.default_paths()
    own = Tokenizer.from_file(a)
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_file=b)


def plain(libraries, text):
    """(groups as text, Counter of linked pairs) of one text, or None."""
    a, b = libraries
    if not text:
        return None
    letters = cross_tokens.byte_letters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    groups, x, y = [], list(zip(ids_a, bytes_a, strict=True)), list(zip(ids_b, bytes_b, strict=True))
    while x:
        mine, other, n, m = [x[0][0]], [y[0][0]], len(x.pop(0)[1]), len(y.pop(0)[1])
        while n != m:
            if n < m:
                i, t = x.pop(0)
                mine.append(i)
                n += len(t)
            else:
                i, t = y.pop(0)
                other.append(i)
                m += len(t)
        groups.append((mine, other))
    text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
    return text, Counter((i, j) for g, h in groups for i in g for j in h)


def expected(libraries, rows):
    held = [plain(libraries, t) for _, t in rows]
    counts = Counter(p for x in held if x for p in x[1])
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(n, most.get(i, 0))
    out = []
    for (d, _), x in zip(rows, held, strict=True):
        if x is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups = [g.split("|") for g in x[0].split(";")]
        n = [sum(len(g[k].split(",")) for g in groups) for k in (0, 1)]
        best = sum(c for p, c in x[1].items() if counts[p] == most[p[0]])
        out.append((d, *n, len(groups), sum(x[1].values()), best, sum(c * counts[p] for p, c in x[1].items()), hashlib.sha256(x[0].encode()).hexdigest()))
    return sorted(map(repr, out))


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
MORE = ["a  b", " a", "a ", "  ", "▁", "a▁b c", "<s> </s> <unk> <|endoftext|>", "\x1c \x85 x", "ＡＢ ﬁ", "日本語 \U0001f600\U0001f600", "\n\n\n x", "a b", "tab\there", "İstanbul é"]


@pytest.fixture(scope="module")
def rows(odd_rows):
    rng = random.Random(5)
    own = [(100 + k, t) for k, t in enumerate(MORE)]
    return odd_rows + own + [(200 + k, " ".join(rng.choice(MORE + ["the", "of", "Hello,", "x2"]) for _ in range(rng.randint(1, 30)))) for k in range(60)] + [(300 + k, prose(k, 300)) for k in range(10)]


def test_by_word_is_as_whole():
    own = cross_tokens.Aligner(*cross_tokens.default_paths())
    assert own.by_word
    texts = [prose(k, 100) for k in range(20)]
    a, b, sure = own.ids(pa.array(texts))
    assert all(sure)
    assert [x.tolist() for x in a] == own.a.encode_whole(texts) and [x.tolist() for x in b] == own.b.encode_whole(texts)


def test_query(spark, rows, libraries, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = cross_tokens.op12_cross_tokens(spark, str(tmp_path))
    assert tuple(got.columns) == COLUMNS
    assert sorted(repr(tuple(r)) for r in got.collect()) == expected(libraries, rows)


@pytest.mark.parametrize("sent,links,pairs", [(0, 7, 5), (50, 1 << 22, 1 << 21)])
def test_few_sent_pairs_and_small_blocks(spark, rows, libraries, monkeypatch, sent, links, pairs):
    monkeypatch.setattr(cross_tokens, "BLOCK_LINKS", links)  # in the driver: of the aligner below
    own = cross_tokens.Aligner(*cross_tokens.default_paths())
    texts = [t or "" for _, t in rows if t is None or len(t) < 5000]
    got = own.align(pa.array(texts))
    for k, t in enumerate(texts):
        want = plain(libraries, t)
        held = zip(cross_tokens.restored(got["pairs"][k], own.kind).tolist(), cross_tokens.restored(got["times"][k], "<u4").tolist(), strict=True)
        assert {(p // own.n_b, p % own.n_b): n for p, n in held} == (dict(want[1]) if want else {})
        assert got["groups"][k].decode() == (want[0] if want else "")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    aligned = cross_tokens.align_documents(docs)
    scored = cross_tokens.score_links(aligned, cross_tokens.pair_counts(aligned), sent_pairs=sent)
    assert sorted(repr(tuple(r)) for r in scored.select(*COLUMNS).collect()) == expected(libraries, rows)


def test_pair_counts(spark, libraries):
    docs = spark.createDataFrame([("x", "one two one"), ("y", "two"), (None, None)], "name string, body string")
    aligned = cross_tokens.align_documents(docs, id_col="name", text_col="body", spelled=True)
    want = Counter(p for t in ("one two one", "two") for p in plain(libraries, t)[1])
    got = cross_tokens.pair_counts(aligned).collect()
    assert {(r.a, r.b): r.n for r in got} == dict(want)
    assert all(r.top == (r.n == max(n for (a, _), n in want.items() if a == r.a)) for r in got)
    assert {r.doc_id: r.groups for r in aligned.collect()} == {"x": plain(libraries, "one two one")[0], "y": plain(libraries, "two")[0], None: ""}


def test_extra_columns_and_nothing(odd, odd_rows, empty, libraries):
    aligned = cross_tokens.align_documents(odd.withColumnsRenamed({"kept": "pairs", "found": "key"}))
    assert sorted(repr(r.doc_id) for r in aligned.collect()) == sorted(repr(d) for d, _ in odd_rows)
    none = cross_tokens.align_documents(empty)
    assert cross_tokens.score_links(none, cross_tokens.pair_counts(none)).count() == 0


def test_shuffled_values_come_back():
    for kind in ("<u4", "<u8"):
        for n in (0, 1, 7, 1000):
            v = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(kind)
            assert cross_tokens.restored(cross_tokens.shuffled(v), kind).tolist() == v.tolist()
