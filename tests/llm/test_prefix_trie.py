"""The trie against a plain re-statement; sorted runs and the tree of losers by themselves."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from linekeeper.llm import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth long, key string, path string, kind string"


def expected(rows):
    """Result rows of (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(v, key=lambda x: (x[0], x[1], __import__("base64").b64encode(x[2])))] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        words = len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below)
    out = []
    for node, own in members.items():
        ends = sorted(c for c in own if rebuilt[c] == node)
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), leaves[node], saved[node], sha))
    return sorted(map(repr, out))


def conversations(seed, n, same=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello there", "a b c", "", None, " x\ty "])))
    for c in range(n, n + same):
        rows += [(c, t, "user", f"the same turn {t}") for t in range(5)]
    return rows


ODD = [
    (None, 1, "user", "nobody's"), (7, None, "user", "first"), (7, 0, "user", "second"), (7, 0, "user", "second"), (7, 5, None, None), (40, 1, None, ""), (41, 3, "a", "b"),
    (45, 1, "a:", "b"), (46, 1, "a", ":b"), (-3, 1, "user", "negative"), (-20, 1, "user", "negative base"), (99, 1, "x", "é日本 " * 2000), (98, 1, "x", "y"), (97, 1, "x", "y"),
]


@pytest.mark.parametrize("seed,n,same,parts", [(1, 60, 0, 1), (2, 200, 0, 4), (3, 60, 150, 7), (4, 1, 0, 4), (5, 300, 300, 13)])
def test_query(spark, tmp_path, seed, n, same, parts):
    rows = conversations(seed, n, same) + ODD
    table = spark.createDataFrame([(*r, 1, "k", "p", "z") for r in rows], SCHEMA).repartition(3)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.op13_prefix_trie(spark, str(tmp_path))
        assert tuple(got.columns) == prefix_trie.RESULT
        assert sorted(repr(tuple(r)) for r in got.collect()) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_tiny_runs_and_few_waiting_children(spark, tmp_path, monkeypatch):
    rows = conversations(9, 400, 50)
    paths = prefix_trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = prefix_trie.prefix_trie(paths, run_bytes=2000).select(*prefix_trie.RESULT).collect()
    assert sorted(repr(tuple(r)) for r in got) == expected(rows)


def test_children_that_do_not_wait(monkeypatch):
    monkeypatch.setattr(prefix_trie, "WAITING", 2)
    own = prefix_trie.OpenPath(0)
    digest = lambda *x: "".join(f"{i:024d}" for i in x)
    paths = [(digest(0), 1, [1]), *[(digest(1, k), 2 + k, [1, 1]) for k in range(6)], (digest(2), 9, [1])]
    for row in prefix_trie.with_lcps(paths):
        own.take(*row)
    own.close()
    wide = next(r for r in own.rows if r["kind"] == "node" and r["depth"] == 1 and r["n_children"] == 6)
    assert wide["wanted"] and sum(r.get("parent_conv_id") is None for r in own.rows if r.get("parent_key") == wide["key"]) == 6


def test_sorted_stream(tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FAN_IN", 3)
    monkeypatch.setattr(prefix_trie, "READ_ROWS", 4)
    rng = random.Random(3)
    digest = lambda: "".join(rng.choice("ab") * prefix_trie.WIDTH for _ in range(rng.randint(0, 6)))
    rows = [(digest(), k) for k in range(500)]
    rng.shuffle(rows)
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([c for _, c in part]), pa.array([p for p, _ in part]), pa.array([[7] * (len(p) // prefix_trie.WIDTH) for p, _ in part], pa.list_(pa.int64()))], ["conv_id", "path", "words"])
    got = list(prefix_trie.sorted_stream(iter([batch(rows[k : k + 90]) for k in range(0, 500, 90)]), f"file://{tmp_path}/runs", 1500))
    assert [(p, c) for p, c, _, _ in got] == sorted(rows)
    before = ""
    for path, _, words, lcp in got:
        assert lcp == prefix_trie.shared_turns(before, path) and len(words) * prefix_trie.WIDTH == len(path)
        before = path
    assert list((tmp_path / "runs").iterdir()) == []


def test_shared_turns_are_not_compared_again(monkeypatch):
    """Merging two runs of long equal beginnings looks at few turns."""
    same = "s" * prefix_trie.WIDTH * 200
    runs = [[(same + f"{2 * k + j:024d}", k, [0] * 201) for k in range(50)] for j in range(2)]
    looked = []
    plain = prefix_trie.shared_turns
    monkeypatch.setattr(prefix_trie, "shared_turns", lambda a, b, start=0: looked.append(plain(a, b, start) - start) or plain(a, b, start))
    streams = [iter([(p, c, w, 200 if k else 0) for k, (p, c, w) in enumerate(r)]) for r in runs]
    assert [p for p, *_ in prefix_trie.merged(streams)] == sorted(p for r in runs for p, *_ in r)
    assert sum(looked) <= 200 + 100


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert prefix_trie.op13_prefix_trie(spark, str(tmp_path)).count() == 0
