"""Every operator on odd rows, against plain re-statements, and on empty tables."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tests.llm import brute
from tests.llm.conftest import prose

from linekeeper.llm import decontaminate, near_copies, packing, quality_model, quality_rules, repeats, secrets, sharding, token_files, tokens, warc


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


# -- 1 and 3: tokens -------------------------------------------------------------


def test_packing(spark, odd, odd_rows, tokenizer):
    rows = packing.pack_documents(odd).collect()
    want = []
    for d, t in odd_rows:
        ids = brute.token_ids(tokenizer, t)
        want += [(d, k, a, len(ids[a : a + 4096]), brute.crc(ids[a : a + 4096])) for k, a in enumerate(range(0, len(ids), 4096))]
    same([r[:5] for r in rows], want)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) == -(-sum(r.length for r in rows) // 4096)


def test_packing_of_one_repeated_row(spark):
    """Equal rows spread over tasks and places; no task ranks them all."""
    df = spark.createDataFrame([(7, "a b c")] * 5000, "doc_id long, text string").repartition(6)
    rows = packing.pack_documents(df).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 5000
    assert len({r.sequence_id for r in rows}) == -(-5000 // (4096 // rows[0].length))


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_a_best_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 400)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan, opened = packing.plan_best_fit(counts, 64)
    used, taken = defaultdict(set), defaultdict(int)
    for r in plan.itertuples():
        for k in range(r.n):
            at = range(r.offset + k % r.per * r.length, r.offset + (k % r.per + 1) * r.length)
            assert not used[r.sequence + k // r.per] & set(at) and at[-1] < 64
            used[r.sequence + k // r.per] |= set(at)
            taken[r.length] += 1
    assert dict(taken) == counts and len(used) == opened
    assert all(v == set(range(len(v))) for v in used.values())  # gapless
    free = []  # one at a time
    for length in sorted(lengths, reverse=True):
        fits = [x for x in free if x >= length]
        if fits:
            free[free.index(min(fits))] -= length
        else:
            free.append(64 - length)
    assert opened == len(free)


def test_token_files(spark, odd, odd_rows, tokenizer):
    folder, files = token_files.write_token_files(odd, file_tokens=5000)
    rows = token_files.read_token_files(spark, folder, files, with_ids=True).collect()
    want, at = [], 0
    for d, t in sorted(odd_rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = brute.token_ids(tokenizer, t)
        want.append((d, at, len(ids), brute.crc(ids), ids))
        at += len(ids)
    assert [tuple(r) for r in sorted(rows, key=lambda r: r.start)] == want


def test_token_files_of_text_ids(spark, tmp_path):
    rows = [("b", "one two"), (None, "x"), ("", "y"), ("é\n", None), ("b", "one two"), ("a", "three")]
    spark.createDataFrame(rows, "doc_id string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(token_files.op3_token_files(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, "", "a", "b", "b", "é\n"]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(6)]


def test_token_files_of_nothing(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert token_files.op3_token_files(spark, str(tmp_path)).count() == 0


def test_values_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        for top in (2, 256, 257, 65536, 65537, 1 << 24, (1 << 24) + 1, 1 << 32):
            v = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            control, data = token_files.encode_values(v)
            assert len(control) == -(-n // 4)
            assert token_files.decode_values(control, data, n).tolist() == v.tolist()


def test_damaged_token_file_is_an_error():
    import struct

    raw = struct.pack(token_files.FILE_HEAD, token_files.MAGIC, token_files.VERSION, 0) + token_files.pack_block([1, None], [2, 1], np.array([7, 300, 2], np.uint32))
    assert [(i, r.tolist()) for _, i, _, r in token_files.read_file(raw)] == [([1, None], [7, 300, 2])]
    with pytest.raises(ValueError):
        list(token_files.read_file(raw[:-1] + b"\xff"))


def test_word_encoder_with_a_tiny_cache(tokenizer):
    import pyarrow as pa

    enc = tokens.WordEncoder(tokens.default_path(), cache_stems=3)
    texts = ["a b c. d! <|endoftext|>e|", "", "  X'll 'S Ünï ß. |>..", "a b q r s t u v w x. y, Z"]
    for _ in range(3):
        assert [x.tolist() for x in enc.encode(pa.array(texts))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# -- 2: near copies --------------------------------------------------------------


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_near_copies(odd, odd_rows, size, percent):
    same(near_copies.near_copies(odd, size, percent).collect(), brute.components(odd_rows, size, percent))


def test_near_copies_of_a_large_group(spark, monkeypatch):
    from tests.llm.conftest import prose

    import random

    rng, base = random.Random(5), prose(9, 90).split()
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.sample(range(90), rng.randint(0, 3)):
            w[k] = f"w{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, prose(100 + i, 60) + " " + " ".join(base[:25])) for i in range(60)]
    for group in (4000, 20):
        monkeypatch.setattr(near_copies, "PIVOT_GROUP", group)
        monkeypatch.setattr(near_copies, "TOP", 1 << 18 if group > 100 else 30)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        same(near_copies.near_copies(docs, 4, 85).collect(), brute.components(rows, 4, 85))


def test_near_copies_of_nothing(empty):
    assert near_copies.near_copies(empty).count() == 0


def test_filters_lose_nothing():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 60, 3).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        assert near_copies.suffix_bound(a, b) >= common
        assert near_copies.linked(a, b, 80) == (100 * common >= 80 * len(np.union1d(a, b)))
        if near_copies.linked(a, b, 80):
            frequent = np.unique(rng.integers(0, 60, 20).astype(np.uint64)), rng.integers(1, 5, 60)
            p = [set(near_copies.rare_first(x, frequent)[0][: near_copies.prefix_size(len(x), 80)].tolist()) for x in (a, b)]
            assert p[0] & p[1]
            bits = [np.frombuffer(near_copies.signature(x), np.uint64)[None] for x in (a, b)]
            assert near_copies.may_link(*bits, np.array([len(a)]), np.array([len(b)]), 80).all()


# -- 4: sharding -----------------------------------------------------------------


def test_sharding(odd, odd_rows):
    rows = sharding.shard_documents(odd).collect()
    same([r[:4] for r in rows], [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key") for d, t in odd_rows])
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_are_those_of_the_draws(spark):
    tree = {r: {k: {4 * r + 2 * k + s: 1.0 for s in range(2)} for k in range(2)} for r in range(4)}
    grown = {**tree, 4: {0: {16: 1.0}}}
    ids = [None, "", "a|b", "é", *map(str, range(-5, 400))]
    df = spark.createDataFrame([(i, "t") for i in ids], "doc_id string, text string")
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(df).collect()}
    assert got == {i: (brute.shard_of("\0" if i is None else i, tree), brute.shard_of("\0" if i is None else i, grown)) for i in ids}


def test_slots_of_one_repeated_id_spread(spark):
    df = spark.createDataFrame([(7, "same")] * 3000, "doc_id long, text string").repartition(4)
    rows = sharding.shard_documents(df)
    assert sorted(r.slot for r in rows.collect()) == list(range(3000)) and rows.select("shard").distinct().count() == 1


def test_sharding_of_nothing(empty):
    assert sharding.shard_documents(empty).count() == 0


def test_weights_move_only_what_changes(spark):
    from pyspark.sql import functions as F

    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    tree = sharding.Tree.even(16)
    heavier = sharding.Tree(tuple(sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in tree.leaves))
    both = sharding.assign(sharding.assign(keys, F.col("k"), tree, "a"), F.col("k"), heavier, "b").collect()
    per = np.bincount([r.a for r in both], minlength=16)
    assert per.min() > 180 and per.max() < 320
    assert np.bincount([r.b for r in both], minlength=16)[5] > 500
    place = {x.shard: (x.region, x.rack) for x in tree.leaves}
    for r in both:
        if r.a != r.b:  # only into the region that grew, or within it
            assert place[r.b][0] == place[5][0]


# -- 5: quality rules ------------------------------------------------------------


def test_base_rules(odd, odd_rows):
    rows = quality_rules.quality_rules(odd).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same([(r.doc_id, *(r[n] for n in names)) for r in rows], [(d, *brute.base_rules(t)) for d, t in odd_rows])
    assert all(r.kept <= (not r.base_failed) for r in rows)


@pytest.mark.parametrize("given", ["sent", "shuffled", None])
def test_likelihood_ratio(spark, given, monkeypatch):
    """Tokens, cells, both multinomials, scores and threshold restated; filters on the results run."""
    texts = [prose(i, 80) + ", é日本 1,000" for i in range(30)] + [" ".join(w.upper() + "!!" for w in prose(50 + i, 80).split()) for i in range(6)] + [None, "", "-- 12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if given:
        monkeypatch.setattr(quality_rules, "BROADCAST_IDS", 100 if given == "sent" else 3)
        chosen = [i for i in range(30) if i % 3 == 0]
        target = quality_rules.labelled_target(docs, spark.createDataFrame([(i, int(i % 3 == 0 and i < 30)) for i in range(39)] + [(None, 1), (1, None), (99, 1), (0, 1)], "doc_id long, quality int"))
        same(target.collect(), [(i, texts[i]) for i in chosen])
    else:
        chosen, target = range(30), None
    scores, cut = brute.likelihood_ratios(texts, [texts[i] for i in chosen], quality_rules.CELLS, quality_rules.SPREAD)
    out = quality_rules.quality_rules(docs, target)
    for r in out.collect():
        assert r.llr == pytest.approx(scores[r.doc_id], abs=1e-9)
        assert r.kept == (not r.base_failed and scores[r.doc_id] >= cut) == (r.doc_id < 30)
    assert out.filter("kept and llr > -10").count() == 30


def test_rules_without_a_target_are_the_base_rules(spark, odd):
    rows = quality_rules.quality_rules(odd, odd.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in rows) and any(r.kept for r in rows)


def test_columns_named_as_results_stay(spark):
    docs = spark.createDataFrame([(1, prose(1, 60), -5, "x")], "doc_id long, text string, n_words int, kept string")
    got = quality_rules.judged(docs).first()
    assert (got.n_words, got.kept, got["__r"].n_words) == (-5, "x", 60)


def test_quality_rules_of_nothing(empty):
    assert quality_rules.quality_rules(empty).count() == 0


# -- 6: repeats ------------------------------------------------------------------


@pytest.mark.parametrize(("shard_words", "common", "few"), [(200_000, 4096, 1 << 20), (30, 2, 0)])
def test_repeats(odd, odd_rows, shard_words, common, few):
    want = brute.repeats(list(dict.fromkeys(odd_rows)))
    same([tuple(r) for r in repeats.remove_repeats(odd, shard_words=shard_words, common_places=common, filter_anchors=few).collect()], [want[d] for d, _ in odd_rows])


@pytest.mark.parametrize(("shard_words", "common"), [(200_000, 4096), (100, 3)])
def test_repeats_of_a_common_passage(spark, shard_words, common):
    """A passage in other surroundings each time, near copies of one text, and a text made of few words."""
    passage, base = prose(21, 45), prose(22, 90).split()
    rows = [(i, f"{prose(100 + i, 12)} {passage} {prose(200 + i, 25)}") for i in range(40)]
    rows += [(100 + i, " ".join([*base[: 20 + i], "changed", *base[20 + i :]])) for i in range(40)]
    rows += [(200 + i, " ".join("ab"[(k * k + i) % 7 % 2] for k in range(150))) for i in range(8)]
    want = brute.repeats(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same([tuple(r) for r in repeats.remove_repeats(df, shard_words=shard_words, common_places=common).collect()], list(want.values()))


def test_repeats_of_nothing(empty):
    assert repeats.remove_repeats(empty).count() == 0


def test_automaton_against_brute_force():
    """Every window's first place in the reference, and matching across no ends."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        seqs = [rng.integers(0, 3, rng.integers(1, 14)).tolist() for _ in range(4)]
        first = {}
        for k, s in enumerate(seqs):
            for i in range(len(s) - 2):
                first.setdefault(tuple(s[i : i + 3]), (k, i))
        automaton = repeats.SuffixAutomaton()
        for s in seqs:
            automaton.add(s)
        reference = repeats.Reference(automaton.packed([b"a", b"b", b"c"], [(k, 0) for k in range(4)]))
        for s in [*seqs, rng.integers(0, 4, 30).tolist()]:
            want = {i: first[tuple(s[i : i + 3])] for i in range(len(s) - 2) if tuple(s[i : i + 3]) in first}
            assert reference.first_places([b"abcd"[v : v + 1] for v in s], 3) == want


# -- 7: WARC ---------------------------------------------------------------------


def test_warc(spark):
    pages = [(1, "http://a.example/x", "<p>one</p>"), (2, None, None), (3, "http://b.example/é y\r\nX: 1", "<p>one</p>"), (4, "u", ""), (5, "u", "z" * 300_000), (None, "n", "<p>one</p>"), (7, "u", "unique"), (7, "u", "unique")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, first string, record_type int")
    folder, _ = warc.write_archives(df)
    got = warc.assemble(warc.read_records(spark, folder, payloads=True)).collect()
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    want = set()
    for p, _, h in pages:
        h = h or ""
        revisit = p != first[h]
        want.add((p, len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if revisit else "response", first[h] if revisit else None))
    assert {(r.metadata.page_id, r.response.payload_bytes, r.response.payload_digest, r.response.record_type, r.refers_to) for r in got} == want
    assert all(r.request.concurrent_to == r.response.record_id == r.metadata.concurrent_to for r in got)
    assert {bytes(r.response.payload).decode() for r in got if r.response.record_type == "response"} == {h or "" for _, _, h in pages}


def test_warc_least_size_of_revisits(spark):
    df = spark.createDataFrame([(i, "u", "same") for i in range(3)], "page_id long, url string, html string")
    folder, _ = warc.write_archives(df, min_bytes=5)
    assert warc.read_records(spark, folder).filter("record_type = 'revisit'").count() == 0


def test_warc_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op7_warc(spark, str(tmp_path)).count() == 0


def test_warc_part_missing(spark):
    rows = [("request", "q", "gone", None, None, None, None, None, None), ("response", "r", None, "u", None, "D", 1, None, None)]
    got = {r.capture: (r.request is not None, r.response is not None) for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert got == {"gone": (True, False), "r": (False, True)}


# -- 8: decontamination ----------------------------------------------------------


def test_leaks(spark, odd, odd_rows):
    from tests.llm.conftest import prose

    items = [(1, prose(3, 70)), (2, prose(1, 120)[:200]), (3, None), (4, "two words"), (5, prose(77, 30)), (5, prose(3, 70)), (6, " ".join(prose(2, 9000).split()[4000:4006]))]
    want = []
    for d, t in odd_rows:
        have = brute.shingle_set(t, 5)
        for k, x in items:
            own = brute.shingle_set(x, 5) if len(brute.words(x)) >= 5 else set()
            if own and 100 * len(own & have) >= 80 * len(own):
                want.append((d, k, len(own), len(own & have)))
    table = spark.createDataFrame(items, "item_id long, text string")
    same(decontaminate.leaks(odd, table).collect(), want)
    assert {d for d, *_ in want} >= {5, 6, 8, 9, 11, 12}
    assert decontaminate.leaks(odd, table.limit(0)).count() == 0


def test_leaks_in_blocks(spark, odd, monkeypatch):
    from tests.llm.conftest import prose

    table = spark.createDataFrame([(i, prose(3, 70 - i)) for i in range(8)], "item_id long, text string")
    whole = decontaminate.leaks(odd, table).collect()
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 600)
    same(decontaminate.leaks(odd, table).collect(), whole)


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_scattered_items_are_found(parts):
    """Four fifths of an item in pieces all over a long document share a minimum with it."""
    rng = np.random.default_rng(parts)
    for n in (20, 60, 150):
        item = rng.integers(0, 2**64, n, dtype=np.uint64)
        body = rng.integers(0, 2**64, 3000, dtype=np.uint64)
        pieces, cuts = np.array_split(item[: -(-4 * n // 5)], parts), np.sort(rng.integers(0, 3000, parts))
        spread = np.concatenate([x for p, a, b in zip(pieces, [0, *cuts[:-1]], cuts, strict=True) for x in (body[a:b], p)])
        assert decontaminate.ItemIndex([1], [np.sort(item)]).candidates(spread, np.zeros(len(spread), np.int64)) == {(0, 0)}


def test_leaks_of_nothing(spark, empty):
    assert decontaminate.leaks(empty, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


# -- 9: quality classifier -------------------------------------------------------


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    bags = [quality_model.Bag(rng.normal(size=(n, 4)).astype(np.float32), np.array([5] * n), rng.integers(0, 512, 5 * n).astype(np.int16)) for n in (1, 3, 2)]
    model = quality_model.GatedAttention.fit(bags, [1, 0, 1])
    x, starts, sizes = model.inputs(bags)
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p = model._forward(x, starts, sizes)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in model._gradients(x, starts, sizes, y).items():
        at = (int(bags[1].buckets[0]), 0) if k == "W" else tuple(0 for _ in g.shape)
        old = model.weights[k][at]
        model.weights[k][at] = old + 1e-6
        up = loss()
        model.weights[k][at] = old - 1e-6
        assert g[at] == pytest.approx((up - loss()) / 2e-6, abs=1e-6)
        model.weights[k][at] = old


def test_scores_against_a_plain_forward_pass(odd, odd_rows, spark):
    """Passage by passage, word by word; and the bags that are fitted on hold the same passages."""
    rng = np.random.default_rng(3)
    bags = [quality_model.Bag(rng.normal(size=(n, quality_model.FEATURES)).astype(np.float32), np.array([5] * n), rng.integers(0, 512, 5 * n).astype(np.int16)) for n in (1, 3, 2, 4)]
    model = quality_model.GatedAttention.fit(bags, [1, 0, 1, 0])
    want = [(d, brute.attention_score(model, t)) for d, t in odd_rows]
    got = [(r.doc_id, r.score) for r in quality_model.score_quality(odd, model).collect()]
    key = lambda x: (repr(x[0]), x[1])
    for (a, x), (b, y) in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a == b and x == pytest.approx(y, abs=1e-5)
    import pyarrow as pa

    made = quality_model.make_bags(quality_model.WordTable(), pa.array([t for _, t in odd_rows], pa.string()))
    for bag, (_, y) in zip(made, want, strict=True):
        x, starts, sizes = model.inputs([bag])
        assert model._forward(x, starts, sizes)["p"][0] == pytest.approx(y, abs=1e-5)


def test_fitting_takes_bounded_rows(spark, monkeypatch):
    """An id with very many rows counts once, with the text of the smallest hash."""
    seen = []
    monkeypatch.setattr(quality_model.GatedAttention, "fit", classmethod(lambda cls, bags, labels: seen.append((len(bags), labels))))
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None), (3, "x"), (4, "y"), (6, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4, 6)], "doc_id long, quality int")
    quality_model.fit_quality(docs, labels, most=3)
    assert seen == [(3, [1, 1, 1])]


def test_classifier_on_held_out_documents(spark, odd, odd_rows):
    from tests.llm.conftest import prose

    rows = [(i, prose(i, 150) if i % 3 else " ".join(w + "***" for w in prose(i, 150).split())) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows] + [(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.fit_quality(docs, labels)
    got = quality_model.score_quality(docs, model).collect()
    tested = [r for r in got if r.held_out]
    assert len(tested) > 30 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in tested]) >= 0.97
    same([(r.doc_id,) for r in quality_model.score_quality(odd, model).collect()], [(d,) for d, _ in odd_rows])
    assert all(0 <= r.score <= 1 for r in quality_model.score_quality(odd, model).collect())


def test_classifier_without_labels(odd, odd_rows, empty, spark):
    model = quality_model.fit_quality(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert model is None
    assert {r.score for r in quality_model.score_quality(odd, model).collect()} == {0.5}
    assert quality_model.score_quality(empty, model).count() == 0


# -- 10: secrets -----------------------------------------------------------------


def test_secrets(odd, odd_rows):
    rows = secrets.scan_secrets(odd)
    counts = [secrets.F.expr(f"size(filter(found, s -> s.kind = '{k}'))").alias(k) for k in ("assign", "access", "hex")]
    base = secrets.F.sha2(secrets.listed("found", ("assign", "access", "hex")).cast("binary"), 256).alias("sha")
    got = rows.select("doc_id", *counts, base, secrets.listed("found").alias("spans")).collect()
    same([r[:5] for r in got], [(d, *n, sha) for d, t in odd_rows for n, sha in [brute.base_secrets(t)]])
    kinds = {s.split(":")[0] for r in got for s in r.spans.split(",") if s}
    assert {"assign", "access", "hex", "pem", "hook"} <= kinds


def test_redaction(odd, odd_rows):
    got = {r.doc_id: r.text for r in secrets.redact(odd).collect() if r.doc_id is not None}
    assert got[15] == 'é日本 [SECRET]" token:abc [SECRET] [SECRET]'
    assert got[16] == "secret: [SECRET] [SECRET]' [SECRET] [SECRET]" or got[16].count("[SECRET]") >= 3
    clean = {d: t for d, t in odd_rows if d not in (15, 16, None)}
    assert {d: got[d] for d in clean} == clean


def test_index_agrees_with_full_scans(odd):
    """Candidates from the index give what a scan of all texts gives (but for one of 200,000 letters, which an expression without the index takes minutes over)."""
    odd = odd.filter("doc_id is null or doc_id <> 10")
    indexed = secrets.scan_secrets(odd).select("doc_id", secrets.listed("found").alias("x")).collect()
    full = odd.withColumn("__text", secrets.F.coalesce("text", secrets.F.lit("")))
    arrays = [secrets.spans_of(r, k) for k, r in enumerate(secrets.RULES)]
    same(indexed, full.withColumn("f", secrets.F.array_sort(secrets.F.concat(*arrays))).select("doc_id", secrets.listed("f").alias("x")).collect())


@pytest.mark.parametrize(
    "pattern,want",
    [("[0-9a-f]{24,}", None), ("abcd", [{"abc", "bcd"}]), ("(?:foo|Barr)x", [{"foo", "oox"}, {"bar", "arr", "rrx"}]), ("a?b?cd.*", None), ("ab.cdef", [{"cde", "def"}])],
)
def test_trigram_queries(pattern, want):
    got = secrets.trigram_query(pattern)
    assert got == secrets.ANY if want is None else sorted(map(sorted, got)) == sorted(map(sorted, want))


def test_secrets_of_nothing(empty):
    assert secrets.scan_secrets(empty).count() == 0
    assert secrets.redact(empty).count() == 0


# -- stored tables ---------------------------------------------------------------


def test_stored_tables_are_shared_and_cleared(spark, odd):
    import os

    from linekeeper.llm import store

    root = store.shared_root(spark)
    assert root == store.shared_root(spark)
    path = store.new_folder(spark, "x")
    assert path.startswith(f"{root}/linekeeper/{spark.sparkContext.applicationId}/x-")
    store.put_file(path, "a.bin", b"one")
    store.put_file(path, "a.bin", b"two")
    local = path.removeprefix("file:").replace("//", "/")
    assert os.listdir(local) == ["a.bin"] and open(f"{local}/a.bin", "rb").read() == b"two"
    assert store.clear(spark) and not os.path.exists(local)


def test_id_filter_lets_no_candidate_go(spark):
    from linekeeper.llm import store

    docs = spark.range(1000).selectExpr("xxhash64(id) as uid", "cast(id as string) as text")
    ids = docs.filter("cast(text as int) % 7 = 0").select("uid")
    assert sorted(int(r.text) for r in store.keep_candidates(docs, "uid", ids).collect()) == list(range(0, 1000, 7))
    assert store.keep_candidates(docs, "uid", ids.limit(0)).count() == 0
