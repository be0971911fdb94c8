"""Batched ratios of matching blocks against the standard library, and what is built on them against plain folds over real texts."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linekeeper.functions import blocks
from linekeeper.operators import joins, matching
from linekeeper.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(a, b):
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def plain_score(a, b):
    r = plain(a, b)
    return 0.0 if not a or not b else max(r, 0.96) if a in b else max(r, 0.72) if b in a and len(b) >= 4 else r


def pairs(seed, n, most, alphabets):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice(alphabets)
        text = lambda k: "".join(rng.choice(letters) for _ in range(k))  # noqa: B023, E731
        a = text(rng.randint(0, most))
        cut = rng.randint(0, len(a))
        yield a, text(rng.randint(0, most)) if rng.random() < 0.5 else a[:cut] + text(rng.randint(0, 9)) + a[rng.randint(cut, len(a)) :]


@pytest.mark.parametrize("seed,n,most", [(1, 80_000, 14), (2, 18_000, 40), (3, 2_000, 260)])
def test_ratios_of_random_pairs(seed, n, most):
    """100,000 pairs; the longer ones have frequent characters that begin no block."""
    held = list(pairs(seed, n, most, ["ab", "abc", "abcdefghij", "abcdefghijklmnopqrstuvwxyz", "aé日\U0001f600xyz"]))
    got = blocks.ratios([a for a, _ in held], [b for _, b in held])
    assert got.tolist() == [plain(a, b) for a, b in held]


def test_long_texts_with_frequent_characters(monkeypatch):
    rng = random.Random(4)
    letters = "".join(chr(48 + k) for k in range(60))
    held = [("".join(rng.choice(letters) for _ in range(rng.randint(150, 900))), "".join(rng.choice(letters[: rng.choice([3, 20, 60])]) for _ in range(rng.randint(199, 900)))) for _ in range(120)]
    held += [(a, a[: len(a) // 2] + "xyz" + a[len(a) // 2 :]) for a, _ in held[:40]] + [("a" * 300, "a" * 400), ("a" * 200, "b" * 200), ("ab" * 150, "ba" * 150)]
    want = [plain(a, b) for a, b in held]
    assert blocks.ratios([a for a, _ in held], [b for _, b in held]).tolist() == want
    monkeypatch.setattr(blocks, "MEETING_PLACES", 1000)
    monkeypatch.setattr(blocks, "STEP_PLACES", 1000)
    assert blocks.ratios([a for a, _ in held], [b for _, b in held]).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abAB 日", max_size=30), st.text("abAB 日", max_size=30)), max_size=8))
def test_ratios_and_scores_of_any_pairs(held):
    a, b = [x for x, _ in held], [y for _, y in held]
    assert blocks.ratios(a, b).tolist() == [plain(x, y) for x, y in held]
    assert blocks.scores(a, b).tolist() == [plain_score(x, y) for x, y in held]


def plain_matches(lines, texts, ahead=12, spans=3):
    at, out = 0, []
    for entry, line in lines:
        best = (0.0, None, 0)
        for i in range(at, min(len(texts), at + ahead)):
            for k in range(1, min(spans, len(texts) - i) + 1):
                s = plain_score(line, "".join(texts[i : i + k]))
                if s > best[0]:
                    best = (s, i, k)
            if best[0] >= 0.88:
                break
        hit = best[1] is not None and best[0] >= 0.42
        out.append((entry, best[1] + 1 if hit else None, best[2] if hit else None, best[0]))
        at = best[1] + best[2] if hit else at
    return out


def test_fuzzy_match_of_real_turns(spark):
    """All conversations of the table, each turn against turns with a word left out, some missing, some cut in two."""
    rows = catalogue.conversation_lines(spark, SF).select("song", "entry", "norm").collect()
    rng, songs, heard = random.Random(6), {}, {}
    for r in sorted(rows, key=lambda r: (r.song, r.entry)):
        songs.setdefault(r.song, []).append((r.entry, r.norm))
        texts = heard.setdefault(r.song, [])
        cut = rng.randint(0, len(r.norm))
        for part in rng.choice([[r.norm], [], [r.norm[:cut], r.norm[cut:]], [r.norm[: cut // 2] + r.norm[cut // 2 + 4 :]], ["something else", r.norm[5:]]]):
            texts.append(part)
    lines = spark.createDataFrame([(s, e, n) for s, own in songs.items() for e, n in own], "song long, entry int, norm string").repartition(3)
    segments = spark.createDataFrame([(s, k, t) for s, own in heard.items() for k, t in enumerate(own, 1)], "song long, seg_idx int, norm string").repartition(3)
    got = sorted((tuple(r) for r in joins.fuzzy_match(lines, segments).collect()), key=lambda r: r[:2])
    assert got == [(s, *r) for s in sorted(songs) for r in plain_matches(songs[s], heard[s])]
    assert {r[3] for r in got} >= {1, 2} and any(r[2] is None for r in got)


def test_songs_side_by_side(spark, monkeypatch):
    """Songs of one side alone, null texts, more songs than go side by side."""
    lines = [("a", 1, "hello world"), ("a", 2, None), ("b", 1, "no segments"), (None, 1, "hello")]
    segments = [("a", 1, "hello world"), ("c", 1, "no lines"), (None, 1, "hello there")]
    df = spark.createDataFrame(lines, "song string, entry int, norm string"), spark.createDataFrame(segments, "song string, seg_idx int, norm string")
    got = {(r.song, r.entry): (r.segment, r.span, round(r.score, 3)) for r in joins.fuzzy_match(*df).collect()}
    assert got == {("a", 1): (1, 1, 1.0), ("a", 2): (None, None, 0.0), ("b", 1): (None, None, 0.0), (None, 1): (1, 1, 0.96)}
    many = [(f"s{k:04d}", e, f"line {e} of song {k}") for k in range(600) for e in range(1, 4)]
    both = spark.createDataFrame(many, "song string, entry int, norm string").repartition(1)
    assert joins.fuzzy_match(both, both.withColumnRenamed("entry", "seg_idx")).filter("segment = entry and score = 1").count() == 1800


def test_anchor_match_of_real_turns(spark):
    """By number where one is given, else the first unused equal text behind the last match, else the first unused one."""
    rows = [tuple(r) for r in catalogue.conversation_lines(spark, SF).select("song", "entry", "norm").collect()]
    rows = [(s, e, n[:2]) for s, e, n in rows]  # short texts, so that many are equal
    rng = random.Random(7)
    hints = [(s, k, rng.choice([None, None, e, e + 50]), n if rng.random() < 0.9 else "zz") for k, (s, e, n) in enumerate(rows) if rng.random() < 0.6]
    hints += [(s, k + 10_000, number, n) for s, k, number, n in hints[::5] if number is not None]
    want, used, last, texts = {}, {}, {}, {}
    for s, e, n in sorted(rows):
        texts.setdefault(s, {})[e] = n
    for s, k, number, text in sorted(hints, key=lambda h: h[:2]):
        own, taken = texts[s], used.setdefault(s, set())
        if number is not None:
            error = "out of range" if number not in own else "duplicate" if number in taken else "text mismatch" if own[number] != text else None
            entry = number
        else:
            free = [e for e in sorted(own) if own[e] == text and e not in taken]
            entry = next((e for e in free if e > last.get(s, 0)), free[0] if free else None)
            error = None if free else "no match"
        if error is None:
            taken.add(entry)
            last[s] = entry
        want[s, k] = (None if error else entry, error)
    lines = spark.createDataFrame(rows, "song long, entry int, norm string")
    got = joins.match_anchors(lines, spark.createDataFrame(hints, "song long, hint_idx int, entry_number int, norm string")).collect()
    assert {(r.song, r.hint_idx): (None if r.entry != r.entry else r.entry, r.error) for r in got} == want
    assert {e for _, e in want.values()} == {None, "out of range", "duplicate", "text mismatch", "no match"}


def test_earlier_duplicates_of_random_texts(spark):
    rng = random.Random(8)
    words = ["sing", "the", "song", "again", "now"]
    made = lambda: "".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    segs = [(s, k, round(t, 2), made()) for s in range(20) for k, t in enumerate(sorted(rng.uniform(0, 60) for _ in range(25)))]
    lines = [(s, e, made(), rng.choice([None, *range(25)]), rng.uniform(0.4, 1)) for s in range(20) for e in range(1, 30)]
    at = {(s, k): (t, n) for s, k, t, n in segs}
    want = {}
    for s, e, text, k, score in lines:
        for back, seconds, alike in ((2, 2.5, 0.70), (3, 5.0, 0.86)):
            for j in range(k - 1, max(-1, k - back - 1), -1) if k else ():
                (t0, n0), (t1, n1) = at[s, j], at[s, k]
                if not n0 or t1 - t0 > seconds or plain(n0, n1) < alike:
                    continue
                if back == 2 and plain_score(text, n0) >= score - 0.05:
                    k, score = j, max(score, plain_score(text, n0))
                    break
                if back == 3 and text.startswith(n0):
                    k, score = j, max(score, 0.80)
                    break
        want[s, e] = (k, score)
    got = matching.earlier_duplicates(spark.createDataFrame(lines, "song int, entry int, norm string, segment int, score double"), spark.createDataFrame(segs, "song int, seg_idx int, start double, norm string")).collect()
    assert {(r.song, r.entry): (None if r.segment != r.segment else r.segment, r.score) for r in got} == want
