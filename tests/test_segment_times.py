"""Times from matched segments over real turns, against a restatement rule by rule."""

import random

import pytest

from linekeeper.operators import matching
from linekeeper.plans import catalogue

SF = "/root/testdata/sf0.001"
LINES = "song long, entry int, norm string, marker boolean, segment int, score double, t double, duration double"
SEGMENTS = "song long, seg_idx int, start double, end double, norm string"


def restated(lines, segs, duration):
    """Times, segments and how they came about of one song; lines: norm, marker, segment, score, t."""
    n = len(lines)
    seg = [x[2] if x[2] in segs else None for x in lines]
    t = [x[4] if s is not None else None for x, s in zip(lines, seg, strict=True)]
    score, text, how, borrowed = [x[3] for x in lines], [x[0] for x in lines], ["matched"] * n, [False] * n
    for i in range(n):
        if t[i] is not None:
            continue
        left = max((k for k in range(i) if t[k] is not None), default=None)
        right = min((k for k in range(i + 1, n) if t[k] is not None), default=None)
        ls, rs = (seg[k] if k is not None else None for k in (left, right))
        if left is not None and right is not None and ls is not None and ls == rs:
            seg[i], t[i], how[i] = ls, segs[ls][0], "shared"
        elif right is not None and rs is not None and (left is None or 0.4 < segs[rs][0] - t[left] <= 4.2):
            seg[i], t[i], how[i], borrowed[i] = rs, segs[rs][0], "borrowed", True
        elif left is not None and right is not None and ls is not None and not lines[i][1] and t[right] - segs[ls][1] >= 6.0:
            t[i], how[i] = min(t[right] - 0.5, segs[ls][1] + min(3.2, max(2.8, 0.45 * len(text[i])))), "tail"
        elif left is not None and right is not None:
            t[i], how[i] = t[left] + (t[right] - t[left]) * (i - left) / (right - left), "between"
        elif left is not None:
            t[i], how[i] = min(duration, t[left] + 2.0 * (i - left)), "after"
        elif right is not None:
            t[i], how[i] = max(0.0, t[right] - 2.0 * (right - i)), "before"
        else:
            t[i], how[i] = 0.0, "none"
    for i in range(n - 1):
        if borrowed[i] and seg[i] is not None and seg[i + 1] == seg[i]:
            a, b, _ = segs[seg[i]]
            t[i], t[i + 1] = a, max(t[i + 1], a + 0.55 * max(0.0, b - a))
    for i in range(1, n - 1):
        if seg[i] is None or seg[i + 1] is None or seg[i] == seg[i + 1] or score[i] < 0.60:
            continue
        a, b, heard = segs[seg[i]]
        says = bool(text[i]) and (text[i] in heard or heard in text[i] or score[i] >= 0.82)
        to = max(t[i - 1] + 0.10, t[i + 1] - min(2.8, max(1.4, 1.0 + 0.10 * len(text[i]))))
        if not says and t[i + 1] - b >= 6.0 and t[i + 1] - t[i] >= 8.0 and t[i] - t[i - 1] >= 4.5 and b - a >= 2.5 and t[i] < to < t[i + 1] - 0.30:
            t[i] = to
    i = 0
    while i < n:
        k = next((k for k in range(i, n) if seg[k] != seg[i]), n)
        m = k - i
        if seg[i] is not None and m > 1:
            a, b, _ = segs[seg[i]]
            later = next((segs[s][0] for s in seg[k:] if s is not None and s != seg[i]), None)
            if later is not None and 0.5 < later - a <= 18.0:
                end = later - 0.10
            else:
                end = a + max(0.5, b - a, 3.5 * m)
                end = end if later is None else min(end, later - 0.10)
            for j in range(m):
                t[i + j] = max(t[i + j], a + max(end - a, 0.20 * m) * (j / 2 if m == 2 else j / max(1.0, m - 0.55)))
        i = k
    for i in range(1, n):
        t[i] = max(t[i], t[i - 1] + 0.10)
    return [(max(0.0, min(duration, x)), s, h, b) for x, s, h, b in zip(t, seg, how, borrowed, strict=True)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_times_of_real_turns(spark, seed):
    rng = random.Random(seed)
    turns = {}
    for r in catalogue.conversation_lines(spark, SF).select("song", "entry", "norm").collect():
        turns.setdefault(r.song, []).append((r.entry, r.norm[: rng.choice([4, 12, 400])]))
    lines, segs, want = [], [], {}
    for song, own in turns.items():
        own.sort()
        held, at = {}, 0.0
        for k in range(len(own) + 2):
            at += rng.choice([0.3, 1.0, 2.0, 3.0, 9.0, 20.0])
            length = rng.choice([0.5, 2.0, 3.0, 6.0])
            held[k] = (at, at + length, rng.choice([own[k % len(own)][1], "other", "", own[k % len(own)][1][:3]]))
            at += rng.choice([0.0, length])
        duration, place, rows = at + rng.choice([-5.0, 0.5, 30.0]), 0, []
        for entry, text in own:
            place = min(len(own) + 1, place + rng.choice([0, 1, 1, 2]))
            known = rng.random() < 0.6
            rows.append((text, rng.random() < 0.1, place if known else None, rng.choice([0.3, 0.5, 0.61, 0.7, 0.9]), held[place][0] + rng.uniform(0, 0.4) if known else None))
            lines.append((song, entry, *rows[-1], duration))
        segs += [(song, k, *v) for k, v in held.items()]
        for (entry, _), x in zip(own, restated(rows, held, duration), strict=True):
            want[song, entry] = x
    got = {}
    for r in matching.times_from_segments(spark.createDataFrame(lines, LINES).repartition(3), spark.createDataFrame(segs, SEGMENTS)).collect():
        got[r.song, r.entry] = (r.time, None if r.segment != r.segment else r.segment, r.how, r.borrowed)
    assert set(got) == set(want)
    for key, (time, segment, how, borrowed) in want.items():
        assert got[key][0] == pytest.approx(time) and got[key][1:] == (segment, how, borrowed), key
    assert len({x[2] for x in want.values()}) >= 5


def test_word_candidate_of_real_turns(spark):
    """The plan against its parts restated: matches, earlier duplicates, places, times, and the counts of its report."""
    from tests.test_blocks import plain, plain_matches, plain_score

    from linekeeper.plans import evidence

    turns, heard = {}, {}
    rows = catalogue.conversation_lines(spark, SF)
    for r in rows.select("song", "entry", "norm").collect():
        turns.setdefault(r.song, []).append((r.entry, r.norm))
    for r in evidence.heard_turns(rows).collect():
        heard.setdefault(r.song, {})[r.seg_idx] = (r.start, r.end, r.norm)
    want, counts = {}, {}
    for song, own in turns.items():
        own.sort()
        segs = heard.get(song, {})
        duration = max(e for e, _ in own) * 4.0 + 10
        made = []
        for (entry, text), (_, at, _, score) in zip(own, plain_matches(own, [segs[k][2] for k in sorted(segs)]), strict=True):
            for back, seconds, alike in ((2, 2.5, 0.70), (3, 5.0, 0.86)):
                for k in range(at - 1, max(0, at - back - 1), -1) if at else ():
                    if not segs[k][2] or segs[at][0] - segs[k][0] > seconds or plain(segs[k][2], segs[at][2]) < alike:
                        continue
                    if back == 2 and plain_score(text, segs[k][2]) >= score - 0.05:
                        at, score = k, max(score, plain_score(text, segs[k][2]))
                        break
                    if back == 3 and text.startswith(segs[k][2]):
                        at, score = k, max(score, 0.80)
                        break
            place = None
            if at:
                a, b, norm = segs[at]
                place = a + (b - a) * min(0.95, norm.find(text) / len(norm)) if norm.find(text) > 0 and b - a > 0.05 else a
            made.append((text, False, at, score, place))
        for (entry, _), x, y in zip(own, restated(made, segs, duration), made, strict=True):
            want[song, entry] = (round(x[0], 5), x[1], x[2], round(y[3], 5))
        times = restated(made, segs, duration)
        counts[song] = (len(own), sum(x[1] is not None for x in times), sum(x[1] is not None and y[3] >= 0.62 for x, y in zip(times, made, strict=True)))
    got = {(r.song, r.entry): (round(r.time, 5), None if r.segment != r.segment else r.segment, r.how, round(r.score, 5)) for r in evidence.word_candidates(spark, SF).collect()}
    assert set(got) == set(want)
    for key, x in want.items():
        assert got[key][1:3] == x[1:3] and (got[key][0], got[key][3]) == pytest.approx((x[0], x[3]), abs=2e-5), (key, got[key], x)
    assert {x[2] for x in want.values()} >= {"matched", "borrowed"} and any(x[1] is not None and x[3] < 1 for x in want.values())
    assert {r.song: (r.timing_entries, r.assigned_entries, r.trusted_entries) for r in evidence.word_reports(spark, SF).collect()} == counts
