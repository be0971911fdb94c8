"""Ratio of matching blocks of many pairs of texts at a time, exact to the last bit of the common library's.

The longest common block of two texts is cut out (of equals the one that begins first in
the left text, then in the right), and what lies before it in both, and behind it in both,
is treated likewise.  All windows of all pairs that are open go through one step together:
rows are windows, columns the right texts' places, and the length of the block that ends at
each place follows from the one before.  In right texts of 200 characters or more,
characters that make up over a hundredth of it begin no block; they only extend one.
"""

from __future__ import annotations

import numpy as np

#: Characters of a right text from which on frequent ones begin no block, and the share (one in so many) that makes one frequent.
LONG, SHARE = 200, 100
#: Places (windows x columns) that go through a step together.
STEP_PLACES = 1 << 17
#: Places of equal characters that are held together where frequent characters begin no block.
MEETING_PLACES = 1 << 21


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a small number for each distinct character, all texts in a row; where each begins and the last ends)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    seen, small = np.unique(flat, return_inverse=True)
    # the two largest numbers stand beyond the ends of left and right texts
    kind = np.uint8 if len(seen) < 254 else np.uint16 if len(seen) < 65534 else np.uint32
    return small.astype(kind), np.concatenate([[0], np.cumsum(sizes)])


def frequent(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which places of texts hold a character that is frequent there."""
    out = np.zeros(len(flat), bool)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= LONG:
            part = flat[a:b]
            out[a:b] = (np.bincount(part) > (b - a) // SHARE + 1)[part]
    return out


def _longest(flat: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin in the left texts, in the right ones, length) of each window's longest block.

    a, b: where windows begin, n, m: their sizes.  Steps go down the left texts or, with
    ``across``, along the right ones.
    """
    if across:
        a, n, b, m = b, m, a, n
    rows, high, wide = len(a), int(n.max()), int(m.max())
    top = np.iinfo(flat.dtype).max
    column, step = np.arange(wide), np.arange(high)
    other = np.where(column < m[:, None], flat[np.minimum(b[:, None] + column, len(flat) - 1)], top)
    mine = np.where(step[:, None] < n, flat[np.minimum(a + step[:, None], len(flat) - 1)], top - 1)
    ends = np.zeros((2, rows, wide + 1), np.uint8 if min(high, wide) < 255 else np.uint32)
    same = np.empty((rows, wide), bool)
    size, at, to = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for i in range(high):
        before, now = ends[i & 1], ends[1 - (i & 1)]
        np.equal(other, mine[i][:, None], out=same)
        np.add(before[:, :-1], 1, out=now[:, 1:])
        np.multiply(now[:, 1:], same.view(np.uint8), out=now[:, 1:])
        longest = now.max(axis=1)
        better = (longest >= size if across else longest > size).nonzero()[0]
        if len(better):
            k, j = longest[better], now[better].argmax(axis=1)
            if across:  # an equal one counts if it begins earlier in the left text
                good = (k > size[better]) | ((k > 0) & (j < to[better]))
                better, k, j = better[good], k[good], j[good]
            size[better], at[better], to[better] = k, i + 1, j
    i, j = a + at - size, b + to - size
    return (j, i, size) if across else (i, j, size)


def _alike(flat: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many characters from i and j on (``way`` 1) or back (-1) are equal, ``most`` of them at most."""
    out, open_, wide = np.zeros(len(i), np.int64), np.flatnonzero(most > 0), 4
    while len(open_):
        far = out[open_][:, None] + np.arange(wide)
        there = far < most[open_][:, None]
        far = np.where(there, far, 0) * way
        same = there & (flat[i[open_][:, None] + far] == flat[j[open_][:, None] + far])
        run = np.where(same.all(axis=1), wide, same.argmin(axis=1))
        out[open_] += run
        open_, wide = open_[run == wide], min(256, 4 * wide)
    return out


def _extended(flat, a, b, n, m, i, j, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks with equal characters before and behind them, whatever these are, added; a block of none begins at its window's corner."""
    i, j = np.where(k > 0, i, a), np.where(k > 0, j, b)
    before = _alike(flat, i - 1, j - 1, np.minimum(i - a, j - b), -1)
    i, j, k = i - before, j - before, k + before
    return i, j, k + _alike(flat, i + k, j + k, np.minimum(a + n - i, b + m - j) - k, 1)


def _beside(windows: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """What lies before and behind the windows' blocks in both texts."""
    pair, a, n, b, m = windows.T
    return np.concatenate([np.stack([pair, a, i - a, b, j - b], axis=1), np.stack([pair, i + k, a + n - i - k, j + k, b + m - j - k], axis=1)])


def _dense(flat: np.ndarray, open_: np.ndarray, total: np.ndarray) -> None:
    """Adds the blocks of windows (pair, begin and size in the left text, in the right one) in which every character counts."""
    while len(open_ := open_[(open_[:, 2] > 0) & (open_[:, 4] > 0)]):
        more = []
        for across in (False, True):
            own = open_[(open_[:, 2] > open_[:, 4]) == across]
            rows, wide = own[:, 4 if across else 2], own[:, 2 if across else 4]
            # windows of about as many rows and columns go together
            order = np.lexsort((wide, np.int64(2 * np.log2(np.maximum(rows, 1)))))
            own, rows, wide, x = own[order], rows[order], wide[order], 0
            while x < len(own):
                far = np.flatnonzero((rows[x:] > max(8, 2 * rows[x])) | (np.maximum.accumulate(wide[x:]) * np.arange(1, len(own) - x + 1) > STEP_PLACES))
                y = x + (max(1, int(far[0])) if len(far) else len(own) - x)
                part = own[x:y]
                i, j, k = _longest(flat, *part.T[1:], across)
                np.add.at(total, part[:, 0], k)
                hit = k > 0
                more.append(_beside(part[hit], i[hit], j[hit], k[hit]))
                x = y
        open_ = np.concatenate(more)


def _sparse(flat: np.ndarray, barred: np.ndarray, open_: np.ndarray, total: np.ndarray) -> None:
    """Adds the blocks of windows in whose right texts ``barred`` places begin none: few places are left, and these meet by character."""
    pair, a, n, b, m = open_.T
    spread = lambda begin, size: np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
    kinds = int(flat.max()) + 1
    left, right, of, to = spread(a, n), spread(b, m), np.repeat(np.arange(len(open_)), n), np.repeat(np.arange(len(open_)), m)
    free = ~barred[right]
    right, to = right[free], to[free]
    key = to * kinds + flat[right]
    order = np.argsort(key, kind="stable")
    key, right = key[order], right[order]
    asked = of * kinds + flat[left]
    lo, hi = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")
    i, window, j = np.repeat(left, hi - lo), np.repeat(of, hi - lo), right[spread(lo, hi - lo)]
    while len(open_):
        pair, a, n, b, m = open_.T
        # runs on a diagonal of a window
        order = np.lexsort((i, i - j, window))
        i, j, window = i[order], j[order], window[order]
        new = np.ones(len(i), bool)
        new[1:] = (window[1:] != window[:-1]) | (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + 1)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(i)))
        best = np.lexsort((j[first], i[first], -size, window[first]))
        best = best[np.concatenate([[True], window[first][best][1:] != window[first][best][:-1]])] if len(best) else best
        bi, bj, bk = np.zeros((3, len(open_)), np.int64)
        at = window[first[best]]
        bi[at], bj[at], bk[at] = i[first[best]], j[first[best]], size[best]
        bi, bj, bk = _extended(flat, a, b, n, m, bi, bj, bk)
        np.add.at(total, pair, bk)
        # each place goes on in the window before or behind the block, if it is in one
        mine, end = bi[window] + bk[window], bj[window] + bk[window]
        side = np.where((i < bi[window]) & (j < bj[window]), 0, np.where((i >= mine) & (j >= end), 1, 2))
        beside = _beside(open_, bi, bj, bk)
        alive = (np.concatenate([bk, bk]) > 0) & (beside[:, 2] > 0) & (beside[:, 4] > 0)
        number = np.cumsum(alive) - 1
        child = window + np.where(side == 1, len(open_), 0)
        stay = (side < 2) & alive[child]
        i, j, window = i[stay], j[stay], number[child[stay]]
        open_ = beside[alive]


def matched(left: list[str], right: list[str]) -> np.ndarray:
    """Characters in the matching blocks of each pair."""
    total = np.zeros(len(left), np.int64)
    if not len(left):
        return total
    flat, starts = codes([*left, *right])
    lefts, rights = starts[: len(left) + 1], starts[len(left) :]
    windows = np.stack([np.arange(len(left)), lefts[:-1], np.diff(lefts), rights[:-1], np.diff(rights)], axis=1)
    barred = frequent(flat, rights)
    some = np.concatenate([[0], np.cumsum(barred)])
    some = some[rights[1:]] > some[rights[:-1]]
    # where every character counts, a text that the other holds is one block
    held = np.array([not x and (b in a or a in b) for a, b, x in zip(left, right, some.tolist(), strict=True)], bool)
    total[held] = np.minimum(windows[held, 2], windows[held, 4])
    _dense(flat, windows[~some & ~held], total)
    rest = windows[some & (windows[:, 2] > 0)]
    # places that may meet: a character that isn't frequent stands at a hundredth of the right text's places at most
    meet = np.cumsum(rest[:, 2] * (rest[:, 4] // SHARE + 1))
    at = 0
    while at < len(rest):
        end = max(at + 1, int(np.searchsorted(meet, (meet[at - 1] if at else 0) + MEETING_PLACES, side="right")))
        _sparse(flat, barred, rest[at:end], total)
        at = end
    return total


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Twice the matched characters over all characters of each pair; 0 where one is empty."""
    sizes = np.array([len(a) + len(b) for a, b in zip(left, right, strict=True)], np.int64)
    some = np.array([bool(a) and bool(b) for a, b in zip(left, right, strict=True)], bool)
    out = np.zeros(len(left))
    if some.any():
        # equal pairs of texts are worked out once
        keys = {}
        place = [keys.setdefault(p, len(keys)) for p, s in zip(zip(left, right, strict=True), some, strict=True) if s]
        found = matched([a for a, _ in keys], [b for _, b in keys])
        out[some] = 2.0 * found[place] / sizes[some]
    return out


def at_least(left: list[str], right: list[str], least: float) -> np.ndarray:
    """Whether the ratio of each pair is ``least`` (over 0, 1 at most) or more; blocks aren't looked for where texts are equal or their lengths tell."""
    out = np.array([bool(a) and a == b for a, b in zip(left, right, strict=True)], bool)
    most = np.array([2.0 * min(len(a), len(b)) / max(1, len(a) + len(b)) for a, b in zip(left, right, strict=True)])
    asked = np.flatnonzero(~out & (most >= least))
    out[asked] = ratios([left[k] for k in asked], [right[k] for k in asked]) >= least
    return out


def scores(entries: list[str], segments: list[str]) -> np.ndarray:
    """How well segments' texts fit entries': the ratio, 0.96 at least where a segment holds the entry, 0.72 where the entry holds a segment of 4 characters."""
    floor = np.array([0.0 if not a or not b else 0.96 if a in b else 0.72 if len(b) >= 4 and b in a else 0.0 for a, b in zip(entries, segments, strict=True)])
    # no block is longer than the shorter text: where that can't lift a score over its floor, blocks aren't looked for
    most = np.array([2.0 * min(len(a), len(b)) / max(1, len(a) + len(b)) for a, b in zip(entries, segments, strict=True)])
    asked = np.flatnonzero(most > floor)
    out = floor.copy()
    out[asked] = np.maximum(floor[asked], ratios([entries[k] for k in asked], [segments[k] for k in asked]))
    return out
