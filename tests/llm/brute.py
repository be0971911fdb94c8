"""Plain re-statements of what the operators compute, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(UPPER) if lower else text)


def shingle_set(text, size):
    w = words(text, True)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(docs, size, percent):
    """{row: (n, component)} of (id, text) rows; all pairs."""
    sets = [shingle_set(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(docs):
        ids.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)]


def repeats(docs, window=20):
    """(id, words, removed, sha of what is kept) of rows with distinct ids."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if x in seen:
                gone[i : i + window] = [True] * window
            seen.add(x)
        kept = " ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out[d] = (d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def base_rules(text):
    text = text or ""
    w = words(text)
    three = list(zip(w, w[1:], w[2:], strict=False))
    often = Counter(three)
    covered = {j for i, k in enumerate(three) if often[k] > 1 for j in (i, i + 1, i + 2)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered), n < 50 or 100 * len(covered) > 50 * n


ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_secrets(text):
    text, out = text or "", []
    out += [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    return [sum(x[1] == k for x in out) for k in range(3)], hashlib.sha256(",".join(x[2] for x in out).encode()).hexdigest()


def token_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def shard_of(key, tree):
    """Where the draws of a tree {region: {rack: {shard: weight}}} lead a key."""

    def weight(node):
        return sum(weight(x) for x in node.values()) if isinstance(node, dict) else node

    def wins(at, node):
        def arrival(name):
            u = int(hashlib.md5(f"{key}|{at}|{name}".encode()).hexdigest()[:13], 16)
            return -math.log((u + 0.5) / 2**52) / weight(node[name])

        return min(node, key=arrival)

    region = wins("root", tree)
    rack = wins(region, tree[region])
    return wins(f"{region}.{rack}", tree[region][rack])


def attention_score(model, text):
    """The score of one text: a passage of 64 words at a time, each sum written out."""
    from linekeeper.llm.quality_model import word_bucket, word_features

    w = [x.encode() for x in words(text)]
    raw, hidden = [], []
    for passage in [w[i : i + 64] for i in range(0, len(w), 64)] or [[]]:
        n = max(1, len(passage))
        x = [sum(v) / n for v in zip(*map(word_features, passage), strict=True)] or [0.0] * 17
        x += [sum(a == b for a, b in zip(passage, passage[1:], strict=False)) / n, len(set(passage)) / n, len(passage) / 64]
        x = [(v - m) / s for v, m, s in zip(x, model.mean, model.scale, strict=True)]
        m = model.weights
        h = []
        for j in range(len(m["e"])):
            h.append(math.tanh(m["e"][j] + sum(v * m["E"][i][j] for i, v in enumerate(x)) + sum(m["W"][word_bucket(p)][j] for p in passage) / n))
        gate = 0.0
        for g in range(len(m["w"])):
            gate += m["w"][g] * math.tanh(sum(h[j] * m["V"][j][g] for j in range(len(h)))) / (1 + math.exp(-sum(h[j] * m["U"][j][g] for j in range(len(h)))))
        raw.append(gate)
        hidden.append(h)
    top = max(raw)
    weight = [math.exp(r - top) for r in raw]
    z = [sum(a * h[j] for a, h in zip(weight, hidden, strict=True)) / sum(weight) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-(model.weights["b"][0] + sum(c * v for c, v in zip(model.weights["c"], z, strict=True)))))


def murmur3(data, seed):
    """The 32-bit hash of bytes or a 32-bit integer, as a signed integer; bytes beyond whole words are mixed one by one."""
    mask = 0xFFFFFFFF

    def rot(x, r):
        return (x << r | x >> (32 - r)) & mask

    def mix(h, k):
        k = rot(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
        return (rot(h ^ k, 13) * 5 + 0xE6546B64) & mask

    h = seed & mask
    if isinstance(data, int):
        h, n = mix(h, data & mask), 4
    else:
        n = len(data)
        for i in range(0, n - n % 4, 4):
            h = mix(h, int.from_bytes(data[i : i + 4], "little"))
        for b in data[n - n % 4 :]:
            h = mix(h, (b - 256 if b > 127 else b) & mask)
    h ^= n
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def likelihood_ratios(texts, target, cells, spread):
    """(mean log ratio of each text, threshold): hashed tokens and pairs of them, 1 added to each count."""
    import regex

    def grams(text):
        h = [murmur3(t.encode(), 42) for t in regex.findall(r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+", text or "")]
        return [x % cells for x in h] + [murmur3(b, murmur3(a, 42)) % cells for a, b in zip(h, h[1:], strict=False)]

    held = [grams(t) for t in texts]
    raw, good = Counter(c for g in held for c in g), Counter(c for t in target for c in grams(t))
    raw_n, good_n = sum(raw.values()) + cells, sum(good.values()) + cells
    ratio = [math.log((good[c] + 1) / good_n) - math.log((raw[c] + 1) / raw_n) for c in range(cells)]
    mean = sum(n * ratio[c] for c, n in good.items()) / sum(good.values())
    square = sum(n * ratio[c] ** 2 for c, n in good.items()) / sum(good.values())
    return [sum(ratio[c] for c in g) / len(g) if g else 0.0 for g in held], mean - spread * math.sqrt(square - mean * mean)
