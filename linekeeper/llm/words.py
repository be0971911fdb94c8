"""Hashes of words and of windows of words, over runs of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes that are split together.
RUN_BYTES = 2 << 20

_ODD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about RUN_BYTES of text."""
    start, total = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if total and total + n > RUN_BYTES:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words (runs of other than ASCII white space) of all texts in a row, and where each text's begin and the last ends."""
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = split.flatten()
    full = pc.not_equal(flat, "")
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
    if pc.all(full).as_py() is not False:
        return flat, ends
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), kept[ends]


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hash of each word; every distinct one is hashed once."""
    coded = words.dictionary_encode()
    distinct = pc.cast(coded.dictionary, pa.large_binary())
    if not len(distinct):
        return np.zeros(0, np.uint64)
    at = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1].tolist()
    raw = distinct.buffers()[2].to_pybytes() if distinct.buffers()[2] is not None else b""
    digest = xxhash.xxh3_64_intdigest
    hashes = np.array([digest(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
    return hashes[coded.indices.to_numpy()]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` values in a row; the value at i is of the window that begins there."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= _ODD
        out += hashes[j : j + n]
    return mix(out)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted set of a text's shingles; with fewer words the whole sequence is one, without words none."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    if len(hashes) < size:
        return windows(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(windows(hashes, size))


def hashed_texts(batch: pa.RecordBatch, text_col: str, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the batch, its words' hashes)."""
    texts = batch.column(text_col)
    for a, b in runs(texts):
        words, ends = split_words(texts.slice(a, b - a), lower)
        hashes = hash_words(words)
        for i in range(b - a):
            yield a + i, hashes[ends[i] : ends[i + 1]]
