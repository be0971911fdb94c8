"""Token ids by the tokenizers library, word by word with a bounded cache."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Id that ends a document.
END_ID = 1
#: Stems of either half of the cache.
CACHE_STEMS = 200_000
#: Text bytes that are encoded together.
RUN_BYTES = 3 << 20
#: Splits joined stems apart again; never part of a stem that is joined.
SENTINEL = "<|endoftext|>"
#: Closing marks, which are tokens of their own after letters.
MARKS = ".,!?;:#$%&*|"
#: Letters that compose with nothing before them and lower to one letter each.
LETTERS = "".join(chr(i) for i in [*range(65, 91), *range(97, 123), *range(192, 215), *range(216, 247), *range(248, 256)])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts, as the tokenizer gives them for the text at once.

    For a tokenizer that lowers case, drops white space and splits letters from marks, a
    text's ids are those of its words in a row, and those of a word of plain letters and
    closing marks are the ids of either part.  Arrow tells the parts apart; each stem is
    encoded once and kept.  The cache has two halves: when the young one is full it becomes
    the old one, and stems met again move back, which keeps frequent stems and bounds the
    memory.
    """

    def __init__(self, path: str, cache_stems: int = CACHE_STEMS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.sentinel_id = self.whole.token_to_id(SENTINEL)
        # the same merges for stems of lower-case letters, which need no rules before them; a stem's last id ends a word
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends_word = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        self.cache_stems = cache_stems
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn_plain(self, stems: list[bytes]) -> None:
        for i in range(0, len(stems), 2000):
            part = stems[i : i + 2000]
            ids = np.asarray(self.plain.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            cut = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            data = ids.tobytes()
            self.young.update(zip(part, [data[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)], strict=True))

    def _learn_whole(self, words: list[bytes]) -> None:
        safe = [w for w in words if b"<|" not in w] if self.sentinel_id is not None else []
        rest = [w for w in words if b"<|" in w] if safe else words
        if safe:
            ids = np.asarray(self.whole.encode_batch_fast(["".join(SENTINEL + w.decode() for w in safe)], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(ids == self.sentinel_id) * 4
            data = ids.tobytes()
            self.young.update(zip(safe, [data[a + 4 : b] for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(data)], strict=True)], strict=True))
        for w, x in zip(rest, self.whole.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False), strict=True):
            self.young[w] = np.asarray(x.ids, "<u4").tobytes()

    def _values(self, stems: list[bytes]) -> list[bytes]:
        """Ids of distinct stems."""
        if len(self.young) > self.cache_stems:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = set(stems).difference(young)
        if missing:
            again = missing.intersection(old)
            young.update(zip(again, map(old.__getitem__, again), strict=True))
            missing -= again
            plain = {s for s in missing if s.isalpha() or (not s.isascii() and not s.decode().strip(LETTERS))}
            self._learn_plain([s for s in plain if s == s.lower()])
            self._learn_whole(list(missing.difference(young)))
        return list(map(young.__getitem__, stems))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids (unsigned 32-bit) of each text of a string array without nulls."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        stems = pc.ascii_rtrim(words, characters=MARKS)
        lettered = pc.equal(pc.utf8_ltrim(stems, characters=LETTERS), "")
        stems = pc.if_else(lettered, pc.utf8_lower(stems), words).dictionary_encode()
        tails = pc.if_else(lettered, pc.utf8_ltrim(words, characters=LETTERS), "").dictionary_encode()
        values = self._values(_bytes(stems.dictionary))
        n_stems = len(values)
        values += self._values(_bytes(tails.dictionary))
        ids = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        starts = np.cumsum(sizes) - sizes
        # each word's stem, then its marks
        pieces = np.stack([stems.indices.to_numpy(), tails.indices.to_numpy() + np.int64(n_stems)], axis=1)
        at = pieces[coded.indices.to_numpy()].reshape(-1)
        size = sizes[at]
        ends = np.cumsum(size)
        out = ids[np.repeat(starts[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        n_words = np.cumsum(pc.list_value_length(split).to_numpy())
        bounds = np.concatenate([[0], ends])[2 * np.concatenate([[0], n_words])]
        return [out[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _bytes(strings: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each string of an array without nulls."""
    strings = pc.cast(strings, pa.large_string())
    _, offsets, data = strings.buffers()
    if not len(strings) or data is None:
        return [b""] * len(strings)
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1].tolist()
    raw = data.to_pybytes()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each path and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about RUN_BYTES."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > RUN_BYTES:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _long(enc: WordEncoder, text: bytes) -> np.ndarray:
    """Ids of one very long text, cut at white space."""
    parts, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > RUN_BYTES:
            gap = re.compile(rb"[\x09-\x0D\x20]").search(text, at + RUN_BYTES)
            end = gap.start() if gap else end
        parts.append(enc.encode(pa.array([text[at:end].decode()]))[0])
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def encoded(batches: Iterator[pa.RecordBatch], path: str, id_col: str, text_col: str) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids of rows, their token ids with END_ID as little-endian bytes) in runs of about RUN_BYTES of text."""
    enc, end = encoder(path), np.uint32(END_ID).tobytes()
    for batch in batches:
        texts = pc.fill_null(batch.column(text_col), "")
        sizes = pc.binary_length(texts).to_numpy()
        for a, b in _runs(sizes):
            if b - a == 1 and sizes[a] > RUN_BYTES:
                got = [_long(enc, texts[a].as_py().encode())]
            else:
                got = enc.encode(texts.slice(a, b - a))
            yield batch.column(id_col).slice(a, b - a), [x.tobytes() + end for x in got]


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
