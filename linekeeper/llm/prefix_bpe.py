"""Byte-level BPE by prefixes: for every byte prefix of a piece, the last token of its encoding.

A text falls into pieces by a pattern, and each piece is encoded on its own.  A prefix has
one encoding, so it has one last token: of the tokens that end at a byte, the one that
stands after the last token of the prefix before it (both together encode to just these
two).  The table of last tokens is filled from left to right and read from right to left.

The table of a longer piece begins with that of its beginning, so that text is appended
without encoding anything anew.  Behind an edit the table is filled only until it has
agreed with the old one over the length of the longest token; from there on it is the old.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linekeeper.llm.store import tidy
from linekeeper.llm.tokens import LETTERS
from linekeeper.llm.words import runs

#: Entries of either half of a cache.
CACHE = 400_000
#: Pairs of tokens that are remembered as standing together or not.
PAIRS = 1 << 20
#: Between pieces that are searched together; no byte of a piece.
GAP = "Ā"
#: Characters before an edit of which a piece's end may depend on it: the pattern looks at three in its contractions.
LOOK = 3
#: Marks that end a word of letters: one piece after that of the letters.
MARKS = ".,;:!?"
#: A space that white space follows belongs to a longer run.
IRREGULAR = "[ ][\\s\\x0b\\x85\\p{Z}]"
NO_RANK = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Kept:
    """Bounded cache of two halves: when the young one is full it becomes the old one; what is met again moves back."""

    def __init__(self, most: int = CACHE) -> None:
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: Iterable) -> list:
        """Those of ``keys`` that are unknown; all others are in ``young`` afterwards."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        unknown = set(keys).difference(self.young)
        again = unknown.intersection(self.old)
        self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
        return list(unknown - again)


class PrefixCoder:
    """Ids of pieces, of texts, and bytes of ids, by ranks of byte sequences (each single byte has one)."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE) -> None:
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.size = [len(x) for x in self.bytes_of]
        self.longest = max(self.size)
        self.split = regex.compile(pattern).findall
        # whether letters, and marks behind them, are a piece each under this pattern
        self.lettered = all(self.split(x) == [x[:-4], ".,;:"] for x in ("aZé.,;:", " aZé.,;:")) and self.split("a b\n c") == ["a", " b", "\n", " c"]
        self.ends = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.ends.add_word(token.decode("latin-1"), rank)
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.pieces, self.parts = Kept(cache), Kept(cache // 4)

    # -- pieces ----------------------------------------------------------------

    def merged(self, data: bytes) -> list[int]:
        """Ids by the definition: the pair of lowest rank is merged, the leftmost of equals, until none is left."""
        rank_of, none = self.ranks.get, NO_RANK
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank_of(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) != none:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] + parts[i + 1], none)
        return [self.ranks[x] for x in parts]

    def stand(self, a: int, b: int) -> bool:
        """Whether the bytes of ``a`` and ``b`` in a row encode to just these two."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            both = self.bytes_of[a] + self.bytes_of[b]
            known = self.pairs[key] = both not in self.ranks and self.merged(both) == [a, b]
        return known

    def tables(self, pieces: list[bytes]) -> tuple[list[int], list[int]]:
        """(last tokens by byte, all pieces in a row with a place before each; where each piece's bytes begin)."""
        joined = GAP + GAP.join(x.decode("latin-1") for x in pieces)
        starts, at = [], 1
        last = [-1] * (len(joined) + 1)
        for x in pieces:
            starts.append(at)
            last[at - 1] = -2
            at += len(x) + 1
        size, pairs, stand = self.size, self.pairs, self.stand
        for end, token in self.ends.iter(joined):
            if last[end] == -1:
                before = last[end - size[token]]
                if before == -2:
                    last[end] = token
                elif before >= 0:
                    known = pairs.get(before << 32 | token)
                    if known or (known is None and stand(before, token)):
                        last[end] = token
        return last, starts

    def walk(self, last, end: int, start: int = 0) -> list[int]:
        """Ids of the bytes from ``start`` to ``end`` (both included) of a table, from its right end."""
        out = []
        while end >= start:
            token = int(last[end])
            out.append(token)
            end -= self.size[token]
        return out[::-1]

    def ids_of_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian ids of each piece."""
        last, starts = self.tables(pieces)
        return [np.array(self.walk(last, s + len(x) - 1, s), "<u4").tobytes() for x, s in zip(pieces, starts, strict=True)]

    def spliced(self, old: bytes, last: np.ndarray, start: int, end: int, new: bytes) -> np.ndarray:
        """Table of ``old`` with its bytes from ``start`` to ``end`` replaced by ``new``; an empty range at the end appends."""
        data = old[:start] + new + old[end:]
        shift = len(new) - (end - start)
        out = np.full(len(data), -1, np.int64)
        out[:start] = last[:start]
        begin, same, size = max(0, start - self.longest + 1), 0, self.size
        settled = start  # bytes whose last token is known
        for at, token in self.ends.iter(data[begin:].decode("latin-1")):
            at += begin
            if at < start or out[at] >= 0:
                continue
            first = at - size[token]
            if first == -1 or self.stand(int(out[first]), token):
                out[at] = token
                settled = at + 1
                same = same + 1 if at >= start + len(new) and last[at - shift] == token else 0
                if same == self.longest:
                    out[settled:] = last[settled - shift :]
                    break
        return out

    # -- texts -----------------------------------------------------------------

    def _learn_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of these pieces, among others."""
        fresh = self.pieces.missing(pieces)
        for a in range(0, len(fresh), 20_000):
            part = fresh[a : a + 20_000]
            self.pieces.young.update(zip(part, self.ids_of_pieces([p.encode() for p in part]), strict=True))
        return self.pieces.young

    def _spelled(self, parts: list[str]) -> list[bytes]:
        """Ids of parts of texts that begin and end at cuts, each split by the pattern."""
        fresh = self.parts.missing(parts)
        if fresh:
            cut = [self.split(x) for x in fresh]
            known = self._learn_pieces(p for x in cut for p in x)
            self.parts.young.update(zip(fresh, [b"".join([known[p] for p in x]) for x in cut], strict=True))
        return list(map(self.parts.young.__getitem__, parts))

    def _whole(self, text: str) -> bytes:
        pieces = self.split(text)
        return b"".join(map(self._learn_pieces(pieces).__getitem__, pieces))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text of a string array without nulls.

        A space that no white space follows begins a piece, so that texts fall apart at
        such spaces into words, with their space or, the first, without.  Arrow tells the
        distinct words, and of those of letters the marks behind them, apart; what was met
        before is not split or encoded again.
        """
        odd = pc.match_substring_regex(texts, IRREGULAR)
        if pc.any(odd).as_py():
            plain = iter(self.encode(texts.filter(pc.invert(odd))))
            return [self._whole(t.as_py()) if x.as_py() else next(plain) for t, x in zip(texts, odd, strict=True)]
        split = pc.split_pattern(texts, " ")
        n_words = pc.list_value_length(split).to_numpy()
        begins = np.cumsum(n_words) - n_words
        flat = split.flatten()
        firsts = flat.take(pa.array(begins))
        coded = flat.dictionary_encode()
        words = coded.dictionary
        stems = pc.ascii_rtrim(words, characters=MARKS)
        lettered = pc.and_(pc.equal(pc.utf8_ltrim(stems, characters=LETTERS), ""), pc.not_equal(stems, "")) if self.lettered else pa.array(np.zeros(len(words), bool))
        tails = pc.if_else(lettered, pc.utf8_ltrim(words, characters=LETTERS), "").dictionary_encode()
        stems = pc.if_else(lettered, stems, "").dictionary_encode()
        rest = words.filter(pc.invert(lettered)).to_pylist()
        stem_list, tail_list = [" " + x if x else "" for x in stems.dictionary.to_pylist()], tails.dictionary.to_pylist()
        known = self._learn_pieces([x for x in stem_list if x] + [x for x in tail_list if x])
        values = [known[x] if x else b"" for x in stem_list] + [known[x] if x else b"" for x in tail_list]
        values += self._spelled([" " + x for x in rest]) + self._spelled(firsts.to_pylist())
        ids = np.frombuffer(b"".join(values), "<u4")
        sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
        starts = np.cumsum(sizes) - sizes
        # of each distinct word: where its stem's ids are, or those of the whole, then those of its tail
        head = stems.indices.to_numpy().astype(np.int64)
        other = ~lettered.to_numpy(zero_copy_only=False)
        head[other] = len(stem_list) + len(tail_list) + np.arange(len(rest))
        pieces = np.stack([head, tails.indices.to_numpy() + np.int64(len(stem_list))], axis=1)
        at = pieces[coded.indices.to_numpy()]
        no_more = len(stem_list) + (tail_list.index("") if "" in tail_list else len(tail_list) + len(rest) + len(firsts))
        at[begins, 0] = len(values) - len(firsts) + np.arange(len(firsts))
        at[begins, 1] = no_more
        sizes, starts = np.append(sizes, 0), np.append(starts, 0)
        at = at.reshape(-1)
        size = sizes[at]
        ends = np.cumsum(size)
        out = ids[np.repeat(starts[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[2 * np.concatenate([begins, [len(flat)]])]
        return [out[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class PrefixTable:
    """A text, the ends of its pieces (code points) and the last token of the prefix at each of its bytes."""

    def __init__(self, coder: PrefixCoder, text: str = "", ends: np.ndarray | None = None, last: np.ndarray | None = None) -> None:
        self.coder, self.text = coder, ""
        self.ends, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if ends is not None and last is not None:
            self.text, self.ends, self.last = text, ends, last
        elif text:
            self.edit(0, 0, text)

    def _bytes_before(self, text: str, place: int) -> int:
        return len(text[:place].encode())

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the code points from ``start`` to ``end`` (exclusive)."""
        old, coder = self.text, self.coder
        text, shift = old[:start] + new + old[end:], len(new) - (end - start)
        # pieces that end well before the edit stay; behind it the old ones hold from the first common cut on
        kept = int(np.searchsorted(self.ends, start - LOOK, side="right"))
        at = int(self.ends[kept - 1]) if kept else 0
        cuts = set((self.ends[np.searchsorted(self.ends, end) :] + shift).tolist()) | {len(text)}
        fresh, place = [], at
        window = max(256, 2 * (start + len(new) - at))
        while place < len(text) and not (place >= start + len(new) and place in cuts):
            upto = min(len(text), place + window)
            pieces = coder.split(text[place:upto])
            if upto < len(text):  # the last pieces may depend on what follows
                while pieces and place + sum(map(len, pieces)) > upto - LOOK:
                    pieces.pop()
                window *= 2
            for p in pieces:
                fresh.append(p)
                place += len(p)
                if place >= start + len(new) and place in cuts:
                    break
        tail = int(np.searchsorted(self.ends, place - shift, side="right"))
        b_at, b_place = self._bytes_before(old, at), self._bytes_before(old, place - shift)
        part = self._filled(fresh, old[at : place - shift], kept, tail, start - at, end - at, new)
        ends = at + np.cumsum([len(p) for p in fresh], dtype=np.int64) if fresh else np.zeros(0, np.int64)
        self.last = np.concatenate([self.last[:b_at], part, self.last[b_place:]])
        self.ends = np.concatenate([self.ends[:kept], ends, self.ends[tail:] + shift])
        self.text = text

    def _filled(self, fresh: list[str], was: str, kept: int, tail: int, start: int, end: int, new: str) -> np.ndarray:
        """Table of the pieces ``fresh`` that stand in the place of ``was``; one long piece that stays one takes over its old table."""
        data = [p.encode() for p in fresh]
        if len(fresh) == 1 and tail - kept == 1 and 0 <= start:
            before = len(was[:start].encode())
            own = self.last[len(self.text[: int(self.ends[kept - 1]) if kept else 0].encode()) :][: len(was.encode())]
            return self.coder.spliced(was.encode(), own, before, len(was[:end].encode()), new.encode())
        last, starts = self.coder.tables(data)
        return np.concatenate([np.array(last[s : s + len(d)], np.int64) for d, s in zip(data, starts, strict=True)]) if data else np.zeros(0, np.int64)

    def ids(self) -> bytes:
        """Little-endian ids of the whole text, read off the table."""
        out, at, begin = [], 0, 0
        for end in self.ends.tolist():
            n = len(self.text[begin:end].encode())
            out += self.coder.walk(self.last, at + n - 1, at)
            at, begin = at + n, end
        return np.array(out, "<u4").tobytes()


_CODERS: dict[tuple[str, str], PrefixCoder] = {}


def coder(path: str, pattern: str) -> PrefixCoder:
    """One coder for each vocabulary and Python worker."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = PrefixCoder(path, pattern)
    return _CODERS[path, pattern]


def _struct(docs: DataFrame, *fields: T.StructField) -> T.StructType:
    names = {f.name for f in fields}
    return T.StructType([f for f in docs.schema.fields if f.name not in names] + list(fields))


def _with(batch: pa.RecordBatch, a: int, b: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """Rows ``a`` to ``b`` of a batch with ``columns`` in place of those of their names, at the end."""
    part = batch.slice(a, b - a)
    own = [n for n in part.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([part.column(n) for n in own] + list(columns.values()), names=own + list(columns))


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text", tables: bool = False) -> DataFrame:
    """Every row with n_tokens (long) and ids (binary, little-endian unsigned 32-bit).

    With ``tables`` also ``ends`` (binary, 64-bit: code points before the end of each piece)
    and ``last`` (binary, 64-bit: the last token at each byte), from which ``edit_documents``
    goes on.  Null and empty texts have no ids; texts of any length are encoded whole, a
    batch of rows holding some 2 MB of them or one; repeated rows and ids are encoded each
    for itself; an empty table gives no rows; columns of the input that have names of
    results give way.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if tables:
        fields += [T.StructField("ends", T.BinaryType()), T.StructField("last", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for a, b in runs(batch.column(text_col)):
                texts = pc.fill_null(batch.column(text_col).slice(a, b - a), "")
                if tables:
                    held = [PrefixTable(own, t) for t in texts.to_pylist()]
                    ids = [x.ids() for x in held]
                else:
                    ids = own.encode(texts)
                columns = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())}
                if tables:
                    columns |= {"ends": pa.array([x.ends.tobytes() for x in held], pa.binary()), "last": pa.array([x.last.tobytes() for x in held], pa.binary())}
                yield _with(batch, a, b, columns)

    return docs.mapInArrow(tidy(run), _struct(docs, *fields))


def decode_documents(rows: DataFrame, path: str | None = None, pattern: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Every row with ``out``: the bytes of its ids (binary).

    Null ids give null, no ids give no bytes; an id that the vocabulary lacks is an error;
    other columns stay, but one named as ``out`` gives way.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for a, b in runs(batch.column(ids_col)):
                ids = batch.column(ids_col).slice(a, b - a).to_pylist()
                yield _with(batch, a, b, {out: pa.array([None if x is None else own.decode(x) for x in ids], pa.binary())})

    return rows.mapInArrow(tidy(run), _struct(rows, T.StructField(out, T.BinaryType())))


def edit_documents(rows: DataFrame, edits: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``encode_documents(..., tables=True)`` after ``edits``: text, n_tokens, ids, ends and last are those of the new text.

    ``edits``: ``id_col``, seq, start, end (code points, end exclusive; both beyond the text:
    append) and new.  A document's edits are made in the order of (seq, start, end, new), each on the text that
    the one before left; null bounds append, a null ``new`` is empty.  Documents without
    edits come back as they are; edits of unknown or null ids change nothing; rows that
    share an id all get its edits; a document's edits are held together with it.
    """
    path, pattern = path or default_path(), pattern or default_pattern()
    made = F.sort_array(F.collect_list(F.struct("seq", "start", "end", "new")))
    mine = edits.select(F.col(id_col).alias("doc_of_edit"), "seq", F.col("start").cast("long"), F.col("end").cast("long"), "new").groupBy("doc_of_edit").agg(made.alias("edits_of_doc"))
    held = F.struct(*[F.col(c) for c in rows.columns]).alias("row_of_doc")
    joined = rows.select(held, F.col(id_col).alias("key_of_doc")).join(mine, F.col("key_of_doc") == F.col("doc_of_edit"), "left").select("row_of_doc", "edits_of_doc")
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            part = dict(zip(names, batch.column("row_of_doc").flatten(), strict=True))
            got = {c: part[c].to_pylist() for c in (text_col, "n_tokens", "ids", "ends", "last")}
            for i, made in enumerate(batch.column("edits_of_doc").to_pylist()):
                if not made:
                    continue
                table = PrefixTable(own, got[text_col][i] or "", np.frombuffer(got["ends"][i], np.int64), np.frombuffer(got["last"][i], np.int64))
                for e in made:
                    n = len(table.text)
                    start = n if e["start"] is None else max(0, min(n, e["start"]))
                    table.edit(start, max(start, n if e["end"] is None else min(n, e["end"])), e["new"] or "")
                ids = table.ids()
                for c, v in ((text_col, table.text), ("n_tokens", len(ids) // 4), ("ids", ids), ("ends", table.ends.tobytes()), ("last", table.last.tobytes())):
                    got[c][i] = v
            yield pa.RecordBatch.from_arrays([pa.array(got[c], part[c].type) if c in got else part[c] for c in names], names=names)

    return joined.mapInArrow(tidy(run), rows.schema)


def sha(column: str) -> Column:
    return F.sha2(F.col(column), 256).alias(f"{column}_sha256")


def op11_prefix_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = encode_documents(docs).select("doc_id", "n_tokens", "ids")
    return decode_documents(encoded).select("doc_id", "n_tokens", sha("ids"), sha("decoded"))
