"""Token files: frequency-ranked ids in byte-aligned variable-length code with control bytes apart.

A value takes 1 to 4 bytes; its two-bit length code goes to the control bytes, four to a
byte, and its bytes to the data.  Frequent ids get small ranks, hence one byte.  Decoding
looks the four lengths of each control byte up in a table.

File: b"LKTF", version, file number, then blocks.  Block: header (sizes and crc32 of what
follows), document ids, token counts, control bytes, data bytes.  Ids: null flags, then
64-bit numbers, or texts' lengths and UTF-8 bytes.  ``vocabulary.lkt`` holds the id of
each rank.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linekeeper.llm.store import materialize, new_folder, put_file, tidy
from linekeeper.llm.tokens import crc, default_path, encoded

#: Tokens of a file and of a block within it.
FILE_TOKENS = 16_000_000
BLOCK_TOKENS = 1_000_000

MAGIC, VERSION = b"LKTF", 2
FILE_HEAD = "<4sIQ"
BLOCK_HEAD = "<I?QQQQI"
#: The four lengths that a control byte holds.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
PLACES = np.arange(4, dtype=np.uint8)


def _width(top: int) -> int:
    """Bytes of the narrowest array type for values up to ``top``."""
    return 1 if top <= 0xFF else 2 if top <= 0xFFFF else 4


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    width = _width(int(values.max()) if len(values) else 0)
    values = np.ascontiguousarray(values, f"<u{width}")
    size = np.ones(len(values), np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF)[: width - 1]:
        size += values > limit
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, width)[size[:, None] > PLACES[:width]]
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of encode_values."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    top = int(size.max()) if n else 1
    width = top if top < 3 else 4
    out = np.zeros((n, width), np.uint8)
    out[size[:, None] > PLACES[:width]] = np.frombuffer(data, np.uint8)
    return out.view(f"<u{width}").reshape(-1)


def pack_ids(ids: list[int | str | None]) -> tuple[bool, bytes]:
    """Whether the ids are texts, and their bytes."""
    null = np.array([i is None for i in ids], np.uint8).tobytes()
    if not any(isinstance(i, str) for i in ids):
        return False, null + np.array([i or 0 for i in ids], "<i8").tobytes()
    raw = [(i or "").encode() for i in ids]
    return True, null + np.array([len(x) for x in raw], "<u4").tobytes() + b"".join(raw)


def unpack_ids(n: int, texts: bool, raw: bytes) -> list[int | str | None]:
    null = np.frombuffer(raw[:n], np.uint8).tolist()
    if not texts:
        values = np.frombuffer(raw[n:], "<i8").tolist()
    else:
        ends = (5 * n + np.cumsum(np.frombuffer(raw[n : 5 * n], "<u4").astype(np.int64))).tolist()
        values = [raw[a:b].decode() for a, b in zip([5 * n, *ends[:-1]], ends, strict=True)]
    return [None if z else i for z, i in zip(null, values, strict=True)]


def pack_block(ids: list[int | str | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode_values(ranks)
    texts, own = pack_ids(ids)
    body = b"".join([own, np.array(counts, "<u4").tobytes(), control, data])
    return struct.pack(BLOCK_HEAD, len(ids), texts, len(own), len(ranks), len(control), len(data), crc(body)) + body


def read_file(raw: bytes) -> Iterator[tuple[int, list[int | str | None], np.ndarray, np.ndarray]]:
    """(file number, document ids, token counts, ranks) of each block; a damaged file is an error."""
    magic, version, number = struct.unpack_from(FILE_HEAD, raw)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file of this version")
    at = struct.calcsize(FILE_HEAD)
    while at < len(raw):
        n, texts, n_ids, total, n_control, n_data, check = struct.unpack_from(BLOCK_HEAD, raw, at)
        at += struct.calcsize(BLOCK_HEAD)
        control = n_ids + 4 * n
        body = memoryview(raw)[at : at + control + n_control + n_data]
        if crc(body) != check:
            raise ValueError(f"block at byte {at} is damaged")
        counts = np.frombuffer(body[n_ids:control], "<u4")
        yield number, unpack_ids(n, texts, bytes(body[:n_ids])), counts, decode_values(body[control : control + n_control], body[control + n_control :], total)
        at += len(body)


def tokenize(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id (long, or as text), n_tokens, tokens (compressed ids, two bytes each) and a hash of these."""
    import zstandard

    kind = _id_kind(docs, id_col)
    arrow = pa.int64() if kind == "long" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for ids, tokens in encoded(batches, path, id_col, text_col):
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(arrow),
                    pa.array([len(x) // 4 for x in tokens], pa.int64()),
                    pa.array([squeeze.compress(np.frombuffer(x, "<u4").astype("<u2").tobytes()) for x in tokens], pa.binary()),
                ],
                ["doc_id", "n_tokens", "tokens"],
            )

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, tokens binary")


def _id_kind(docs: DataFrame, id_col: str) -> str:
    """Ids that are whole numbers are kept as such, all others as text."""
    return "long" if docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "string"


def _unpack(batch: pa.RecordBatch, squeeze) -> list[np.ndarray]:
    return [np.frombuffer(squeeze.decompress(x), "<u2") for x in batch.column("tokens").to_pylist()]


def vocabulary(tokens: DataFrame, size: int) -> np.ndarray:
    """Ids by falling frequency over all documents, ties by id; one row for each id reaches the driver."""
    import zstandard

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, total, held = zstandard.ZstdDecompressor(), np.zeros(size, np.int64), []
        for batch in batches:
            for x in _unpack(batch, squeeze):
                held.append(x)
            if held:
                total += np.bincount(np.concatenate(held), minlength=size)
                held.clear()
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = tokens.select("tokens").mapInArrow(tidy(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    total = np.zeros(size, np.int64)
    total[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return np.lexsort((np.arange(size), -total)).astype("<u4")


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> tuple[str, DataFrame]:
    """Write token files in ascending order of the ids; returns the folder and its list of files (file, docs, tokens)."""
    import zstandard
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = tokenizer or default_path()
    size = Tokenizer.from_file(path).get_vocab_size()
    if size > 1 << 16:
        raise ValueError("vocabularies over 65,536 ids need wider interim ids")
    folder = folder or new_folder(spark, "token-files")
    tokens = materialize(tokenize(docs, path, id_col, text_col), "tokens")
    id_of = vocabulary(tokens, size)
    put_file(folder, "vocabulary.lkt", id_of.tobytes())
    rank_of = np.empty(size, "<u4")
    rank_of[id_of] = np.arange(size, dtype="<u4")
    sent = spark.sparkContext.broadcast(rank_of)
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, ranks = zstandard.ZstdDecompressor(), sent.value
        number = TaskContext.get().partitionId()
        blocks, ids, counts, held, docs_n, tokens_n, block_n = [], [], [], [], 0, 0, 0

        def close() -> None:
            if ids:
                blocks.append(pack_block(ids, counts, ranks[np.concatenate(held)]))
                ids.clear(), counts.clear(), held.clear()

        for batch in batches:
            for i, x in zip(batch.column("doc_id").to_pylist(), _unpack(batch, squeeze), strict=True):
                ids.append(i)
                counts.append(len(x))
                held.append(x)
                docs_n, tokens_n, block_n = docs_n + 1, tokens_n + len(x), block_n + len(x)
                if block_n >= BLOCK_TOKENS:
                    close()
                    block_n = 0
        close()
        if docs_n:
            put_file(folder, f"part-{number:06d}.lkt", struct.pack(FILE_HEAD, MAGIC, VERSION, number) + b"".join(blocks))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (number, docs_n, tokens_n)], ["file", "docs", "tokens"])

    parts = max(1, -(-total // file_tokens))
    # the range is found from a sample of the keys that goes to the driver: a hash stands for the tokens there
    order = ("doc_id", "n_tokens", F.xxhash64("tokens"))
    ordered = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return folder, materialize(ordered.mapInArrow(tidy(write), "file long, docs long, tokens long"), "token-file-list")


def read_token_files(spark, folder: str, files: DataFrame, with_ids: bool = False, id_kind: str = "long") -> DataFrame:
    """doc_id (``id_kind``: long or string, as written), start, n_tokens, ids_crc32 (and ids) of each document in the files; start counts all ids before it."""
    id_of = np.frombuffer(bytes(spark.read.format("binaryFile").load(f"{folder}/vocabulary.lkt").first()["content"]), "<u4")
    sent = spark.sparkContext.broadcast(id_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                at = 0
                for number, ids, counts, ranks in read_file(batch.column("content")[i].as_py()):
                    data = ids_of[ranks].tobytes()
                    ends = np.cumsum(counts.astype(np.int64))
                    parts = [data[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                    cols = [
                        pa.array([number] * len(ids), pa.int64()),
                        pa.array(ids, pa.int64() if id_kind == "long" else pa.string()),
                        pa.array(at + ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([crc(x) for x in parts], pa.int64()),
                    ]
                    names = ["file", "doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        cols, names = [*cols, pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in parts], pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(cols, names)
                    at += int(ends[-1])

    kind = f"file long, doc_id {id_kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.lkt").load(folder).select("content").mapInArrow(tidy(run), kind)
    # the list has a row for each file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    joined = rows.join(base, "file")  # a file's documents are many, its base is one row
    return joined.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    """Null text: the end id alone; null ids come first; equal ids in the order of their numbers of tokens, then of a hash; repeated rows each; an empty table gives no files and no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kind = _id_kind(docs, "doc_id")
    folder, files = write_token_files(docs)
    if files.isEmpty():
        return spark.createDataFrame([], f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder, files, id_kind=kind)
