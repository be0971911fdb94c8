"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded from its words: each word has a
learned embedding (by a hash of its lower-case form) and features of its writing, and the
passage how often words repeat.  A gated attention learned from document labels alone
weighs the passages, and a logistic output scores the weighted representation.  Labels,
language, source and id are never inputs of a score.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linekeeper.llm.store import tidy
from linekeeper.llm.words import runs, split_words

#: Words of a passage.
PASSAGE = 64
#: Labelled documents that the model is fitted on, at most: those with the smallest hashes of their ids.
FIT_DOCUMENTS = 4000
#: Embeddings of words, by hash.
BUCKETS = 512
HIDDEN, GATE, BATCH, EPOCHS, STEPS, RATE, DECAY, SEED = 12, 8, 256, 12, 250, 0.03, 1e-3, 7
#: Score from which a document is predicted to be good.
CUT = 0.3

SHAPES = 8
WORD_FEATURES = 9 + SHAPES
FEATURES = WORD_FEATURES + 3
#: Words whose features are kept.
KEPT_WORDS = 200_000


def word_features(word: bytes) -> list[float]:
    """What a word looks like, from its characters' classes."""
    text = word.decode("utf-8", "replace")
    n = len(text)
    upper = sum(c.isupper() for c in text)
    letters = sum(c.isalpha() for c in text)
    digits = sum(c.isdigit() for c in text)
    marks = sum(c in "#*$%&|<>" for c in text)
    doubled = any(a == b and not a.isalnum() for a, b in zip(text, text[1:], strict=False))
    shape, last = 0, ""
    for c in text:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else "." if c in ".,;:" else "-"
        if kind != last:
            shape = shape * 5 + "Aa0.-".index(kind) + 1
            last = kind
    out = [min(n, 30) / 10, upper / n, float(upper == letters > 1), marks / n, float(doubled), float(letters + digits == 0), digits / n, float(text[-1] in ".!?"), float(n == 1)]
    return out + [float(shape % SHAPES == k) for k in range(SHAPES)]


def word_bucket(word: bytes) -> int:
    return zlib.crc32(word.decode("utf-8", "replace").lower().encode()) % BUCKETS


class WordTable:
    """Features and buckets of words; those of frequent words are remembered."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.features = np.zeros((1024, WORD_FEATURES), np.float32)
        self.buckets = np.zeros(1024, np.int32)
        self.projected: dict[str, np.ndarray] = {}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The rows of distinct words."""
        number = self.number
        if len(number) > KEPT_WORDS:
            number.clear()
            self.projected.clear()
        new = [w for w in words if w not in number]
        if new:
            at = len(number)
            if at + len(new) > len(self.features):
                room = 2 * (at + len(new))
                self.features = np.concatenate([self.features[:at], np.zeros((room - at, WORD_FEATURES), np.float32)])
                self.buckets = np.concatenate([self.buckets[:at], np.zeros(room - at, np.int32)])
            self.features[at : at + len(new)] = [word_features(w) for w in new]
            self.buckets[at : at + len(new)] = [word_bucket(w) for w in new]
            number.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def project(self, key: str, shapes: np.ndarray, embedding: np.ndarray) -> np.ndarray:
        """features @ shapes + embedding[bucket] of every word, made once for each model ``key``."""
        n, own = len(self.number), self.projected.get(key)
        done = 0 if own is None else len(own)
        if done < n:
            more = self.features[done:n] @ shapes + embedding[self.buckets[done:n]]
            self.projected = {key: more if own is None else np.concatenate([own, more])}
        return self.projected[key] if n else np.zeros((0, embedding.shape[1]), np.float32)


_TABLE: list[WordTable] = []


def word_table() -> WordTable:
    """One for each Python worker."""
    if not _TABLE:
        _TABLE.append(WordTable())
    return _TABLE[0]


@dataclass
class Passages:
    """The passages of some texts in a row: word rows, where passages and texts begin; a text without words has one passage without any."""

    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    per_text: np.ndarray

    @classmethod
    def of(cls, table: WordTable, texts: pa.Array) -> Passages:
        flat, ends = split_words(texts)
        coded = flat.dictionary_encode()
        rows = table.numbers([w.encode() for w in coded.dictionary.to_pylist()])
        n = np.diff(ends)
        per_text = np.maximum(1, -(-n // PASSAGE))
        text = np.repeat(np.arange(len(n)), per_text)
        within = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        starts = ends[:-1][text] + PASSAGE * within
        return cls(rows[coded.indices.to_numpy()], starts, np.minimum(PASSAGE, ends[1:][text] - starts), per_text)

    def mean(self, values: np.ndarray) -> np.ndarray:
        """Mean of ``values`` (a row for each word) over each passage; zeros without words."""
        out = np.zeros((len(self.starts), values.shape[1]), np.float32)
        full = self.sizes > 0
        if full.any():
            out[full] = np.add.reduceat(values, self.starts[full], axis=0) / self.sizes[full, None]
        return out

    def habits(self) -> np.ndarray:
        """(passages, 3): shares of words equal to the one before and of distinct words, and the passage's length."""
        w = self.words
        own = np.repeat(np.arange(len(self.starts)), self.sizes)
        same = np.zeros((len(w), 1), np.float32)
        same[1:, 0] = (w[1:] == w[:-1]) & (own[1:] == own[:-1])
        keys = np.sort(own * (int(w.max(initial=0)) + 1) + w)
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)].astype(np.float32)
        return np.hstack([self.mean(same), self.mean(new[:, None]), self.sizes[:, None] / np.float32(PASSAGE)]).astype(np.float32)


@dataclass
class Bag:
    """A document's passages for fitting: features of each, and the buckets of its words in a row."""

    features: np.ndarray
    sizes: np.ndarray
    buckets: np.ndarray

    def __len__(self) -> int:
        return len(self.features)


def make_bags(table: WordTable, texts: pa.Array) -> list[Bag]:
    p = Passages.of(table, texts)
    x = np.hstack([p.mean(table.features[p.words]), p.habits()])
    last = np.cumsum(p.per_text)
    words = np.concatenate([[0], np.cumsum(p.sizes)])
    buckets = table.buckets[p.words].astype(np.int16)
    return [Bag(x[a:b], p.sizes[a:b], buckets[words[a] : words[b]]) for a, b in zip((last - p.per_text).tolist(), last.tolist(), strict=True)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def word_shares(sizes: np.ndarray, buckets: np.ndarray, width: int) -> np.ndarray:
    """(passages, width): the share of each bucket among a passage's words."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(own * width + buckets, minlength=len(sizes) * width).reshape(len(sizes), width)
    return counts / np.maximum(sizes, 1)[:, None]


@dataclass
class GatedAttention:
    """h = tanh(Ex + Ws + e);  a = softmax over the bag of w . (tanh(Vh) * sigmoid(Uh));  p = sigmoid(c . sum(a h) + b).

    x: a passage's standardised features; s: the shares of word buckets in it, so that Ws is
    the mean of its words' embeddings, the rows of W.
    """

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def fit(cls, bags: list[Bag], labels: list[int]) -> GatedAttention:
        """Adam on the cross-entropy in batches of BATCH documents; the same bags in the same order give the same model."""
        every = np.concatenate([b.features for b in bags]).astype(np.float64)
        mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        del every
        y = np.asarray(labels, np.float64)
        rng = np.random.default_rng(SEED)
        width = len(mean)
        shapes = {"E": (width, HIDDEN), "W": (BUCKETS, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "b": (1,)}
        weights = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k.isupper() or k in "wc" else np.zeros(s) for k, s in shapes.items()}
        model = cls(mean, scale, weights)
        first = {k: np.zeros_like(v) for k, v in weights.items()}
        second = {k: np.zeros_like(v) for k, v in weights.items()}
        per_epoch = -(-len(bags) // BATCH)
        step = 0
        for _ in range(max(EPOCHS, -(-STEPS // per_epoch))):
            order = rng.permutation(len(bags))
            for i in range(0, len(bags), BATCH):
                own = np.sort(order[i : i + BATCH])
                x, starts, sizes = model.inputs([bags[k] for k in own])
                step += 1
                for k, g in model._gradients(x, starts, sizes, y[own]).items():
                    g = g + DECAY * weights[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    weights[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return model

    def inputs(self, bags: list[Bag]) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """((features, shares of buckets), where bags begin, their sizes)."""
        x = (np.concatenate([b.features for b in bags]) - self.mean) / self.scale
        sizes = np.array([len(b) for b in bags])
        shares = word_shares(np.concatenate([b.sizes for b in bags]), np.concatenate([b.buckets for b in bags]).astype(np.int64), len(self.weights["W"]))
        return (x, shares), np.cumsum(sizes) - sizes, sizes

    def _attend(self, before: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        m = self.weights
        h = np.tanh(before)
        t, s = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
        raw = (t * s) @ m["w"]
        a = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ m["c"] + m["b"])}

    def _forward(self, x: tuple[np.ndarray, np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        m = self.weights
        return self._attend(x[0] @ m["E"] + x[1] @ m["W"] + m["e"], starts, sizes)

    def _gradients(self, x: tuple[np.ndarray, np.ndarray], starts: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        m, f = self.weights, self._forward(x, starts, sizes)
        h, t, s, a = f["h"], f["t"], f["s"], f["a"]
        out = (f["p"] - y) / len(y)
        dz = np.repeat(out[:, None] * m["c"], sizes, axis=0)
        da = (dz * h).sum(axis=1)
        draw = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt = draw[:, None] * m["w"] * s * (1 - t * t)
        ds = draw[:, None] * m["w"] * t * s * (1 - s)
        dh = a[:, None] * dz + dt @ m["V"].T + ds @ m["U"].T
        dpre = dh * (1 - h * h)
        return {"E": x[0].T @ dpre, "W": x[1].T @ dpre, "e": dpre.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ draw, "c": f["z"].T @ out, "b": np.array([out.sum()])}

    def score(self, table: WordTable, texts: pa.Array) -> np.ndarray:
        """The scores of texts: every word's part of the encoding is made once, and summed by passage."""
        m = self.weights
        own = m["E"] / self.scale[:, None]
        p = Passages.of(table, texts)
        words = table.project(self.key, own[:WORD_FEATURES].astype(np.float32), m["W"].astype(np.float32))
        before = p.mean(words[p.words]) + p.habits() @ own[WORD_FEATURES:] + (m["e"] - self.mean @ own)
        return self._attend(before, np.cumsum(p.per_text) - p.per_text, p.per_text)["p"]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id, as text, is divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = FIT_DOCUMENTS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> GatedAttention | None:
    """Fit on ``most`` labelled rows, at most, that aren't held out; None if there are none.

    Repeated labels of an id are averaged and rounded up, null labels are left out; of rows
    that share an id, the text with the smallest hash counts, once.  All passages of a
    chosen document are fitted on.
    """
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(id_col)
        .agg(F.ceil(F.avg(label_col)).cast("int").alias("__label"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(most)
    )
    # at most ``most`` ids and labels are sent
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(F.broadcast(chosen), id_col)
    rows = rows.groupBy(id_col).agg(F.min_by(F.struct("__text", "__label"), F.xxhash64("__text")).alias("__r")).select(F.col(id_col).cast("string").alias("id"), "__r.*")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table()
        for batch in batches:
            texts = batch.column("__text")
            for a, b in runs(texts):
                made = make_bags(table, texts.slice(a, b - a))
                raw = [[x.tobytes() for x in (g.features, g.sizes.astype(np.int32), g.buckets)] for g in made]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), batch.column("__label").slice(a, b - a), *[pa.array([r[k] for r in raw], pa.binary()) for k in range(3)]],
                    ["id", "label", "features", "sizes", "buckets"],
                )

    got = rows.mapInArrow(tidy(bags), "id string, label int, features binary, sizes binary, buckets binary").toArrow().to_pandas().sort_values("id", kind="stable")
    if got.empty:
        return None
    made = [Bag(np.frombuffer(f, np.float32).reshape(-1, FEATURES), np.frombuffer(n, np.int32), np.frombuffer(w, np.int16)) for f, n, w in zip(got["features"], got["sizes"], got["buckets"], strict=True)]
    return GatedAttention.fit(made, got["label"].tolist())


def score_quality(docs: DataFrame, model: GatedAttention | None, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, over whole texts.

    Null and empty texts are one empty passage; without a model every score is 0.5.
    Repeated rows get equal scores, each its own row; null ids are kept; texts of any
    length are read whole; an empty table gives no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, fitted = word_table(), sent.value
        for batch in batches:
            texts = batch.column(text_col)
            for a, b in runs(texts):
                score = np.full(b - a, 0.5) if fitted is None else fitted.score(table, texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    rows = docs.select(id_col, text_col, held_out(id_col).alias("held_out"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def op9_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_quality(docs, fit_quality(docs, labels))
