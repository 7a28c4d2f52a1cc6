"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Word vectors: every word has a sparse ternary index vector that depends on its hash alone;
a word's vector is the sum of its neighbours' index vectors over the training texts.  A document
is the mean vector of its known words and the mean index vector of its word shapes (runs of
capitals, letters, digits and marks), with the mean's norm, the shares of unknown, distinct and
immediately repeated words and the logarithm of its length.  A word is known if two other
training documents hold it, so that training and unseen documents are measured alike.  The network is plain numpy; a temperature, fitted on
rows it was not trained on, calibrates its probabilities.

Training uses at most ``sample_rows`` labelled rows, those of the least hash of the id, as long as
their texts together stay within ``sample_bytes``; texts above a 64th of that are scored, but not
learned from (documented bounds).  Texts are hashed by the executors and the model is fitted in one
task, so that the driver holds the finished model alone.  Every document is scored, whole.  Null and empty texts are scored as texts
without words.  Without labelled rows of both classes all scores are the share of label 1, or 0.5.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import hash_words, lean, mix, quoted, text_chunks

DIMENSIONS = 64
NONZERO = 4
REACH = 2
HIDDEN = 32
SHAPE_DIMENSIONS = 32
SHAPE_BUCKETS = 4096
#: Words whose vectors are looked up at a time.
SLICE = 1 << 15

#: Bytes by class: A-Z, other letters (all bytes from 80 up too), digits, spaces, and marks as they are.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:], _CLASS[0x30:0x3A] = ord("A"), ord("a"), ord("a"), ord("0")
_CLASS[0x09:0x0E] = 0x20


def shape_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of each word's shape, in the order of ``hash_words``."""
    shape = _CLASS[data]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[offsets[:-1][offsets[:-1] < len(shape)]] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    return hash_words(shape[keep], at[offsets]).hashes


@dataclass
class Hashed:
    """Words of some texts: hashes, shapes and the texts' offsets into them."""

    words: np.ndarray
    shapes: np.ndarray
    offsets: np.ndarray


def hash_text(data: np.ndarray, offsets: np.ndarray) -> Hashed:
    w = hash_words(data, offsets)
    return Hashed(w.hashes, shape_hashes(data, offsets), w.offsets)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """Sparse, nearly ternary vectors of word hashes, as bytes to spare the driver's memory."""
    out = np.zeros((len(hashes), DIMENSIONS), np.int8)
    rows, h = np.arange(len(hashes)), hashes
    for _ in range(NONZERO):
        h = mix(h + np.uint64(0x632BE59BD9B4E019))
        out[rows, (h >> np.uint64(8)).astype(np.int64) % DIMENSIONS] += np.where(h & np.uint64(1), 1, -1).astype(np.int8)
    return out


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None
    holders: np.ndarray | None = None  # training documents that hold each word

    def features(self, text: Hashed, own: int = 0) -> np.ndarray:
        """One row per text.  own: 1 for training texts, which are among the holders themselves."""
        hashes, offsets = text.words, text.offsets
        n = len(offsets) - 1
        counts = np.diff(offsets)
        pooled, known = np.zeros((n, DIMENSIONS), np.float32), np.zeros(n, np.float32)
        shapes, distinct, again = np.zeros((n, SHAPE_DIMENSIONS), np.float32), np.zeros(n), np.zeros(n)
        doc = np.repeat(np.arange(n), counts)
        for lo in range(0, len(hashes), SLICE):  # slices bound the memory, within a long text too
            part = slice(lo, lo + SLICE)
            here, h = doc[part], hashes[part]
            first = np.flatnonzero(np.diff(here, prepend=-1))
            rows = here[first]
            if len(self.words):
                at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
                hit = (self.words[at] == h) & (self.holders[at] >= 2 + own)
                at[~hit] = len(self.words)  # the zero vector
                known[rows] += np.add.reduceat(hit.astype(np.float32), first)
                pooled[rows] += np.add.reduceat(self.vectors[at], first, axis=0, dtype=np.float32)
            shapes[rows] += np.add.reduceat(_shape_table()[(text.shapes[part] >> np.uint64(52)).astype(np.int64)], first, axis=0, dtype=np.float32)
        pooled /= np.maximum(known, 1)[:, None]
        norm = np.sqrt((pooled**2).sum(1))
        unknown = 1 - known / np.maximum(counts, 1)
        if len(hashes):
            full = counts > 0
            first = offsets[:-1][full]
            key = np.sort(doc.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
            new = np.ones(len(key), dtype=bool)
            new[1:] = key[1:] != key[:-1]
            distinct[full] = np.add.reduceat(new.astype(np.float64), first)
            same = np.zeros(len(hashes))
            same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
            again[full] = np.add.reduceat(same, first)
        size = np.maximum(counts, 1)
        return np.column_stack([pooled, shapes / size[:, None], norm, unknown, np.log1p(counts), distinct / size, again / size])

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        x = (features - self.mean) / self.scale
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def scores(self, text: Hashed) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(text.offsets) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(text)) / self.temperature, -30, 30)))


_shapes: list[np.ndarray] = []


def _shape_table() -> np.ndarray:
    if not _shapes:
        _shapes.append(index_vectors(mix(np.arange(SHAPE_BUCKETS, dtype=np.uint64) + np.uint64(0x51ED270B)))[:, :SHAPE_DIMENSIONS].astype(np.float32))
    return _shapes[0]


def hash_all(texts: list[str | None]) -> Hashed:
    parts = [hash_text(data, offsets) for _, _, data, offsets in text_chunks(pa.array(texts, pa.large_string()))]
    if not parts:
        return Hashed(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(1, np.int64))
    sizes = np.concatenate([np.diff(p.offsets) for p in parts])
    return Hashed(np.concatenate([p.words for p in parts]), np.concatenate([p.shapes for p in parts]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def _word_vectors(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, vectors and numbers of holders of the words that two texts hold at least."""
    words, where = np.unique(hashes, return_inverse=True)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    held = np.unique(where * np.int64(len(offsets)) + doc) // len(offsets)
    counts = np.bincount(held, minlength=len(words))
    keep = np.flatnonzero(counts >= 2)
    row = np.full(len(words), len(keep))
    row[keep] = np.arange(len(keep))
    row = row[where]  # of each occurrence; len(keep): not in the vocabulary
    vectors = np.zeros((len(keep) + 1, DIMENSIONS), np.float32)
    index = index_vectors(words)  # bytes
    for shift in [s for s in range(-REACH, REACH + 1) if s]:
        at = np.arange(max(0, -shift), len(hashes) - max(0, shift))
        at = at[doc[at] == doc[at + shift]] if len(at) else at
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            order = np.argsort(row[part], kind="stable")
            rows = row[part][order]
            firsts = np.flatnonzero(np.diff(rows, prepend=-1))
            vectors[rows[firsts]] += np.add.reduceat(index[where[part + shift]][order], firsts, axis=0, dtype=np.float32)
    vectors /= np.maximum(np.sqrt((vectors**2).sum(1)), 1e-6)[:, None]
    vectors[len(keep)] = 0
    return words[keep], vectors, counts[keep]


def train(texts: list[str | None], labels: np.ndarray, seed: int = 7, epochs: int = 40) -> Model:
    return train_hashed(hash_all(texts), labels, seed, epochs)


def train_hashed(text: Hashed, labels: np.ndarray, seed: int = 7, epochs: int = 40) -> Model:
    """Fits word vectors, network and temperature; every fifth row calibrates only."""
    labels = np.asarray(labels, np.float64)
    empty = np.zeros(0)
    if len(labels) < 10 or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros(0, np.uint64), np.zeros((1, DIMENSIONS), np.float32), empty, empty, [], 1.0, share)
    words, vectors, holders = _word_vectors(text.words, text.offsets)
    model = Model(words, vectors, np.zeros(1), np.ones(1), [], 1.0, None, holders)
    x = model.features(text, own=1).astype(np.float64)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    model.layers = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), np.zeros(1)]
    held = np.arange(len(labels)) % 5 == 4
    if len(set(labels[~held])) < 2 or not held.any():
        held[:] = False
    z, y = ((x - model.mean) / model.scale)[~held], labels[~held]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) ** 0.5  # half-way to balanced
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.layers]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 64):
            i = order[lo : lo + 64]
            w1, b1, w2, b2 = model.layers
            hidden = np.maximum(z[i] @ w1 + b1, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30)))
            g = (p - y[i]) * weight[i] / len(i)
            back = np.outer(g, w2) * (hidden > 0)
            grads = [z[i].T @ back + 1e-4 * w1, back.sum(0), hidden.T @ g + 1e-4 * w2, np.array([g.sum()])]
            step += 1
            for k, (q, (m, v)) in enumerate(zip(grads, moments)):
                m += 0.1 * (q - m)
                v += 0.001 * (q * q - v)
                model.layers[k] = model.layers[k] - 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    check = held if held.any() else ~held
    logit = model.logits(x[check])
    grid = np.geomspace(0.25, 8, 41)
    loss = [np.mean(np.logaddexp(0, -logit / t * (2 * labels[check] - 1))) for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int, sample_bytes: int = 64 << 20) -> DataFrame:
    """(text, label): the bounded sample; ids with crc32 modulo 4 of 2 are held out and never used."""
    usable = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("double").alias("label")).where("id is not null and label in (0, 1) and crc32(cast(cast(id as string) as binary)) % 4 <> 2")
    chosen = usable.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text")).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    some = texts.where(F.col("size") <= sample_bytes // 64).join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "text").limit(sample_rows)
    # a window over sample_rows rows at most
    so_far = F.sum("size").over(Window.orderBy(F.xxhash64("id"), "id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return some.withColumn("so_far", so_far).where(F.col("so_far") <= sample_bytes).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 4000, seed: int = 7, sample_bytes: int = 64 << 20) -> Model:
    """The model of the bounded sample; only the model comes to the driver."""
    sample = training_sample(docs, labels, id_col, text_col, label_col, sample_rows, sample_bytes)

    def run(batches):
        texts, sizes, marks = [], [], []
        for batch in batches:
            marks.append(batch.column(1).to_numpy())
            for _, _, data, offsets in text_chunks(batch.column(0)):
                h = hash_text(data, offsets)
                texts.append((h.words, h.shapes))
                sizes.append(np.diff(h.offsets))
        none = [np.zeros(0, np.uint64)]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes or [np.zeros(0, np.int64)]))]).astype(np.int64)
        text = Hashed(np.concatenate([w for w, _ in texts] or none), np.concatenate([s for _, s in texts] or none), offsets)
        del texts
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train_hashed(text, np.concatenate(marks or [np.zeros(0)]), seed), 5)], pa.binary())], ["model"])

    made = sample.coalesce(1).mapInArrow(lean(run), "model binary").first()
    return pickle.loads(made["model"]) if made else train([], np.zeros(0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id and score of every row, and the ``keep`` columns as struct ``kept``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    inside = keep.index(text_col) if text_col in keep else None  # a kept text isn't sent a second time
    kept = [F.struct(*map(quoted, keep)).alias("kept")] if keep else []
    source = docs.select(quoted(id_col).alias("id"), *kept, *([quoted(text_col).alias("text")] if inside is None else []))
    fields = [f for f in source.schema.fields if f.name != "text"]

    def run(batches):
        for batch in batches:
            got = np.zeros(batch.num_rows)
            texts = batch.column(len(fields)) if inside is None else batch.column(1).field(inside)
            for first, end, data, offsets in text_chunks(texts, 1 << 20):
                got[first:end] = held.value.scores(hash_text(data, offsets))
            columns = [*batch.columns[: len(fields)], pa.array(got)]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in fields], "score"])

    return source.mapInArrow(lean(run), T.StructType([*fields, T.StructField("score", T.DoubleType())])).withColumnRenamed("id", id_col)
