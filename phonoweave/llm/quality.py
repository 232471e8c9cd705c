"""Quality classifier: supervised subword embeddings.

Features of a text are its words, the 3- to 5-byte n-grams of its words with the blanks around them, and a mark for each word
that repeats the one before it (the pair of equal words as a word n-gram, whatever the word), hashed into a table
of learned vectors. A text's vector is the average of its features' vectors; a softmax layer gives the label. Both are
trained by numpy stochastic gradient descent on a bounded sample of labelled rows (sample_rows, taken by a hash of doc_id).
With two labels the softmax of an average is the logistic function of an average of scalars, so scoring looks up one number
for each feature: the projection of its vector on the difference of the label vectors.

Texts are scored whole, whatever their length, a stretch at a time. Null and empty texts have no features and score by the
bias alone. Without any usable labels every text scores 0.5. doc_ids that are labelled more than once take the lowest label,
and of a labelled id with several texts the least one teaches; null labels and null ids teach nothing. Only text enters a score. Repeated rows are rows of their own; other columns are not
read. An empty table of documents gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoweave.llm.common import small_batches

BUCKET_BITS = 17
DIMENSIONS = 8
SAMPLE_ROWS = 2500
#: Steps of the vectors against those of the softmax layer.
VECTOR_RATE = 50.0
SIZES = (3, 4, 5)
#: Bytes of a text that are hashed at a time; stretches end at blanks.
STRETCH = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: The bucket of a word that repeats the one before it.
_REPEATED = 12_345
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _stretches(raw: bytes):
    at = 0
    while at < len(raw):
        end = min(len(raw), at + STRETCH)
        while end < len(raw) and not _BLANK[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def features(raw: bytes) -> np.ndarray:
    """Buckets of all features of one stretch, repeats included."""
    data = np.frombuffer(b" " + raw + b" ", np.uint8)
    blank = _BLANK[data]
    symbol = np.where(blank, 32, data).astype(np.uint64)
    found = []
    shift = np.uint64(64 - BUCKET_BITS)
    for size in SIZES:
        n = len(data) - size + 1
        if n <= 0:
            continue
        code = np.full(n, size, np.uint64)
        inner = np.zeros(n, bool)
        for k in range(size):
            code = code * np.uint64(257) + symbol[k : k + n]
            if 0 < k < size - 1:
                inner |= blank[k : k + n]
        found.append((code[~inner] * _MULTIPLIER) >> shift)
    edges = np.flatnonzero(np.diff(blank.astype(np.int8)))
    starts, ends = edges[::2] + 1, edges[1::2] + 1
    if len(starts):
        mixed = (symbol + np.uint64(1)) * _MULTIPLIER
        # Words by their bytes and places: a sum of mixed products, taken from running sums.
        place = np.arange(len(symbol), dtype=np.uint64) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(symbol)]]))).astype(np.uint64)
        part = (mixed ^ (mixed >> np.uint64(29))) * (np.uint64(2) * place * place + np.uint64(2) * place + np.uint64(0xBF58476D1CE4E5B9))
        total = np.concatenate([[np.uint64(0)], np.cumsum(part, dtype=np.uint64)])
        words = total[ends] - total[starts]
        found.append((words * _MULTIPLIER) >> shift)
        # A word next to itself: pairs of equal words share one feature, whatever the word.
        found.append(np.full(int((words[1:] == words[:-1]).sum()), _REPEATED, np.uint64))
    return np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text, with counts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    parts = [np.unique(features(s), return_counts=True) for s in _stretches(raw)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    if len(parts) == 1:
        return parts[0][0], parts[0][1].astype(np.int32)
    buckets, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return buckets.astype(np.int32), np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int32)


class Model:
    """The folded classifier: a weight for each bucket and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for stretch in _stretches((text or "").encode("utf-8", "surrogatepass")):
            buckets = features(stretch)
            total += float(self.weights[buckets].sum(dtype=np.float64))
            n += len(buckets)
        z = self.bias + (total / n if n else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 640, rate: float = 0.5, batch: int = 16, seed: int = 13) -> Model:
    """rows: buckets, counts, label. Embeddings and softmax by minibatch gradient descent, the rate falling to zero over the steps."""
    size = 1 << BUCKET_BITS
    if not rows:
        return Model(np.zeros(size, np.float32), 0.0)
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (size, DIMENSIONS)).astype(np.float32)
    output, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    done, per_epoch = 0, -(-len(rows) // batch)
    epochs = -(-steps // per_epoch)
    steps = epochs * per_epoch
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(rows), batch):
            part = [rows[k] for k in order[at : at + batch]]
            lengths = np.array([len(r[0]) for r in part])
            labels = np.array([r[2] for r in part])
            buckets = np.concatenate([r[0] for r in part])
            share = np.concatenate([r[1] / max(1, r[1].sum()) for r in part]).astype(np.float32)
            doc = np.repeat(np.arange(len(part)), lengths)
            weighted = vectors[buckets] * share[:, None]
            hidden = np.stack([np.bincount(doc, weighted[:, d], len(part)) for d in range(DIMENSIONS)], 1).astype(np.float32)
            z = hidden @ output + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels] -= 1
            now = rate * (1 - done / steps)
            back = p @ output.T
            output -= now * hidden.T @ p / len(part)
            bias -= now * p.mean(0)
            # A feature's share of a text is small, so vectors take a step for each text, not for the average.
            distinct, inverse = np.unique(buckets, return_inverse=True)
            step = back[doc] * share[:, None]
            for d in range(DIMENSIONS):
                vectors[distinct, d] -= now * VECTOR_RATE * np.bincount(inverse, step[:, d], len(distinct)).astype(np.float32)
            done += 1
    edge = (output[:, 1] - output[:, 0]).astype(np.float64)
    return Model((vectors.astype(np.float64) @ edge).astype(np.float32), float(bias[1] - bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of a bounded sample of the labelled texts: the sample_rows smallest hashes of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            rows = [counted(t) for t in batch.column("text").to_pylist()]
            packed = [pa.array([r[k].astype("<i4").tobytes() for r in rows], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *packed, batch.column("quality")], names=["doc_id", "buckets", "counts", "quality"])

    # Repeated rows of a chosen id: one of them is enough, so that the sample's bound holds.
    one = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    # As bytes: lists of Python numbers would take ten times the driver's memory.
    rows = one.mapInArrow(run, "doc_id long, buckets binary, counts binary, quality int").collect()
    return [(np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.counts, "<i4"), r.quality) for r in sorted(rows, key=lambda r: r.doc_id)]


def quality_scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            scores = [own.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id) -> F.Column:
    """Rows that must not teach: crc32 of the id as text, remainder 0 of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_and_score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on labelled rows that are not held out, then score every row: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    model = train(labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), sample_rows))
    return quality_scores(docs, model, threshold).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    small_batches(docs.sparkSession)
    model = train(labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), sample_rows))
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        own = Model(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t) >= threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
