"""Quality classifier on supervised subword embeddings.

Words, neighbouring word pairs and character n-grams (orders 2 to 4, across blanks) are
hashed into a table of learned vectors. A document's vector is the mean of its word and
pair vectors plus the mean of its character vectors; softmax over two outputs gives the
score. Vectors and outputs are trained by stochastic gradient descent in numpy on about
``per_class`` labelled rows of either label (the documented bound of the fit, chosen by a
hash of the id), and fewer where their features would pass ``fit_bytes`` together; the outputs are then shifted back to the labels' shares among all rows.
A pair is hashed by the difference of its words, so every repetition of a word meets one
learned vector.

As the outputs are linear in the vectors, scoring keeps one number per bucket (its vector
times the difference of the outputs) and a document's logit is a mean of gathered numbers.

Edge cases: null and empty texts score by the bias alone; without labels every score is
1.0, so that a filter keeps all; with one label it is that label; of a document labelled
twice the lower label counts; repeated rows stay; very long texts are read whole; extra
columns pass through (older columns named `score` are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, lean, table, within_bytes
from .features import char_buckets, codepoints, word_hashes

BITS = 16
ORDERS = (2, 3, 4)
DIM = 16
PER_CLASS = 2_000
FIT_BYTES = 64 << 20
KEEP = 0.7


@dataclass(frozen=True)
class Model:
    """gain: each bucket's vector times (output 1 - output 0)."""

    gain: np.ndarray
    bias: float


def features(text: str | None):
    """Parts of the text's features: (0, buckets of words and pairs), then (1, buckets of character n-grams) a part at a time; repeats included."""
    c = codepoints(text or "")
    w = word_hashes(c)
    pairs = w[1:] - w[:-1]
    mix = np.concatenate([w * np.uint32(0x9E3779B1), (pairs ^ np.uint32(0x5BD1E995)) * np.uint32(0xC2B2AE35)])
    yield 0, (mix ^ (mix >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
    for _, buckets in char_buckets(c, ORDERS, BITS):
        yield 1, buckets


def weighted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights): the weights of words and pairs sum to 1, those of characters too."""
    total = np.zeros((2, 1 << BITS))
    for kind, part in features(text):
        total[kind] += np.bincount(part, minlength=1 << BITS)
    total /= np.maximum(total.sum(axis=1, keepdims=True), 1)
    both = total.sum(axis=0).astype(np.float32)
    at = np.flatnonzero(both)
    return at, both[at]


def logit(text: str | None, gain: np.ndarray, bias: float) -> float:
    total, n = [0.0, 0.0], [0, 0]
    for kind, part in features(text):
        total[kind] += float(gain[part].sum(dtype=np.float64))
        n[kind] += len(part)
    return bias + sum(t / k for t, k in zip(total, n) if k)


#: Steps of the descent at least; a small sample is passed over more often.
LEAST_STEPS = 6_000


def fit_sgd(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 5, rate: float = 1.0, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, outputs, bias) by one-row steps with a rate that falls to zero."""
    epochs = max(epochs, -(-LEAST_STEPS // max(1, len(rows))))
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BITS, DIM)) - 0.5) / DIM).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, w, y = rows[k]
            lr = np.float32(rate * (1 - steps / total))
            steps += 1
            own = vectors[at]
            mean = w @ own
            x = mean @ out + bias
            p = np.exp(x - x.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * p
            vectors[at] = own - lr * np.outer(w, back)
    return vectors, out, bias


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", per_class: int = PER_CLASS, fit_bytes: int = FIT_BYTES) -> Model:
    """Learns from the labels given; the caller leaves out what is held out."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 50.0 if sizes.get(1, 0) or not sizes else -50.0)
    mark = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(3)), F.lit(1 << 20))
    share = F.when(F.col("y") == 1, min(1.0, per_class / sizes[1])).otherwise(min(1.0, per_class / sizes[0]))
    chosen = known.where(mark < share * (1 << 20))  # about 2 * per_class ids: a proven bound for the broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(chosen), "id").select("id", "y", "t")

    def featurise(batches):
        for b in batches:
            pairs = [weighted(t) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.string()), b.column("y"), pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.float32()))], ["id", "y", "at", "w"])

    got = within_bytes(sample.mapInArrow(lean(featurise), "id string, y int, at array<int>, w array<float>"), "id", 8 * F.size("at"), fit_bytes).toArrow()
    rows = [(at.values.to_numpy(), w.values.to_numpy(), y) for _, y, at, w in sorted(zip(got["id"].to_pylist(), got["y"].to_pylist(), got["at"], got["w"]), key=lambda r: r[:2])]
    vectors, out, bias = fit_sgd(rows)
    seen = [max(1, sum(r[2] == k for r in rows)) for k in (0, 1)]
    shift = np.log(sizes[1] / seen[1]) - np.log(sizes[0] / seen[0])
    return Model(vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0] + shift))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The rows with `out_col` (an older one is replaced), the probability of label 1."""
    docs = docs.drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            logits = np.array([logit(t, m.gain, m.bias) for t in b.column(text_col).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(logits, -60, 60))))], [*b.schema.names, out_col])

    return docs.mapInArrow(lean(run), docs.select("*", F.lit(0.0).alias(out_col)).schema)


def held_out(col: str | Column = "doc_id") -> Column:
    return crc_mod(F.col(col) if isinstance(col, str) else col, 4) == 2


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))
