"""Language identification by sparse multinomial logistic regression.

Texts become TF-IDF vectors of hashed character n-grams (orders 1 to 3 over the letters).
Document frequencies are counted over all training rows on the executors. The weights are
fitted by follow-the-regularised-leader (proximal, one rate per coordinate) with L1 and L2
penalties, on a sample of about ``per_class`` rows of each label (the documented bound of
the fit, chosen by a hash of the id; every language gets its share), and fewer where their features
would pass ``fit_bytes`` together. Labels are taken to number in the hundreds at most. A fifth of that sample
is held back to fit the temperature that calibrates the probabilities.

Edge cases: a null text or one without letters is `und` with score 0, as is every row
where no label exists to learn from; null labels teach nothing; equal scores go to the
label that sorts first; repeated rows stay; very long texts are read whole; extra columns
pass through (older columns of the names added here are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, table, within_bytes
from .features import char_buckets, letters_only

BITS = 15
ORDERS = (1, 2, 3)
PER_CLASS = 1_000
FIT_BYTES = 64 << 20


@dataclass(frozen=True)
class Model:
    """weights: one row per bucket and a last one for the bias; sparse, most rows are zero."""

    langs: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, occurrences) of the text's n-grams."""
    c = letters_only(text or "")
    if not len(c):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = np.zeros(1 << BITS, np.int64)
    for _, buckets in char_buckets(c, ORDERS, BITS):
        n += np.bincount(buckets, minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at]


def tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(n)) * idf[at]
    return v / max(np.sqrt((v * v).sum()), 1e-12)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many rows each bucket occurs, and the number of rows; summed per task, then over tasks."""

    def run(batches):
        df = np.zeros((1 << BITS) + 1, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                at, _ = counts_of(text)
                df[at] += 1
            df[-1] += b.num_rows
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held], pa.int64())], ["bucket", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros((1 << BITS) + 1, np.int64)
    for r in rows:
        df[r["bucket"]] = r["n"]
    return df[:-1], int(df[-1])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_features: int, n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 3, seed: int = 1) -> np.ndarray:
    """Weights (n_features+1, n_classes) by FTRL-proximal with elastic net; rows are (indices, values, class)."""
    z = np.zeros((n_features + 1, n_classes))
    n = np.zeros_like(z)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, v, y = rows[k]
            at, v = np.append(at, n_features), np.append(v, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(v @ w)
            p[y] -= 1
            g = np.outer(v, p)
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
    return weights(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, between 1/20 and 20, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t):
        x = logits / np.exp(log_t)
        return -np.log(np.maximum(softmax(x)[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, golden = -np.log(20), np.log(20), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_class: int = PER_CLASS, fit_bytes: int = FIT_BYTES) -> Model:
    """Learns from the rows given; the caller leaves out what is held out."""
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = tuple(sorted(sizes))
    df, n_docs = document_frequencies(known, "t")
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    if not langs:
        return Model((), idf, np.zeros(((1 << BITS) + 1, 1)), 1.0)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_class / sizes[k]))])
    mark = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(1)), F.lit(1 << 20))
    sample = known.where(mark < share[F.col("lang")] * (1 << 20)).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "lang", "t", (F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(2)), F.lit(5)) == 0).alias("calibrate"))

    def featurise(batches):
        for b in batches:
            pairs = [counts_of(t) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), b.column("calibrate"), pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())), pa.array([p[1].astype(np.int32) for p in pairs], pa.list_(pa.int32()))], ["id", "lang", "calibrate", "at", "n"])

    got = within_bytes(sample.mapInArrow(featurise, "id string, lang string, calibrate boolean, at array<int>, n array<int>"), "id", 8 * F.size("at"), fit_bytes).toArrow()
    number = {k: i for i, k in enumerate(langs)}
    fit, hold = [], []
    rows = sorted(zip(got["id"].to_pylist(), got["lang"].to_pylist(), got["calibrate"].to_pylist(), got["at"], got["n"]), key=lambda r: (r[:2], r[3].values.to_pylist()))
    for _, lang, cal, at, n in rows:  # in the order of ids, not of arrival
        at = at.values.to_numpy()
        if len(at):
            (hold if cal else fit).append((at, tfidf(at, n.values.to_numpy(), idf), number[lang]))
    fit, hold = (fit, hold) if fit else (hold, fit)
    weights = fit_ftrl(fit, 1 << BITS, len(langs))
    logits = np.array([v @ weights[at] + weights[-1] for at, v, _ in hold]).reshape(-1, len(langs))
    return Model(langs, idf.astype(np.float32), weights.astype(np.float32), fit_temperature(logits, np.array([y for _, _, y in hold], np.int64)))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score (the calibrated probability of that language)."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            langs, scores = [], []
            for text in b.column(text_col).to_pylist():
                at, n = counts_of(text) if m.langs else ((), ())
                if not len(at):
                    langs.append("und"), scores.append(0.0)
                    continue
                p = softmax((tfidf(at, n, m.idf) @ m.weights[at] + m.weights[-1]).astype(np.float64) / m.temperature)
                k = int(p.argmax())
                langs.append(m.langs[k]), scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, docs.select("*", F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def held_out(id_col: str | Column = "doc_id") -> Column:
    return crc_mod(F.col(id_col) if isinstance(id_col, str) else id_col, 3) == 1


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
