"""A multilayer regressor trained by distributed Adam: tasks sum the gradients of their samples, the sums merge through a tree, the parameters go along with each step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = (32, 16)
#: Samples of a stored block.
ROWS = 1024

Layers = list[tuple[np.ndarray, np.ndarray]]


def start(sizes: list[int], seed: int) -> Layers:
    """Uniform weights in ± sqrt(6 / (inputs + outputs)), zero offsets."""
    rng = np.random.default_rng(seed)
    return [(rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def outputs(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """What each layer gives: rectified, the last as it is."""
    out = [x]
    for k, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(z if k == len(layers) - 1 else np.maximum(z, 0))
    return out


def loss(layers: Layers, x: np.ndarray, y: np.ndarray) -> float:
    """Half the sum of squared errors."""
    return float(((outputs(layers, x)[-1][:, 0] - y) ** 2).sum() / 2)


def gradients(layers: Layers, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of loss(), in the order weights, offsets of each layer; then the number of samples."""
    out = outputs(layers, x)
    back = out[-1] - y[:, None]
    grads: list = []
    for k in range(len(layers) - 1, -1, -1):
        grads = [out[k].T @ back, back.sum(axis=0), *grads]
        back = (back @ layers[k][0].T) * (out[k] > 0)
    return [*grads, np.array(float(len(x)))]


def _added(a, b):
    return b if a is None else a if b is None else [x + y for x, y in zip(a, b)]


def train(rows: DataFrame, features: str, target: str, hidden: tuple[int, ...] = HIDDEN, steps: int = 200, rate: float = 0.01, penalty: float = 1e-4, seed: int = 42) -> Layers:
    """Layers after `steps` steps of Adam on all rows(features array, target); rows with a NULL target, or NULL features, are left out. The penalty is on the squares of the weights."""
    known = rows.where(F.col(target).isNotNull() & F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"))

    def packed(batches):
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                part = b.slice(k, ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("x").flatten().to_numpy(zero_copy_only=False).tobytes()]), pa.array([part.column("y").to_numpy().tobytes()])], ["x", "y"])

    width = known.select(F.max(F.size("x"))).first()[0] or 0
    layers = start([width, *hidden, 1], seed)
    stored = known.mapInArrow(packed, "x binary, y binary").rdd.map(lambda r: (np.frombuffer(r["x"]).reshape(-1, width), np.frombuffer(r["y"]))).persist()
    sc = rows.sparkSession.sparkContext
    first = [np.zeros_like(p) for layer in layers for p in layer]
    second = [np.zeros_like(p) for p in first]
    for t in range(1, (steps if width else 0) + 1):
        sent = sc.broadcast(layers)
        total = stored.treeAggregate(None, lambda acc, b: _added(acc, gradients(sent.value, *b)), _added)
        if total is None:
            break
        *grads, n = total
        flat = [p for layer in layers for p in layer]
        grads = [(g + (penalty * p if p.ndim == 2 else 0)) / n for g, p in zip(grads, flat)]
        first = [0.9 * m + 0.1 * g for m, g in zip(first, grads)]
        second = [0.999 * v + 0.001 * g * g for v, g in zip(second, grads)]
        flat = [p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) for p, m, v in zip(flat, first, second)]
        layers = list(zip(flat[::2], flat[1::2]))
        sent.destroy()
    stored.unpersist()
    return layers


def predict(rows: DataFrame, layers: Layers, features: str, out: str = "prediction") -> DataFrame:
    """rows with the regressor's output; NULL features give NULL."""
    sent = rows.sparkSession.sparkContext.broadcast(layers)

    @F.pandas_udf("double")
    def scored(x):
        known = x.notna()
        y = x.astype(object).where(known, None)
        if known.any():
            y[known] = outputs(sent.value, np.array(x[known].tolist(), float))[-1][:, 0]
        return y.astype(float)

    return rows.withColumn(out, scored(F.col(features).cast("array<double>")))


def mean_squared_error(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """(n, mse) over the rows that have both."""
    return df.where(F.col(prediction).isNotNull() & F.col(target).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.pow(F.col(prediction) - F.col(target), 2)).alias("mse"))
