"""Directed importances: forests of regression trees for every feature as a target, grown level by level for all targets at once.

Samples share one table of binned features (equal-width bins from each feature's least to greatest value) and are packed
once into blocks of at most CHUNK, which stay cached. A level is one pass: a task has a few targets and goes through the blocks one at a
time, finding each sample's node from the splits so far and adding up weights and sums of the target by (tree, node,
candidate feature, bin). It holds these sums and a block, whatever the number of samples, and passes on its targets'
splits only: sums are not shuffled. What the driver holds are splits, targets × trees × 2^depth at most.

Trees take Poisson(1) weights by a hash of the sample as their bootstrap, the square root of the
other features as candidates at a node, and end at DEPTH levels, at nodes of one sample or of one value. Missing values
are the feature's mean.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .gram import placed

BINS = 32
DEPTH = 8
TREES = 100
#: Samples of a block.
CHUNK = 8192
#: Targets of a task at most, and trees whose splits are chosen at a time.
TARGETS, AT_ONCE = 4, 10


class Table:
    """The features' ids, bounds and means (one row a feature on the driver), and the samples' cells."""

    def __init__(self, m: DataFrame):
        known = m.where("value is not null")
        rows = sorted(known.groupBy("feature_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean")).collect(), key=lambda r: r["feature_id"])
        self.names, self.kind = [r["feature_id"] for r in rows], m.schema["feature_id"].dataType
        self.low, self.high, self.mean = (np.array([r[c] for r in rows], float) for c in ("low", "high", "mean"))
        cells = F.collect_list(F.struct("place", F.col("value").cast("double").alias("value"))).alias("cells")
        self.count = known.select("sample_id").distinct().count()
        self.rows = placed(known, self.names).groupBy(F.col("sample_id").cast("string").alias("id")).agg(cells)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rows"}

    def blocks(self, trees: int, seed: int, bootstrap: bool) -> RDD:
        """(bins, deviations from the mean, weights) of at most CHUNK samples, one row a feature or tree; kept, as every level reads them."""

        def pack(rows):
            ids, held = [], []

            def block():
                x = np.array(held)
                w = weights(ids, trees, seed).T if bootstrap else np.ones((trees, len(ids)))
                return np.ascontiguousarray(self.bins(x).T.astype(np.uint8)), np.ascontiguousarray((x - self.mean).T), np.ascontiguousarray(w.astype(np.uint8))

            for i, cells in rows:
                row = self.mean.copy()
                for place, value in cells:
                    row[place] = value
                ids.append(i)
                held.append(row)
                if len(held) == CHUNK:
                    yield block()
                    ids, held = [], []
            if held:
                yield block()

        parts = max(1, -(-self.count * 4 // (3 * CHUNK)))  # full blocks: a task's cost a block is that of some thousand samples
        return self.rows.repartition(parts, "id").rdd.mapPartitions(pack).persist(StorageLevel.MEMORY_AND_DISK)

    def bins(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            at = np.floor((x - self.low) / (self.high - self.low) * BINS)
        return np.clip(np.nan_to_num(at), 0, BINS - 1).astype(np.int64)


def weights(ids: list[str], trees: int, seed: int) -> np.ndarray:
    """samples × trees: how often each tree draws the sample."""
    return np.array([np.random.default_rng([seed, zlib.crc32(i.encode())]).poisson(1.0, trees) for i in ids], float)


def candidates(target: int, level: int, features: int, trees: int, many: int, seed: int) -> np.ndarray:
    """trees × nodes × many: the features that a node may split on, the target never among them."""
    if many >= features - 1:
        own = np.delete(np.arange(features), target)
        return np.broadcast_to(own, (trees, 1 << level, features - 1))
    draw = np.random.default_rng([seed, target, level]).random((trees, 1 << level, features), np.float32)
    draw[:, :, target] = 2
    return np.argpartition(draw, many, axis=2)[:, :, :many]


def nodes(bins: np.ndarray, who: np.ndarray, splits: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(samples, nodes) of one tree for those of the samples that a leaf has not ended. splits: by level (feature, bin) of each node, feature -1 at a leaf."""
    at = np.zeros(len(who), np.int64)
    for feature, cut in splits:
        f = feature[at]
        if (f < 0).any():
            on = f >= 0
            who, at, f = who[on], at[on], f[on]
        at = 2 * at + (bins[f, who] > cut[at])
    return who, at


def best_splits(w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(candidate, bin, gain) of every node from trees × nodes × candidates × bins of weights and sums: values up to the bin go left. The first on ties."""
    left_w, left_s = np.cumsum(w, axis=3)[..., :-1], np.cumsum(s, axis=3)[..., :-1]
    all_w, all_s = w.sum(axis=3, keepdims=True), s.sum(axis=3, keepdims=True)
    right_w, right_s = all_w - left_w, all_s - left_s
    ok = (left_w > 0) & (right_w > 0)
    gain = np.where(ok, left_s**2 / np.where(ok, left_w, 1) + right_s**2 / np.where(ok, right_w, 1) - all_s**2 / np.where(all_w > 0, all_w, 1), 0.0)
    flat = gain.reshape(*gain.shape[:2], -1)
    top = (flat >= flat.max(axis=2, keepdims=True) * (1 - 1e-9)).argmax(axis=2)  # sums in another order are ties still
    return top // gain.shape[3], top % gain.shape[3], np.take_along_axis(flat, top[:, :, None], axis=2)[:, :, 0]


def grow(table: Table, blocks: RDD, level: int, splits: list, trees: int, many: int, seed: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(target, feature, cut, gain) of every target: its splits of one level, trees × nodes each."""
    p = len(table.names)
    sc = table.rows.sparkSession.sparkContext
    sent = sc.broadcast(splits)
    wide = min(many, p - 1)
    shape = (trees, 1 << level, wide, BINS)
    few = max(1, min(TARGETS, p // (2 * sc.defaultParallelism)))

    def add(t, drawn, sums, block):
        bins, y, weight = block
        own = [(f[t], c[t]) for f, c in sent.value]
        y = y[t]
        for k in range(trees):
            who, at = nodes(bins, np.flatnonzero(weight[k]), [(f[k], c[k]) for f, c in own])
            w = weight[k, who].astype(float)
            wy = w * y[who]
            size = shape[1] * BINS
            at_bin = at * BINS
            for c in range(wide):
                cell = at_bin + bins[drawn[k, :, c][at], who]
                sums[0, k, :, c] += np.bincount(cell, w, size).reshape(-1, BINS)
                sums[1, k, :, c] += np.bincount(cell, wy, size).reshape(-1, BINS)

    def run(met):
        # a partition has one group of targets, and meets every block in turn
        held: dict = {}
        for group, block in met:
            if not held:
                held = {t: (np.ascontiguousarray(candidates(t, level, p, trees, many, seed)), np.zeros((2, *shape))) for t in group}
            for t, (drawn, sums) in held.items():
                add(t, drawn, sums, block)
        for t, (drawn, (w, s)) in held.items():
            parts = [best_splits(w[k : k + AT_ONCE], s[k : k + AT_ONCE]) for k in range(0, trees, AT_ONCE)]
            at, cut, gain = (np.concatenate(v) for v in zip(*parts))
            feature = np.take_along_axis(drawn, at[:, :, None], axis=2)[:, :, 0]
            yield t, np.where(gain > 1e-12, feature, -1).astype(np.int32), cut.astype(np.uint8), gain

    groups = [list(range(k, min(k + few, p))) for k in range(0, p, few)]
    return sc.parallelize(groups, len(groups)).cartesian(blocks.coalesce(1)).mapPartitions(run).collect()


def levels(table: Table, trees: int = TREES, depth: int = DEPTH, seed: int = 42, many: int | None = None, bootstrap: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By level (feature, bin, gain), targets × trees × nodes each; a feature of -1 marks a leaf. Ends early once all nodes are leaves."""
    p = len(table.names)
    if p < 2:
        return []
    many = many or max(1, int(np.sqrt(p - 1)))
    out: list = []
    blocks = table.blocks(trees, seed, bootstrap)
    for level in range(depth):
        size = (p, trees, 1 << level)
        feature, cut, gain = np.full(size, -1, np.int32), np.zeros(size, np.uint8), np.zeros(size)
        for t, *v in grow(table, blocks, level, [(f, c) for f, c, _ in out], trees, many, seed):
            feature[t], cut[t], gain[t] = v
        out.append((feature, cut, gain))
        if (feature < 0).all():
            break
    blocks.unpersist()
    return out


def importances(m: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 42, least: float = 1e-4) -> DataFrame:
    """(i, j, w): the importance of feature i for target j above `least`, each target's summing to at most 1; each tree's gains are scaled to 1 and averaged."""
    table = Table(m)
    grown = levels(table, trees, depth, seed)
    p = len(table.names)
    spark = m.sparkSession
    sent = spark.sparkContext.broadcast([(f, g) for f, _, g in grown])
    names = pa.array(table.names, to_arrow_type(table.kind))

    def run(batches):
        for b in batches:
            for t in b.column("id").to_pylist():
                own = np.zeros((trees, p))
                for feature, gain in sent.value:
                    k, node = np.nonzero(feature[t] >= 0)
                    np.add.at(own, (k, feature[t][k, node]), gain[t][k, node])
                total = own.sum(axis=1)
                w = (own[total > 0] / total[total > 0][:, None]).sum(axis=0) / max(1, (total > 0).sum())
                keep = np.flatnonzero(w > least)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(keep)), names.take(pa.array([t] * len(keep), pa.int64())), pa.array(w[keep])], ["i", "j", "w"])

    kind = table.kind.simpleString()
    return spark.range(p).mapInArrow(run, f"i {kind}, j {kind}, w double")


def first_splits(m: DataFrame) -> DataFrame:
    """(target, feature, bin, gain): the best first split of every target over all samples and all other features."""
    table = Table(m)
    (feature, cut, gain), *_ = levels(table, trees=1, depth=1, many=len(table.names), bootstrap=False) or [(np.empty((0, 1, 1), int),) * 3]
    kind = table.kind.simpleString()
    rows = [(table.names[t], table.names[f], int(c), float(g)) for t, (f, c, g) in enumerate(zip(feature[:, 0, 0].tolist(), cut[:, 0, 0].tolist(), gain[:, 0, 0].tolist())) if f >= 0]
    return m.sparkSession.createDataFrame(rows, f"target {kind}, feature {kind}, bin int, gain double")
