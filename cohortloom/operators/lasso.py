"""Sparse precision networks fitted on covariances: penalties by cross-validation or by stability, arms by the number of samples.

One pass of masked sums (gram.moments) gives the covariances of every network: of all its samples,
of each fold and of each subsample. No sample leaves its partition for a fit; tasks get features ×
features tables, at most gram.WIDTH features a network (see matrix.prefilter). Networks are few, one row each on the driver.

A network of fewer than 40 samples has no edges, one of 40 to 69 gets its penalty by stability, a larger one by
five folds. A fit that fails there leaves the network empty; with stability 1.5 and 2 times the penalty and 0.1 are tried first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from . import gram
from .gram import SUMS

FOLDS = 5
SUBSAMPLES, SHARE = 20, 0.8
#: Ten penalties from 1 down to 10 ** -2.5.
PENALTIES = tuple(float(10 ** (-2.5 * k / 9)) for k in range(10))
UNSTABLE = 0.05
LEAST_STARS, LEAST_CV = 40, 70
EDGE = 1e-5


def fold_bits(sample_id: Column, folds: int = FOLDS) -> Column:
    """A sample's fold as a bit: the first six digits of its id's md5 modulo the folds."""
    number = F.conv(F.substring(F.md5(sample_id.cast("string").cast("binary")), 1, 6), 16, 10).cast("long")
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(folds)).cast("int"))


def subsample_bits(samples: DataFrame, by: list[str], subsamples: int = SUBSAMPLES, share: float = SHARE) -> DataFrame:
    """(by, sample_id, member): bit s is set if the sample is among the floor(share * n) of its group that subsample s takes.

    Subsample s takes the least by the md5 of "id:s", ties by id. Samples are counted by the hash's first three digits; only those of the
    one prefix at the bound are ranked.
    """
    keys = [*by, "s"]
    h = F.md5(F.concat(F.col("sample_id").cast("string"), F.lit(":"), F.col("s").cast("string")).cast("binary"))
    each = samples.select(*by, "sample_id").distinct().withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(subsamples - 1)))).withColumn("h", F.substring(h, 1, 8)).withColumn("p", F.substring("h", 1, 3))
    over = Window.partitionBy(*keys)  # 4,096 prefixes at most
    counts = each.groupBy(*keys, "p").agg(F.count("*").alias("n"))
    bounds = counts.select(*keys, "p", "n", (F.sum("n").over(over.orderBy("p")) - F.col("n")).alias("before"), F.floor(F.lit(share) * F.sum("n").over(over)).alias("most"))
    joined = each.join(bounds, [*keys, "p"]).where("before < most")
    at = joined.where("before + n > most").withColumn("r", F.row_number().over(Window.partitionBy(*keys, "p").orderBy("h", "sample_id"))).where("before + r <= most")
    taken = joined.where("before + n <= most").select(*by, "sample_id", "s").unionByName(at.select(*by, "sample_id", "s"))
    bits = taken.groupBy(*by, "sample_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s"))).alias("member"))
    return samples.select(*by, "sample_id").distinct().join(bits, [*by, "sample_id"], "left").withColumn("member", F.coalesce("member", F.lit(0).cast("long")))


def covariance(sums: list[np.ndarray]) -> np.ndarray:
    n, sa, sb, _, _, sab = sums
    return (sab - sa * sb / n) / n


def deviations(cov: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-8


def scaled(cov: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return cov / np.outer(sd, sd)


class Networks:
    """The tables of the sums of some networks: whole (by, sums) and parts (by, set, sums of the set and of the whole)."""

    def __init__(self, m: DataFrame, by: list[str], member: Column | None, sets: int):
        found, self.names, _ = gram.moments(m, by, member, sets)
        if len(self.names) > gram.WIDTH:
            raise ValueError(f"a network of over {gram.WIDTH} features: filter them first")
        self.by, self.kind = by, m.schema["feature_id"].dataType
        found = found.persist()  # a few tables; computed again if an executor is lost
        self.schema = "".join(f"`{c}` {m.schema[c].dataType.simpleString()}, " for c in by)
        self.whole = found.where("set = -1").select(*by, *SUMS)
        self.parts = found.where("set >= 0").join(self.whole.select(*by, *[F.col(s).alias(f"w_{s}") for s in SUMS]), by) if by else found.where("set >= 0").crossJoin(F.broadcast(self.whole.select(*[F.col(s).alias(f"w_{s}") for s in SUMS])))

    def opened(self, t: pa.RecordBatch, i: int, prefix: str = "") -> list[np.ndarray]:
        p = len(self.names)
        return gram.shaped([t.column(prefix + s)[i].as_buffer() for s in SUMS], (p, p))

    def key(self, t: pa.RecordBatch, i: int) -> tuple:
        return tuple(t.column(c)[i].as_py() for c in self.by)

    def over(self, tables: DataFrame, work, schema: str) -> DataFrame:
        """Rows of work(key, row, batch): lists of columns for each table; each is a task's row."""
        by = self.by

        def run(batches):
            for t in batches:
                for i in range(t.num_rows):
                    columns = work(self.key(t, i), i, t)
                    n = len(columns[0])
                    yield pa.RecordBatch.from_arrays([t.column(c).take(pa.array([i] * n, pa.int32())) for c in by] + [pa.array(c) for c in columns], by + [x.strip().split(" ")[0].strip("`") for x in schema.split(",")])

        return tables.repartition(*by, *(["set"] if "set" in tables.columns else [])).mapInArrow(run, self.schema + schema) if by or "set" in tables.columns else tables.mapInArrow(run, self.schema + schema)

    def __getstate__(self):  # tasks need the names only
        return {"by": self.by, "names": self.names, "kind": self.kind}

    def train(self, t: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(covariance of all but the set, covariance of the set), both by the deviations of all; None if the set is all."""
        whole, own = self.opened(t, i, "w_"), self.opened(t, i)
        if not (whole[0] > own[0]).all():
            return None
        sd = deviations(covariance(whole))
        return scaled(covariance([w - o for w, o in zip(whole, own)]), sd), scaled(covariance(own), sd)

    def subsample(self, t: pa.RecordBatch, i: int) -> np.ndarray:
        own = covariance(self.opened(t, i))
        return scaled(own, deviations(own))

    def standard(self, t: pa.RecordBatch, i: int) -> np.ndarray:
        whole = covariance(self.opened(t, i))
        return scaled(whole, deviations(whole))

    def pairs(self):
        from pyspark.sql.pandas.types import to_arrow_type

        i, j = np.triu_indices(len(self.names))
        names = pa.array(self.names, to_arrow_type(self.kind))
        return i, j, names.take(pa.array(i)), names.take(pa.array(j))

    def covariances(self, kind: str) -> DataFrame:
        """(by, set, i, j, cov) for i <= j: of all but a fold ("train") or of a subsample ("subsample")."""

        def work(key, i, t):
            a, b, first, second = self.pairs()
            two = self.train(t, i) if kind == "train" else (self.subsample(t, i), None)
            if two is None:
                a, b, first, second = a[:0], b[:0], first[:0], second[:0]
            cov = two[0] if two else np.zeros((len(self.names),) * 2)
            return [pa.array([t.column("set")[i].as_py()] * len(a), pa.int32()), first, second, cov[a, b]]

        name = self.kind.simpleString()
        return self.over(self.parts, work, f"set int, i {name}, j {name}, cov double")


def folded(m: DataFrame, by: list[str], folds: int = FOLDS) -> Networks:
    return Networks(m, by, fold_bits(F.col("sample_id"), folds), folds)


def subsampled(m: DataFrame, by: list[str], subsamples: int = SUBSAMPLES) -> Networks:
    bits = subsample_bits(m, by, subsamples)
    return Networks(m.join(bits, [*by, "sample_id"]), by, F.col("member"), subsamples)


def likelihood(cov: np.ndarray, theta: np.ndarray) -> float:
    """Mean log-likelihood a sample of covariance cov under precision theta; the worst if that is no precision matrix."""
    sign, logdet = np.linalg.slogdet(theta)
    return float((logdet - (cov * theta).sum() - len(cov) * np.log(2 * np.pi)) / 2) if sign > 0 else -1e300


def path(cov: np.ndarray, penalties) -> list[np.ndarray | None]:
    """A fit for each penalty, from the largest down, each started at the one before; None where a fit fails."""
    out: dict = {}
    start = None
    for alpha in sorted(penalties, reverse=True):
        fit = kernels.graphical_lasso(cov, alpha, steps=500, tol=1e-4, start=start)
        out[alpha], start = fit, fit if fit is not None else start
    return [out[a] for a in penalties]


def next_penalties(scores: dict[float, float], size: int) -> list[float]:
    """`size` penalties between the neighbours of the best so far, evenly on the log scale; below the least, down to a hundredth of it."""
    tried = sorted(scores, reverse=True)
    k = max(range(len(tried)), key=lambda i: (scores[tried[i]], -i))
    high, low = tried[max(k - 1, 0)], tried[k + 1] if k + 1 < len(tried) else tried[k] / 100
    return np.logspace(np.log10(high), np.log10(low), size + 2)[1:-1].tolist()


def cross_validated(nets: Networks, size: int = 4, rounds: int = 5) -> dict[tuple, float]:
    """The penalty of each network by the folds' mean held-out likelihood: `rounds` rounds of `size` penalties, each round around the best so far."""
    most = nets.over(nets.whole, lambda key, i, t: [[float(np.abs(s - np.diag(np.diag(s))).max(initial=0))] for s in [nets.standard(t, i)]], "most double").collect()
    keys = {tuple(r[c] for c in nets.by): r["most"] for r in most}
    scores: dict = {k: {} for k in keys}
    ask = {k: np.logspace(np.log10(v), np.log10(v / 100), size).tolist() for k, v in keys.items() if v > 0}
    for _ in range(rounds):
        if not ask:
            break
        sent = nets.whole.sparkSession.sparkContext.broadcast(ask)

        def work(key, i, t):
            two = nets.train(t, i)
            asked = sent.value.get(key, []) if two else []
            train, held = two or (None, None)
            fits = path(train, asked) if two else []
            return [pa.array(asked, pa.float64()), pa.array([likelihood(held, f) if f is not None else -1e300 for f in fits], pa.float64())]

        got = nets.over(nets.parts, work, "alpha double, score double").groupBy(*nets.by, "alpha").agg(F.avg("score").alias("score")).collect()
        for r in got:
            scores[tuple(r[c] for c in nets.by)][r["alpha"]] = r["score"]
        ask = {k: next_penalties(scores[k], size) for k in ask if scores[k]}
    return {k: max(s, key=lambda a: (s[a], a)) for k, s in scores.items() if s}


def instabilities(nets: Networks, penalties=PENALTIES, subsamples: int = SUBSAMPLES) -> DataFrame:
    """(by, lambda, instability): the mean over feature pairs of 2 t (1 - t), t the share of subsamples that have the edge. A failed fit has none."""
    p = len(nets.names)

    def work(key, i, t):
        lam, first, second = [], [], []
        for alpha, fit in zip(penalties, path(nets.subsample(t, i), penalties)):
            a, b = np.nonzero(np.triu(np.abs(fit) > EDGE, 1)) if fit is not None else (np.empty(0, int),) * 2
            lam += [alpha] * len(a)
            first += a.tolist()
            second += b.tolist()
        return [pa.array(lam, pa.float64()), pa.array(first, pa.int32()), pa.array(second, pa.int32())]

    spark = nets.whole.sparkSession
    share = nets.over(nets.parts, work, "lambda double, i int, j int").groupBy(*nets.by, "lambda", "i", "j").agg((F.count("*") / F.lit(subsamples)).alias("t"))
    some = share.groupBy(*nets.by, "lambda").agg((F.sum(2 * F.col("t") * (1 - F.col("t"))) / F.lit(max(1, p * (p - 1) // 2))).alias("instability"))
    every = nets.whole.select(*nets.by).crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in penalties], "lambda double")))
    return every.join(some, [*nets.by, "lambda"], "left").withColumn("instability", F.coalesce("instability", F.lit(0.0)))


def stable_penalty(path_of: DataFrame, by: list[str], beta: float = UNSTABLE) -> DataFrame:
    """(by, lambda): the smallest penalty before the first whose instability passes beta, walking down from the largest; the largest if that passes."""
    w = Window.partitionBy(*by).orderBy(F.desc("lambda"))  # a handful of penalties
    walked = path_of.withColumn("broken", F.max((F.col("instability") > beta).cast("int")).over(w))
    return walked.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("broken") == 0, F.col("lambda"))), F.max("lambda")).alias("lambda"))


def edges_of(nets: Networks, penalties: dict[tuple, list[float]], method: str) -> DataFrame:
    """(by, i, j, weight, method): |precision| above EDGE of the first penalty of each network that can be fitted."""
    sent = nets.whole.sparkSession.sparkContext.broadcast(penalties)

    def work(key, i, t):
        cov = nets.standard(t, i)
        fit = next((f for a in sent.value.get(key, []) if (f := kernels.graphical_lasso(cov, a, tol=1e-6)) is not None), None)
        a, b, first, second = nets.pairs()
        w = np.abs(fit[a, b]) if fit is not None else np.zeros(len(a))
        keep = np.flatnonzero((a < b) & (w > EDGE))
        return [first.take(pa.array(keep)), second.take(pa.array(keep)), w[keep], pa.array([method] * len(keep), pa.string())]

    name = nets.kind.simpleString()
    return nets.over(nets.whole, work, f"i {name}, j {name}, weight double, method string")


def fixed(m: DataFrame, by: list[str], penalty: float) -> DataFrame:
    nets = Networks(m, by, None, 0)
    return edges_of(nets, {tuple(r): [penalty] for r in nets.whole.select(*by).collect()}, "Fixed")


def networks(m: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, j, weight, method) of every network of m(by, sample_id, feature_id, value), by the arm of its size."""
    sizes = m.groupBy(*by).agg(F.count_distinct("sample_id").alias("_n"))
    own = lambda low, high: m.join(sizes.where((F.col("_n") >= low) & (F.col("_n") < high)).select(*by), by, "left_semi")
    folds = folded(own(LEAST_CV, 1 << 62), by)
    by_folds = edges_of(folds, {k: [a] for k, a in cross_validated(folds).items()}, "CV")
    subs = subsampled(own(LEAST_STARS, LEAST_CV), by)
    chosen = {tuple(r[c] for c in by): r["lambda"] for r in stable_penalty(instabilities(subs), by).collect()}
    return by_folds.unionByName(edges_of(subs, {k: [a, 1.5 * a, 2 * a, 0.1] for k, a in chosen.items()}, "StARS"))
