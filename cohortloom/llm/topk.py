"""Exact top-k search by inner product with cover trees on both sides.

Vectors become whole numbers. Every vector goes to the nearest of a bounded set of centres (the
trees' upper level: chosen by the covering rule from a sample), and a centre's vectors are cut into
blocks. A block is stored with its cover tree: a node covers its points within its radius, its
children cover them within half of it, sit at least that far apart, and the first keeps the
node's centre; a node whose next level would hold over half as many children as points stays a
leaf. Query vectors are grouped and indexed the same way.

A pair of nodes can hold no score above <q, p> + r_q |p| + r_p |q| + r_q r_p, for centres q, p and radii
r_q, r_p. The search goes down both trees and drops each pair whose bound is below the worst k-th score
of the query node. The same bound, between a query group and a centre, decides which blocks a
group is sent to at all: each query starts from its k-th score within the sample, then meets one
block of its own centre, then all blocks that the bound still admits. Blocks and groups meet by an
equi-join; nothing is a product of rows.

Equal vectors have equal scores, so the k + 1 smallest ids of each distinct vector are kept, and equal
queries are searched once (for k + 1, from which a query's own row is taken out afterwards).

Edge cases: a vector that is null, holds a null, NaN or infinite component, or one whose whole number passes
2^26 (scores could leave 64 bits), or has no id, takes no part. Vectors of different lengths count as filled
up with zeros. Several rows of one id are queries and candidates each for itself; equal ones give their
results once a row. Fewer than k others give all of them; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table
from .vector_codes import usable

SCALE = 256
K = 5
#: Vectors of the sample, and centres chosen from it.
SAMPLE = 1024
CENTRES = 64
#: Vectors of a block, query vectors of a group, points of a leaf.
BLOCK = 2048
GROUP = 256
LEAF = 32
LARGEST = 1 << 26


def away(x: np.ndarray, c: int) -> np.ndarray:
    """Distances of the points from point c, by differences, so that equal points are at 0 exactly."""
    d = x - x[c]
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class CoverTree:
    """Nodes over slices of `order`, rows of `nodes`: lo, hi, radius, and the children's numbers as first and count."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        nodes = [[0, len(x), 0.0, 0, 0]] if len(x) else []
        at = 0
        while at < len(nodes):
            lo, hi = nodes[at][:2]
            members = self.order[lo:hi]  # the centre is the first of them
            far = away(x[members], 0)
            nodes[at][2] = float(far.max())
            parts = self.level(x, members, far, nodes[at][2] / 2) if hi - lo > LEAF and nodes[at][2] > 0 else []
            if parts:
                nodes[at][3:] = [len(nodes), len(parts)]
                self.order[lo:hi] = np.concatenate(parts)
                for p in parts:
                    nodes.append([lo, lo + len(p), 0.0, 0, 0])
                    lo += len(p)
            at += 1
        self.nodes = np.array(nodes, float).reshape(-1, 5)

    @staticmethod
    def level(x, members, far, radius) -> list[np.ndarray]:
        """Members by children that cover them within the radius, each child's centre first; none if children are too many."""
        parts, left = [], members
        while len(left):
            near = far <= radius
            parts.append(left[near])
            left = left[~near]
            if len(parts) % 16 == 0 and 2 * len(parts) > len(members) - len(left):
                return []
            if len(left):
                far = away(x[left], 0)
        return parts if 2 * len(parts) <= len(members) else []


class Side:
    """Points in the order of their tree, with the nodes' centres, norms and radii."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray):
        self.x = x
        self.lo, self.hi, self.first, self.count = (nodes[:, k].astype(int) for k in (0, 1, 3, 4))
        self.radius = nodes[:, 2]
        self.centre = x[self.lo] if len(nodes) else x[:0]  # a node's centre is the first of its points
        self.norm = np.sqrt((self.centre**2).sum(axis=1))

    def below(self, node: int) -> np.ndarray:
        n = self.count[node]
        return np.arange(self.first[node], self.first[node] + n) if n else np.array([node])


def bound(dot, q_norm, q_radius, p_norm, p_radius):
    """No inner product of a point within q_radius of q and one within p_radius of p is greater; rounding included."""
    return dot + q_radius * p_norm + p_radius * q_norm + q_radius * p_radius + 1e-9 * (q_norm + q_radius + 1) * (p_norm + p_radius + 1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where every sum fits 53 bits, else in int64."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return a @ b.T if most < 2**53 else a.astype(np.int64) @ b.T.astype(np.int64)


def search(q: Side, d: Side, ids: np.ndarray, low: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query the (score, id) that can be among its k best: at least `low` and the k-th best found here, ties to the smaller id."""
    found: list[list[tuple[int, int]]] = [[] for _ in low]
    worst = low.astype(float).copy()
    stack = [(0, 0, np.inf)] if len(q.lo) and len(d.lo) else []
    while stack:
        a, b, most = stack.pop()
        lo, hi = q.lo[a], q.hi[a]
        if most < worst[lo:hi].min():
            continue
        if q.count[a] or d.count[b]:
            left, right = (q.below(a), d.below(b)) if q.count[a] and d.count[b] else (q.below(a), np.array([b])) if q.count[a] else (np.array([a]), d.below(b))
            tops = bound(q.centre[left] @ d.centre[right].T, q.norm[left][:, None], q.radius[left][:, None], d.norm[right][None], d.radius[right][None])
            need = np.array([worst[q.lo[n] : q.hi[n]].min() for n in left])
            i, j = np.nonzero(tops >= need[:, None])
            best_last = np.argsort(tops[i, j], kind="stable")
            stack += [(int(left[i[n]]), int(right[j[n]]), float(tops[i[n], j[n]])) for n in best_last]
            continue
        score = products(q.x[lo:hi], d.x[d.lo[b] : d.hi[b]])
        own = ids[d.lo[b] : d.hi[b]]
        for r in np.flatnonzero((score >= worst[lo:hi][:, None]).any(axis=1)).tolist():
            row = score[r]
            got = np.flatnonzero(row >= worst[lo + r])
            if len(got) > k:
                got = got[row[got] >= np.partition(row[got], -k)[-k]]
            every = sorted([*found[lo + r], *((int(row[c]), int(own[c])) for c in got)], key=lambda t: (-t[0], t[1]))[:k]
            found[lo + r] = every
            if len(every) == k:
                worst[lo + r] = max(worst[lo + r], every[-1][0])
    return found


def floats(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1) if vectors and vectors[0] else np.zeros((len(vectors), 0))


def chosen_centres(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` points of the sample, each the farthest from those before: they cover the sample within the distance of the next."""
    if not len(sample):
        return sample
    near, out = np.full(len(sample), np.inf), [0]
    while True:
        near = np.minimum(near, ((sample - sample[out[-1]]) ** 2).sum(axis=1))
        if len(out) == most or near.max() == 0:
            return sample[out]
        out.append(int(near.argmax()))


def placed(rows: DataFrame, width: int, centres: np.ndarray) -> DataFrame:
    """(id, v binary, cell int, away double): whole numbers as doubles, the nearest centre and the distance from it."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        c = sent.value
        half = (c * c).sum(axis=1) / 2
        for b in batches:
            x = np.zeros((b.num_rows, width))
            for k, v in enumerate(b.column("v")):
                got = v.values.to_numpy(zero_copy_only=False)
                x[k, : len(got)] = np.floor(got * SCALE)
            cell = (half - x @ c.T).argmin(axis=1)
            far = np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "v", "cell", "away"])

    return rows.mapInArrow(run, "id long, v binary, cell int, away double")


def indexed(points: DataFrame, sizes: DataFrame, most: int, columns: list[str]) -> DataFrame:
    """One row a block of up to about `most` points of a cell: (cell, block, x binary, nodes binary, and each column as an array), in the order of its tree."""
    dealt = points.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / F.lit(most))).cast("int"))
    packed = dealt.groupBy("cell", "block").agg(F.array_sort(F.collect_list(F.struct("v", *columns))).alias("p"))
    kinds = {c: points.schema[c].dataType.simpleString() for c in columns}

    def run(batches):
        for b in batches:
            for cell, block, p in zip(b.column("cell").to_pylist(), b.column("block").to_pylist(), b.column("p")):
                x = floats(p.values.field("v").to_pylist())
                tree = CoverTree(x)
                lists = [p.values.field(c).to_numpy(zero_copy_only=False)[tree.order] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([block], pa.int32()), pa.array([x[tree.order].tobytes()], pa.binary()), pa.array([tree.nodes.tobytes()], pa.binary()), *(pa.array([v]) for v in lists)], ["cell", "block", "x", "nodes", *columns])

    return packed.mapInArrow(run, "cell int, block int, x binary, nodes binary, " + ", ".join(f"{c} array<{k}>" for c, k in kinds.items()))


def opened(x: bytes, nodes: bytes, width: int) -> Side:
    return Side(np.frombuffer(x, "<f8").reshape(-1, width), np.frombuffer(nodes).reshape(-1, 5))


def admitted(groups: DataFrame, cells: list, centres: np.ndarray, width: int) -> DataFrame:
    """groups by each (cell, block) that may hold a score not below the group's worst k-th; cells are (cell, radius, blocks)."""
    sent = groups.sparkSession.sparkContext.broadcast((cells, centres))

    def run(batches):
        cells, centres = sent.value
        at, radius, blocks = np.array([c[0] for c in cells]), np.array([c[1] for c in cells]), np.array([c[2] for c in cells])
        c = centres[at]
        norm = np.sqrt((c * c).sum(axis=1))
        for b in batches:
            for k in range(b.num_rows):
                x, low = opened(b.column("x")[k].as_py(), b.column("nodes")[k].as_py(), width), b.column("low")[k].values.to_numpy()
                tops = bound(c @ x.centre[0], x.norm[0], x.radius[0], norm, radius)
                keep = np.flatnonzero(tops >= low.min())
                to = [(int(at[n]), m) for n in keep for m in range(blocks[n])]
                yield pa.RecordBatch.from_arrays([b.column("cell").slice(k, 1), b.column("block").slice(k, 1), pa.array([[{"to_cell": i, "to_block": m} for i, m in to]], pa.list_(pa.struct([("to_cell", pa.int32()), ("to_block", pa.int32())])))], ["cell", "block", "to"])

    found = groups.select("cell", "block", "x", "nodes", "low").mapInArrow(run, "cell int, block int, to array<struct<to_cell:int,to_block:int>>")
    return found.select("cell", "block", F.explode("to").alias("to")).select("cell", "block", "to.*")


def met(groups: DataFrame, pairs: DataFrame, blocks: DataFrame, width: int, k: int) -> DataFrame:
    """(rep, score, id) from every pair of a group and a block."""
    asked = groups.join(pairs, ["cell", "block"]).select(F.col("to_cell").alias("cell"), F.col("to_block").alias("block"), F.col("x").alias("qx"), F.col("nodes").alias("qnodes"), "rep", "low")
    both = asked.join(blocks, ["cell", "block"])

    def run(batches):
        for b in batches:
            for qx, qn, x, n, rep, low, ids in zip(*(b.column(c) for c in ("qx", "qnodes", "x", "nodes", "rep", "low", "id"))):
                found = search(opened(qx.as_py(), qn.as_py(), width), opened(x.as_py(), n.as_py(), width), ids.values.to_numpy(), low.values.to_numpy(), k)
                names = rep.values.to_numpy()
                flat = [(names[r], s, i) for r, own in enumerate(found) for s, i in own]
                yield pa.RecordBatch.from_arrays([pa.array([t[c] for t in flat], pa.int64()) for c in range(3)], ["rep", "score", "id"])

    return both.select("qx", "qnodes", "x", "nodes", "rep", "low", "id").mapInArrow(run, "rep long, score long, id long")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(rep, best array of (minus, id)): the k best of each query vector."""
    rank = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "id"))
    kept = found.withColumn("r", rank).where(F.col("r") <= k)
    return kept.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("best"))


def top_k(rows: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", centres: int = CENTRES, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k greatest inner products of each query with the other rows, ties to the smaller id."""
    spark = rows.sparkSession
    fits = ~F.exists(F.col(vec_col), lambda x: F.abs(x.cast("double")) >= float(LARGEST // SCALE))
    vectors = rows.withColumn("_asks", is_query).where(usable(F.col(vec_col)) & fits & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), "_asks")
    width = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    if not width:
        vectors, width = vectors.withColumn("v", F.array(F.lit(0.0))), 1
    sample = vectors.select("v", F.xxhash64("v", "id").alias("h")).orderBy("h").limit(SAMPLE).collect()
    seen = np.array([[np.floor(c * SCALE) for c in r["v"]] + [0.0] * (width - len(r["v"])) for r in sample]).reshape(-1, width)
    middle = chosen_centres(seen, centres)

    every = placed(vectors, width, middle)
    # the k + 1 smallest ids of each distinct vector, first by parts, so that a vector of many rows meets in no one task
    parts = Window.partitionBy("v", "part").orderBy("id")
    first = every.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("r", F.row_number().over(parts)).where(F.col("r") <= k + 1)
    points = checkpoint(first.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1).select("id", "v", "cell", "away"))
    asking = checkpoint(placed(vectors.where("_asks"), width, middle).select("id", "v", "cell"))
    queries = started(asking.groupBy("v", "cell").agg(F.min("id").alias("first")), seen, k, width)
    # ids may repeat over different vectors: the name of a query vector is its own number
    queries = checkpoint(queries.withColumn("rep", F.monotonically_increasing_id()))

    sizes = points.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
    blocks = checkpoint(indexed(points.select("id", "v", "cell"), sizes.select("cell", "n"), block, ["id"]))
    groups = checkpoint(indexed(queries.select("rep", "low", "v", "cell"), queries.groupBy("cell").agg(F.count("*").alias("n")), group, ["rep", "low"]))
    cells = [(r["cell"], r["radius"] * (1 + 1e-12), -(-r["n"] // block)) for r in sizes.collect()]

    # a block of the group's own centre first; its scores raise what the rest must reach
    held = spark.createDataFrame([(c, n) for c, _, n in cells], "cell int, n int")
    own = groups.join(F.broadcast(held), "cell").select("cell", "block", F.col("cell").alias("to_cell"), F.pmod(F.col("block"), "n").alias("to_block"))
    near = checkpoint(met(groups, own, blocks, width, k + 1))
    raised = near.groupBy("rep").agg(F.count("*").alias("m"), F.min("score").alias("least")).where(F.col("m") == k + 1)
    better = queries.join(raised, "rep", "left").withColumn("low", F.greatest("low", F.coalesce(F.col("least").cast("double"), "low"))).select("rep", "low", "v", "cell")
    groups = checkpoint(indexed(better, queries.groupBy("cell").agg(F.count("*").alias("n")), group, ["rep", "low"]))
    rest = admitted(groups, cells, middle, width).join(own, ["cell", "block", "to_cell", "to_block"], "left_anti")
    found = checkpoint(best_of(near.unionByName(met(groups, rest, blocks, width, k + 1)), k + 1))

    named = checkpoint(queries.join(found, "rep").select("v", "best"))
    answers = asking.select("id", "v").join(named, "v")
    return without_own(answers, width, k)


def started(queries: DataFrame, sample: np.ndarray, k: int, width: int) -> DataFrame:
    """Adds low: the (k + 1)-th greatest score of the query within the sample, which no worse row can pass."""
    sent = queries.sparkSession.sparkContext.broadcast(sample)

    def run(batches):
        for b in batches:
            low = np.full(b.num_rows, -np.inf)
            if len(sent.value) > k and b.num_rows:
                low = np.partition(products(floats(b.column("v").to_pylist()), sent.value), -k - 1, axis=1)[:, -k - 1].astype(float)
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("cell"), pa.array(low)], ["v", "cell", "low"])

    return queries.select("v", "cell").mapInArrow(run, "v binary, cell int, low double")


def without_own(answers: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from (id, v, best), one row of the query's id and of its vector's product with itself left out."""

    def run(batches):
        for b in batches:
            out = []
            for i, v, best in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), b.column("best").to_pylist()):
                x = floats([v])
                own = (-int(products(x, x)[0, 0]), i)
                pairs = [(t["minus"], t["id"]) for t in best]
                if own in pairs:
                    pairs.remove(own)
                out += [(i, r + 1, j, -m) for r, (m, j) in enumerate(pairs[:k])]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([t[c] for t in out], kinds[c]) for c in range(4)], ["query_id", "rank", "vec_id", "score"])

    return answers.mapInArrow(run, "query_id long, rank int, vec_id long, score long")


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP12_SQL = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5"""
