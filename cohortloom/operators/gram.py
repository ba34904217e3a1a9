"""Sums of products of features, block by block: the sufficient statistics of correlations, covariances and matrix products.

Samples are dense chunks inside a task; what leaves it are partial sums of feature blocks (at most WIDTH ×
WIDTH numbers each), never sample × feature pairs. Features are cut into blocks of WIDTH; with one block
the sums are made where the samples are, with more the chunks' column blocks meet by an equi-join on the
chunk. Partial sums of one block are added one at a time as they stream by, sorted by block. The feature
ids, one row each, are the matrix's short side and are known to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

WIDTH = 512
#: Bytes of samples, or of sums, that a task holds before it passes them on.
HELD = 1 << 25
SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def named_types(df: DataFrame, by: list[str]) -> str:
    """The columns as the head of a schema."""
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def columns_of(m: DataFrame) -> tuple[list, np.ndarray]:
    """The feature ids in order, and a value of each to count from (its least: a constant feature becomes 0)."""
    rows = sorted(m.where("value is not null").groupBy("feature_id").agg(F.min("value").alias("low")).collect(), key=lambda r: r["feature_id"])
    return [r["feature_id"] for r in rows], np.array([r["low"] for r in rows], float)


def placed(m: DataFrame, names: list, col: str = "feature_id", out: str = "place") -> DataFrame:
    """m with the place of `col` among the names."""
    kind = m.schema[col].dataType.simpleString()
    known = m.sparkSession.createDataFrame(list(zip(names, range(len(names)))), f"`{col}` {kind}, `{out}` int")
    return m.join(known, col)


def sample_rows(m: DataFrame, names: list, by: list[str], member: Column | None) -> DataFrame:
    """(by, member, cells): each sample's (place, value); member's bits are the sets that the sample is in besides that of all."""
    once = placed(m.where("value is not null"), names).withColumn("_member", F.lit(0).cast("long") if member is None else member.cast("long"))
    return once.groupBy("sample_id", "_member", *by).agg(F.collect_list(F.struct("place", F.col("value").cast("double").alias("value"))).alias("cells"))


def chunks(batches, by: list[str], low: np.ndarray) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(key, samples × features with NaN where absent, members) of up to about HELD bytes in all."""
    held: dict[tuple, list] = {}
    size = 0
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in by))) if by else [()] * b.num_rows
        members = b.column("_member").to_numpy()
        cells = b.column("cells")
        flat, ends = cells.flatten(), cells.offsets.to_numpy()
        place, value = flat.field("place").to_numpy(), flat.field("value").to_numpy(zero_copy_only=False)
        first = ends[0]
        for k, key in enumerate(keys):
            row = np.full(len(low), np.nan)
            part = slice(ends[k] - first, ends[k + 1] - first)
            row[place[part]] = value[part]
            held.setdefault(key, []).append((row - low, members[k]))
            size += row.nbytes
        if size >= HELD:
            for key, rows in held.items():
                yield key, np.array([r for r, _ in rows]), np.array([s for _, s in rows])
            held, size = {}, 0
    for key, rows in held.items():
        yield key, np.array([r for r, _ in rows]), np.array([s for _, s in rows])


def sums_of(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """SUMS over the samples that have both features, for every pair of columns; shapes that broadcast to the pairs' table."""
    mx, my = ~np.isnan(x), ~np.isnan(y)
    if mx.all() and my.all():
        return [np.full((1, 1), float(len(x))), x.sum(axis=0)[:, None], y.sum(axis=0)[None], (x * x).sum(axis=0)[:, None], (y * y).sum(axis=0)[None], x.T @ y]
    x, y, mx, my = np.where(mx, x, 0), np.where(my, y, 0), mx.astype(float), my.astype(float)
    return [mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y]


def shaped(values: list, wide: tuple[int, int]) -> list[np.ndarray]:
    """The stored sums as arrays again."""
    a, b = wide
    one = {"n": (1, (1, 1)), "sa": (a, (a, 1)), "saa": (a, (a, 1)), "sb": (b, (1, b)), "sbb": (b, (1, b))}
    out = []
    for name, v in zip(SUMS, values):
        v = np.frombuffer(v)
        size, shape = one.get(name, (0, wide))
        out.append(v.reshape(shape if len(v) == size else wide))
    return out


class Totals:
    """Sums by key, handed on once they take HELD bytes."""

    def __init__(self, add: Callable):
        self.add, self.held, self.size = add, {}, 0

    def put(self, key, value: list[np.ndarray]):
        if key in self.held:
            self.held[key] = self.add(self.held[key], value)
        else:
            self.held[key] = value
            self.size += sum(v.nbytes for v in value)
        if self.size >= HELD:
            yield from self.rest()

    def rest(self):
        held, self.held, self.size = self.held, {}, 0
        yield from held.items()


def _added(a, b):
    return [x + y for x, y in zip(a, b)]


def record(keys: list, names: list[str], value: list[np.ndarray], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], t) for k, t in zip(keys, types)] + [pa.array([np.ascontiguousarray(v, float).tobytes()], pa.binary()) for v in value], names)


def summed(partial: DataFrame, keys: list[str], values: list[str], opened: Callable) -> DataFrame:
    """One row a key: the sum of its rows' arrays, added as they stream by in the order of the keys. opened(key, buffers) gives the arrays."""
    schema = partial.schema
    sorted_rows = partial.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        now, total = None, None
        for b in batches:
            types = [b.schema.field(k).type for k in keys]
            rows = list(zip(*(b.column(k).to_pylist() for k in keys)))
            for i, key in enumerate(rows):
                value = opened(key, [b.column(v)[i].as_buffer() for v in values])
                if key == now:
                    total = _added(total, value)
                else:
                    if now is not None:
                        yield record(now, keys + values, total, types)
                    now, total = key, value
        if now is not None:
            yield record(now, keys + values, total, types)

    return sorted_rows.select(*keys, *values).mapInArrow(run, ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in keys + values))


def moments(m: DataFrame, by: list[str] | None = None, member: Column | None = None, sets: int = 0, width: int = WIDTH) -> tuple[DataFrame, list, np.ndarray]:
    """((by, set, a, b, sums), feature ids, offsets) of a long matrix: for every group, set of samples and pair of feature blocks a <= b the SUMS of value - offset.

    Set -1 is all samples; sample s is in set k if bit k of `member` (below `sets`, 62 at most) is set.
    """
    by = by or []
    names, low = columns_of(m)
    rows = sample_rows(m, names, by, member)
    blocks = max(1, -(-len(names) // width))
    kinds = named_types(rows, by)
    keys = [*by, "set", "a", "b"]
    schema = f"{kinds}set int, a int, b int, " + ", ".join(f"{s} binary" for s in SUMS)
    wide = lambda k: min(width, len(names) - k * width)

    def parts(key, x, y, members, a, b):
        for s in range(-1, sets):
            inside = slice(None) if s < 0 else (members >> s & 1).astype(bool)
            if s < 0 or inside.any():
                yield (*key, s, a, b), sums_of(x[inside], y[inside])

    def records(totals, schema_of, made):
        types = [schema_of.field(c).type for c in by] + [pa.int32()] * 3
        for key, value in made:
            yield record(key, keys + list(SUMS), value, types)

    def here(batches):
        totals, seen = Totals(_added), None

        def peeked():
            nonlocal seen
            for b in batches:
                seen = b.schema
                yield b

        for key, x, members in chunks(peeked(), by, low):
            for k, v in parts(key, x, x, members, 0, 0):
                yield from records(totals, seen, totals.put(k, v))
        if seen is not None:
            yield from records(totals, seen, totals.rest())

    def cut(batches):
        from uuid import uuid4

        seen = None

        def peeked():
            nonlocal seen
            for b in batches:
                seen = b.schema
                yield b

        for key, x, members in chunks(peeked(), by, low):
            chunk = uuid4().hex
            for a in range(blocks):
                yield pa.RecordBatch.from_arrays([*(pa.array([k], seen.field(c).type) for k, c in zip(key, by)), pa.array([chunk]), pa.array([a], pa.int32()), pa.array([np.ascontiguousarray(x[:, a * width : (a + 1) * width]).tobytes()], pa.binary()), pa.array([members.tobytes()], pa.binary())], [*by, "chunk", "a", "x", "members"])

    def joined(batches):
        totals, seen = Totals(_added), None
        for t in batches:
            seen = t.schema
            for i in range(t.num_rows):
                a, b = t.column("a")[i].as_py(), t.column("b")[i].as_py()
                x, y = (np.frombuffer(t.column(c)[i].as_buffer()).reshape(-1, wide(k)) for c, k in (("x", a), ("y", b)))
                for k, v in parts(tuple(t.column(c)[i].as_py() for c in by), x, y, np.frombuffer(t.column("members")[i].as_buffer(), np.int64), a, b):
                    yield from records(totals, seen, totals.put(k, v))
        if seen is not None:
            yield from records(totals, seen, totals.rest())

    if blocks == 1:
        partial = rows.mapInArrow(here, schema)
    else:
        # chunks get random names, so they are stored before two sides of a join read them
        cols = rows.mapInArrow(cut, f"{kinds}chunk string, a int, x binary, members binary").persist()
        other = cols.select("chunk", F.col("a").alias("b"), F.col("x").alias("y"))
        partial = cols.join(other, "chunk").where("a <= b").select(*by, "a", "b", "x", "y", "members").mapInArrow(joined, schema)
    return summed(partial, keys, list(SUMS), lambda key, v: shaped(v, (wide(key[-2]), wide(key[-1])))), names, low


def correlations(m: DataFrame, width: int = WIDTH, by: list[str] | None = None) -> DataFrame:
    """(by, i, j, r) for i < j: Pearson over the samples that have both; NULL against a constant feature or without a common sample."""
    by = by or []
    found, names, _ = moments(m, by, width=width)
    kind = m.schema["feature_id"].dataType.simpleString()
    arrow = pa.array(names, to_arrow_type(m.schema["feature_id"].dataType))

    def run(batches):
        for t in batches:
            for i in range(t.num_rows):
                a, b = t.column("a")[i].as_py(), t.column("b")[i].as_py()
                wa, wb = min(width, len(names) - a * width), min(width, len(names) - b * width)
                n, sa, sb, saa, sbb, sab = shaped([t.column(s)[i].as_buffer() for s in SUMS], (wa, wb))
                with np.errstate(invalid="ignore", divide="ignore"):
                    va, vb = saa - sa * sa / n, sbb - sb * sb / n
                    # what is left of rounding when all values are one
                    va, vb = np.where(va <= 1e-13 * saa, 0, va), np.where(vb <= 1e-13 * sbb, 0, vb)
                    r = (sab - sa * sb / n) / np.sqrt(va * vb)
                met = np.broadcast_to(n > 0, (wa, wb))
                first, second = np.nonzero(met & (np.arange(wa)[:, None] + a * width < np.arange(wb)[None] + b * width))
                r = r[first, second]
                yield pa.RecordBatch.from_arrays([*(t.column(c).take(pa.array([i] * len(r), pa.int32())) for c in by), arrow.take(pa.array(first + a * width)), arrow.take(pa.array(second + b * width)), pa.array(r, mask=~np.isfinite(r))], [*by, "i", "j", "r"])

    return found.select(*by, "a", "b", *SUMS).mapInArrow(run, named_types(m, by) + f"i {kind}, j {kind}, r double")


def squared(cells: DataFrame, width: int = WIDTH, by: list[str] | None = None) -> DataFrame:
    """(by, i, j, v) for i < j: the product of each group's symmetric matrix cells(by, i, j, v) with itself, as a join of its blocks on the inner one."""
    by = by or []
    names = sorted(r[0] for r in cells.select("i").distinct().collect())
    kind, groups = cells.schema["i"].dataType.simpleString(), named_types(cells, by)
    arrow, types = pa.array(names, to_arrow_type(cells.schema["i"].dataType)), [to_arrow_type(cells.schema[c].dataType) for c in by] + [pa.int32()] * 2
    wide = lambda k: min(width, len(names) - k * width)
    keys = [*by, "a", "b"]
    key_of = lambda t, i: [t.column(c)[i].as_py() for c in keys]
    at = placed(placed(cells, names, "i", "p"), names, "j", "q")
    block = lambda c: F.floor(F.col(c) / F.lit(width)).cast("int")
    packed = at.groupBy(*by, block("p").alias("a"), block("q").alias("b")).agg(F.collect_list(F.struct((F.col("p") % width).alias("p"), (F.col("q") % width).alias("q"), F.col("v").cast("double").alias("v"))).alias("cells"))

    def dense(batches):
        for t in batches:
            for i in range(t.num_rows):
                *_, a, b = key = key_of(t, i)
                c = t.column("cells")[i].values
                x = np.zeros((wide(a), wide(b)))
                x[c.field("p").to_numpy(), c.field("q").to_numpy()] = c.field("v").to_numpy(zero_copy_only=False)
                yield record(key, [*keys, "x"], [x], types)

    blocks = packed.mapInArrow(dense, groups + "a int, b int, x binary").persist()
    left, right = blocks.select(*by, "a", F.col("b").alias("c"), "x"), blocks.select(*by, F.col("a").alias("c"), "b", F.col("x").alias("y"))

    def multiplied(batches):
        totals = Totals(_added)
        give = lambda made: (record(k, [*keys, "x"], v, types) for k, v in made)
        for t in batches:
            for i in range(t.num_rows):
                *_, a, b = key = key_of(t, i)
                c = t.column("c")[i].as_py()
                x, y = np.frombuffer(t.column("x")[i].as_buffer()).reshape(wide(a), wide(c)), np.frombuffer(t.column("y")[i].as_buffer()).reshape(wide(c), wide(b))
                yield from give(totals.put(tuple(key), [x @ y]))
        yield from give(totals.rest())

    partial = left.join(right, [*by, "c"]).where("a <= b").select(*keys, "c", "x", "y").mapInArrow(multiplied, groups + "a int, b int, x binary")
    total = summed(partial, keys, ["x"], lambda key, v: [np.frombuffer(v[0]).reshape(wide(key[-2]), wide(key[-1]))])

    def rows(batches):
        for t in batches:
            for i in range(t.num_rows):
                *_, a, b = key_of(t, i)
                x = np.frombuffer(t.column("x")[i].as_buffer()).reshape(wide(a), wide(b))
                first, second = np.nonzero(np.arange(wide(a))[:, None] + a * width < np.arange(wide(b))[None] + b * width)
                yield pa.RecordBatch.from_arrays([*(t.column(c).take(pa.array([i] * len(first), pa.int32())) for c in by), arrow.take(pa.array(first + a * width)), arrow.take(pa.array(second + b * width)), pa.array(x[first, second])], [*by, "i", "j", "v"])

    return total.mapInArrow(rows, groups + f"i {kind}, j {kind}, v double")
