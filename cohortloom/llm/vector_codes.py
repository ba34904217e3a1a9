"""Vectors compressed to codes: each part of a vector becomes the number of its nearest codebook entry.

Vectors go into columnar blocks (one numpy row a component) that are stored once in the shared
folder. A round is one RDD ``treeAggregate`` over the blocks: distances to all entries of a part
accumulate component by component, ``np.add.at`` sums the integers of each entry's parts, and
the int64 sum and count tensors (entries x components) merge through a reduction tree. Only
these tensors and the codebooks meet the driver; neither grows with the rows.

Edge cases: rows whose vector is null or holds a null, NaN or infinite component are left out.
Vectors shorter than the longest, or than a multiple of the parts, count as filled up with zeros.
Repeated ids keep one row each and start entries in the order of id, then vector; a null id comes
last. Fewer rows than entries give a shorter codebook. An empty table, or one without a usable vector,
gives no rows. Components too large for int64 distances are counted in Python's whole numbers, and
an error beyond 64 bits is null. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, pack, table, unpack

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components of a block: 4 MB as int64.
BLOCK = 1 << 19
#: Whole numbers below this have squared distances within int64 for up to 8,192 components.
NARROW = 1 << 24


def usable(vec) -> F.Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def whole(x: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """floor(scale * x) as int64, or as Python's whole numbers."""
    if wide:
        return np.frompyfunc(lambda v: math.floor(Fraction(v) * scale), 1, 1)(x)
    return np.floor(x * scale).astype(np.int64)


def columns_of(vectors: list, width: int) -> np.ndarray:
    """Vectors as the columns of an array of `width` rows, filled up with zeros."""
    out = np.zeros((width, len(vectors)))
    for k, v in enumerate(vectors):
        out[: len(v), k] = v
    return out


def blocks_of(rows: DataFrame, width: int) -> DataFrame:
    """(ids array, labels array, block binary): about BLOCK components a row, component after component."""
    most = max(1, BLOCK // max(width, 1))

    def run(batches):
        ids, labels, held = [], [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(id_type)), pa.array([labels], pa.list_(label_type)), pa.array([pack(columns_of(held, width).reshape(-1)) if width else b""], pa.binary())], ["ids", "labels", "block"])

        for b in batches:
            id_type, label_type = b.schema.field("id").type, b.schema.field("label").type
            for i, label, v in zip(*(b.column(n).to_pylist() for n in ("id", "label", "v"))):
                ids.append(i)
                labels.append(label)
                held.append(v)
                if len(held) == most:
                    yield out()
                    ids, labels, held = [], [], []
        if held:
            yield out()

    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("id", "label")}
    return rows.mapInArrow(run, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, block binary")


def opened(block: bytes, width: int, wide: bool) -> np.ndarray:
    """The whole numbers of a block, components by vectors."""
    return whole(unpack(block, "f8").reshape(width, -1), SCALE, wide)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each column of part (components x n) in book (entries x components); ties to the lower entry."""
    far = np.zeros((len(book), part.shape[1]), part.dtype)
    for j in range(len(part)):
        step = part[j][None] - book[:, j][:, None]
        far += step * step
    at = far.argmin(axis=0)
    return at, np.take_along_axis(far, at[None], axis=0)[0]


def add_block(acc, x: np.ndarray, books: np.ndarray):
    """Adds a block's parts to (sums parts x entries x components, counts parts x entries)."""
    parts, entries, w = books.shape
    sums, counts = acc or (np.zeros(books.shape, books.dtype), np.zeros((parts, entries), np.int64))
    for p in range(parts):
        part = x[p * w : (p + 1) * w]
        at, _ = nearest(part, books[p])
        np.add.at(counts[p], at, 1)
        for j in range(w):
            np.add.at(sums[p, :, j], at, part[j])
    return sums, counts


def merged(a, b):
    if a is None or b is None:
        return b if a is None else a
    return a[0] + b[0], a[1] + b[1]


def moved(books: np.ndarray, acc) -> np.ndarray:
    """Each entry at the floor of the mean of its parts; unused entries stay."""
    if acc is None:
        return books
    sums, counts = acc
    return np.where((counts > 0)[:, :, None], sums // np.maximum(counts, 1)[:, :, None], books)


def first_books(vectors: list, width: int, parts: int, wide: bool) -> np.ndarray:
    """parts x entries x components of the first vectors."""
    return whole(columns_of(vectors, width), SCALE, wide).T.reshape(len(vectors), parts, width // parts).transpose(1, 0, 2).copy()


def fit(blocks: DataFrame, books: np.ndarray, width: int, wide: bool, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after `rounds` rounds over all blocks."""
    sc = blocks.sparkSession.sparkContext
    stored = blocks.select("block").rdd
    depth = 2 if stored.getNumPartitions() < 1000 else 3
    for _ in range(rounds if width else 0):
        sent = sc.broadcast(books)
        acc = stored.treeAggregate(None, lambda a, r: add_block(a, opened(r["block"], width, wide), sent.value), merged, depth)
        books = moved(books, acc)
        sent.destroy()
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code binary, error long) of every usable row, codebooks parts x entries x components of whole numbers).

    At most 256 entries, so that a code has one byte a part.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("1 to 256 entries and at least one part")
    kept = rows.where(usable(F.col(vec_col))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    size, most = kept.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    width = -(-(size or 0) // parts) * parts
    wide = (most or 0) * SCALE >= NARROW
    first = kept.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    blocks = checkpoint(blocks_of(kept, width))
    books = fit(blocks, first_books([r["v"] for r in first], width, parts, wide), width, wide, rounds)
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for b in batches:
            for ids, labels, block in zip(b.column("ids"), b.column("labels"), b.column("block")):
                n = len(ids.values)
                codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, object if wide else np.int64)
                if width:
                    x, w = opened(block.as_py(), width, wide), width // parts
                    for p in range(parts):
                        at, far = nearest(x[p * w : (p + 1) * w], sent.value[p])
                        codes[:, p] = at
                        error += far
                fits = [e if e < 1 << 63 else None for e in error.tolist()]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(fits, pa.int64())], ["id", "label", "code", "error"])

    kinds = {n: kept.schema[n].dataType.simpleString() for n in ("id", "label")}
    return blocks.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code binary, error long"), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = checkpoint(coded)
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("id").cast("long").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL of one round: distances, nearest entries, moved entries."""
    return f"""d{k} AS MATERIALIZED (SELECT r, v.p, e, sum((x - c) * (x - c)) AS d FROM v JOIN b{k} USING (p, j) GROUP BY ALL),
  a{k} AS MATERIALIZED (SELECT r, p, min_by(e, d * 16 + e) AS e, min(d) AS d FROM d{k} GROUP BY ALL),
  b{k + 1} AS MATERIALIZED (SELECT b{k}.p, b{k}.e, b{k}.j, coalesce(m.c, b{k}.c) AS c FROM b{k} LEFT JOIN
    (SELECT p, e, j, (sum(x) - (((sum(x) % count(*)) + count(*)) % count(*))) // count(*) AS c FROM v JOIN a{k} USING (r, p) GROUP BY ALL) m USING (p, e, j))"""


OP11_SQL = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding AS x, len(embedding) // 8 AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  v AS MATERIALIZED (SELECT r, i // w AS p, i % w AS j, floor(4096 * x[i + 1]::DOUBLE)::HUGEINT AS x FROM (SELECT r, w, x, unnest(range(len(x))) AS i FROM k)),
  b0 AS MATERIALIZED (SELECT p, r AS e, j, x AS c FROM v WHERE r < 16),
  {', '.join(_round(k) for k in range(ROUNDS + 1))},
  o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1),
  h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h"""
