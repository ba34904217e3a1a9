"""SimHash near-duplicates found with BK-trees.

Texts become 64-bit fingerprints (majority vote over the XXH64 of their word shingles).
Equal fingerprints are one node. Two fingerprints that differ in at most ``radius`` bits
agree on whole blocks of bits: cut in radius+2 blocks, at least two blocks are equal, so
every linked pair meets in a shard named by some two blocks and their bits. Each shard's
fingerprints make BK-trees (children keyed by the integer Hamming distance to the parent)
and a query follows only edges within the radius. A shard above ``SHARD`` nodes is cut
into salted cells, each the tree of one slice queried by another, so that every pair
still meets once and no task holds an unbounded group. A cell returns only the links that
join two of its parts, never all pairs; components of these links equal those of all pairs.

Edge cases: a null text or one without words has fingerprint zero and links like any other;
fewer words than a shingle give one shingle; repeated rows share a class and stay; rows
without an id link to nothing and have a null component unless their fingerprint also has an id; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, lean, table

SHINGLE = 4
RADIUS = 4
SHARD = 512


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of the text's bytes in UTF-8."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # of bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lens + 1) - lens - 1
    ends = starts + lens
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    bits = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 16):  # a long text's shingles a part at a time
        h = np.array([xxh64_intdigest(joined[a:z], 42) for a, z in zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist())], np.uint64)
        bits += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) of every row; fp is the fingerprint's 64 bits as a signed integer."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in b.column("_text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(fps.view(np.int64))], [id_col, "fp"])

    rows = docs.select(id_col, F.col(text_col).cast("binary").alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, fp long")


class BKTree:
    """Nodes in arrival order; each child hangs under its integer Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while at != new:
            d = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(d, new)
        return new

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at distance radius or less; only edges within the radius of the distance to the parent are followed."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found


def spanning_links(members: list[int], queries: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Index pairs (into members + queries) that join what the radius links, at most one fewer than the nodes.

    Without queries each member is asked of the tree of those before it.
    """
    every = members + (queries or [])
    root = list(range(len(every)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    tree = BKTree()
    if queries is not None:
        for v in members:
            tree.add(v)
    for i in range(0 if queries is None else len(members), len(every)):
        for j in tree.within(every[i], radius):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                links.append((i, j))
        if queries is None:
            tree.add(every[i])
    return links


def shard_masks(radius: int, bits: int = 64) -> list[int]:
    """Masks of every two of radius+2 blocks: fingerprints within the radius agree under one of them."""
    blocks = radius + 2
    cuts = [bits * k // blocks for k in range(blocks + 1)]
    each = [((1 << (z - a)) - 1) << a for a, z in zip(cuts, cuts[1:])]
    return [x | y for x, y in combinations(each, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def salted_cells(keyed: DataFrame, salt, shard: int) -> DataFrame:
    """The rows of keys that two or more rows have, with the cell (i, j) where each takes part; q marks the queries of a mixed cell.

    A key of up to `shard` rows is one cell. Of a larger one, slice s (dealt by `salt`, which
    must not change between runs) of c meets slices s..c-1 as tree and 0..s-1 as query.
    """
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cold = keyed.join(sizes.where(F.col("n") <= shard), "key", "left_semi").select("*", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("q"))
    hot = keyed.withColumn("salt", salt).join(sizes.where(F.col("n") > shard), "key").withColumn("c", F.ceil(F.col("n") / F.lit(shard)).cast("int")).withColumn("s", F.expr("cast(pmod(salt, c) as int)"))
    cells = hot.select(*keyed.columns, F.explode(F.expr("concat(transform(sequence(s, c - 1), j -> struct(s as i, j as j, false as q)), filter(transform(sequence(0, s), i -> struct(i as i, s as j, true as q)), x -> x.i < x.j))")).alias("x")).select(*keyed.columns, "x.i", "x.j", "x.q")
    return cold.unionByName(cells)


def near_links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between the `rep`s of nodes(fp long, rep long), enough to join all that the radius links."""
    masks = shard_masks(radius)
    keyed = nodes.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("m", "bits")).select("fp", "rep", F.xxhash64("m", "bits").alias("key"))
    spread = salted_cells(keyed, F.xxhash64("fp", F.lit(7)), shard).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "q", "fp")

    def run(batches):
        for cell in runs_of(batches, ("key", "i", "j")):
            q = cell["q"]
            fps = cell["fp"].view(np.uint64)
            reps = cell["rep"]
            tree, ask = fps[~q].tolist(), fps[q].tolist()
            alone = cell["i"][0] == cell["j"][0]
            links = spanning_links(tree, None if alone else ask, radius)
            if links:
                at = np.array(links)
                yield pa.RecordBatch.from_arrays([pa.array(reps[at[:, 0]]), pa.array(reps[at[:, 1]])], ["a", "b"])

    return spread.select("key", "i", "j", "q", "fp", "rep").mapInArrow(lean(run), "a long, b long")


def runs_of(batches, keys):
    """Consecutive rows of equal keys as numpy columns; rows come sorted, and a run may go on in the next batch."""
    left = None
    for b in batches:
        cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        if left is not None:
            cols = {n: np.concatenate([left[n], cols[n]]) for n in cols}
        size = len(cols[keys[0]])
        if not size:
            continue
        change = np.zeros(size, bool)
        change[0] = True
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        cuts = np.flatnonzero(change)
        # lone rows make no link
        lens = np.diff(np.append(cuts, size))
        for a, n in zip(cuts[:-1][lens[:-1] > 1].tolist(), lens[:-1][lens[:-1] > 1].tolist()):
            yield {k: v[a : a + n] for k, v in cols.items()}
        left = {k: v[cuts[-1] :] for k, v in cols.items()}
    if left is not None and len(left[keys[0]]) > 1:
        yield left


def near_classes(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, rep, component) of nodes(fp long, rep long) that share a class of fingerprints, named by its smallest rep."""
    firsts = nodes.groupBy("fp").agg(F.min("rep").alias("first"))
    comps = connected_components(near_links(firsts.select("fp", F.col("first").alias("rep")), radius))
    named = firsts.join(comps.withColumnRenamed("node", "first"), "first", "left").select("fp", F.coalesce("component", "first").alias("component"))
    return nodes.join(named, "fp").select("fp", "rep", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fingerprint, component_id) of every row; the component is named by its smallest id."""
    marked = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    nodes = marked.groupBy("fp").agg(F.min(id_col).cast("long").alias("rep"))
    named = nodes.where("rep is not null")
    comps = connected_components(near_links(named, radius))
    classes = nodes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(classes, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
