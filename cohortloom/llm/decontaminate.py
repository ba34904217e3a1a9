"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item gives windows of ``width`` consecutive words. Over the whole corpus the
benchmark's words are counted and each window's tokens are ordered by rarity. A document
can hold a window only if it holds the window's necessary prefix, which for exact
containment is its single rarest token; that token's place in the window bounds where
the window can start (position bound) and how many words must follow (length bound).
What is left is verified word by word.

Documents are scanned where they lie, never shuffled. The benchmark is dealt to blocks of
about ``block_bytes`` by a hash of its items; one block at a time is read, counted and sent along with
the tasks, so neither the driver nor a task ever holds more of it. A benchmark within one block
costs one pass over the documents to count and one to scan; a larger one costs both for each block,
and what a block finds is kept (checkpointed) until all have been read.

Edge cases: null or wordless text has no words and no hits; items without words have no
windows; an item shorter than ``width`` is one window; equal items count as separate items; items
without an id count as one that has no name;
repeated document rows stay; extra columns are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, lean, table

WIDTH = 10
BLOCK_BYTES = 16 << 20
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes of a word stay, A-Z become a-z, all others part words. UTF-8 letters beyond ASCII are bytes from 0x80.
TO_WORDS = bytes(i if i in _KEEP else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_WORDS).split()


def windows_of(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    if len(words) <= width:
        return [tuple(words)] if words else []
    return list(dict.fromkeys(tuple(words[i : i + width]) for i in range(len(words) - width + 1)))


def _counts(docs: DataFrame, text_col: str, items: list) -> dict[bytes, int]:
    """Occurrences in the whole corpus of the words of a block: sums per task, then over tasks."""
    vocabulary = sorted({w for _, words in items for w in words})
    shared = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def run(batches):
        number = shared.value
        n = len(number)
        total = np.zeros(n + 1, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                ids = [number.get(w, n) for w in words_of(text)]
                if ids:
                    total += np.bincount(ids, minlength=n + 1)
        held = np.flatnonzero(total[:n])
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["w", "n"])

    found = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(lean(run), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    seen = {vocabulary[r["w"]]: r["n"] for r in found}
    return {w: seen.get(w, 0) for w in vocabulary}


def _items(block: DataFrame) -> list[tuple[str | None, list[bytes]]]:
    """(item, words) of a block's items that have words, in a fixed order."""
    rows = [(r[0], words_of(bytes(r[1]))) for r in block.collect()]
    return sorted(((i, w) for i, w in rows if w), key=lambda x: (x[0] or "", x[1]))


def prefix_index(items: list[tuple[str, list[bytes]]], counts: dict[bytes, int], width: int):
    """rarest word -> [(its place in the window, the window, the window's number)], and the items of each window."""
    owners: dict[tuple, list[int]] = {}
    for k, (_, words) in enumerate(items):
        for w in windows_of(words, width):
            owners.setdefault(w, []).append(k)
    index: dict[bytes, list] = {}
    for n, window in enumerate(owners):
        place = min(range(len(window)), key=lambda i: (counts.get(window[i], 0), window[i], i))
        index.setdefault(window[place], []).append((place, list(window), n))
    return index, list(owners.values())


def find_windows(words: list[bytes], index: dict, hit: list) -> None:
    """Appends (start, end, window's number) of every occurrence."""
    size = len(words)
    for p in [i for i, w in enumerate(words) if w in index]:
        for place, window, n in index[words[p]]:
            start = p - place
            end = start + len(window)
            if start >= 0 and end <= size and words[start:end] == window:
                hit.append((start, end, n))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, items, span_from, span_to) of every row; spans are hit word ranges [from, to), merged.

    With `carry`, the row's own columns go along as one struct `row`.
    """
    sc = docs.sparkSession.sparkContext
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("t")).where("t is not null")
    n = max(1, -(-2 * (bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    rows = docs.select(id_col, *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * carry, F.col(text_col).cast("binary").alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    carried = ["row"] * carry
    extra = "".join(f", row {rows.schema['row'].dataType.simpleString()}" for _ in carried)
    spans = [("items", pa.list_(pa.string())), ("span_from", pa.list_(pa.int32())), ("span_to", pa.list_(pa.int32()))]

    def scan(items):
        """Work on (_text) that gives, for each text, its number of words, item names and merged spans."""
        shared = sc.broadcast((items, _counts(docs, text_col, items) if items else {}))

        ready: list = []  # the index, built once in a task

        def over(texts):
            if not ready:
                ready.append((shared.value[0], *prefix_index(*shared.value, width)))
            held, index, owners = ready[0]
            for text in texts:
                words = words_of(text)
                hit: list = []
                find_windows(words, index, hit)
                f, t = merged(sorted((a, z) for a, z, _ in hit))
                yield len(words), sorted({held[k][0] for _, _, w in hit for k in owners[w]}, key=lambda x: (x is not None, x)), f, t

        return over

    def finished(ids, own, got):
        n_words, names, froms, tos = zip(*got) if got else ((),) * 4
        named = [",".join(i for i in x if i is not None) for x in names]
        cols = [pa.array(n_words, pa.int64()), pa.array([sum(t) - sum(f) for f, t in zip(froms, tos)], pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in named], pa.string())]
        return pa.RecordBatch.from_arrays([ids, *cols, *(pa.array(x, k) for x, (_, k) in zip((names, froms, tos), spans)), *own], [id_col, "n_words", "n_hit", "n_items", "items_sha256", "items", "span_from", "span_to", *carried])

    schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, span_from array<int>, span_to array<int>{extra}"
    if n == 1:
        over = scan(_items(bench))

        def run(batches):
            for b in batches:
                yield finished(b.column(id_col), [b.column(c) for c in carried], list(over(b.column("_text").to_pylist())))

        return rows.mapInArrow(lean(run), schema)

    def block_hits(over):
        def run(batches):
            for b in batches:
                hit = [(hashlib.sha256(text or b"").hexdigest(), *x[1:]) for text, x in ((t, next(over([t]))) for t in b.column("_text").to_pylist()) if x[2]]
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hit], k) for i, k in enumerate((pa.string(), *(k for _, k in spans)))], ["digest", *(c for c, _ in spans)])

        return run

    found = None
    for k in range(n):
        over = scan(_items(bench.where(F.pmod(F.xxhash64("item", "t"), F.lit(n)) == k)))
        hits = checkpoint(rows.select("_text").mapInArrow(block_hits(over), "digest string, items array<string>, span_from array<int>, span_to array<int>"))
        found = hits if found is None else found.unionByName(hits)
    # equal texts have equal hits: one row for each text that any block hits
    by_text = found.distinct().groupBy("digest").agg(F.collect_list(F.struct("items", "span_from", "span_to")).alias("hits"))
    joined = rows.withColumn("digest", F.sha2(F.coalesce("_text", F.lit(b"")), 256)).join(by_text, "digest", "left").drop("digest")

    def gather(batches):
        for b in batches:
            got = []
            for text, hits in zip(b.column("_text").to_pylist(), b.column("hits").to_pylist()):
                names = sorted({i for h in hits or () for i in h["items"]}, key=lambda x: (x is not None, x))
                got.append((len(words_of(text)), names, *merged(sorted(s for h in hits or () for s in zip(h["span_from"], h["span_to"])))))
            yield finished(b.column(id_col), [b.column(c) for c in carried], got)

    return joined.select(id_col, *carried, "_text", "hits").mapInArrow(lean(gather), schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """The rows that hold no window of any item."""
    found = contamination(docs, benchmark, carry=True, **columns)
    return found.where("n_hit = 0").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    froms, tos = [], []
    for a, z in spans:
        if tos and a <= tos[-1]:
            tos[-1] = max(tos[-1], z)
        else:
            froms.append(a), tos.append(z)
    return froms, tos


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row_id, doc_id, {_TOKENS} AS w FROM documents),
i AS (SELECT item_id, {_TOKENS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS size, list_slice(w, s, s + {WIDTH - 1}) AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
occ AS (
  SELECT g.row_id, g.s, g.size, win.item_id
  FROM (SELECT row_id, size, s, list_slice(w, s, s + size - 1) AS words
        FROM (SELECT row_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, sizes WHERE len(w) >= size)) g
  JOIN win ON win.size = g.size AND win.words = g.words),
hit AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT row_id, unnest(range(s, s + size)) AS p FROM occ) GROUP BY row_id),
its AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY row_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(its.items, '')) AS items_sha256,
  coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row_id) LEFT JOIN its USING (row_id)
"""
