"""Language-model scores from Brown class-based bigrams.

Words are put into classes by exchange clustering on the likelihood of class bigrams: a
round counts how often every word follows and precedes each class, and moves it to the
class where that likelihood gains most once the word is taken out of its own. A round moves
one half of the words, all at once, against the class table it began with (as distributed
exchange does); the halves take turns. A round that lowers the likelihood is undone, and those
after it move half as many. Every training word takes part, however rare. A text's probability is the product of class-transition probabilities (Witten-Bell smoothed)
and word-emission probabilities; a word that training never saw is one further type in a
class of its own, whose share is that of words seen once. The end of a text is a word in a
class of its own, which also begins each text.

A word's class is kept under a slot, the first ``SLOT_BITS`` bits of its hash, so the table of
classes is 2**SLOT_BITS bytes whatever the corpus, and is sent along with every task. Words that
share a slot share a class; counts and emissions are the word's own.

How it runs: each task reads its texts in chunks of about ``CHUNK_BYTES`` and writes each
chunk once (checkpointed) as the hashes of its words and the run of their numbers; texts are
never shuffled. A word's training count is a sum over the chunks' counts. Every round, a
chunk sends its (word, class) counts to the range of slots they belong to, which adds up any
number of chunks in bounded space. Only class-by-class sums and the class table pass
the driver. Words are told apart by their 64-bit hash.

Edge cases: a null text is empty and has the end token only; without training rows all
words are unknown; repeated rows count each time; very long texts are read whole; rows
without an id are scored (and split by crc32 of the empty text); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, crc_mod, pack, parts, table, unpack

CHUNK_BYTES = 16 << 20
CHUNK_ROWS = 1 << 16
CLASSES = 64
ROUNDS = 6
SLOT_BITS = 24
#: Slots of a range, which has 2**RANGE_BITS * (2 * CLASSES + 3) different counts at most.
RANGE_BITS = 15
END, UNKNOWN = CLASSES, CLASSES + 1  # classes of their own
END_HASH = 0
#: Contexts of a word: the class before it, the class after it, and the word itself before it.
AFTER, SELF, CONTEXTS = CLASSES + 1, 2 * CLASSES + 2, 2 * CLASSES + 3


def tokenise(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers of all texts on end, tokens of each text, hash of each number); numbers follow the hashes, 0 is the end of a text."""
    from xxhash import xxh64_intdigest

    numbers: dict[bytes, int] = {}
    seqs = []
    for t in texts:
        words = (t or b"").lower().split()  # of bytes: A-Z and the six ASCII blanks only
        seqs.append(np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.int32, len(words)))
        seqs.append(np.zeros(1, np.int32))
    lens = np.array([len(a) + 1 for a in seqs[::2]], np.int64)
    hashes = np.fromiter((xxh64_intdigest(w) or 1 for w in numbers), np.uint64, len(numbers))
    # equal hashes are one word
    kept, place = np.unique(np.concatenate([np.array([END_HASH], np.uint64), hashes]), return_inverse=True)
    return place.astype(np.int32)[np.concatenate(seqs)] if seqs else np.empty(0, np.int32), lens, kept


def encoded(docs: DataFrame, id_col: str, text_col: str, train: Column, chunk_bytes: int) -> DataFrame:
    """One row per chunk: ids, train and lens of its texts, seq (word numbers), hashes and slots of the words."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), train.alias("train"))
    kind = rows.schema["id"].dataType

    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        schema = None
        ids, texts, marks, held = [], [], [], 0

        def chunk():
            seq, lens, hashes = tokenise(texts)
            one = {"chunk": part << 32 | k, "ids": ids, "train": marks, "lens": lens.tolist(), "seq": pack(seq), "hashes": hashes.tobytes(), "slots": pack(np.diff(slots_of(hashes), prepend=np.uint32(0)))}
            return pa.RecordBatch.from_pylist([one], schema)

        for b in batches:
            if schema is None:
                schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(b.schema.field("id").type)), ("train", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int64())), ("seq", pa.binary()), ("hashes", pa.binary()), ("slots", pa.binary())])
            for i, text, mark in zip(*(b.column(c).to_pylist() for c in ("id", "text", "train"))):
                ids.append(i), texts.append(text), marks.append(mark)
                held += len(text)
                if held >= chunk_bytes or len(ids) >= CHUNK_ROWS:
                    yield chunk()
                    ids, texts, marks, held, k = [], [], [], 0, k + 1
        if ids:
            yield chunk()

    return rows.mapInArrow(run, f"chunk long, ids array<{kind.simpleString()}>, train array<boolean>, lens array<long>, seq binary, hashes binary, slots binary")


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)


def training_run(row: dict) -> np.ndarray:
    """Word numbers of a chunk's training texts on end."""
    return unpack(row["seq"], "i4")[np.repeat(np.array(row["train"], bool), row["lens"])]


def word_counts(chunks: DataFrame) -> DataFrame:
    """Of checkpointed chunks, a row per chunk: totals (training count of each of its words), and of the words that it is the first to hold: how many were trained, once, and the most frequent."""

    def count(batches):
        for b in batches:
            for row in b.to_pylist():
                hashes = np.frombuffer(row["hashes"], np.int64)
                n = np.bincount(training_run(row), minlength=len(hashes))
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.full(len(hashes), row["chunk"])), pa.array(n)], ["h", "chunk", "n"])

    uses = chunks.select("chunk", "train", "lens", "seq", "hashes").mapInArrow(count, "h long, chunk long, n long")
    w = Window.partitionBy("h")
    n = parts(chunks.sparkSession, chunks.count())  # some 300,000 words a chunk
    known = uses.repartition(n, "h").select("chunk", "h", F.sum("n").over(w).alias("total"), (F.row_number().over(w.orderBy("chunk")) == 1).alias("first"))

    def gather(rows: pa.Table) -> pa.Table:
        h = rows["h"].to_numpy().view(np.uint64)
        order = np.argsort(h)
        h, total, first = h[order], rows["total"].to_numpy()[order], rows["first"].to_numpy()[order]
        own = np.flatnonzero(first & (total > 0) & (h != END_HASH))
        top = own[np.lexsort((h[own], -total[own]))[:CLASSES]]
        one = {"chunk": rows["chunk"][0], "totals": pack(total), "n_tokens": int(total[first].sum()), "n_distinct": int((total[first] > 0).sum()), "n_once": int((total[first] == 1).sum()), "top": [{"n": int(total[i]), "h": int(h[i].view(np.int64))} for i in top]}
        return pa.Table.from_pylist([one], pa.schema([("chunk", pa.int64()), ("totals", pa.binary()), ("n_tokens", pa.int64()), ("n_distinct", pa.int64()), ("n_once", pa.int64()), ("top", pa.list_(pa.struct([("n", pa.int64()), ("h", pa.int64())])))]))

    return known.repartition(n, "chunk").groupBy("chunk").applyInArrow(gather, "chunk long, totals binary, n_tokens long, n_distinct long, n_once long, top array<struct<n:bigint,h:bigint>>")


def class_run(row: dict, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each word of the chunk, slot of each); the end of a text is word 0."""
    slots = np.cumsum(unpack(row["slots"], "u4"), dtype=np.uint32)
    cls = classes[slots]
    cls[0] = END
    return cls, slots


def class_bigrams(chunks: DataFrame, classes) -> np.ndarray:
    """How often each class follows each other in training texts: one table, summed per task, then over tasks."""
    k = CLASSES + 1

    def run(batches):
        total = np.zeros(k * k, np.int64)
        for b in batches:
            for row in b.to_pylist():
                cls = class_run(row, classes.value)[0][training_run(row)].astype(np.int64)
                total += np.bincount(np.concatenate([[END], cls[:-1]])[: len(cls)] * k + cls, minlength=k * k)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["k", "n"])

    out = np.zeros(k * k, np.int64)
    for r in chunks.select("train", "lens", "seq", "slots").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[r["k"]] = r["n"]
    return out.reshape(k, k)


def contexts_of(seq: np.ndarray, cls: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, context, count), by slot, of the words of one run of texts (each closed by word 0)."""
    before = np.concatenate([np.zeros(1, np.int32), seq[:-1]])[: len(seq)]
    is_word, was_word = seq != 0, before != 0
    same = is_word & was_word & (slots[seq] == slots[before])
    left = seq[is_word].astype(np.int64) * CONTEXTS + np.where(same, SELF, cls[before])[is_word]
    at = was_word & ~same
    right = before[at].astype(np.int64) * CONTEXTS + AFTER + cls[seq[at]]
    key, n = np.unique(np.concatenate([left, right]), return_counts=True)
    return slots[key // CONTEXTS], (key % CONTEXTS).astype(np.uint8), n


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


LITTLE = 32


def ready_terms(table_: np.ndarray) -> list[np.ndarray]:
    """What counts below LITTLE add to each cell of the class bigrams and of their transpose: (count, context class, class)."""
    cells = [m[:, :CLASSES].astype(np.float64) for m in (table_, table_.T)]
    return [(xlogx(m[None] + np.arange(LITTLE)[:, None, None]) - xlogx(m)[None]).astype(np.float32) for m in cells]


def exchange_gains(grid: np.ndarray, own: np.ndarray, table_: np.ndarray, terms: list[np.ndarray]) -> np.ndarray:
    """What the class-bigram log likelihood gains if a word, taken out of its class, enters each class; a row per word.

    grid: counts by context of each word; own: its class; table_: class bigrams, the end of texts last; terms: their
    ready_terms. Constants of a row are left out.
    """
    left, right, twice = grid[:, : CLASSES + 1], grid[:, AFTER:SELF], grid[:, SELF]
    out = np.zeros((len(grid), CLASSES))
    each = np.arange(len(grid))
    for x_of, m, other, ready in ((left, table_, right, terms[0]), (right, table_.T, left, terms[1])):
        w, c = np.nonzero(x_of)
        if not len(w):
            continue
        x = x_of[w, c]
        m_c = m[:, :CLASSES].astype(np.float64)
        for a in range(0, len(w), 1 << 16):
            wa, ca, xa = w[a : a + (1 << 16)], c[a : a + (1 << 16)], x[a : a + (1 << 16)]
            part = ready[np.minimum(xa, LITTLE - 1), ca]
            big = np.flatnonzero(xa >= LITTLE)
            part[big] = xlogx(m_c[ca[big]] + xa[big, None]) - xlogx(m_c[ca[big]])
            home, here = own[wa], np.arange(len(wa))
            part[here, home] = xlogx(m_c[ca, home]) - xlogx(m_c[ca, home] - xa)
            k = np.flatnonzero(ca == home)  # the context is the class that the word leaves
            less = m_c[ca[k]] - other[wa[k], :CLASSES]
            part[k] = xlogx(less + xa[k, None]) - xlogx(less)
            inner = np.flatnonzero(ca < CLASSES)
            part[inner, ca[inner]] = 0  # the diagonal follows below
            first = np.flatnonzero(np.concatenate([[True], wa[1:] != wa[:-1]]))
            out[wa[first]] += np.add.reduceat(part, first, axis=0)
    inside = left[:, :CLASSES] + right[:, :CLASSES] + twice[:, None]
    w, b = np.nonzero(inside)
    base, x = table_[b, b].astype(np.float64), inside[w, b]
    base -= np.where(b == own[w], x, 0)
    out[w, b] += xlogx(base + x) - xlogx(base)
    n = left.sum(axis=1) + twice
    size = table_.sum(axis=0)[:CLASSES].astype(np.float64)
    value, at = np.unique(n, return_inverse=True)
    whole = (xlogx(size[None] + value[:, None]) - xlogx(size)[None])[at]
    whole[each, own] = xlogx(size[own]) - xlogx(size[own] - n)
    return out - 2 * whole


def moved(keys: np.ndarray, n: np.ndarray, classes: np.ndarray, table_: np.ndarray, terms: list[np.ndarray]) -> np.ndarray:
    """The classes after each word went to its best; keys: word * CONTEXTS + context, sorted. A word with no gain elsewhere stays."""
    new = classes.copy()
    words, place = np.unique(keys // CONTEXTS, return_inverse=True)
    for a in range(0, len(words), 4096):
        at = words[a : a + 4096]
        lo, hi = np.searchsorted(place, [a, a + len(at)])
        grid = np.zeros((len(at), CONTEXTS), np.int64)
        grid[place[lo:hi] - a, keys[lo:hi] % CONTEXTS] = n[lo:hi]
        own, here = classes[at].astype(np.int64), np.arange(len(at))
        gain = exchange_gains(grid, own, table_, terms)
        best = gain.argmax(axis=1)
        new[at] = np.where(gain[here, best] > gain[here, own] + 1e-6 * np.abs(gain[here, own]), best, own)
    return new


def summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    out, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(out), np.int64)
    np.add.at(total, at, np.concatenate(n))
    return out, total


def turn(slots: np.ndarray, of: int) -> np.ndarray:
    """Which of so many parts (a power of two above 1) the words of a slot belong to."""
    return (slots * np.uint32(0x9E3779B1)) >> np.uint32(33 - of.bit_length())


def log_likelihood(table_: np.ndarray) -> float:
    """Of the classes' bigrams, but for what no class changes."""
    n = table_.astype(np.float64)
    return float(xlogx(n).sum() - xlogx(n.sum(axis=0)).sum() - xlogx(n.sum(axis=1)).sum())


def exchange_round(chunks: DataFrame, classes, table_: np.ndarray, part: int, of: int) -> dict[int, bytes]:
    """The new classes of every range of slots that holds a word of the part, after it has moved."""
    span = 1 << RANGE_BITS

    def send(batches):
        for b in batches:
            for row in b.to_pylist():
                cls, slots = class_run(row, classes.value)
                slot, ctx, n = contexts_of(training_run(row), cls.astype(np.int64), slots)
                mine = turn(slot, of) == part
                slot, ctx, n = slot[mine], ctx[mine], n[mine]
                present, starts = np.unique(slot >> RANGE_BITS, return_index=True)
                cuts = [*starts.tolist(), len(slot)]
                place = (slot & (span - 1)).astype(np.uint16)
                n = n.astype(np.uint32)
                cols = [[pack(x[a:z]) for a, z in zip(cuts, cuts[1:])] for x in (np.diff(place, prepend=np.uint16(0)), ctx, n)]
                first = [int(place[a]) for a in cuts[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), pa.array(first, pa.int32()), *(pa.array(x, pa.binary()) for x in cols)], ["slots", "first", "place", "ctx", "n"])

    sent = chunks.select("train", "lens", "seq", "slots").mapInArrow(send, "slots int, first int, place binary, ctx binary, n binary")

    def merge(batches):
        terms = ready_terms(table_)

        def settled(at, keys, n):
            new = moved(*summed(keys, n), classes.value[at * span : (at + 1) * span], table_, terms)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([new.tobytes()], pa.binary())], ["slots", "classes"])

        at, keys, n, held = None, [], [], 0
        for b in batches:
            for row in b.to_pylist():
                if row["slots"] != at:
                    if at is not None:
                        yield settled(at, keys, n)
                    at, keys, n, held = row["slots"], [], [], 0
                place = unpack(row["place"], "u2").copy()
                place[0] = row["first"]
                keys.append(np.cumsum(place, dtype=np.uint16).astype(np.int64) * CONTEXTS + unpack(row["ctx"], "u1"))
                n.append(unpack(row["n"], "u4"))
                held += len(place)
                if held > 4 * span * CONTEXTS:  # a range has span * CONTEXTS keys at most
                    keys, n = ([x] for x in summed(keys, n))
                    held = len(keys[0])
        if at is not None:
            yield settled(at, keys, n)

    n = min(parts(chunks.sparkSession, chunks.count()), 1 << (SLOT_BITS - RANGE_BITS))
    rows = sent.repartition(n, "slots").sortWithinPartitions("slots").mapInArrow(merge, "slots int, classes binary").collect()  # a byte per slot
    return {r["slots"]: r["classes"] for r in rows}


def exchange(chunks: DataFrame, counted: DataFrame, rounds: int = ROUNDS) -> tuple[object, np.ndarray]:
    """(the broadcast class table, class bigrams under it). Words start in hashed classes, the most frequent ones each in its own."""
    sc = chunks.sparkSession.sparkContext
    classes = ((np.arange(1 << SLOT_BITS, dtype=np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint8) % np.uint8(CLASSES)
    top = counted.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("n"), "h").limit(CLASSES).collect()
    for k, r in reversed(list(enumerate(top))):
        classes[slots_of(np.array([r["h"]], np.int64).view(np.uint64))] = k
    shared = sc.broadcast(classes)
    table_ = class_bigrams(chunks, shared)
    of, part = 2, 0
    for _ in range(rounds if table_.any() else 0):
        new = classes.copy()
        for at, some in exchange_round(chunks, shared, table_, part % of, of).items():
            new[at << RANGE_BITS : (at + 1) << RANGE_BITS] = np.frombuffer(some, np.uint8)
        sent = sc.broadcast(new)
        after = class_bigrams(chunks, sent)
        if log_likelihood(after) >= log_likelihood(table_):
            shared.unpersist()
            classes, shared, table_, part = new, sent, after, part + 1
        else:  # too many moved together
            sent.unpersist()
            of *= 2
    return shared, table_


def log_transitions(follows: np.ndarray, n_tokens: int, n_once: int) -> np.ndarray:
    """log10 of the smoothed probability of each class after each class; each row's probabilities sum to 1."""
    unseen = (n_once + 1) / (n_tokens + 2)
    q = follows.sum(axis=0) + 1e-9
    q[UNKNOWN] = 0
    q /= q.sum()
    kinds = np.maximum(1, (follows > 0).sum(axis=1, keepdims=True))
    p = (follows + kinds * q) / (follows.sum(axis=1, keepdims=True) + kinds) * (1 - unseen)
    p[:, UNKNOWN] = unseen
    return np.log10(p)


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row; train: which rows the model learns from."""
    chunks = checkpoint(encoded(docs, id_col, text_col, train, chunk_bytes))
    counted = checkpoint(word_counts(chunks))
    n_tokens, n_distinct, n_once = (x or 0 for x in counted.agg(F.sum("n_tokens"), F.sum("n_distinct"), F.sum("n_once")).first())
    classes, table_ = exchange(chunks, counted, rounds)
    follows = np.pad(table_, ((0, 1), (0, 1))).astype(np.float64)
    logs = log_transitions(follows, n_tokens, n_once)
    tokens = np.maximum(follows.sum(axis=0), 1)
    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    per_token = float(np.log10(n_tokens + n_distinct + 1))

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                seq, lens, counts = unpack(row["seq"], "i4"), np.array(row["lens"]), unpack(row["totals"], "i8")
                cls = np.where(counts > 0, class_run(row, classes.value)[0], UNKNOWN).astype(np.int64)
                starts = np.cumsum(lens) - lens
                by_text = lambda x: np.add.reduceat(x, starts)
                emission = np.where(counts > 0, np.log10(np.maximum(counts, 1) / tokens[cls]), 0.0)
                run_ = cls[seq]
                steps = logs[np.concatenate([[END], run_[:-1]]), run_]
                base = by_text(np.log10(counts + 1.0)[seq]) - lens * per_token
                cols = [pa.array(lens), pa.array(by_text((counts > 0).astype(np.int64)[seq])), pa.array(np.full(len(lens), n_tokens)), pa.array(base), pa.array(by_text(emission[seq] + steps))]
                ids = b.schema.field("ids").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], ids), pa.array(row["train"], pa.bool_()), *cols], [id_col, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    joined = chunks.select("chunk", "ids", "train", "lens", "seq", "slots").join(counted.select("chunk", "totals"), "chunk")
    return joined.mapInArrow(run, f"`{id_col}` {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, crc_mod(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
