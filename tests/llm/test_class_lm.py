"""The class language model against brute force: base columns, exchange gains, scores; odd rows and repeats."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import class_lm
from cohortloom.llm.common import crc_mod, pack, table, unpack

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "x"), (4, "x"), (None, "no id here at all"), (7, "long " * 30_000), (8, "1234 !!! 5678")]


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def words(text):
    return (text or "").encode().lower().split() + [None]


def test_base_columns_and_held_out_gain(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in class_lm.op9_class_lm(spark, sf).collect()}
    split = {i: words(t) for i, t in docs}
    counts = Counter(w for i, ws in split.items() if crc(i) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in split.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(counts[w] > 0 for w in ws), n, crc(i) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def bigrams(seq, cls):
    k = class_lm.CLASSES + 1
    c = cls[seq].astype(np.int64)
    return np.bincount(np.concatenate([[class_lm.END], c[:-1]]) * k + c, minlength=k * k).reshape(k, k)


def likelihood(n):
    f = lambda x: sum(y * math.log(y) for y in x.ravel().tolist() if y)
    return f(n) - f(n.sum(axis=0)) - f(n.sum(axis=1))


@pytest.mark.parametrize("little", [2, 32])
def test_exchange_gains_are_brute_force(monkeypatch, little):
    monkeypatch.setattr(class_lm, "LITTLE", little)
    rng = np.random.default_rng(3)
    seq = np.concatenate([np.append(np.minimum(rng.zipf(1.3, 40), 25).repeat(rng.integers(1, 3, 40)), 0) for _ in range(30)]).astype(np.int32)
    cls = rng.integers(0, 5, 26)
    cls[0] = class_lm.END
    table_ = bigrams(seq, cls)
    slot, ctx, n = class_lm.contexts_of(seq, cls, np.arange(26, dtype=np.uint32))
    grid = np.zeros((26, class_lm.CONTEXTS), np.int64)
    grid[slot, ctx] = n
    own = np.where(np.arange(26) == 0, 0, cls)
    gain = class_lm.exchange_gains(grid[1:], own[1:], table_, class_lm.ready_terms(table_))
    for w in range(1, 26):
        if not grid[w].any():
            continue
        for b in (0, 1, 2, 3, 4, 9):
            other = cls.copy()
            other[w] = b
            assert gain[w - 1, b] - gain[w - 1, own[w]] == pytest.approx(likelihood(bigrams(seq, other)) - likelihood(table_), abs=2e-2)


def test_rounds_raise_the_likelihood(spark):
    rng = np.random.default_rng(1)  # words of kind k follow words of kind k - 1
    texts = [(i, " ".join(f"k{k % 4}w{rng.integers(40)}" for k in range(20))) for i in range(200)]
    chunks = class_lm.encoded(spark.createDataFrame(texts, DOCS), "doc_id", "text", F.lit(True), 1 << 20).cache()
    counted = class_lm.word_counts(chunks).cache()
    held = [class_lm.log_likelihood(class_lm.exchange(chunks, counted, k)[1]) for k in (0, 2, 6)]
    assert held[0] <= held[1] <= held[2] and held[0] < held[2]


def test_scores_are_brute_force(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id < 60")
    train = crc_mod(F.col("doc_id"), 7) != 2
    chunks = class_lm.encoded(docs, "doc_id", "text", train, 20_000).cache()
    assert chunks.count() > 4
    classes, follows = class_lm.exchange(chunks, class_lm.word_counts(chunks).cache(), 2)
    from xxhash import xxh64_intdigest

    split = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    counts = Counter(w for i, ws in split.items() if crc(i) % 7 != 2 for w in ws)
    of = lambda w: class_lm.END if w is None else int(classes.value[xxh64_intdigest(w) >> 64 - class_lm.SLOT_BITS]) if counts[w] else class_lm.UNKNOWN
    pairs = Counter((a, b) for i, ws in split.items() if crc(i) % 7 != 2 for a, b in zip([class_lm.END] + [of(w) for w in ws], [of(w) for w in ws]))
    assert {(a, b): int(follows[a, b]) for a, b in zip(*np.nonzero(follows))} == pairs
    tokens = Counter()
    for w, n in counts.items():
        tokens[of(w)] += n
    logs = class_lm.log_transitions(np.pad(follows, ((0, 1), (0, 1))).astype(float), sum(counts.values()), sum(n == 1 for n in counts.values()))
    got = {r["doc_id"]: r["score"] for r in class_lm.score_texts(docs, train, chunk_bytes=20_000, rounds=2).collect()}
    for i, ws in split.items():
        cls = [of(w) for w in ws]
        expected = sum(logs[a, b] for a, b in zip([class_lm.END] + cls, cls)) + sum(math.log10(counts[w] / tokens[of(w)]) for w in ws if counts[w])
        assert got[i] == pytest.approx(expected, rel=1e-9)


def test_repeated_rows_fill_many_chunks_and_count_each_time(spark):
    docs = spark.createDataFrame([(5, "one two three four")] * 300, DOCS)
    assert class_lm.encoded(docs, "doc_id", "text", F.lit(True), 500).count() >= 10
    got = class_lm.score_texts(docs, F.lit(True), chunk_bytes=500).collect()
    assert len(got) == 300 and {(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == {(5, 5, 1500)} and len({r["score"] for r in got}) == 1


def test_edges(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    for name in ("id", "train", "chunk", "score", "seq"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = {r["doc_id"]: r for r in class_lm.score_texts(docs, crc_mod(F.col("doc_id"), 7) != 2).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 1 and got[7]["n_tokens"] == 30_001 and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got.values())
    none = class_lm.score_texts(docs, F.lit(False)).collect()
    assert len(none) == len(ODD) and {r["n_known"] for r in none} == {0} and {r["train_tokens"] for r in none} == {0}
    assert class_lm.score_texts(docs.limit(0), F.lit(True)).count() == 0


def test_class_lm_probabilities_sum_to_one():
    follows = np.zeros((class_lm.CLASSES + 2,) * 2)
    follows[3, 4], follows[class_lm.END, 3] = 5, 2
    assert np.allclose((10 ** class_lm.log_transitions(follows, 7, 1)).sum(axis=1), 1)


def test_packed_numbers():
    for a in (np.arange(5, dtype=np.int32), np.array([2**40], np.int64), np.empty(0, np.uint16), np.array([3], np.uint8)):
        assert (unpack(pack(a), a.dtype.str) == a).all()
