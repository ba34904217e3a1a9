"""The pipeline's rows against its stages done by hand."""

import hashlib
import re
import struct

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import bpe, decontaminate, near_dedup, quality, secrets, simhash
from cohortloom.llm.common import table


def test_stages_and_run(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "tokens"]
    docs = table(spark, sf, "documents")
    names = docs.columns
    model = quality.train(docs, table(spark, sf, "labels").where(~quality.held_out()))
    kept = {r["doc_id"] for r in quality.score(docs, model).collect() if r["score"] >= quality.KEEP}
    after = corpus_pipeline.keep_good(spark, docs, sf)
    assert {r["doc_id"] for r in after.collect()} == kept and after.columns == names
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    bench = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    windows = {w for t in bench for w in decontaminate.windows_of(decontaminate.words_of(t.encode()), decontaminate.WIDTH)}
    one = near_dedup.one_of_each(after)
    clean = {r["doc_id"] for r in one.collect() if not any(tuple(ws[i : i + len(w)]) == w for ws in [decontaminate.words_of(r["text"].encode())] for w in windows for i in range(len(ws) - len(w) + 1) if ws[i] == w[0])}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == clean
    path, pattern = bpe.default_vocab()
    with open(path, "rb") as f:
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(f.read()), special_tokens={})
    for i, row in got.items():
        text = redacted(texts[i])
        ids = enc.encode_ordinary(text)
        assert row == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def redacted(text):
    """Matches of all rules; those that overlap give one mark."""
    spans = [(m.start(), m.end()) for rule in secrets.RULES for m in re.finditer(rule.pattern, text, rule.flags) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    groups: list = []
    for a, z in sorted(spans):
        if groups and a < groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], z)
        else:
            groups.append([a, z])
    for a, z in reversed(groups):
        text = text[:a] + "[secret]" + text[z:]
    return text


ODD = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, " \t\n ", "en", "s", 4), (4, "x", "en", "s", 1), (4, "x", "en", "s", 1), (None, "no id here at all", "fr", "s", 3), (7, "long " * 30_000, "en", "s", 150_000)]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows_and_clashing_columns(spark, sf, name, stage):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "group", "times", "found_secrets", "row", "id", "digest", "chunk"):
        docs = docs.withColumn(c, F.lit("own"))
    rows = stage(spark, docs, sf).collect()
    ids = {r["doc_id"] for r in rows}
    if name == "tokens":
        assert len(rows) == len(ODD) and sorted(r["n_tokens"] for r in rows)[:2] == [0, 0]
    else:
        assert all(r[c] == "own" for r in rows for c in ("score", "group", "times", "found_secrets", "row", "id"))
    if name == "near_dedup":
        assert ids == {1, 4, 7, None} and len(rows) == 4
    if name in ("decontaminate", "secrets"):
        assert len(rows) == len(ODD)


def test_a_repeated_id_leaves_the_same_row_each_time(spark):
    rows = [(5, t, "en", s, 1) for t, s in (("b b", "x"), ("a a", "z"), ("a a", "y"), ("c", "w"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [near_dedup.one_of_each(d).collect() for d in (docs, docs.orderBy(F.desc("text")).repartition(3))]
    assert got[0] == got[1] and len(got[0]) == 1 and got[0][0]["text"] == "a a"


def test_empty_documents(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_clean_rows(spark, sf, name, stage):
    rows = [(10_000 + i, f"Ertion on the it is onenerth edonre ontiatth edes erat as on oransh of shat erre rely thha number {i} " + " ".join(f"w{i}x{k}" for k in range(40)) + ".", "en", "s", 1) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = stage(spark, table(spark, sf, "documents").unionByName(docs), sf)
    assert out.columns == docs.columns and {r[0] for r in rows} <= {r["doc_id"] for r in out.collect()}


def test_near_dedup_searches_fingerprints_first(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words[:k], f"new{i}", *words[k + 1 :]])) for i, k in enumerate((3, 150, 290))] + [(9, " ".join(f"v{i}" for i in range(300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r["id"]: r["fp"] & (2**64 - 1) for r in near_dedup.marks(docs, "doc_id", "text", 5).collect()}
    assert prints == {i: simhash.fingerprint(t.encode()) for i, t in rows}
    asked = []
    search = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda nodes, *a: asked.append(nodes.count()) or search(nodes, *a))
    groups = {r["id"]: r["group_id"] for r in near_dedup.near_groups(docs).collect()}
    assert asked == [4] and groups == {0: 0, 1: 0, 2: 0, 9: 9}


def test_near_dedup_shuffles_no_texts_and_sketches_rule_pairs_out(spark):
    draw = np.random.default_rng(5)
    for size, other in ((0, 3), (40, 60), (3000, 2900)):
        p, q = (np.unique(draw.integers(0, 2**32, n, np.uint32)) for n in (size, other))
        q = np.unique(np.concatenate([q, p[::2]]))
        bits = int(np.bitwise_count(near_dedup.sketch(p) ^ near_dedup.sketch(q)).sum())
        assert bits <= len(np.setxor1d(p, q)) and len(near_dedup.sketch(p)) * 8 == near_dedup.SKETCH
    sets = [np.arange(1000, dtype=np.uint32), np.arange(900, dtype=np.uint32), np.arange(500, dtype=np.uint32)]
    marked = spark.createDataFrame([(i, len(s), near_dedup.sketch(s).tobytes()) for i, s in enumerate(sets)], "rep long, n long, bits binary")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "rep long, rep2 long")
    assert [tuple(r) for r in near_dedup.may_be_similar(pairs, marked, 0.8).collect()] == [(0, 1)]

    def written():
        sc = spark.sparkContext
        store, lists = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList
        stages = store.stageList(lists(), False, False, sc._gateway.new_array(sc._jvm.double, 0), lists())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    texts = [" ".join(map(str, draw.integers(10**9, 10**10, 300))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = near_dedup.checkpoint(near_dedup.marks(docs, "doc_id", "text", 5).select("set_key", F.col("id").alias("rep"), "size", F.col("id").alias("group")))
    before = written()
    assert near_dedup.prefix_links(nodes, docs, "doc_id", "text", 5, 0.8).count() == 0
    assert written() - before < sum(map(len, texts))
