"""Vector codes, exact search and spelling variants against brute force, and their edge cases."""

import math
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from cohortloom.llm import spelling, topk, vector_codes

INF = float("inf")


def coded(rows, rounds=6):
    """vec_id -> (code, error), and the codebooks, in plain Python."""
    kept = sorted((i, [math.floor(4096 * float(x)) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = -(-max(len(v) for _, v in kept) // 8) * 8
    w = width // 8
    cut = [[(v + [0] * (width - len(v)))[p * w : (p + 1) * w] for p in range(8)] for _, v in kept]
    books = [[c[p] for c in cut[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(8)] for c in cut]

    for _ in range(rounds):
        at = assign()
        for p in range(8):
            for e in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at) if a[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    out = Counter((i, "".join(f"{e:02x}" for e in a), sum(far(c[p], books[p][a[p]]) for p in range(8))) for (i, _), c, a in zip(kept, cut, at))
    return out, ",".join(str(x) for p in books for e in p for x in e)


def vectors(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in np.float32(rng.normal(size=dim) * spread)], int(rng.integers(3))) for i in rng.permutation(n) * 5]


SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


@pytest.mark.parametrize("dim, spread", [(16, 1.0), (8, 1e-3), (16, 1e9)])
def test_codes_equal_plain_python(spark, dim, spread):
    rows = vectors(60, dim, 1, spread) + [(7, None, 1), (8, [None] + [0.0] * (dim - 1), 1), (9, [INF] * dim, None), (11, [float("nan")] * dim, 2), (12, [0.5] * dim, None), (12, [0.5] * dim, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    got, books = vector_codes.compress(df)
    want, text = coded(rows)
    fits = lambda e: e if e < 1 << 63 else None
    assert Counter((r["id"], bytes(r["code"]).hex(), r["error"]) for r in got.collect()) == Counter({(i, c, fits(e)): n for (i, c, e), n in want.items()})
    assert vector_codes.digest(books) == sha256(text.encode()).hexdigest()


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.compress(empty)[0].collect() == []
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1, "")], SCHEMA))[0].collect() == []
    few = spark.createDataFrame([(2, [1.0, 2.0], 1, ""), (None, [3.0], None, ""), (4, [], 1, "")], SCHEMA)
    got, books = vector_codes.compress(few)
    assert books.shape == (8, 3, 1)
    assert sorted((r["id"] or 0, bytes(r["code"])[0], r["error"]) for r in got.collect()) == [(0, 2, 0), (2, 0, 0), (4, 1, 0)]
    none = vector_codes.compress(spark.createDataFrame([(2, [], 1, "")], SCHEMA))[0].collect()
    assert [(r["id"], bytes(r["code"]), r["error"]) for r in none] == [(2, bytes(8), 0)]


def test_blocks_are_cut(spark, monkeypatch):
    rows = vectors(50, 16, 3)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    whole = sorted((r["id"], bytes(r["code"]), r["error"]) for r in vector_codes.compress(df)[0].collect())
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    blocks = vector_codes.blocks_of(df.select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v")), 16)
    assert max(len(r["ids"]) for r in blocks.collect()) == 4
    assert sorted((r["id"], bytes(r["code"]), r["error"]) for r in vector_codes.compress(df)[0].collect()) == whole


def best(rows, k=5, mod=50):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, q) in enumerate(kept):
        if i % mod == 0:
            found = sorted((-sum(x * y for x, y in zip(q, c)), j) for b, (j, c) in enumerate(kept) if b != a)[:k]
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(found))
    return out


def searched(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    return Counter(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **how).select("query_id", "rank", "vec_id", "score").collect())


def near_groups(seed=5):
    """Clusters, a vector of a third of all rows, repeated rows and ids, and rows to leave out."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, 8))
    rows = [(int(i) * 10, [float(x) for x in np.float32(middle[i % 6] + 0.05 * rng.normal(size=8))]) for i in range(300)]
    rows += [(i * 25 + 3, [0.5] * 8) for i in range(150)] + [(i * 50, [0.5] * 8) for i in range(20)]
    return rows + [(100, rows[10][1])] * 2 + [rows[10]] + [(150, None), (200, [None] * 8), (250, [INF] * 8), (None, [1.0] * 8)]


@pytest.mark.parametrize("how", [{}, {"block": 20, "group": 3, "centres": 4}, {"k": 1, "block": 7}])
def test_search_equals_brute_force(spark, how):
    rows = near_groups()
    assert searched(spark, rows, **how) == best(rows, how.get("k", 5))


def test_search_of_odd_tables(spark):
    assert not searched(spark, [])
    assert not searched(spark, [(0, [1.0, 2.0])])
    few = [(0, [1.0, 2.0]), (50, [3.0]), (51, []), (52, [-1e5, 1e5])]
    assert searched(spark, few) == best(few)
    assert searched(spark, [(0, []), (1, [])]) == Counter([(0, 1, 1, 0)])


def test_search_of_large_numbers_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i * 10, [float(x) for x in np.float32(rng.integers(-(1 << 17), 1 << 17, 70))]) for i in range(40)]
    assert searched(spark, rows) == best(rows)


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(12, 4))[rng.integers(0, 12, 900)] * 1000 + rng.normal(size=(900, 4)) * 8)
    tree = topk.CoverTree(x)
    side = topk.Side(x[tree.order], tree.nodes)
    assert sorted(tree.order.tolist()) == list(range(900))
    assert (side.count > 0).sum() > 1
    for n in range(len(side.lo)):
        own = side.x[side.lo[n] : side.hi[n]]
        assert np.sqrt(((own - side.centre[n]) ** 2).sum(axis=1)).max() <= side.radius[n] + 1e-9
        kids = side.below(n) if side.count[n] else []
        if len(kids):
            assert side.lo[kids[0]] == side.lo[n] and side.hi[kids[-1]] == side.hi[n]
            c = side.centre[kids]
            gaps = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))[np.triu_indices(len(c), 1)]
            assert gaps.min() > side.radius[n] / 2 and (side.radius[kids] <= side.radius[n] / 2 + 1e-9).all()
    tested = []
    real = topk.products
    topk.products = lambda a, b: tested.append(len(a) * len(b)) or real(a, b)
    try:
        found = topk.search(topk.Side(x[tree.order], tree.nodes), side, np.arange(900), np.full(900, -np.inf), 6)
    finally:
        topk.products = real
    score = side.x @ side.x.T
    assert all(f == sorted(((int(s), i) for i, s in enumerate(row)), key=lambda t: (-t[0], t[1]))[:6] for f, row in zip(found, score))
    assert sum(tested) < 0.6 * 900 * 900  # pairs of nodes are dropped


def near(a, b):
    """One edit by the table of distances."""
    if a == b or abs(len(a) - len(b)) > 1 or (len(a) > 5 and a[:3] != b[:3] and a[-2:] != b[-2:]):
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[-1] + 1))
    return row[-1] == 1


def spelled(docs):
    counts = Counter()
    for d, t in docs:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    by = defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    form, some = {}, {}
    for w, n in words.items():
        others = [o for m in (len(w) - 1, len(w), len(w) + 1) for o in by[m] if near(w, o)]
        some[w] = len(others)
        top = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = top if top and words[top] >= 5 * n else None
    out = Counter()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w, form[w], root, n, some[w], form[w] and words[form[w]]] += 1
    return out


def spelled_by_spark(spark, docs):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id long, text string, word string, n string").repartition(3)
    return Counter(tuple(r) for r in spelling.variants(spelling.words_of(df)).select("word", "form", "root", "n", "n_near", "form_n").collect())


def variant_docs():
    rng = np.random.default_rng(4)
    base = ["letter", "kitten", "Ünïcodé", "banana", "aaaaaaa", "aaaaaa", "wording", "straße×", "longestwordofall" * 4, "eightlet", "ninelette", "tenletters", "elevenlette"]
    docs = []
    for d in range(60):
        words = []
        for _ in range(60):
            w = base[int(rng.integers(len(base)))]
            p, c, kind = int(rng.integers(len(w))), "abzé"[int(rng.integers(4))], int(rng.integers(14))
            words.append(w[:p] + c + w[p:] if kind == 0 else w[:p] + w[p + 1 :] if kind == 1 else w[:p] + c + w[p + 1 :] if kind == 2 else w)
        docs.append((d, " ".join(words)))
    docs += [(2000 + d, "chainaa " * 40 + "chainab " * 6 + "chainbb") for d in range(9)]
    return docs + [(1000, None), (None, "letter letters lettter " * 9), (1001, ""), (1002, "a" * 40000 + " "), (1003, "1 2 ,")] + [(1002, "a" * 40000)] * 5 + [docs[0]] * 2


@pytest.mark.parametrize("cell", [1024, 5])
def test_variants_equal_brute_force(spark, cell, monkeypatch):
    monkeypatch.setattr(spelling, "near_pairs", lambda words, real=spelling.near_pairs: real(words, cell))
    docs = variant_docs()
    want = spelled(docs)
    assert any(w[1] and w[1] != w[2] for w in want) and len(want) > 20
    assert spelled_by_spark(spark, docs) == want


def test_variants_of_the_test_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.op13_spelling(spark, sf).collect())
    assert got == spelled(docs)


def test_variants_of_no_words(spark):
    assert not spelled_by_spark(spark, [])
    assert not spelled_by_spark(spark, [(1, "letter letter"), (2, None)])


def test_roots_follow_forms_to_the_last(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "d"), ("d", "e"), ("p", "q")], "word string, form string")
    assert {tuple(r) for r in spelling.followed(links).collect()} == {("a", "e"), ("b", "e"), ("c", "e"), ("x", "e"), ("d", "e"), ("p", "q")}


@pytest.mark.parametrize("q", [3, 4])
def test_two_disjoint_grams_are_asked(q):
    for rarity in ([5, 1, 9, 2, 7], [1, 1, 1, 1, 1], [9, 8, 7, 6, 5, 4, 3], list(range(30))):
        i, j = spelling.asked_pair(np.array(rarity), q)
        assert i + q <= j
        assert max(rarity[i], rarity[j]) == min(max(rarity[a], rarity[b]) for a in range(len(rarity)) for b in range(a + q, len(rarity)))


def test_one_edit():
    for a in ("abc", "aabc", "abcd", "abd", "acb", "ab", "aa", "", "aaa"):
        for b in ("abc", "aabc", "abcd", "abd", "acb", "ab", "aa", "", "aaa"):
            assert spelling.one_edit(a, b) == near(a, b)
