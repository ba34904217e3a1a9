"""Spelling variants: corpus words one edit apart, and the frequent form each rare word stands for.

Words are counted over all texts. Near words are found by a positional q-gram index: a posting is a
gram at a position in a word of a length. One edit touches at most one of two disjoint grams, so each
word asks only for the rarer pair of its disjoint grams, at the positions and lengths that one edit allows;
these postings are cells of a shuffle, and a cell above ``CELL`` words is cut into slices that meet each
other. Within a cell the words' grams form the inverted index, whose postings (sorted by word) are
merged by a heap for each asking word under the length and position limits. Words that meet the count filter,
max(length) - q + 1 - q common grams, are verified by one linear comparison. Grams of the words of a length
have half as many letters, 3 to 5: the longest of which two fit.

Edge cases: null and empty texts have no words; a null id counts as the empty text; repeated rows count again; ties of
n go to the smaller word in code-point order; words of any length are compared whole. Extra columns are ignored.
No words give no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint, portions, table
from .simhash import runs_of

LETTER = "[A-Za-zÀ-ÿ]"
#: Letters of a run once A-Z are lower-case: a-z and U+00C0 to U+00FF.
LETTERS = 26 + 64
#: Letters of the grams whose frequency is known; and the most of any gram.
Q, LONGEST = 3, 5
#: One occurrence in so many loses a letter.
TYPO = 199
SHORTEST, RAREST, TIMES = 6, 5, 5
CELL = 1024


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo: int = TYPO, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """(word, n) of every word of the texts that is long and frequent enough; of the runs whose crc32 `typo` divides, one letter is left out."""
    # a match is a whole run: shorter runs cannot give a word that is long enough, and matches are greedy
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"{LETTER}{{{shortest},}}"), F.lit(0))).alias("run"))
    lower = runs.select("d", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run"))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % typo == 0, cut).otherwise(F.col("run"))
    long_enough = lower.withColumn("h", h).select(word.alias("word"))
    return long_enough.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rarest)


def gram_size(length: int) -> int:
    """Letters of the grams of words of a length."""
    return min(LONGEST, length // 2)


def gram_codes(words: list[str], q: int = Q) -> tuple[np.ndarray, np.ndarray]:
    """(a number, below LETTERS ** q, for every place in the words in turn where a gram of q letters begins; where each word's begin, and the end). Words of fewer letters have none."""
    c = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    c = np.where(c < 128, c - 97, c - 0xC0 + 26)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    starts, n = np.cumsum(lens) - lens, np.maximum(lens - q + 1, 0)
    at = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(starts, n)
    out = np.zeros(len(place), np.int64)
    for k in range(q):
        out = out * LETTERS + c[place + k]
    return out, at


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each of all LETTERS ** Q grams occurs in the words (729,000 int64, whatever the corpus)."""

    def run(batches):
        held = np.zeros(LETTERS**Q, np.int64)
        for b in batches:
            for some in portions(b.column("word").to_pylist()):
                np.add.at(held, gram_codes(some)[0], 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["gram", "n"])

    got = words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(LETTERS**Q, np.int64)
    out[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return out


def asked_pair(rarity: np.ndarray, q: int = Q) -> tuple[int, int]:
    """Places i + q <= j of two disjoint grams whose commoner one is rarest; one edit leaves one of the two whole."""
    n = len(rarity) - q  # the number of places for i
    before = np.minimum.accumulate(rarity[:n])
    j = int(np.maximum(before, rarity[q:]).argmin())
    return int(rarity[: j + 1].argmin()), j + q


def postings(words: DataFrame, rarity: np.ndarray) -> DataFrame:
    """(id, key, asks): the whole index of words(id, word), and what each word asks of it; a key is a gram, the length of its word and its place.

    A gram at place p of a word of length m is, after one edit elsewhere, at p in a word of length m, and at p or
    p - 1 in one of length m - 1. The longer word of a pair asks for the shorter. A longer gram is as rare as the rarest of Q letters in it.
    """
    sent = words.sparkSession.sparkContext.broadcast(rarity)

    def run(batches):
        for b in batches:
            ids, done = b.column("id").to_numpy(), 0
            for some in portions(b.column("word").to_pylist()):
                own, done = ids[done : done + len(some)], done + len(some)
                codes = {q: gram_codes(some, q) for q in range(Q, LONGEST + 1)}
                seen = sent.value[codes[Q][0]]
                asked, posted = [], []
                for k, w in enumerate(some):
                    m, rare = len(w), seen[codes[Q][1][k] : codes[Q][1][k + 1]]
                    for d in (0, 1) if m > 2 * Q else (0,):
                        q = gram_size(m - d)
                        g = codes[q][0][codes[q][1][k] : codes[q][1][k + 1]]
                        rarest = rare
                        for s in range(1, q - Q + 1):
                            rarest = np.minimum(rarest[:-1], rare[s:])
                        asked += [(own[k], g[p], m - d, p - s) for p in asked_pair(rarest, q) for s in range(d + 1) if 0 <= p - s <= m - d - q]
                        if not d:
                            posted.append((g, m, own[k]))
                n = [len(g) for g, _, _ in posted]
                whole = np.stack([np.repeat([i for _, _, i in posted], n), np.concatenate([g for g, _, _ in posted]), np.repeat([m for _, m, _ in posted], n), np.concatenate([np.arange(x) for x in n])], axis=1)
                rows = np.concatenate([np.array(asked, np.int64), whole])
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[:, c])) for c in range(4)), pa.array(np.arange(len(rows)) < len(asked))], ["id", "gram", "length", "place", "asks"])

    found = words.select("id", "word").mapInArrow(run, "id long, gram long, length long, place long, asks boolean")
    return found.select("id", F.xxhash64("gram", "length", "place").alias("key"), "asks")


def cells(index: DataFrame, cell: int = CELL) -> DataFrame:
    """(id, key, asks, i, j): postings that some other word asks for, those that ask and those that are asked in slices of about `cell`; every slice i of the ones meets every slice j of the others."""
    sizes = checkpoint(index.groupBy("key").agg(F.count_if("asks").alias("a"), F.count_if(~F.col("asks")).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("a > 0 and n > 0 and low < high"))
    slices = sizes.select("key", F.ceil(F.col("a") / F.lit(cell)).cast("int").alias("ca"), F.ceil(F.col("n") / F.lit(cell)).cast("int").alias("cn"))
    dealt = index.join(slices, "key").withColumn("h", F.xxhash64("id"))
    to = F.when(F.col("asks"), F.expr("transform(sequence(0, cn - 1), j -> struct(cast(pmod(h, ca) as int) as i, j as j))")).otherwise(F.expr("transform(sequence(0, ca - 1), i -> struct(i as i, cast(pmod(h, cn) as int) as j))"))
    return dealt.select("id", "key", "asks", F.explode(to).alias("x")).select("id", "key", "asks", "x.*")


def one_edit(a: str, b: str) -> bool:
    """Whether a becomes b by exactly one letter put in, taken out or replaced."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    at = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[at + 1 :] == b[at:]


def near_within(asking: list[str], asked: list[str]):
    """(place in asking, place in asked) of words one edit apart; the asked are of one length. Postings (of a gram at a place) of the asked are merged by a heap for each asking word, at the places that one edit allows, and counted."""
    short = len(asked[0])
    q = gram_size(short)
    index: dict = defaultdict(list)
    for k, w in enumerate(asked):
        for p in range(short - q + 1):
            index[w[p : p + q], p].append(k)
    for a, w in enumerate(asking):
        if len(asked) == 1 and asked[0] == w:
            continue
        shifts = (0,) if len(w) == short else (0, 1)
        lists = [index[at] for p in range(len(w) - q + 1) for s in shifts if (at := (w[p : p + q], p - s)) in index]
        enough = len(w) - 2 * q + 1
        met, times = -1, 0
        for k in heapq.merge(*lists, (len(asked),)):
            if k == met:
                times += 1
                continue
            if met >= 0 and times >= enough and one_edit(w, asked[met]):
                yield a, met
            met, times = k, 1


def near_pairs(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(a, b) of the ids of all words(id, word) that are one edit apart, each pair in both directions."""
    index = checkpoint(postings(words, gram_counts(words)))
    spread = cells(index, cell).join(words.select("id", "word"), "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "asks")

    def run(batches):
        for c in runs_of(batches, ("key", "i", "j")):
            q = c["asks"].astype(bool)
            ids, asked, words = c["id"], c["id"][~q], c["word"]
            if len(asked) and len(asked) < len(ids):
                pairs = [sorted((ids[q][a], asked[b])) for a, b in near_within(words[q].tolist(), words[~q].tolist())]
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], ["a", "b"])

    found = spread.select("key", "i", "j", "asks", "id", "word").mapInArrow(run, "a long, b long").distinct()
    return found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")


def followed(links: DataFrame) -> DataFrame:
    """(word, root) from links(word, form) without circles: every round doubles how far the forms are followed."""
    roots = checkpoint(links.select("word", F.col("form").alias("root")))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = checkpoint(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not further.where("moved").take(1):
            return roots
        roots = further.select("word", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of words(word, n): form is the near word of greatest n if that is at least `times` the word's."""
    held = checkpoint(words.select("word", "n").withColumn("id", F.monotonically_increasing_id()))
    near = near_pairs(held).join(held.select(F.col("id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n")), "b")
    best = near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    enough = -F.col("best.minus") >= times * F.col("n")
    marked = held.join(best, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"))
    marked = checkpoint(marked)
    roots = followed(marked.where("form is not null"))
    return marked.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words_of(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")
