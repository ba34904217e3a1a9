"""Near-duplicate texts at a stated similarity of word shingles, exact for that similarity.

Two texts are alike if the Jaccard similarity of their sets of distinct five-word shingles
is 0.8 or more. They are found in three steps. First, the SimHash fingerprints of op2 are
searched by its BK-trees, and the texts of each class of fingerprints meet in cells. Second, texts that
share a MinHash band (ten bands of three minima) with one of another group meet there too: pairs at 0.8 lie up
to some 20 of 64 bits apart, where no radius shows them. Third, a prefix join finds what neither showed: with shingles in any fixed order, similar sets share
one of their first n - ceil(0.8 n) + 1, so texts of different groups that share such a
shingle are compared too. Shingles frequent in a sample of the texts come last in the
order; the sample bears on cost only, not on what is found.

In a cell every pair that can be similar is verified on the shingle sets (32-bit hashes):
nodes that share no shingle of their prefixes by the cell's own frequencies can't be.

Texts of equal shingle sets are one node before anything is compared, so a text copied any
number of times is one node. A key of more than ``SHARD`` nodes is cut into cells. Of a class or band, each
cell holds a slice of the nodes and the key's ``LEADERS``, so a group of near copies of any size is
joined in proportion to its size; what no leader shows is left to the prefix join, which is exact.
Of a prefix element, the nodes outside the key's largest group meet all its nodes, slice by slice,
and those of the largest group don't meet each other again. A cell returns links that join its
parts, not all pairs.

Edge cases: a null text or one without words has the empty set, and all such rows are one
group; fewer words than a shingle give one shingle; repeated rows are one group; rows
without an id stay and remove nothing; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, free_name, lean
from .simhash import fingerprint, near_classes, runs_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
SLOTS = BANDS * ROWS
SHARD = 512
LEADERS = 16
#: One row in SAMPLE is asked for frequent shingles: those of OFTEN rows or more, the MOST most frequent of them.
SAMPLE, OFTEN, MOST = 32, 8, 100_000
#: Bits of a set's sketch.
SKETCH = 2048
#: Id lists up to this long are broadcast (8 bytes each); longer ones are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_draw = np.random.default_rng(11)
_MUL = _draw.integers(0, 2**32, SLOTS, np.uint32) | np.uint32(1)
_ADD = _draw.integers(0, 2**32, SLOTS, np.uint32)


def shingle_hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; one for a text of fewer words, none without words."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.fromiter((xxh64_intdigest(joined[a:z], 42) for a, z in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def minima(distinct: np.ndarray) -> np.ndarray:
    """SLOTS independent minima over the set."""
    if not len(distinct):
        return np.zeros(SLOTS, np.uint32)
    low = (distinct ^ (distinct >> np.uint64(32))).astype(np.uint32)
    out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 4096):
        out = np.minimum(out, (low[k : k + 4096, None] * _MUL + _ADD).min(axis=0))
    return out


def marks(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, set_key, size, bands, fp) of every row with an id; size counts the distinct shingles, fp is op2's fingerprint."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            keys, sizes, bands, fps = [], [], [], []
            for text in b.column(1).to_pylist():
                distinct = np.unique(shingle_hashes(text, shingle))
                m = minima(distinct)
                keys.append(xxh64_intdigest(distinct.tobytes(), 1))
                sizes.append(len(distinct))
                fps.append(fingerprint(text))
                bands.append([xxh64_intdigest(m[k : k + ROWS].tobytes(), k) for k in range(0, BANDS * ROWS, ROWS)])
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            flat = signed([x for y in bands for x in y])
            yield pa.RecordBatch.from_arrays([b.column(0), signed(keys), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), flat), signed(fps)], ["id", "set_key", "size", "bands", "fp"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), "id long, set_key long, size long, bands array<long>, fp long")


def similarity_of(p: np.ndarray, q: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    common = len(np.intersect1d(p, q, assume_unique=True))
    return common / max(1, len(p) + len(q) - common)


def prefix_sizes(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """How many first elements a set of each size must show: similar sets share one of theirs in any common order."""
    return sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1


def cell_links(sets: list[np.ndarray], similarity: float, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified pairs (i, j) of non-empty sets that join all that the similarity links and `groups` doesn't join yet, at most one fewer than the nodes."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    starts = np.cumsum(sizes) - sizes
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    token = token.astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    root = list(range(n)) if groups is None else np.unique(groups, return_index=True)[1][np.unique(groups, return_inverse=True)[1]].tolist()
    links = []
    held = np.zeros(len(count), np.int32)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def try_all(i):
        """Links i with every node that is as similar as asked and not yet joined."""
        mine = token[starts[i] : starts[i] + sizes[i]]
        held[mine] = 1
        common = np.add.reduceat(held[token], starts)
        held[mine] = 0
        for j in np.flatnonzero(common / (sizes[i] + sizes - common) >= similarity).tolist():
            if find(i) != find(j):
                root[find(j)] = find(i)
                links.append((i, j))

    def joined():
        return np.array([find(i) for i in range(n)])

    for _ in range(8):  # leaders join most of a large group without a search
        now = joined()
        alone = np.flatnonzero(np.bincount(now, minlength=n)[now] == 1)
        if len(alone) < 16:
            break
        try_all(int(alone[0]))
    rare = np.lexsort((token, count[token], owner))
    first = rare[np.arange(len(token)) - np.repeat(starts, sizes) < np.repeat(prefix_sizes(sizes, similarity), sizes)]
    now = joined()
    # only nodes that share a prefix element with another group can have a link to find
    least, most = np.full(len(count), n), np.full(len(count), -1)
    np.minimum.at(least, token[first], now[owner[first]])
    np.maximum.at(most, token[first], now[owner[first]])
    mixed = np.unique(owner[first][(least < most)[token[first]]])
    largest = np.bincount(now).argmax()
    for i in mixed[now[mixed] != largest].tolist():
        try_all(i)
    return links


def shingle_sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(rep, set) for ids(rep, set_key): the sorted distinct shingle hashes, 32 bits each, of a row of that id and key."""
    return hashed_sets(ids, docs, id_col, text_col, shingle).groupBy("rep").agg(F.min("set").alias("set"))


def set_columns(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    return {"set": pa.array([x.tobytes() for x in sets], pa.binary())}


def hashed_sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, columns=set_columns, schema: str = "set binary") -> DataFrame:
    """shingle_sets with a row for each repeated one, or other columns of the sets, made in the same worker: a second one would stay beside it for all later stages."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("binary").alias("text")).join(ids, "rep")

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            keep, sets = [], []
            for text, key in zip(b.column("text").to_pylist(), b.column("set_key").to_pylist()):
                distinct = np.unique(shingle_hashes(text, shingle))
                keep.append(np.uint64(xxh64_intdigest(distinct.tobytes(), 1)).astype(np.int64) == key)
                sets.append(np.unique(distinct.astype(np.uint32)))
            yield pa.RecordBatch.from_pydict({"rep": b.column("rep")} | columns(sets)).filter(pa.array(keep, pa.bool_()))

    return texts.mapInArrow(lean(run), f"rep long, {schema}")


def frequent_shingles(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> np.ndarray:
    """Shingle hashes frequent in a sample of the rows, sorted."""

    def run(batches):
        for b in batches:
            for text in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text, shingle)).view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(SAMPLE)) == 0).select(F.col(text_col).cast("binary"))
    often = some.mapInArrow(lean(run), "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(MOST)
    return np.sort(np.array([r["h"] for r in often.collect()], np.int64).view(np.uint64))


def prefix_keys(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(rep, group, keys) for nodes(rep, set_key, group): the first shingles of each set, frequent ones last. No text is shuffled, only keys where nodes are too many to broadcast."""
    frequent = frequent_shingles(docs, id_col, text_col, shingle)
    nodes = nodes.select("rep", "set_key", "group")
    nodes = F.broadcast(nodes) if 3 * nodes.count() <= BROADCAST_IDS else nodes
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("binary").alias("text"))

    def run(batches):
        from xxhash import xxh64_intdigest

        for b in batches:
            sets, keys = [], []
            for text in b.column("text").to_pylist():
                distinct = np.unique(shingle_hashes(text, shingle))
                sets.append(xxh64_intdigest(distinct.tobytes(), 1))
                last = np.isin(distinct, frequent, assume_unique=True)
                keys.append(np.concatenate([distinct[~last], distinct[last]])[: prefix_sizes(np.array([len(distinct)]), similarity)[0]].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["rep", "set_key", "keys"])

    return texts.mapInArrow(lean(run), "rep long, set_key long, keys array<long>").join(nodes, ["rep", "set_key"]).select("rep", "group", "keys")


def sketch(distinct: np.ndarray) -> np.ndarray:
    """SKETCH bits, each the parity of the elements that fall on it: two sets differ in at least as many elements as their sketches in bits."""
    return np.packbits(np.bincount(distinct.astype(np.uint32) % SKETCH, minlength=SKETCH) & 1)


def sketches(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(rep, n, bits) for ids(rep, set_key): the size and sketch of shingle_sets' sets."""

    def columns(sets):
        return {"n": pa.array([len(x) for x in sets], pa.int64()), "bits": pa.array([sketch(x).tobytes() for x in sets], pa.binary())}

    return hashed_sets(ids, docs, id_col, text_col, shingle, columns, "n long, bits binary").groupBy("rep").agg(F.min_by("n", "bits").alias("n"), F.min("bits").alias("bits"))


def may_be_similar(pairs: DataFrame, marked: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(rep, rep2) that the sketches marked(rep, n, bits) don't rule out."""

    def run(batches):
        for b in batches:
            p, q = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("bits", "bits2"))
            n = b.column("n").to_numpy() + b.column("n2").to_numpy()
            near = np.bitwise_count(p ^ q).sum(axis=1) <= (1 - similarity) / (1 + similarity) * n + 1e-6
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("rep2")], ["rep", "rep2"]).filter(pa.array(near))

    return pairs.join(marked, "rep").join(marked.toDF("rep2", "n2", "bits2"), "rep2").mapInArrow(lean(run), "rep long, rep2 long")


def band_cells(keys: DataFrame) -> DataFrame:
    """(key, i, j, rep): keys(key, rep) of two nodes or more in cells; slices of a large key share its leaders."""
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    cold = keys.join(sizes.where(F.col("n") <= SHARD), "key", "left_semi").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), "rep")
    hot = keys.join(sizes.where(F.col("n") > SHARD), "key").withColumn("c", F.ceil(F.col("n") / (SHARD - LEADERS)).cast("int")).withColumn("i", F.expr("cast(pmod(xxhash64(rep), c) as int)"))
    first = F.min(F.struct(F.xxhash64("rep", F.lit(5)).alias("h"), "rep", "i")).alias("lead")
    leaders = hot.groupBy("key", "c", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(LEADERS)).alias("which")).agg(first)
    spread = leaders.select("key", F.explode(F.expr("filter(sequence(0, c - 1), x -> x <> lead.i)")).alias("i"), F.lit(0).alias("j"), "lead.rep")
    return cold.unionByName(hot.select("key", "i", F.lit(0).alias("j"), "rep")).unionByName(spread)


def element_cells(keys: DataFrame) -> DataFrame:
    """(key, i, j, rep): large keys(key, rep, group) in cells where every node outside the key's largest group meets every node."""
    sizes = keys.groupBy("key", "group").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("key").agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("group", F.struct("m", "group")).alias("main"))
    half = SHARD // 2
    rows = keys.join(largest, "key").withColumns({"o": F.ceil((F.col("n") - F.col("most")) / half).cast("int"), "a": F.ceil(F.col("n") / half).cast("int")}).where("o > 0")
    salt = lambda k, c: F.pmod(F.xxhash64("rep", F.lit(k)), F.col(c)).cast("int")
    every = rows.select("key", F.explode(F.expr("sequence(0, o - 1)")).alias("i"), salt(3, "a").alias("j"), "rep")
    outside = rows.where("group <> main").select("key", salt(5, "o").alias("i"), F.explode(F.expr("sequence(0, a - 1)")).alias("j"), "rep")
    return every.unionByName(outside).distinct()


def near_links(nodes: DataFrame, cells: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Verified (a, b) between the `rep`s of nodes(set_key, rep, group), enough to join all that are similar and share one of cells(key, i, j, rep)."""
    shared = checkpoint(cells)
    members = nodes.select("rep", "set_key", "group").join(shared.select("rep").distinct(), "rep", "left_semi")
    sets = shingle_sets(members.select("rep", "set_key"), docs, id_col, text_col, shingle)
    dealt = shared.join(members.drop("set_key").join(sets, "rep"), "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")

    def run(batches):
        for cell in runs_of(batches, ("key", "i", "j")):
            links = cell_links([np.frombuffer(x, np.uint32) for x in cell["set"].tolist()], similarity, cell["group"])
            if links:
                i, j = (np.array(x) for x in zip(*links))
                yield pa.RecordBatch.from_arrays([pa.array(cell["rep"][i]), pa.array(cell["rep"][j])], ["a", "b"])

    return dealt.select("key", "i", "j", "rep", "group", "set").mapInArrow(lean(run), "a long, b long")


def prefix_links(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Verified (a, b) between the `rep`s of nodes(set_key, rep, group, size), enough to join all groups that are similar.

    Of keys up to SHARD nodes the pairs are formed and their shared prefix elements counted. What
    two prefixes don't show can add one fewer than ceil(similarity * larger size), so pairs that
    share too few can't be similar, nor can those whose sketches differ in too many bits; the others are verified. Keys of more nodes go through cells.
    """
    args = (docs, id_col, text_col, shingle, similarity)
    keys = prefix_keys(nodes, *args).select("rep", "group", F.explode("keys").alias("key"))
    own = Window.partitionBy("key")
    mixed = keys.withColumns({"least": F.min("group").over(own), "most": F.max("group").over(own), "n": F.count("*").over(own)}).where("least < most")
    rows = checkpoint(mixed.select("key", "rep", "group", "n"))
    x = rows.where(F.col("n") <= SHARD).join(nodes.select("rep", "size"), "rep").select("key", "rep", "group", "size")
    y = x.toDF("key", "rep2", "group2", "size2")
    met = x.join(y, "key").where(f"rep < rep2 and group <> group2 and least(size, size2) >= {similarity!r} * greatest(size, size2) - 1e-6")
    needed = f"ceil({similarity!r} / (1 + {similarity!r}) * (size + size2) - 1e-6) - ceil({similarity!r} * greatest(size, size2) - 1e-9) + 1"
    pairs = checkpoint(met.groupBy("rep", "rep2", "size", "size2").agg(F.count("*").alias("c")).where(f"c >= {needed}").select("rep", "rep2"))
    links = near_links(nodes, element_cells(rows.where(F.col("n") > SHARD).select("key", "rep", "group")), *args)
    if pairs.isEmpty():
        return links

    def ends(pairs):
        return nodes.select("rep", "set_key").join(pairs.select("rep").unionByName(pairs.select(F.col("rep2").alias("rep"))).distinct(), "rep", "left_semi")

    pairs = checkpoint(may_be_similar(pairs, checkpoint(sketches(ends(pairs), *args[:-1])), similarity))
    if pairs.isEmpty():
        return links
    sets = checkpoint(shingle_sets(ends(pairs), *args[:-1]))

    def run(batches):
        for b in batches:
            alike = [similarity_of(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)) >= similarity for p, q in zip(b.column("set").to_pylist(), b.column("set2").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("rep2")], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    both = pairs.join(sets, "rep").join(sets.toDF("rep2", "set2"), "rep2")
    return links.unionByName(both.mapInArrow(lean(run), "a long, b long"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, group_id) of every row with an id; a group is named by its smallest id."""
    marked = checkpoint(marks(docs, id_col, text_col, shingle))
    first = F.min_by(F.struct("size", "bands", "fp"), "id").alias("m")
    nodes = checkpoint(marked.groupBy("set_key").agg(F.min("id").alias("rep"), first).select("set_key", "rep", "m.*"))
    args = (docs, id_col, text_col, shingle, similarity)
    filled = nodes.where("size > 0").drop("bands", "fp").withColumn("group", F.col("rep"))

    def grouped(links):
        comps = connected_components(links).withColumnRenamed("node", "rep")
        return comps, checkpoint(filled.drop("group").join(comps, "rep", "left").select("set_key", "rep", "size", F.coalesce("component", "rep").alias("group")))

    classes = near_classes(nodes.where("size > 0").select("fp", "rep")).select("rep", F.col("component").alias("key"))
    links = checkpoint(near_links(filled, band_cells(classes), *args))
    comps, filled = grouped(links)
    bands = nodes.select("rep", F.posexplode("bands").alias("k", "v")).select("rep", F.xxhash64("k", "v").alias("key")).join(filled.select("rep", "group"), "rep")
    mixed = bands.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most").select("key")
    keys = checkpoint(bands.join(mixed, "key", "left_semi").select("key", "rep"))
    for step in (lambda n: near_links(n, band_cells(keys), *args), lambda n: prefix_links(n, *args)):
        more = checkpoint(step(filled))
        if not more.isEmpty():
            links = links.unionByName(more)
            comps, filled = grouped(links)
    named = nodes.select("set_key", "rep").join(comps, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("group_id"))
    return marked.select("id", "set_key").join(named, "set_key").select("id", "group_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows without those that repeat another; of each group the row of the smallest id stays."""
    groups = checkpoint(near_groups(docs, id_col, text_col, shingle, similarity))
    gone = groups.groupBy("id").agg(F.min("group_id").alias("g"), F.count("*").alias("n")).where("g <> id or n > 1")
    count = gone.count()
    gone = F.broadcast(gone) if count <= BROADCAST_IDS else gone
    group, times = free_name(docs, "group"), free_name(docs, "times")
    named = docs.join(gone.select(F.col("id").alias(id_col), F.col("g").alias(group), F.col("n").alias(times)), id_col, "left")
    once = named.where(F.col(times).isNull())
    # rows of a repeated id that stay: one for each, by its text and then its other columns
    again = named.where((F.col(times) > 1) & (F.col(group) == F.col(id_col)))
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    first = again.groupBy(id_col).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col(text_col), F.xxhash64(*plain))).alias(group)).select(f"{group}.*")
    return once.select(*docs.columns).unionByName(first.select(*docs.columns))
