"""Byte-level BPE by corpus-level merge replay.

Tasks split their texts by the public pattern into chunks: the distinct words, and the texts as
runs of word numbers. The words of all chunks are dealt by hash to buckets; a bucket's task replays
the merges over the words it has not met, packet by packet and REPLAY_BYTES of them at once, so that a word of the corpus is encoded once
(or again, if all the words a task has met outgrow its bound), and sends each chunk the ids of the words it asked for. In a replay an inverted index leads from a
token pair (by the rank of the token it makes; all pairs that make it share a list) to the word
positions that hold it, a heap hands out the ranks in order, and each merge updates only the
neighbours it touches. A word's positions of one rank are merged left to right; should a merge
bear a lower rank, that goes first in its word, as in word-by-word encoding.

Chunks are cut by size; buckets are as many as the session's tasks, so packets grow as the corpus
does, and a task holds a packet's words and a bounded store of words.

Edge cases: null text counts as empty and gives no ids; very long texts are whole words
and positions like any other; repeated rows stay; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, pack, parts, table, trim, unpack

CHUNK_BYTES = 8 << 20
CHUNK_ROWS = 1 << 16
#: Bytes of text for each bucket of words at least; of what a task holds of words and their ids.
LEAST_BUCKET = 1 << 20
KNOWN_BYTES = 64 << 20
#: Bytes of words that are replayed together; a longer word is replayed alone.
REPLAY_BYTES = 1 << 19
MAX_VOCAB_BYTES = 64 << 20
#: For texts of these characters only, the standard library's classes agree with the Unicode properties of the pattern.
PLAIN = re.compile("[\t\n\x20-\x7eÀ-ÖØ-öø-ɏ]*")
PLAIN_STANDS_FOR = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A blank that white space precedes and follows; without one, plain texts may be cut before every blank and split piece by piece.
BLANK_WITHIN = re.compile(r"\s (?:\s|\Z)")
PLAIN_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


#: Below so many positions of a rank, single steps are faster than arrays.
FEW = 128


class Pieces(dict):
    """Word numbers of texts in pieces: the words themselves (each splits into itself alone), and ~k for a piece that is the kth run of word numbers."""

    def __init__(self, split):
        self.split, self.runs = split, {}
        self.flat, self.start, self.lens = array("i"), array("q"), array("i")

    def __missing__(self, piece: str) -> int:
        if (number := self.runs.get(piece)) is not None:
            return number
        got = self.split(piece)
        if got == [piece]:
            number = self[piece] = len(self)
            return number
        number = self.runs[piece] = ~len(self.lens)
        self.start.append(len(self.flat))
        self.lens.append(len(got))
        self.flat.extend(self.whole(got).tolist())
        return number

    def whole(self, words: list[str]) -> np.ndarray:
        """Numbers of words."""
        return np.fromiter((self.setdefault(w, len(self)) for w in words), np.int32, len(words))

    def numbers(self, cut: list[str]) -> np.ndarray:
        """Word numbers of pieces on end."""
        at = np.fromiter(map(self.__getitem__, cut), np.int32, len(cut))
        if not (at < 0).any():
            return at
        runs = ~at[at < 0]
        lens = np.ones(len(at), np.int64)
        lens[at < 0] = np.frombuffer(self.lens, np.int32)[runs]
        out = np.repeat(at, lens)
        if len(self.flat):
            out[out < 0] = np.frombuffer(self.flat, np.int32)[spread(np.frombuffer(self.start, np.int64)[runs], lens[at < 0])]
        return out


class MergeReplay:
    """Encodes lists of byte words and decodes ids, by a table of ranks (bytes to id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        n = max(ranks.values(), default=-1) + 1
        self.n = n
        tokens = [b""] * n
        for b, i in ranks.items():
            tokens[i] = b
        self.token_len = np.array([len(b) for b in tokens], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.buffer = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        codes, merged = [], []
        for b, i in ranks.items():
            for k in range(1, len(b)):
                left = ranks.get(b[:k])
                if left is not None and (right := ranks.get(b[k:])) is not None:
                    codes.append(left * n + right)
                    merged.append(i)
        self.rank_of = dict(zip(codes, merged))
        order = np.argsort(np.array(codes, np.int64), kind="stable")
        self.codes = np.array(codes, np.int64)[order]
        self.merged = np.array(merged, np.int64)[order]
        self.first_ranks = self.pair_rank(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, -1 where the pair merges to nothing."""
        code = left * self.n + right
        if not len(self.codes):
            return np.full(len(code), -1, np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.merged[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words on end, number of ids of each word)."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        lens = np.array([len(w) for w in words], np.int64)
        rest = np.flatnonzero((whole < 0) & (lens > 0))
        # words don't bear on each other, so few bytes at a time hold the positions' lists down
        some = np.split(rest, np.flatnonzero(np.diff(np.cumsum(lens[rest]) // REPLAY_BYTES)) + 1)
        flat, counts = (np.concatenate(x) for x in zip(*(self._replay([words[i] for i in k], lens[k]) for k in some)))
        n_ids = np.where(whole >= 0, 1, 0)
        n_ids[rest] = counts
        start = np.cumsum(n_ids) - n_ids
        out = np.empty(int(n_ids.sum()), np.int64)
        out[start[whole >= 0]] = whole[whole >= 0]
        out[spread(start[rest], counts)] = flat
        return out, n_ids

    def _replay(self, words: list[bytes], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        n, rank_of = self.n, self.rank_of
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        size = len(raw)
        # per position: symbol (-1: merged away), next and previous position, rank of the pair that begins here, word
        s_, n_, p_, r_, w_ = (array("i", bytes(4 * size)) for _ in range(5))
        sym, nxt, prv, rank, word = (np.frombuffer(x, np.int32) for x in (s_, n_, p_, r_, w_))
        ends = np.cumsum(lens) - 1
        sym[:] = self.byte_id[raw]
        nxt[:], prv[:] = np.arange(1, size + 1), np.arange(-1, size - 1)
        nxt[ends], prv[ends - lens + 1] = -1, -1
        word[:] = np.repeat(np.arange(len(words)), lens)
        rank[:] = -1
        here = np.flatnonzero(nxt >= 0)
        rank[here] = self.first_ranks[raw[here] * 256 + raw[here + 1]]
        index: dict[int, list[int]] = {}
        heap: list[int] = []

        def post(positions: np.ndarray) -> None:
            """Enters positions into the index under the rank of the pair that begins there."""
            r = rank[positions]
            order = np.argsort(r, kind="stable")
            order = order[np.searchsorted(r[order], 0) :]
            positions, r = positions[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, some in zip(r[np.concatenate([[0], cuts])].tolist() if len(r) else (), np.split(positions, cuts)):
                if (found := index.get(k)) is None:
                    index[k] = some.tolist()
                    heappush(heap, k)
                else:
                    found.extend(some.tolist())

        def few(r: int, at: list[int]) -> None:
            held = -1  # a word in which a lower rank was born; its other positions come again
            for p in sorted(at):
                if r_[p] != r:
                    continue
                if w_[p] == held:
                    if r not in index:
                        heappush(heap, r)
                    index.setdefault(r, []).append(p)
                    continue
                gone, before = n_[p], p_[p]
                after = n_[gone]
                s_[p], s_[gone], r_[gone], n_[p], r_[p] = r, -1, -1, after, -1
                if after >= 0:
                    p_[after] = p
                for q, pair in ((p, r * n + s_[after] if after >= 0 else -1), (before, s_[before] * n + r)):
                    if q < 0 or pair < 0:
                        continue
                    k = r_[q] = rank_of.get(pair, -1)
                    if k >= 0:
                        if (found := index.get(k)) is None:
                            index[k] = [q]
                            heappush(heap, k)
                        else:
                            found.append(q)
                        if k < r:
                            held = w_[p]

        def many(r: int, listed: list[int]) -> None:
            every = np.unique(np.array(listed, np.int64))
            every = every[rank[every] == r]
            if not len(every):
                return
            # of overlapping pairs every other one, from the left
            start = np.ones(len(every), bool)
            start[1:] = every[1:] != nxt[every[:-1]]
            since = np.arange(len(every))
            at = every[(since - np.maximum.accumulate(np.where(start, since, 0))) % 2 == 0]
            gone, before = nxt[at], prv[at]
            after = nxt[gone]
            beside = np.zeros(len(at), bool)
            beside[1:] = gone[:-1] == before[1:]
            left = np.where(before >= 0, self.pair_rank(np.where(beside, r, sym[before]).astype(np.int64), np.full(len(at), r)), -1)
            right = np.where(after >= 0, self.pair_rank(np.full(len(at), r), sym[after].astype(np.int64)), -1)
            low = ((left >= 0) & (left < r)) | ((right >= 0) & (right < r))
            if low.any():  # after the first of a word, its other positions come again
                w = word[at]
                seen = np.cumsum(low) - low
                wait = seen > seen[np.searchsorted(w, w)]
                again = every[np.isin(word[every], w[wait])].tolist()
                at, gone, after = at[~wait], gone[~wait], after[~wait]
            sym[at], sym[gone], rank[gone], nxt[at] = r, -1, -1, after
            has = after >= 0
            prv[after[has]] = at[has]
            before = prv[at]
            touched = np.unique(np.concatenate([at, before[before >= 0]]))
            follow = nxt[touched]
            rank[touched] = np.where(follow >= 0, self.pair_rank(sym[touched].astype(np.int64), sym[follow].astype(np.int64)), -1)
            post(touched)
            if low.any():
                again = [p for p in again if r_[p] == r]
                if again and r not in index:
                    heappush(heap, r)
                if again:
                    index.setdefault(r, []).extend(again)

        post(here)
        while heap:
            r = heappop(heap)
            at = index.pop(r)
            (few if len(at) < FEW else many)(r, at)
        alive = sym >= 0
        return sym[alive].astype(np.int64), np.bincount(word[alive], minlength=len(words)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        lens = self.token_len[ids]
        return self.buffer[spread(self.token_at[ids], lens)].tobytes()


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... for each start, lens of them."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)


def load_ranks(data: bytes) -> dict[bytes, int]:
    """A ranks file: a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def _vocab(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCAB_BYTES + 1)
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"the vocabulary {path} is over {MAX_VOCAB_BYTES} bytes")
    return data


_REPLAYS: dict[str, MergeReplay] = {}


def replay_of(data: bytes) -> MergeReplay:
    """One table of merges per Python worker, kept by the vocabulary's content."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _REPLAYS:
        _REPLAYS.clear()
        _REPLAYS[key] = MergeReplay(load_ranks(data))
    return _REPLAYS[key]


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))


def pack_words(words: list[bytes]) -> bytes:
    """The number of words, then their lengths and bytes compressed."""
    import zstandard

    lens = np.fromiter(map(len, words), np.uint32, len(words))
    return len(words).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(lens.tobytes() + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    import zstandard

    n = int.from_bytes(data[:8], "little")
    held = zstandard.ZstdDecompressor().decompress(data[8:])
    ends = np.cumsum(np.frombuffer(held[: 4 * n], np.uint32), dtype=np.int64) + 4 * n
    return [held[a:z] for a, z in zip([4 * n, *ends[:-1].tolist()], ends.tolist())]


def split_chunks(docs: DataFrame, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk of a task's texts: ids, lens (words of each text), seq (word numbers on end) and the words, by their hash."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import regex

        full = regex.compile(pattern)
        plain = pattern == PLAIN_STANDS_FOR
        part, k = TaskContext.get().partitionId(), 0
        schema = None

        def fresh():
            return [], [], Pieces(PLAIN_PATTERN.findall), 0

        ids, seqs, pieces, held = fresh()

        def chunk():
            words = [w.encode() for w in pieces]
            pieces.clear(), pieces.runs.clear()
            hashes = word_hashes(words)
            order = np.lexsort((np.arange(len(words)), hashes))
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words), dtype=np.int32)
            lens = [len(x) for x in seqs]
            seq = rank[np.concatenate(seqs)]
            seqs.clear()
            one = {"chunk": part << 32 | k, "ids": ids, "lens": lens, "seq": pack(seq), "words": pack_words([words[i] for i in order.tolist()])}
            return pa.RecordBatch.from_pylist([one], schema)

        for b in batches:
            if schema is None:
                schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(b.schema.field("id").type)), ("lens", pa.list_(pa.int64())), ("seq", pa.binary()), ("words", pa.binary())])
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                text = text or ""
                easy = plain and PLAIN.fullmatch(text)
                ids.append(i)
                if easy and not BLANK_WITHIN.search(text):
                    seqs.append(pieces.numbers(text.replace(" ", "\0 ").split("\0")))
                else:
                    seqs.append(pieces.whole((PLAIN_PATTERN if easy else full).findall(text)))
                held += len(text)
                if held >= CHUNK_BYTES or len(ids) >= CHUNK_ROWS:
                    yield chunk()
                    (ids, seqs, pieces, held), k = fresh(), k + 1
        if ids:
            yield chunk()

    return rows.mapInArrow(lean(run), f"chunk long, ids array<{kind}>, lens array<long>, seq binary, words binary")


class Known:
    """The ids of the words that a task has met, each replayed once; forgotten together when they take KNOWN_BYTES."""

    def __init__(self, replay: MergeReplay):
        self.replay = replay
        self.forget()

    def forget(self):
        self.numbers: dict[bytes, int] = {}
        self.flat, self.start, self.size, self.held = array("I"), array("q"), array("I"), 0

    def learn(self, words: list[bytes]):
        if self.held > KNOWN_BYTES:
            self.forget()
        new = list({w: None for w in words if w not in self.numbers})
        if new:
            flat, n_ids = self.replay.encode(new)
            self.start.frombytes((len(self.flat) + np.cumsum(n_ids) - n_ids).tobytes())
            self.flat.frombytes(flat.astype(np.uint32).tobytes())
            self.size.frombytes(n_ids.astype(np.uint32).tobytes())
            self.held += sum(len(w) + 100 for w in new) + 8 * len(flat)
            for w in new:
                self.numbers[w] = len(self.numbers)

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each word has, the ids in turn)."""
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.uint32)
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        size = np.frombuffer(self.size, np.uint32)[at]
        return size, np.frombuffer(self.flat, np.uint32)[spread(np.frombuffer(self.start, np.int64)[at], size.astype(np.int64))]


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of hashes, in their order."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def encode_texts(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) of every row; the ids have been decoded again for the last digest."""
    vocab = docs.sparkSession.sparkContext.broadcast(_vocab(vocab_path))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    spread_over = parts(docs.sparkSession, -(-size // CHUNK_BYTES))
    # as many buckets as the session's tasks, however large the corpus: packets are chunks × buckets, and grow as the chunks do
    n = max(1, min(parts(docs.sparkSession, 1), -(-size // LEAST_BUCKET)))
    # one exchange of the chunks serves both uses below, so both read all columns
    chunks = split_chunks(docs, pattern, id_col, text_col).repartition(spread_over, "chunk")
    kind = chunks.schema["ids"].dataType.elementType.simpleString()

    def ask(batches):
        for b in batches:
            for chunk, packed in zip(b.column("chunk").to_pylist(), b.column("words").to_pylist()):
                words = unpack_words(packed)
                bucket = bucket_of(word_hashes(words), n)
                present, starts = np.unique(bucket, return_index=True)
                cuts = [*starts.tolist(), len(words)]
                yield pa.RecordBatch.from_arrays([pa.array(present), pa.array(np.full(len(present), chunk)), pa.array([pack_words(words[a:z]) for a, z in zip(cuts, cuts[1:])], pa.binary())], ["bucket", "chunk", "words"])

    def encode(batches):
        known = Known(replay_of(vocab.value))
        for b in batches:
            n_ids, word_ids = [], []
            for x in b.column("words").to_pylist():
                words = unpack_words(x)
                known.learn(words)
                size, ids = known.ids(words)
                n_ids.append(pack(size)), word_ids.append(pack(ids))
            yield pa.RecordBatch.from_arrays([b.column("bucket"), b.column("chunk"), pa.array(n_ids, pa.binary()), pa.array(word_ids, pa.binary())], ["bucket", "chunk", "n_ids", "word_ids"])

    answers = chunks.mapInArrow(lean(ask), "bucket long, chunk long, words binary").repartition(spread_over, "bucket").mapInArrow(lean(encode), "bucket long, chunk long, n_ids binary, word_ids binary")

    def write(chunk: pa.Table, got: pa.Table) -> pa.Table:
        got = got.sort_by("bucket")
        out = {name: [] for name in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")}
        none = np.empty(0, np.uint32)
        n_ids = np.concatenate([none, *(unpack(x, "u4") for x in got["n_ids"].to_pylist())]).astype(np.int64)
        flat = np.concatenate([none, *(unpack(x, "u4") for x in got["word_ids"].to_pylist())]).astype(np.int64)
        start = np.cumsum(n_ids) - n_ids
        decode = replay_of(vocab.value).decode
        seq, lens = unpack(chunk["seq"][0].as_py(), "i4"), chunk["lens"][0].as_py()
        at = 0
        for k in lens:
            w = seq[at : at + k]
            at += k
            ids = flat[spread(start[w], n_ids[w])]
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decode(ids)).hexdigest())
            if keep_ids:
                out["ids"].append(ids.astype(np.int32))
        ids_col = chunk["ids"].combine_chunks()
        cols = {id_col: ids_col.flatten(), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "ids_sha256": pa.array(out["ids_sha256"], pa.string()), "decoded_sha256": pa.array(out["decoded_sha256"], pa.string())}
        trim()
        return pa.table(cols | ({"ids": pa.array(out["ids"], pa.list_(pa.int32()))} if keep_ids else {}))

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return chunks.groupBy("chunk").cogroup(answers.repartition(spread_over, "chunk").groupBy("chunk")).applyInArrow(write, schema)


def default_vocab() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), *default_vocab())
