"""Evaluation texts inside training text, by suffix arrays of the training text.

The corpus is cut into shards; of each, all words and the array of all its word
suffixes, sorted, are stored in the shared folder, once.  The test items are
read in blocks of a bounded size; every suffix of a block is searched in every
shard, one word after the other, which narrows its range in the array until it
is empty or as deep as the minimum length; what is found is extended to the
longest verbatim match.  Only matches leave a shard.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise

_WORD = re.compile(r"[^\W_]+")
#: Words of test items that are searched in one pass over the stored shards.
BLOCK_WORDS = 1_000_000
#: Words of a shard.
SHARD_WORDS = 500_000
#: Matches that are extended at a time.
MATCHES = 500_000
_SHARD = "shard long, docs binary, ends binary, vocabulary binary, tokens binary, suffixes binary"
_MATCH = "doc_id long, item_id long, n_words long, doc_word long, item_word long"


def words(text: str | None) -> list[str]:
    """The longest runs of letters or digits, lower-cased."""
    return _WORD.findall(text.lower()) if text else []


def number(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``tokens`` sorted by the first ``depth`` tokens from there on (doubling)."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    h = 1
    while h < depth:
        nxt = np.zeros(n, np.int64)
        nxt[: n - h] = rank[h:] if h < n else nxt[:0]
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([1], (k[1:] != k[:-1]).astype(np.int64))))
        rank = new
        if rank.max() == n:
            break
        h *= 2
    return order


def build_shards(corpus: DataFrame, doc: str, text: str, depth: int, size: int = SHARD_WORDS) -> DataFrame:
    """Shards of the corpus with their suffix arrays, sorted by the first ``depth`` words.

    A word is its place in the shard's sorted vocabulary of 64-bit numbers; a
    document ends with -1.  A text longer than a shard is a shard of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        docs: list[int] = []
        ends: list[int] = []
        tokens: list[int] = []
        ids: dict[str, int] = {}

        def close() -> pa.RecordBatch:
            nonlocal docs, ends, tokens, ids, seq
            numbers = np.array([number(w) for w in ids], np.int64)
            order = np.argsort(numbers)
            place = np.empty(len(order) + 1, np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            place[-1] = -1
            t = place[np.array(tokens, np.int64)]
            sa = suffix_array(t, depth).astype(np.int32)
            sa = sa[t[sa] >= 0]
            values = [np.array(docs, np.int64), np.array(ends, np.int64), numbers[order], t, sa]
            out = pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], names=["shard", "docs", "ends", "vocabulary", "tokens", "suffixes"])
            docs, ends, tokens, ids, seq = [], [], [], {}, seq + 1
            return out

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = words(t)
                if not ws:
                    continue
                for w in ws:
                    tokens.append(ids.setdefault(w, len(ids)))
                tokens.append(-1)
                docs.append(d)
                ends.append(len(tokens))
                if len(tokens) >= size:
                    yield close()
        if docs:
            yield close()

    return corpus.mapInArrow(run, _SHARD)


class Shard:
    """One shard as arrays."""

    def __init__(self, docs: bytes, ends: bytes, vocabulary: bytes, tokens: bytes, suffixes: bytes):
        self.docs, self.ends, self.vocabulary = (np.frombuffer(x, np.int64) for x in (docs, ends, vocabulary))
        self.tokens, self.suffixes = np.frombuffer(tokens, np.int32), np.frombuffer(suffixes, np.int32)

    def local(self, numbers: np.ndarray) -> np.ndarray:
        """Words in the shard's numbering, -2 where the shard has none."""
        at = np.minimum(np.searchsorted(self.vocabulary, numbers), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == numbers, at, -2).astype(np.int32)

    def _edge(self, lo: np.ndarray, hi: np.ndarray, shift: int, value: np.ndarray, right: bool) -> np.ndarray:
        """For each row, the first place in its range whose word at ``shift`` is not before (right: after) ``value``."""
        lo, hi = lo.copy(), hi.copy()
        rows = np.arange(len(lo))
        while len(rows := rows[lo[rows] < hi[rows]]):
            mid = (lo[rows] + hi[rows]) // 2
            have = self.padded[self.suffixes[mid] + shift]
            up = have <= value[rows] if right else have < value[rows]
            lo[rows] = np.where(up, mid + 1, lo[rows])
            hi[rows] = np.where(up, hi[rows], mid)
        return lo

    def search(self, words_: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which start, lo, hi): ranges of the array that begin with the ``least`` words from each start on."""
        self.padded = np.concatenate((self.tokens, np.full(least + 1, -1, np.int32)))
        which = np.arange(len(starts))
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.suffixes), np.int64)
        for shift in range(least):
            value = words_[starts[which] + shift]
            fine = value >= 0
            which, lo, hi, value = which[fine], lo[fine], hi[fine], value[fine]
            lo, hi = self._edge(lo, hi, shift, value, False), self._edge(lo, hi, shift, value, True)
            fine = lo < hi
            which, lo, hi = which[fine], lo[fine], hi[fine]
        return which, lo, hi


class TestSet:
    """One block of test items: their words as numbers, and every suffix of the minimum length."""

    __test__ = False

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.least = least
        ids: dict[str, int] = {}
        rows = [[ids.setdefault(w, len(ids)) for w in ws] for _, ws in items if len(ws) >= least]
        self.vocabulary = np.array([number(w) for w in ids], np.int64)
        self.names = np.array([i for i, ws in items if len(ws) >= least], np.int64)
        self.tokens = np.array([x for r in rows for x in [*r, -1]], np.int64)
        lens = np.array([len(r) for r in rows], np.int64)
        begins = np.cumsum(lens + 1) - lens - 1
        counts = lens - least + 1
        self.item = np.repeat(np.arange(len(rows)), counts)
        self.offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        self.place = np.repeat(begins, counts) + self.offset

    def matches(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        """Longest matches in one shard, some at a time."""
        known = np.append(shard.local(self.vocabulary), np.int32(-3))
        mine = known[self.tokens]
        which, lo, hi = shard.search(mine, self.place, self.least)
        n = hi - lo
        edge = np.flatnonzero(np.diff(np.concatenate(([-1], np.cumsum(n) // MATCHES)))) if len(n) else np.zeros(0, np.int64)
        for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(n)]):
            some = n[x:y]
            suffix = np.repeat(which[x:y], some)
            place = shard.suffixes[np.repeat(lo[x:y], some) + np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)].astype(np.int64)
            at = self.place[suffix]
            before = np.where(place > 0, shard.tokens[place - 1], -1)
            maximal = before != np.where(self.offset[suffix] > 0, mine[at - 1], -3)
            suffix, place, at = suffix[maximal], place[maximal], at[maximal]
            length = np.full(len(suffix), self.least, np.int64)
            live = np.arange(len(suffix))
            while len(live):
                live = live[shard.tokens[place[live] + length[live]] == mine[at[live] + length[live]]]
                length[live] += 1
            run = np.searchsorted(shard.ends, place, "right")
            begin = np.where(run > 0, shard.ends[run - 1], 0)
            cols = (shard.docs[run], self.names[self.item[suffix]], length, place - begin, self.offset[suffix])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_words", "doc_word", "item_word"])


def find_leaks(corpus: DataFrame, tests: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", min_words: int = 12, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Longest verbatim matches: (doc_id, item_id, n_words, doc_word, item_word).

    A match is a run of at least ``min_words`` words that document and item
    share and that cannot be extended to the left or right; words are the
    longest runs of letters or digits, lower-cased.  Places count words from
    0.  NULL or empty texts match nothing, nor do items shorter than the
    minimum; repeated rows count once.  The corpus is read and sorted once;
    the items come to the driver in blocks of about ``block_words`` words, one
    after the other, each with one pass over the stored shards.
    """
    spark = corpus.sparkSession
    rows = corpus.where((F.length(text) > 0) & F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t"))
    held = tests.where(F.length(text) > 0).select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).distinct()
    size = held.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / 6 / block_words))  # a word and its blank have some six characters
    shards = materialise(build_shards(rows, "d", "t", min_words), "suffixes", rows_per_file=16)
    out = None
    for k in range(blocks):
        mine = held if blocks == 1 else held.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        block = TestSet([(r["i"], words(r["t"])) for r in mine.orderBy("i", "t").collect()], min_words)
        if not len(block.place):
            continue
        sent = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(b.num_rows):
                    yield from sent.value.matches(Shard(*(b.column(c)[at].as_py() for c in range(1, 6))))

        found = shards.mapInArrow(scan, _MATCH)
        if blocks > 1:
            found = materialise(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return (spark.createDataFrame([], _MATCH) if out is None else out).distinct()


def remove_leaked(corpus: DataFrame, leaks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The corpus without every document that has a leak (NULL ids stay)."""
    bad = leaks.select(F.col("doc_id").alias(doc)).distinct()
    return corpus.join(bad, doc, "left_anti")
