"""Documents into containers of fixed token capacity, balanced by attention cost.

A document's cost is linear in its tokens plus quadratic for attention.  The
corpus is cut into shards of a bounded number of tokens; in a shard there are
as many sequences as the tokens need at least, and the documents, longest
first, each go to the cheapest sequence with room.  Only a document that
exceeds the capacity by itself is divided.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise

CAPACITY = 2048
#: Tokens of one shard: what one task packs, and at most one container is part-filled for so many.
SHARD_TOKENS = 2_000_000
# Fixed value: the published pre-tokenization pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@functools.lru_cache(maxsize=2)
def tokenizer_of(vocabulary: bytes):
    """The tokenizer of a vocabulary file's content."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer(path: str):
    with open(path, "rb") as f:
        return tokenizer_of(f.read())


def count_pieces(df: DataFrame, key: str, text: str, capacity: int, vocabulary: str) -> DataFrame:
    """(key, piece, first_token, n_tokens): one piece, or more where a text exceeds the capacity.

    The vocabulary is read on the driver and broadcast, so that executors need no file.
    """
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_of(sent.value).encode_ordinary
        for b in batches:
            n = np.array([len(encode(t)) for t in b.column(1).to_pylist()], np.int64)
            pieces = np.maximum(1, -(-n // capacity))
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = piece * capacity
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(first, pa.int64()), pa.array(np.minimum(capacity, n[row] - first), pa.int64())], names=["k", "piece", "first_token", "n_tokens"])

    kind = dict(df.dtypes)[key]
    rows = df.where(F.length(text) > 0).select(key, text)
    return rows.mapInArrow(count, f"k {kind}, piece int, first_token long, n_tokens long").withColumnRenamed("k", key)


def assign(sizes: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[np.ndarray, np.ndarray]:
    """Container and position of each size (given in descending order).

    Cheapest container with room first; equal costs by smaller number.  A new
    container opens only where none has room.
    """
    n = max(1, math.ceil(sizes.sum() / capacity))
    cost = np.zeros(n)
    room = np.full(n, capacity, np.int64)
    count = np.zeros(n, np.int64)
    where = np.zeros(len(sizes), np.int64)
    place = np.zeros(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        c = int(np.argmin(np.where(room >= s, cost, np.inf)))
        if room[c] < s:
            cost, room, count = np.append(cost, 0.0), np.append(room, capacity), np.append(count, 0)
            c = len(cost) - 1
        where[i], place[i] = c, count[c]
        cost[c] += linear * s + quadratic * s * s
        room[c] -= s
        count[c] += 1
    return where, place


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS, linear: float = 1.0, quadratic: float = 1.0 / CAPACITY) -> DataFrame:
    """(container, position, key, piece, first_token, n_tokens) for every document or piece.

    A text that exceeds ``capacity`` tokens is divided into full pieces and a
    rest; no other is divided.  Repeated rows (same key and sizes) count once.
    NULL and empty texts have no tokens and take no container, nor do rows
    whose key is NULL.  ``container`` is ``<shard>-<number>``; a shard is made
    by a hash of the key and the piece, so equal texts do not gather in one.
    """
    pieces = count_pieces(df.where(F.col(key).isNotNull()), key, text, capacity, vocabulary).distinct()
    pieces = materialise(pieces, "pieces")
    total = pieces.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_tokens))
    kind = dict(df.dtypes)[key]

    def fill(name, table):
        sizes = table.column("n_tokens").to_numpy()
        keys = table.column("k")
        order = pa.compute.sort_indices(table, sort_keys=[("n_tokens", "descending"), ("k", "ascending"), ("piece", "ascending")])
        where, place = assign(sizes[order.to_numpy()], capacity, linear, quadratic)
        shard = name[0].as_py()
        t = table.take(order)
        return pa.table(
            [pa.array([f"{shard}-{c}" for c in where.tolist()]), pa.array(place, pa.int64()), keys.take(order), t.column("piece"), t.column("first_token"), t.column("n_tokens")],
            names=["container", "position", "k", "piece", "first_token", "n_tokens"],
        )

    rows = pieces.select(F.pmod(F.xxhash64(key, "piece"), F.lit(shards)).alias("shard"), F.col(key).alias("k"), "piece", "first_token", "n_tokens")
    out = rows.groupBy("shard").applyInArrow(fill, f"container string, position long, k {kind}, piece int, first_token long, n_tokens long")
    return out.withColumnRenamed("k", key)
