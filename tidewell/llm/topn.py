"""First N items of every group, by merging sorted runs with a loser tree.

1. Every input partition becomes a *run*: Spark sorts it (spilling as needed)
   by bucket, group, score and id, and a streaming pass keeps, of each group,
   only the rows that can still come out (the run's own first N).
2. A run's part for one bucket is stored as list columns, in chunks, so the
   order inside it survives shuffles and storage as it is; the runs are
   written to the shared folder, so that a lost executor costs no new sort.
3. Runs of a bucket are merged ``fan_in`` at a time by a loser tree over the
   run heads; after N rows of a group, every run seeks to its next group.
   Levels are added until one run per bucket is left, so a group present in
   every run never brings more than ``fan_in * N`` rows to one task.

Data moved: at most N rows a group and run, of three columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise

CHUNK = 65_536
#: Groups of a bucket, about: with ``fan_in`` runs of ``n`` rows each, what one task merges.
GROUPS = 5_000


class LoserTree:
    """Tournament over run heads: ``winner()`` is the run with the least head."""

    def __init__(self, heads: list):
        self.k = len(heads)
        self.heads = heads
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0  # a place not yet taken wins, so that every leaf enters
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        win, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self._less(self.tree[node], win):
                self.tree[node], win = win, self.tree[node]
            node //= 2
        self.tree[0] = win

    def winner(self) -> int:
        return self.tree[0]

    def replace(self, head) -> None:
        """The winner's run moves on to ``head`` (None: it is exhausted)."""
        leaf = self.tree[0]
        self.heads[leaf] = head
        self._play(leaf)


def merge_runs(runs: list[tuple[list, list, list]], n: int) -> tuple[list, list, list, list]:
    """Merge runs (groups, keys, ids), each sorted; key is the negated score.

    Gives groups, keys, ids and ranks of the first ``n`` distinct (key, id) of
    each group.  A run that still has rows of a finished group seeks past them
    by binary search on the group column.
    """
    out_g: list = []
    out_k: list = []
    out_i: list = []
    out_r: list = []
    pos = [0] * len(runs)

    def head(r: int):
        p, (g, k, i) = pos[r], runs[r]
        return (g[p], k[p], i[p]) if p < len(g) else None

    tree = LoserTree([head(r) for r in range(len(runs))])
    group, rank, last = None, 0, None
    while True:
        r = tree.winner()
        h = tree.heads[r]
        if h is None:
            return out_g, out_k, out_i, out_r
        if h[0] != group or last is None:
            group, rank, last = h[0], 0, None
        if rank == n:
            lo, hi, g = pos[r], len(runs[r][0]), runs[r][0]
            step = 1  # galloping: the next group is mostly near
            while lo + step < hi and g[lo + step] == group:
                step *= 2
            hi = min(hi, lo + step)
            lo += step // 2
            while lo < hi:
                mid = (lo + hi) // 2
                if g[mid] == group:
                    lo = mid + 1
                else:
                    hi = mid
            pos[r] = lo
        else:
            if h[1:] != last:
                rank += 1
                last = h[1:]
                out_g.append(h[0])
                out_k.append(h[1])
                out_i.append(h[2])
                out_r.append(rank)
            pos[r] += 1
        tree.replace(head(r))


def _starts(*cols: np.ndarray) -> np.ndarray:
    """True where any column differs from the row before."""
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = False
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return new


def _run_writer(n: int):
    """Sorted rows of one partition to run chunks, first ``n`` of each group."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run = TaskContext.get().partitionId()
        seq, carry_group, carry_rank, carry_last = 0, None, 0, None
        schema = None
        for b in batches:
            if not b.num_rows:
                continue
            bucket, g, k, i = (b.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            fresh = _starts(g)
            new = _starts(g, k, i)
            if g[0] == carry_group:
                fresh[0] = False
                new[0] = (k[0], i[0]) != carry_last
            at = np.cumsum(new)
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(g)), -1))
            base = np.where(first >= 0, at[np.maximum(first, 0)] - 1, -carry_rank)
            rank = at - base
            carry_group, carry_rank, carry_last = g[-1], int(rank[-1]), (k[-1], i[-1])
            keep = np.flatnonzero(new & (rank <= n))
            if not len(keep):
                continue
            cuts = np.flatnonzero(_starts(bucket[keep]))
            bounds = [*cuts.tolist(), len(keep)]
            offs = [o for lo, hi in zip(bounds[:-1], bounds[1:]) for o in range(lo, hi, CHUNK)]
            offsets = pa.array([*offs, len(keep)], pa.int32())
            take = pa.array(keep)
            cols = [pa.ListArray.from_arrays(offsets, b.column(c).take(take)) for c in (1, 2, 3)]
            m = len(offs)
            out = [pa.array(bucket[keep[offs]], pa.int64()), pa.array(np.full(m, run), pa.int64()), pa.array(np.arange(seq, seq + m), pa.int64()), *cols]
            seq += m
            schema = schema or pa.schema([(name, c.type) for name, c in zip(("bucket", "run", "seq", "g", "k", "i"), out)])
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return write


def build_runs(df: DataFrame, group: str, score: str, item: str, n: int, buckets: int) -> DataFrame:
    """Bucketed runs (bucket, run, seq, g, k, i), to be stored or merged.

    ``k`` is the negated score, so that ascending order is best first.  Rows
    whose group, item or score is NULL, or whose score is NaN, take no place.
    """
    s = F.col(score).cast("double")
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull() & s.isNotNull() & ~F.isnan(s)).select(
        F.pmod(F.xxhash64(F.col(group)), F.lit(buckets)).alias("bucket"), F.col(group).alias("g"), (F.lit(0.0) - s).alias("k"), F.col(item).alias("i")
    )
    kinds = dict(rows.dtypes)
    return rows.sortWithinPartitions("bucket", "g", "k", "i").mapInArrow(_run_writer(n), f"bucket long, run long, seq long, g array<{kinds['g']}>, k array<double>, i array<{kinds['i']}>")


def _load(table: pa.Table) -> list[tuple[list, list, list]]:
    runs: dict[int, tuple[list, list, list]] = {}
    rows = sorted(zip(table.column("run").to_pylist(), table.column("seq").to_pylist(), range(table.num_rows)))
    g, k, i = (table.column(c).combine_chunks() for c in ("g", "k", "i"))
    for run, _, at in rows:
        r = runs.setdefault(run, ([], [], []))
        for to, col in zip(r, (g, k, i)):
            to.extend(col[at].values.to_pylist())
    return list(runs.values())


def merge_level(runs: DataFrame, n: int, fan_in: int) -> DataFrame:
    """Merge the runs of each bucket, ``fan_in`` at a time, into longer runs."""

    def merge(key, table):
        g, k, i, _ = merge_runs(_load(table), n)
        t = table.schema
        lists = []
        offs = list(range(0, max(len(g), 1), CHUNK))
        for values, name in ((g, "g"), (k, "k"), (i, "i")):
            lists.append(pa.ListArray.from_arrays(pa.array([*offs, len(g)], pa.int32()), pa.array(values, t.field(name).type.value_type)))
        m = len(offs)
        return pa.table([pa.array([key[0].as_py()] * m, pa.int64()), pa.array([key[1].as_py()] * m, pa.int64()), pa.array(range(m), pa.int64()), *lists], names=["bucket", "run", "seq", "g", "k", "i"])

    kinds = dict(runs.dtypes)
    return (
        runs.withColumn("to", F.floor(F.col("run") / F.lit(fan_in)).cast("long"))
        .groupBy("bucket", "to")
        .applyInArrow(merge, f"bucket long, run long, seq long, g {kinds['g']}, k array<double>, i {kinds['i']}")
    )


def top_n_per_group(df: DataFrame, group: str, score: str, item: str, n: int = 10, fan_in: int = 64, buckets: int | None = None) -> DataFrame:
    """The first ``n`` items of each group: (group, item, score, rank).

    Order: score descending, equal scores by smaller item; 0.0 and -0.0 are
    equal.  A row whose group or item is NULL or whose score is NULL or NaN
    takes no place.  Rows that agree in group, score and item count once, so
    repeated whole rows do too.  A group with fewer items gives all it has; an
    empty table gives no rows.  Other columns of ``df`` are never read.
    """
    if n < 1 or fan_in < 2:
        raise ValueError("n must be positive and fan_in at least 2")
    parts = max(1, df.rdd.getNumPartitions())
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if buckets is None:  # no more than some groups a bucket, whatever their number
        groups = df.agg(F.approx_count_distinct(group)).first()[0]
        buckets = max(parts, shuffle, groups // GROUPS + 1)
    runs = materialise(build_runs(df, group, score, item, n, buckets), "runs")
    for _ in range(max(0, math.ceil(math.log(parts, fan_in)) - 1)):
        runs = merge_level(runs, n, fan_in)
    kinds = dict(df.dtypes)

    def last(key, table):
        g, k, i, r = merge_runs(_load(table), n)
        t = table.schema
        return pa.table(
            [pa.array(g, t.field("g").type.value_type), pa.array(i, t.field("i").type.value_type), pa.array([0.0 - x for x in k], pa.float64()), pa.array(r, pa.int32())],
            names=["__g", "__i", "__s", "__r"],
        )

    out = runs.groupBy("bucket").applyInArrow(last, f"__g {kinds[group]}, __i {kinds[item]}, __s double, __r int")
    return out.select(F.col("__g").alias(group), F.col("__i").alias(item), F.col("__s").alias(score), F.col("__r").alias("rank"))
