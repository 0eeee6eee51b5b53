"""Most similar vectors of every vector: multiprobe p-stable hashing.

Vectors are brought into a space where the metric's order is that of the
Euclidean distance (cosine: unit length; inner product: one more coordinate
that fills up the length of the data).  Tables of Gaussian projections, cut
into intervals, put near vectors into equal buckets.  A query visits its own
bucket and perturbed ones, in the order in which they are likely to hold its
neighbours; what the tables bring is merged and reranked by the exact distance.

A collection (region) that fits a task is handled in one, with as many
intervals as keep buckets at a constant size, down to a single bucket.  A
larger one is first cut into cells by the same kind of hash, fitted on a
bounded sample of it; queries travel to their own and to perturbed cells, and
their partial results are merged.  A cell that still holds more than twice the
rows of a cell is cut again by further projections, fitted on a sample of that
cell, until none is left; should cells remain that projections do not cut,
their rows are dealt into parts and their queries go to each of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import join_checked, materialise

TABLES = 5
PROBES = 16  # perturbed buckets visited in each table
BUCKET = 192  # vectors that a bucket should hold
CELL = 16_000  # vectors that a task should hold
CELL_TABLES, CELL_PROBES = 3, 3
LEVELS, AGAIN_TABLES = 5, 2  # how often cells are cut by projections, and the tables of a cut of a cell
CELL_INNER = 2  # tables inside a cell: a neighbour has its chance in each cell table too
SAMPLE = 4096  # vectors of a large collection that its cells are fitted on
WIDTH = 2.0  # interval, in standard deviations of the projections


def _directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, dim)).astype(np.float32)


def _offsets(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed + 1).random(n).astype(np.float32)


def probes(position: np.ndarray, n: int) -> list[np.ndarray]:
    """Perturbed codes of every query, likeliest first: (bucket code per query) for each of ``n`` ranks.

    ``position`` is the place inside the grid, one column a hash function;
    stepping over the near edge of a function costs the squared distance to
    it.  Sets of one or two steps are ordered by their cost.
    """
    code = np.floor(position).astype(np.int64)
    frac = position - code
    m = position.shape[1]
    step = np.where(frac < 0.5, -1, 1)
    near = np.minimum(frac, 1 - frac) ** 2
    far = np.maximum(frac, 1 - frac) ** 2
    moves = [((j,), near[:, j], (step[:, j],)) for j in range(m)]
    moves += [((j,), far[:, j], (-step[:, j],)) for j in range(m)]
    moves += [((i, j), near[:, i] + near[:, j], (step[:, i], step[:, j])) for i in range(m) for j in range(i + 1, m)]
    cost = np.stack([c for _, c, _ in moves], 1)
    n = min(n, len(moves))
    order = np.argsort(cost, axis=1, kind="stable")[:, :n]
    delta = np.zeros((len(moves), len(position), m), np.int8)
    for x, (js, _, ss) in enumerate(moves):
        for j, s in zip(js, ss):
            delta[x, :, j] = s
    rows = np.arange(len(position))
    return [code + delta[order[:, r], rows] for r in range(n)]


def _key(code: np.ndarray) -> np.ndarray:
    """One number of each bucket code."""
    out = np.zeros(len(code), np.int64)
    for j in range(code.shape[1]):
        out = out * 1_000_003 + code[:, j]
    return out


def exact(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise distance in double precision, smaller is nearer."""
    q, x = q.astype(np.float64), x.astype(np.float64)
    if metric == "l2":
        return np.sqrt(((q - x) ** 2).sum(-1))
    dot = (q * x).sum(-1)
    if metric == "inner":
        return -dot
    return 1 - dot / (np.sqrt((q * q).sum(-1)) * np.sqrt((x * x).sum(-1)))


def embed(metric: str, x: np.ndarray, longest: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(data, queries) in the space where Euclidean distance orders as the metric."""
    if metric == "cosine":
        u = (x / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]).astype(np.float32)
        return u, u
    if metric == "inner":
        sq = (x.astype(np.float64) ** 2).sum(1)
        top = max(longest or 0.0, float(sq.max()) if len(sq) else 0.0)
        fill = np.sqrt(np.maximum(top - sq, 0)).astype(np.float32)
        return np.concatenate((x, fill[:, None]), 1), np.concatenate((x, np.zeros((len(x), 1), np.float32)), 1)
    return x, x


def _merge(top_d: np.ndarray, top_i: np.ndarray, who: np.ndarray, d: np.ndarray, i: np.ndarray, k: int) -> None:
    """Merge candidates (d, i) of queries ``who`` into their k best, without repeats."""
    ad, ai = np.concatenate((top_d[who], d), 1), np.concatenate((top_i[who], i), 1)
    o = np.argsort(ai, axis=1, kind="stable")
    ad, ai = np.take_along_axis(ad, o, 1), np.take_along_axis(ai, o, 1)
    same = np.zeros(ai.shape, bool)
    same[:, 1:] = ai[:, 1:] == ai[:, :-1]
    ad = np.where(same, np.inf, ad)
    o = np.argpartition(ad, k - 1, axis=1)[:, :k]
    top_d[who], top_i[who] = np.take_along_axis(ad, o, 1), np.take_along_axis(ai, o, 1)


def search(data: np.ndarray, queries: np.ndarray, k: int, tables: int, n_probes: int, seed: int, fill: bool = False) -> np.ndarray:
    """Candidate rows of ``data`` for each query, -1 where there are fewer: the best ``k`` by float distance.

    With ``fill`` a query whose buckets held too few is compared with all rows.
    """
    n, keep = len(data), min(k, len(data))
    top_d = np.full((len(queries), k), np.inf, np.float32)
    top_i = np.full((len(queries), k), -1, np.int64)
    bits = max(0, int(np.ceil(np.log2(n / BUCKET) / 1.2))) if n > 2 * BUCKET else 0
    norms = (data * data).sum(1)
    center = data.mean(0)
    for t in range(tables if bits else 1):
        # Inside one table no data row comes twice, so repeats are looked for only between tables.
        cur_d, cur_i = np.full_like(top_d, np.inf), np.full_like(top_i, -1)
        worst = np.full(len(queries), np.inf, np.float32)
        if bits:
            a = _directions(data.shape[1], bits, seed + 97 * t)
            p = (data - center) @ a.T
            width = WIDTH * p.std(0) + 1e-9
            shift = _offsets(bits, seed + 97 * t)
            key = _key(np.floor(p / width + shift).astype(np.int64))
            pos = ((queries - center) @ a.T) / width + shift
            visits = [_key(np.floor(pos).astype(np.int64)), *map(_key, probes(pos, n_probes))]
        else:
            key, visits = np.zeros(n, np.int64), [np.zeros(len(queries), np.int64)]
        order = np.argsort(key, kind="stable")
        buckets, first = np.unique(key[order], return_index=True)
        last = np.append(first[1:], n)
        who = np.tile(np.arange(len(queries)), len(visits))
        at = np.searchsorted(buckets, np.concatenate(visits))
        ok = (at < len(buckets)) & (buckets[np.minimum(at, len(buckets) - 1)] == np.concatenate(visits))
        who, at = who[ok], at[ok]
        by = np.argsort(at, kind="stable")
        who, at = who[by], at[by]
        edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        for x, y in zip(edge.tolist(), [*edge[1:].tolist(), len(at)]):
            rows = order[first[at[x]] : last[at[x]]]
            members = np.unique(who[x:y])
            for lo in range(0, len(members), 4096):
                m = members[lo : lo + 4096]
                for r in range(0, len(rows), 16384):
                    some = rows[r : r + 16384]
                    d = norms[some][None, :] - 2 * (queries[m] @ data[some].T)
                    better = d.min(1) < worst[m]
                    if not better.any():
                        continue
                    w, d = m[better], d[better]
                    if len(some) > keep:
                        o = np.argpartition(d, keep - 1, axis=1)[:, :keep]
                        d, i = np.take_along_axis(d, o, 1), some[o]
                    else:
                        i = np.broadcast_to(some, d.shape)
                    d, i = np.concatenate((cur_d[w], d), 1), np.concatenate((cur_i[w], i), 1)
                    o = np.argpartition(d, k - 1, axis=1)[:, :k]
                    cur_d[w], cur_i[w] = np.take_along_axis(d, o, 1), np.take_along_axis(i, o, 1)
                    worst[w] = cur_d[w].max(1)
        if t:
            _merge(top_d, top_i, np.arange(len(queries)), cur_d, cur_i, k)
        else:
            top_d, top_i = cur_d, cur_i
    if fill and bits:
        short = np.flatnonzero(~np.isfinite(top_d).all(1))
        for lo in range(0, len(short), 512):
            m = short[lo : lo + 512]
            d = norms[None, :] - 2 * (queries[m] @ data.T)
            top_i[m] = np.argpartition(d, k - 1, axis=1)[:, :k]
            top_d[m] = 0
    return np.where(np.isfinite(top_d), top_i, -1)


def neighbours(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, q_ids: np.ndarray, metric: str, longest: float | None, k: int, tables: int, n_probes: int, seed: int, fill: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, neighbour id, distance): the k nearest of each query among ``ids``.

    Equal vectors are searched once, so that ties among them fall to the
    smaller ids however many there are.
    """
    if not len(ids) or not len(q_ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    by = np.argsort(ids, kind="stable")
    ids, vectors = ids[by], vectors[by]
    flat = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, cls = np.unique(flat, return_index=True, return_inverse=True)
    size = np.bincount(cls)
    held = np.argsort(cls, kind="stable")
    start = np.cumsum(size) - size
    # A class shows its k + 1 smallest ids: k for a query, and one more as it may be one of them.
    shown = np.minimum(size, k + 1)
    data, _ = embed(metric, vectors[first], longest)
    _, q = embed(metric, queries, longest)
    want = min(len(first), k + 4)
    found = search(data, q, want, tables, n_probes, seed, fill)
    row = np.repeat(np.arange(len(q_ids)), want)[found.ravel() >= 0]
    cand = found.ravel()[found.ravel() >= 0]
    dist = exact(metric, queries[row], vectors[first[cand]])
    n = shown[cand]
    row, dist, at = np.repeat(row, n), np.repeat(dist, n), np.repeat(start[cand], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    near = ids[held[at]]
    other = near != q_ids[row]
    row, dist, near = row[other], dist[other], near[other]
    o = np.lexsort((near, np.round(dist, 12), row))
    row, dist, near = row[o], dist[o], near[o]
    begin = np.concatenate(([True], row[1:] != row[:-1]))
    rank = np.arange(len(row)) - np.maximum.accumulate(np.where(begin, np.arange(len(row)), 0))
    top = rank < k
    return q_ids[row[top]], near[top], dist[top]


class _Groups:
    """Batches sorted by a leading key column, given back as whole groups of rows."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches = batches

    def __iter__(self) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for b in self.batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            if held and held[-1].column(0)[-1].as_py() != key[0]:
                yield pa.Table.from_batches(held)
                held = []
            lo = 0
            for c in cuts.tolist():
                held.append(b.slice(lo, c - lo))
                yield pa.Table.from_batches(held)
                held, lo = [], c
            held.append(b.slice(lo))
        if held:
            yield pa.Table.from_batches(held)


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    x = pa.concat_arrays([c.flatten() for c in col.chunks]).to_numpy()
    return np.asarray(x, np.float32).reshape(len(col), -1)


def usable(atoms: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, id, v, metric) of vectors that have the region's length and only finite values, not all zero."""
    r = regions.select(F.col("id").alias("region"), F.col("embedding_dim").alias("dim"), F.col("embedding_metric").alias("metric")).dropDuplicates(["region"])
    a = atoms.select(F.col("region_id").alias("region"), "id", F.col("embedding").alias("v")).where("region IS NOT NULL AND id IS NOT NULL AND v IS NOT NULL")
    fine = (F.size("v") == F.col("dim")) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return join_checked(a, r, "region").where(fine & F.col("metric").isin("cosine", "l2", "inner")).select("region", "id", "v", "metric")


def _cell_fitter(cell: int, tables: int, seed: int):
    def fit(key, table):
        """Projections of one large collection or cell, from a bounded sample of it."""
        n, metric, top = table.column("n")[0].as_py(), table.column("metric")[0].as_py(), table.column("top")[0].as_py()
        x, _ = embed(metric, _matrix(table.column("v")), top)
        bits = max(1, int(np.ceil(np.log2(n / cell) / 1.2)))
        rows = []
        for t in range(tables):
            a = _directions(x.shape[1], bits, seed + 31 * t)
            p = x @ a.T
            rows.append((p.mean(0).tolist(), (WIDTH * p.std(0) + 1e-9).tolist()))
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([[m for m, _ in rows]], pa.list_(pa.list_(pa.float64()))), pa.array([[w for _, w in rows]], pa.list_(pa.list_(pa.float64())))], names=["cell", "mid", "width"])

    return fit


def _mixed(key: np.ndarray, parent: int, table: int) -> np.ndarray:
    """Cell numbers of bucket codes inside a parent."""
    with np.errstate(over="ignore"):
        x = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(parent & 0xFFFFFFFFFFFFFFFF) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(table)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(1)).view(np.int64)


def _spread(seed: int, count: bool):
    """Rows of large collections or cells to smaller cells: the home cell of each table as data, every probed cell as a query.

    A row's role says whether it is data (1), a query (2) or both (3).  With
    ``count`` only the cells of data come out, without vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parent = b.column(0).to_numpy()
            for g in np.unique(parent).tolist():
                s = b.filter(pa.array(parent == g))
                metric, top = s.column(5)[0].as_py(), s.column(6)[0].as_py()
                role = s.column(2).to_numpy()
                x = np.asarray(s.column(4).flatten().to_numpy(), np.float32).reshape(s.num_rows, -1)
                data, q = embed(metric, x, top)
                mid, width = np.array(s.column(7)[0].as_py(), np.float32), np.array(s.column(8)[0].as_py(), np.float32)
                for t in range(len(mid)):
                    a, shift = _directions(data.shape[1], mid.shape[1], seed + 31 * t), _offsets(mid.shape[1], seed + 31 * t)
                    home = _key(np.floor((data @ a.T - mid[t]) / width[t] + shift).astype(np.int64))
                    stored, asks = role & 1 > 0, role & 2 > 0
                    if count:
                        yield pa.RecordBatch.from_arrays([pa.array(_mixed(home[stored], g, t))], names=["cell"])
                        continue
                    pos = (q @ a.T - mid[t]) / width[t] + shift
                    own = _key(np.floor(pos).astype(np.int64))
                    # A query's own cell is mostly its home as data (always, but for the inner product).
                    both = (own == home) & stored & asks
                    sent = [(3, home, both), (1, home, stored & ~both), (2, own, asks & ~both), *((2, key, asks) for key in map(_key, probes(pos, CELL_PROBES)))]
                    for kind, key, rows in sent:
                        if not rows.any():
                            continue
                        some, key = s.filter(pa.array(rows)), key[rows]
                        yield pa.RecordBatch.from_arrays([pa.array(_mixed(key, g, t)), some.column(1), pa.array(np.full(some.num_rows, kind), pa.int32()), *(some.column(c) for c in (3, 4, 5, 6))], names=["cell", "region", "role", "id", "v", "metric", "top"])

    return run


def _cut(rows: DataFrame, bound: int, tables: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows sent to smaller cells, number of data rows of each of these).

    ``rows`` has cell, region, role, id, v, metric, top and n, the data rows of the cell.
    """
    data = rows.where(F.col("role").bitwiseAND(F.lit(1)) > 0)
    # The sample: smallest hashes of a share that gives about SAMPLE rows of each cell.
    share = data.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * (2 * SAMPLE) / F.col("n"))
    first = share.withColumn("__r", F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("id"), "id"))).where(F.col("__r") <= SAMPLE)
    fitted = materialise(first.groupBy("cell").applyInArrow(_cell_fitter(bound, tables, seed), "cell long, mid array<array<double>>, width array<array<double>>"), "cells")
    both = join_checked(rows.drop("n"), fitted, "cell").select("cell", "region", "role", "id", "v", "metric", "top", "mid", "width")
    kinds = dict(rows.dtypes)
    sent = both.mapInArrow(_spread(seed, False), f"cell long, region long, role int, id long, v {kinds['v']}, metric string, top double")
    return sent, both.mapInArrow(_spread(seed, True), "cell long").groupBy("cell").agg(F.count("*").alias("n"))


def exhaustive(rows: DataFrame, asked: DataFrame, k: int, schema: str, block: int = 4096) -> DataFrame:
    """(region, id, near, distance): the exact k nearest of a few vectors, in blocks that are compared with all rows.

    Both frames have region, id, v and metric.  Each task keeps its own k best of a query.
    """
    n = asked.count()
    blocks = max(1, -(-n // block))
    out = None
    for at in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("region", "id"), F.lit(blocks)) == at)
        got = some.select("region", "id", "v").toArrow()
        region, ids = got.column("region").to_numpy(), got.column("id").to_numpy()
        vectors = [np.array(v, np.float32) for v in got.column("v").to_pylist()]
        by = {r: (ids[region == r], np.stack([v for v, x in zip(vectors, region) if x == r])) for r in np.unique(region).tolist()}
        sent = rows.sparkSession.sparkContext.broadcast(by)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], list[tuple[float, int]]] = {}
            for b in batches:
                here = b.column(0).to_numpy()
                for r in np.unique(here).tolist():
                    if r not in sent.value:
                        continue
                    s = b.filter(pa.array(here == r))
                    q_ids, q = sent.value[r]
                    metric, near = s.column(3)[0].as_py(), s.column(1).to_numpy()
                    x = np.asarray(s.column(2).flatten().to_numpy(), np.float32).reshape(s.num_rows, -1)
                    data, ask = (x, q) if metric == "inner" else (embed(metric, x, None)[0], embed(metric, q, None)[1])
                    d = -(ask @ data.T) if metric == "inner" else (data * data).sum(1)[None] - 2 * (ask @ data.T)
                    take = min(k + 8, d.shape[1])
                    for i, cols in enumerate(np.argpartition(d, take - 1, axis=1)[:, :take]):
                        found = [(round(float(e), 12), int(j)) for e, j in zip(exact(metric, q[i][None], x[cols]), near[cols]) if j != q_ids[i]]
                        key = (r, int(q_ids[i]))
                        best[key] = sorted(set(best.get(key, []) + found))[:k]
            flat = [(r, i, j, e) for (r, i), found in best.items() for e, j in found]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["region", "id", "near", "distance"])

        found = rows.select("region", "id", "v", "metric").mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out


def nearest(atoms: DataFrame, regions: DataFrame, k: int = 5, cell: int = CELL) -> DataFrame:
    """(region, id, near, distance): the k nearest others of every usable vector in its region.

    Nearest by the region's metric (cosine or Euclidean distance, or largest
    inner product, given negated); equal distances go by smaller id; where a
    region has fewer others, all of them count.  Vectors of another length,
    with NULL, NaN or infinite elements or only zeros neither ask nor answer;
    repeated rows count once.  Approximate only through the hashing: a region
    of up to two buckets is searched whole.
    """
    rows = usable(atoms, regions)
    stats = rows.groupBy("region").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("top"))
    stats = materialise(stats, "regions")
    large = stats.where(F.col("n") > 2 * cell)
    none_large = large.isEmpty()
    kind = "long"

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        d: list[np.ndarray] = []
        r: list[np.ndarray] = []
        size = 0
        for t in _Groups(batches):
            ids = t.column("id").to_numpy()
            ids, first = np.unique(ids, return_index=True)
            x = _matrix(t.column("v"))[first]
            qa, nb, dd = neighbours(ids, x, x, ids, t.column("metric")[0].as_py(), None, k, TABLES, PROBES, 11, True)
            a.append(qa), b.append(nb), d.append(dd), r.append(np.full(len(qa), t.column("region")[0].as_py()))
            size += len(qa)
            if size > 200_000:
                yield _out(r, a, b, d)
                a, b, d, r, size = [], [], [], [], 0
        if size:
            yield _out(r, a, b, d)

    schema = f"region {kind}, id long, near long, distance double"
    tiny = rows if none_large else join_checked(rows, large.select("region"), "region", "left_anti")
    out = tiny.repartition("region").sortWithinPartitions("region").select("region", "id", "v", "metric").mapInArrow(small, schema)
    if none_large:
        return out

    # Copies of a vector: only the k + 1 smallest ids travel.  The last of them has
    # k copies before it, so its k nearest are also those of every further copy.
    mine = join_checked(rows, large.select("region", "n", "top"), "region").withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64("v", F.lit(1)))
    copies = ["region", "h1", "h2"]
    everyone = mine.dropDuplicates(["region", "id"])
    by_id = Window.partitionBy(*copies).orderBy("id")
    mine = materialise(everyone.withColumn("__r", F.row_number().over(by_id)).where(F.col("__r") <= k + 1), "core")
    full = mine.where(F.col("__r") == k + 1).select(*copies, F.col("id").alias("last"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _Groups(batches):
            role, ids, x = t.column("role").to_numpy(), t.column("id").to_numpy(), _matrix(t.column("v"))
            data, asks = role & 1 > 0, role & 2 > 0
            (di, df), (qi, qf) = (np.unique(ids[w], return_index=True) for w in (data, asks))
            qa, nb, dd = neighbours(di, x[data][df], x[asks][qf], qi, t.column("metric")[0].as_py(), t.column("top")[0].as_py(), k, CELL_INNER, PROBES, 11)
            if len(qa):
                yield _out([np.full(len(qa), t.column("region")[0].as_py())], [qa], [nb], [dd])

    def searched(rows: DataFrame) -> DataFrame:
        return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(cells, schema)

    whole = mine.select(F.col("region").alias("cell"), "region", F.lit(3).alias("role"), "id", "v", "metric", "top", "n")
    sent, sizes = _cut(whole, cell, CELL_TABLES, 7001)
    part = None
    for level in range(1, LEVELS + 1):
        wide = materialise(sizes.where(F.col("n") > 2 * cell), "wide")
        if wide.isEmpty():
            break
        # At most one row for each 2 * cell rows that were sent.
        few = F.broadcast(wide)
        fine = searched(sent.join(few, "cell", "left_anti"))
        part = fine if part is None else part.unionByName(fine)
        rest = materialise(sent.join(few, "cell"), "wide_rows")
        if level == LEVELS:
            parts = F.ceil(F.col("n") / F.lit(cell)).cast("long")
            dealt = rest.withColumn("p", F.explode(F.when(F.col("role") == 1, F.array(F.pmod(F.xxhash64("id"), parts))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))))
            home = F.pmod(F.xxhash64("id"), parts) == F.col("p")
            sent = dealt.withColumn("role", F.when((F.col("role") == 3) & ~home, F.lit(2)).otherwise(F.col("role"))).withColumn("cell", F.xxhash64("cell", "p")).drop("p", "n")
            break
        sent, sizes = _cut(rest, cell, AGAIN_TABLES, 7001 + 1009 * level)
    last = searched(sent)
    part = (last if part is None else part.unionByName(last)).distinct()
    win = Window.partitionBy("region", "id").orderBy(F.round("distance", 12), "near")
    merged = materialise(part.withColumn("__r", F.row_number().over(win)).where(F.col("__r") <= k).drop("__r"), "near")
    # A vector far from all others may meet too few of them: these few are compared with all.
    counts = merged.groupBy("region", "id").agg(F.count("*").alias("c"))
    lonely = mine.select("region", "id", "v", "metric", "n").join(counts, ["region", "id"], "left").where(F.coalesce("c", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1))
    lonely = materialise(lonely, "lonely")
    if not lonely.isEmpty():
        exactly = exhaustive(mine, lonely, k, schema).distinct()
        exactly = exactly.withColumn("__r", F.row_number().over(win)).where(F.col("__r") <= k).drop("__r")
        merged = materialise(merged.join(lonely.select("region", "id"), ["region", "id"], "left_anti").select("region", "id", "near", "distance").unionByName(exactly), "near")
    if full.isEmpty():
        return out.unionByName(merged)
    theirs = merged.join(full.select("region", F.col("last").alias("id"), "h1", "h2"), ["region", "id"]).groupBy(*copies).agg(F.collect_list(F.struct("near", "distance")).alias("list"), F.first("id").alias("last"))
    further = join_checked(rows.select("region", "id", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2")), theirs, copies).where("id > last").select("region", "id", F.inline("list")).distinct()
    return out.unionByName(merged).unionByName(further)


def _out(r: list, a: list, b: list, d: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (r, a, b)] + [pa.array(np.concatenate(d), pa.float64())], names=["region", "id", "near", "distance"])


def pairs(near: DataFrame) -> DataFrame:
    """(a, b), a < b, of which at least one is among the other's nearest."""
    return near.select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).distinct()
