"""Vector distances, exact top-k (JVM-side, double precision), batched search and a stored index of cells."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import shared_dir


def _lit(v: Column | list[float]) -> Column:
    return v if isinstance(v, Column) else F.array(*[F.lit(float(x)) for x in v])


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column | list[float]) -> Column:
    """``<->``"""
    return F.sqrt(_sum(a, _lit(b), lambda x, y: (x - y) * (x - y)))


def inner(a: Column, b: Column | list[float]) -> Column:
    """``<#>``: the negated inner product."""
    return -_sum(a, _lit(b), lambda x, y: x * y)


def cosine(a: Column, b: Column | list[float]) -> Column:
    """``<=>``; NULL where a vector has length zero."""
    b = _lit(b)
    n = F.sqrt(_sum(a, a, lambda x, y: x * y)) * F.sqrt(_sum(b, b, lambda x, y: x * y))
    return F.when(n > 0, 1 - _sum(a, b, lambda x, y: x * y) / n)


def parse(text: str, dim: int | None = None) -> list[float]:
    """The literal ``'[1,2,3]'``, with its dimension checked."""
    v = [float(x) for x in text.strip().removeprefix("[").removesuffix("]").split(",") if x.strip()]
    if not v or (dim is not None and len(v) != dim):
        raise ValueError(f"expected {dim} dimensions, got {len(v)}")
    return v


METRICS = {"l2": l2, "inner": inner, "cosine": cosine}


def top_k(df: DataFrame, column: str, query: list[float], k: int, metric: str = "l2", tie: str = "vec_id", where: Column | None = None) -> DataFrame:
    """Exact ``ORDER BY v op q LIMIT k``: a filter first, equal distances by ``tie``."""
    rows = df if where is None else df.where(where)
    return rows.withColumn("dist", METRICS[metric](F.col(column), query)).orderBy("dist", tie).limit(k)


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


def distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distance of every query (row) to every vector (column); a cosine with a vector of length zero is NaN."""
    dot = q @ x.T
    if metric == "inner":
        return -dot
    if metric == "l2":
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * dot, 0))
    n = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, 1 - dot / n, np.nan)


def knn_batch(df: DataFrame, queries: DataFrame, key: str, column: str, k: int, metric: str = "l2", block: int = 4096) -> DataFrame:
    """(query, key, dist): the k nearest rows of ``df`` for every row of ``queries``, itself left out.

    The queries are read in blocks of ``block``, each sent to all partitions,
    which keep their own k best; only those are shuffled and merged.  Vectors
    that are NULL, hold NULL or have another length than the first query
    neither ask nor answer; equal distances go by smaller key.
    """
    kinds = dict(df.dtypes)
    fine = F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull())
    asked = queries.where(fine & F.col(key).isNotNull()).select(key, column).dropDuplicates([key])
    first = asked.orderBy(key).select(F.size(column)).first()
    out_schema = f"query {kinds[key]}, {key} {kinds[key]}, dist double"
    if first is None:
        return df.sparkSession.createDataFrame([], out_schema)
    dim = first[0]
    rows = df.where(fine & F.col(key).isNotNull() & (F.size(column) == dim)).select(key, column)
    n = asked.count()
    blocks = max(1, -(-n // block))
    parts = []
    for at in range(blocks):
        some = asked.where(F.size(column) == dim)
        some = some if blocks == 1 else some.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == at)
        got = some.toArrow()
        sent = df.sparkSession.sparkContext.broadcast((got.column(key).to_pylist(), np.array(got.column(column).to_pylist(), np.float64).reshape(got.num_rows, -1)))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            best: list[list[tuple]] = [[] for _ in names]
            kind = None
            for b in batches:
                kind = b.column(0).type
                if not b.num_rows or not len(names):
                    continue
                ids = b.column(0).to_pylist()
                x = _matrix(b.column(1))
                # The fast form only chooses; the distances that count are taken exactly.
                d = distances(metric, q, x)
                d = np.where(np.isnan(d), np.inf, d)
                take = min(k + 8, d.shape[1])
                near = np.argpartition(d, take - 1, axis=1)[:, :take]
                for i, cols in enumerate(near.tolist()):
                    edge = max(d[i, c] for c in cols)
                    ties = np.flatnonzero(d[i] <= edge + 1e-9).tolist() if np.isfinite(edge) else cols
                    found = [(_exact(metric, q[i], x[c]), ids[c]) for c in ties if np.isfinite(d[i, c]) and ids[c] != names[i]]
                    best[i] = sorted(set(best[i] + found))[:k]
            flat = [(n_, i, d_) for n_, rows_ in zip(names, best) for d_, i in rows_]
            if flat:
                a, c, e = zip(*flat)
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(c, kind), pa.array(e, pa.float64())], names=["query", key, "dist"])

        parts.append(rows.mapInArrow(scan, out_schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    win = Window.partitionBy("query").orderBy("dist", key)
    return out.distinct().withColumn("__r", F.row_number().over(win)).where(F.col("__r") <= k).drop("__r")


def _exact(metric: str, q: np.ndarray, x: np.ndarray) -> float:
    if metric == "l2":
        return round(float(np.sqrt(((q - x) ** 2).sum())), 12)
    dot = float((q * x).sum())
    return round(-dot if metric == "inner" else 1 - dot / float(np.sqrt((q * q).sum()) * np.sqrt((x * x).sum())), 12)


@dataclass(frozen=True)
class AnnIndex:
    """Vectors stored by cell: the rows of one cell lie in one folder."""

    rows: DataFrame
    path: str
    centers: np.ndarray
    column: str
    key: str
    metric: str


def _unit(metric: str, x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None] if metric == "cosine" else x


def _cells(metric: str, centers: np.ndarray, spark):
    """A column function: the nearest center of each vector."""
    sent = spark.sparkContext.broadcast(centers)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        y, c = _unit(metric, np.array(v.tolist(), np.float64).reshape(len(v), -1)), sent.value
        return pd.Series(((c * c).sum(1) - 2 * y @ c.T).argmin(1).astype("int32"), index=v.index)

    return cell


def build_ann(df: DataFrame, key: str, column: str, metric: str = "l2", filters: tuple[str, ...] = (), sample: int = 20_000, seed: int = 5) -> AnnIndex:
    """An index of cells around centers: fitted on at most ``sample`` vectors, every vector is indexed.

    There are about as many cells as the root of the rows, at most 4,096.
    ``filters`` are columns stored beside the vectors, for pushed predicates.
    Vectors that are NULL or hold NULL, and rows without a key, are not indexed.
    """
    spark = df.sparkSession
    fine = df.where(F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull()) & F.col(key).isNotNull()).select(key, column, *filters)
    n = fine.count()
    cells = int(min(4096, max(1, round(n**0.5))))
    few = fine.select(column).orderBy(F.xxhash64(key, F.lit(seed))).limit(sample).toArrow().column(column).to_pylist()
    x = _unit(metric, np.array(few, np.float64).reshape(len(few), -1)) if few else np.zeros((1, 1))
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(8):
        at = ((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)).argmin(1)
        for c in range(len(centers)):
            mine = x[at == c]
            if len(mine):
                centers[c] = mine.mean(0)
    path = f"{shared_dir(spark)}/tidewell/ann-{uuid.uuid4().hex}"
    placed = fine.withColumn("cell", _cells(metric, centers, spark)(F.col(column)))
    placed.repartition("cell").write.partitionBy("cell").parquet(path)
    return AnnIndex(spark.read.schema(placed.schema).parquet(path), path, centers, column, key, metric)


def ann_add(index: AnnIndex, df: DataFrame) -> None:
    """Keep the index fresh: new rows go to the cells of the same centers."""
    names = [c for c in index.rows.columns if c != "cell"]
    fine = df.where(F.col(index.column).isNotNull() & ~F.exists(index.column, lambda x: x.isNull()) & F.col(index.key).isNotNull()).select(*names)
    fine.withColumn("cell", _cells(index.metric, index.centers, df.sparkSession)(F.col(index.column))).write.mode("append").partitionBy("cell").parquet(index.path)


def ann_top_k(index: AnnIndex, query: list[float], k: int, probes: int = 16, where: Column | None = None) -> DataFrame:
    """Approximate ``ORDER BY v op q LIMIT k``: the nearest cells only, the filter pushed to their scan, exact distances.

    With a filter, cells are searched until enough rows pass it or none is left.
    """
    rows = index.rows.sparkSession.read.schema(index.rows.schema).parquet(index.path)
    q = np.array([query], np.float64)
    order = ((index.centers**2).sum(1) - 2 * (_unit(index.metric, q) @ index.centers.T)[0]).argsort().tolist() if index.metric != "inner" else (-(q @ index.centers.T)[0]).argsort().tolist()
    while True:
        near = rows.where(F.col("cell").isin(order[:probes]))
        near = near if where is None else near.where(where)
        if where is None or probes >= len(order) or near.limit(k).count() >= k:
            break
        probes *= 4
    return top_k(near, index.column, query, k, index.metric, index.key)
