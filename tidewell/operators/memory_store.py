"""Regions of atoms: remember, fetch, link, evolve and rerank, as transforms of snapshots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import json as J
from tidewell.functions import vector
from tidewell.operators import dml, memory
from tidewell.operators.ranges import number_rows
from tidewell.session import materialise

#: Edge kinds that may not close a cycle (fixed values).
ACYCLIC = ("depends_on", "supersedes")
#: Candidates that a reranker sees (fixed value).
RERANK_POOL = 256
# Offset and prime of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3

ATOM = "id long, region_id long, kind string, embedding array<float>, payload string, text_content string, score double, confidence double, access_count long, immutable long, created_at timestamp_ntz, accessed_at timestamp_ntz, expires_at timestamp_ntz"
EDGE = "src_id long, dst_id long, kind string, weight double, evidence_ref string"

Embedder = Callable[[list[str]], list[list[float]]]
Reranker = Callable[[str, list[str]], list[float]]


def mock_embedder(dim: int) -> Embedder:
    """A deterministic embedder: counts of words by their hash."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for word in t.split():
                h = FNV_OFFSET
                for b in word.encode():
                    h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
                v[h % dim] += 1.0
            out.append(v)
        return out

    return embed


def embed(text: Column, embedder: Embedder) -> Column:
    """The embedder applied batch by batch; NULL stays NULL."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        known = s.dropna()
        got = pd.Series(embedder(known.tolist()), index=known.index, dtype=object)
        return got.reindex(s.index).where(s.notna(), None)

    return run(text)


def acyclic(edges: DataFrame, max_rounds: int = 10_000) -> bool:
    """Whether (src_id, dst_id) edges close no cycle: edges that lead nowhere further are taken away until none is left or none goes."""
    left = materialise(edges.select("src_id", "dst_id").distinct(), "cycles")
    n = left.count()
    for _ in range(max_rounds):
        if not n:
            return True
        inner = left.join(left.select(F.col("src_id").alias("dst_id")).distinct(), "dst_id", "left_semi").select("src_id", "dst_id")
        left = materialise(inner, "cycles")
        m = left.count()
        if m == n:
            return False
        n = m
    raise RuntimeError(f"no answer after {max_rounds} rounds")


class CycleError(ValueError):
    """Edges of an acyclic kind would close a cycle."""


@dataclass
class Region:
    id: int
    name: str
    dim: int
    metric: str


class Memory:
    """Named regions over one frame of atoms and one of edges.

    Region names ignore ASCII case.  Every change makes new frames; nothing is
    changed in place.
    """

    def __init__(self, spark: SparkSession, atoms: DataFrame | None = None, edges: DataFrame | None = None, embedder: Embedder | None = None):
        self.spark = spark
        self.atoms = atoms if atoms is not None else spark.createDataFrame([], ATOM)
        self.edges = edges if edges is not None else spark.createDataFrame([], EDGE)
        self.regions: dict[str, Region] = {}
        self.embedder = embedder

    def create_region(self, name: str, dim: int, metric: str = "cosine", region_id: int | None = None) -> Region:
        """A region that exists must have the same dimension and metric."""
        key = name.lower()
        if metric not in vector.METRICS:
            raise ValueError(f"unknown metric {metric}")
        have = self.regions.get(key)
        if have is not None:
            if (have.dim, have.metric) != (dim, metric):
                raise ValueError(f"region {name} exists with other settings")
            return have
        self.regions[key] = Region(region_id if region_id is not None else max((r.id for r in self.regions.values()), default=0) + 1, key, dim, metric)
        return self.regions[key]

    def region(self, name: str) -> Region:
        if name.lower() not in self.regions:
            raise KeyError(f"no region {name}")
        return self.regions[name.lower()]

    def drop_region(self, name: str) -> None:
        """The region, its atoms and all edges from or to these."""
        r = self.region(name)
        gone = self.atoms.where(F.col("region_id") == r.id).select("id")
        for end in ("src_id", "dst_id"):
            self.edges = self.edges.join(gone.withColumnRenamed("id", end), end, "left_anti").select(*self.edges.columns)
        self.atoms = self.atoms.where(~F.coalesce(F.col("region_id") == r.id, F.lit(False)))
        del self.regions[name.lower()]

    def remember_batch(self, name: str, rows: DataFrame, order: list[Column]) -> DataFrame:
        """Store rows (text, and any other atom columns), numbered in ``order``; gives the new atoms.

        Texts without an embedding are embedded; another length than the
        region's is an error.
        """
        r = self.region(name)
        last = self.atoms.agg(F.max("id")).first()[0] or 0
        now = F.current_timestamp().cast("timestamp_ntz")
        default = {"kind": "fact", "score": 0.0, "confidence": 1.0, "access_count": 0, "immutable": 0}
        if "embedding" not in rows.columns:
            if self.embedder is None:
                raise ValueError("no embedder")
            rows = rows.withColumn("embedding", embed(F.col("text"), self.embedder))
        bad = F.raise_error(F.lit(f"expected {r.dim} dimensions")).cast("array<float>")
        rows = rows.withColumn("embedding", F.when(F.size("embedding") != r.dim, bad).otherwise(F.col("embedding")))
        rows = number_rows(rows, order, "__n").withColumn("id", F.col("__n") + last).withColumn("region_id", F.lit(r.id)).withColumn("text_content", F.col("text"))
        for f in self.atoms.schema.fields:
            if f.name not in rows.columns:
                value = now if f.name in ("created_at", "accessed_at") else F.lit(default.get(f.name))
                rows = rows.withColumn(f.name, value)
            rows = rows.withColumn(f.name, F.col(f.name).cast(f.dataType))
        new = materialise(rows.select(*self.atoms.columns), "remembered")
        self.atoms = self.atoms.unionByName(new)
        return new

    def remember(self, name: str, text: str, **columns) -> DataFrame:
        """Store one atom."""
        row = self.spark.createDataFrame([(text,)], "text string")
        for c, v in columns.items():
            row = row.withColumn(c, F.lit(v))
        return self.remember_batch(name, row, [F.col("text")])

    def _in(self, name: str, kinds: list[str] | None = None, payload: str | None = None) -> DataFrame:
        rows = self.atoms.where(F.col("region_id") == self.region(name).id)
        rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows
        return rows.where(J.contains(F.col("payload"), payload)) if payload else rows

    def fetch(self, name: str, kind: str, limit: int, payload: str | None = None) -> DataFrame:
        """The first atoms of a kind by id, whose payload contains ``payload``."""
        return self._in(name, [kind], payload).orderBy("id").limit(limit)

    def fetch_one(self, name: str, atom_id: int) -> DataFrame:
        return self._in(name).where(F.col("id") == atom_id).limit(1)

    def fetch_last(self, name: str, kind: str) -> DataFrame:
        """The atom of a kind with the highest id."""
        return self._in(name, [kind]).orderBy(F.col("id").desc()).limit(1)

    def count(self, name: str, kind: str) -> DataFrame:
        """COUNT(*) of a kind (one row: n)."""
        return self._in(name, [kind]).agg(F.count("*").alias("n"))

    def fetch_edges(self, src: int | None = None, dst: int | None = None, kind: str | None = None) -> DataFrame:
        rows = self.edges
        for c, v in (("src_id", src), ("dst_id", dst), ("kind", kind)):
            rows = rows if v is None else rows.where(F.col(c) == v)
        return rows.orderBy("src_id", "dst_id", "kind")

    def link(self, new: DataFrame) -> DataFrame:
        """Insert or reweight edges (src_id, dst_id, kind, weight) at once; a cycle of an acyclic kind is an error."""
        rows = new.withColumn("evidence_ref", F.lit(None).cast("string")).select("src_id", "dst_id", "kind", "weight", "evidence_ref")
        merged, changed = dml.upsert_do_update(self.edges.select(*rows.columns), rows, ["src_id", "dst_id", "kind"], {"weight": lambda old, ex: ex("weight")})
        merged = materialise(merged, "edges")
        for kind in ACYCLIC:
            if not rows.where(F.col("kind") == kind).isEmpty() and not acyclic(merged.where(F.col("kind") == kind)):
                raise CycleError(f"{kind} edges would close a cycle")
        self.edges = merged
        return changed

    def update_payload(self, name: str, atom_id: int, payload: str) -> None:
        """Replace an atom's payload; an absent or immutable atom is an error."""
        row = self.fetch_one(name, atom_id).select("immutable").first()
        if row is None or row["immutable"] == 1:
            raise ValueError(f"atom {atom_id} is {'absent' if row is None else 'immutable'}")
        hit = (F.col("region_id") == self.region(name).id) & (F.col("id") == atom_id)
        self.atoms = dml.update(self.atoms, {"payload": F.lit(payload)}, hit)[0]

    def recall(self, name: str, query_vector: list[float], text: str, k: int, now_micros: int, kinds: list[str] | None = None, payload: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
        """Hybrid recall in one region, of some kinds and with a payload that contains ``payload``."""
        r = self.region(name)
        rows = self._in(name, kinds, payload).where(F.size("embedding") == r.dim)
        return memory.recall(rows, r.id, query_vector, text, k, now_micros, vector.METRICS[r.metric], weights)

    def evolve(self, name: str, ids: DataFrame, neighbours: int, max_distance: float, now_micros: int) -> tuple[DataFrame, DataFrame]:
        """(edges, scores): derived_from edges of each atom to its nearest within a distance, and its new score.

        ``ids`` has one column, id.  The edges are linked, the scores stored.
        """
        r = self.region(name)
        rows = self._in(name).where(F.size("embedding") == r.dim).dropDuplicates(["id"])
        near = vector.knn_batch(rows, rows.join(ids, "id", "left_semi"), "id", "embedding", neighbours, r.metric)
        edges = near.where(F.col("dist") <= max_distance).select(F.col("query").alias("src_id"), F.col("id").alias("dst_id"), F.lit("derived_from").alias("kind"), (1.0 / (1.0 + F.greatest("dist", F.lit(0.0)))).alias("weight"))
        edges = materialise(edges, "derived")
        now = F.timestamp_micros(F.lit(now_micros)).cast("timestamp_ntz")
        scores = materialise(rows.join(ids, "id", "left_semi").select("id", memory.evolve_score(F.col("created_at"), F.col("access_count"), now).alias("new_score")), "scores")
        self.link(edges)
        self.atoms = self.atoms.join(scores, "id", "left").withColumn("score", F.coalesce("new_score", "score")).select(*self.atoms.columns)
        return edges, scores


def rerank(candidates: DataFrame, query: str, reranker: Reranker, k: int, strategy: str = "replace", rrf_k: int = memory.RRF_K) -> DataFrame:
    """(id, score) of the first ``k`` after a second scoring of the best ``RERANK_POOL`` by ``fused``.

    ``candidates`` has id, text_content and fused.  ``replace`` takes the
    reranker's score, ``rrf`` the sum of reciprocal ranks of both orders;
    ranks count from 0, equal values go by id.
    """
    if strategy not in ("replace", "rrf"):
        raise ValueError(f"unknown strategy {strategy}")
    kind = dict(candidates.dtypes)["id"]

    def run(parts):
        frames = list(parts)
        x = pd.concat(frames) if frames else pd.DataFrame({"id": [], "text_content": [], "fused": []})
        x = x.sort_values("id").reset_index(drop=True)
        if not len(x):
            return
        ce = reranker(query, x["text_content"].fillna("").tolist())
        if len(ce) != len(x):
            raise ValueError(f"the reranker returned {len(ce)} scores for {len(x)} passages")
        x["score"] = ce
        if strategy == "rrf":
            place = lambda c: (-x[c]).rank(method="first") - 1
            x["score"] = 1.0 / (rrf_k + place("score")) + 1.0 / (rrf_k + place("fused"))
        yield x[["id", "score"]]

    # The pool is bounded, so one task may hold it.
    pool = candidates.select("id", "text_content", "fused").orderBy(F.col("fused").desc(), "id").limit(RERANK_POOL).coalesce(1)
    return pool.mapInPandas(run, f"id {kind}, score double").orderBy(F.col("score").desc(), "id").limit(k)
