"""Hybrid recall over atoms: BM25, fusion, reciprocal ranks, graph walks, eviction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions import json as J
from tidewell.session import materialise, read_all

# BM25 and fusion constants.
K1, B = 1.2, 0.75
WEIGHTS = {"semantic": 0.45, "keyword": 0.2, "recency": 0.2, "importance": 0.15}
HALF_LIFE_DAYS = 30.0
RRF_K = 20


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25(df: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, bm25): the candidate pool is the corpus; each distinct query word counts once.

    Rows without any query word score 0.  Only counts per row and per query
    word are aggregated; the corpus is neither exploded nor shuffled.
    """
    import re

    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    rows = df.select(key, F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("__w"))
    tf = [F.size(F.filter("__w", lambda x: x == F.lit(t))).cast("double").alias(f"__tf{i}") for i, t in enumerate(terms)]
    rows = rows.select(key, F.size("__w").cast("double").alias("__n"), *tf)
    stats = rows.agg(F.count("*").alias("__docs"), F.avg("__n").alias("__avg"), *[F.sum((F.col(f"__tf{i}") > 0).cast("long")).alias(f"__df{i}") for i in range(len(terms))])
    both = rows.join(F.broadcast(stats), how="cross")  # stats is one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, d = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.log((F.col("__docs") - d + 0.5) / (d + 0.5) + 1)
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__n") / F.col("__avg")))
    return both.select(key, F.coalesce(score, F.lit(0.0)).alias("bm25"))


def _scaled(c: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, (c - lo) / (hi - lo)).otherwise(1.0)


def fuse(df: DataFrame, now_micros: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Candidates (dist, text_rank, importance, created_micros) with ``fused``.

    Distance and importance are scaled between their extremes, the keyword
    score by its largest, recency halves every 30 days.
    """
    w = {**WEIGHTS, **(weights or {})}
    e = df.agg(F.min("dist").alias("__d0"), F.max("dist").alias("__d1"), F.min("importance").alias("__i0"), F.max("importance").alias("__i1"), F.max("text_rank").alias("__k1"))
    x = df.join(F.broadcast(e), how="cross")  # one row
    sem = 1 - F.when(F.col("__d1") > F.col("__d0"), (F.col("dist") - F.col("__d0")) / (F.col("__d1") - F.col("__d0"))).otherwise(0.0)
    key = F.when(F.col("__k1") > 0, F.col("text_rank") / F.col("__k1")).otherwise(0.0)
    age = F.greatest(F.lit(0.0), (F.lit(float(now_micros)) - F.col("created_micros")) / 86_400_000_000.0)
    rec = F.pow(F.lit(0.5), age / HALF_LIFE_DAYS)
    imp = _scaled(F.col("importance"), F.col("__i0"), F.col("__i1"))
    return x.withColumn("fused", w["semantic"] * sem + w["keyword"] * key + w["recency"] * rec + w["importance"] * imp).select(*df.columns, "fused")


def rrf(rankings: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """(key, rrf): sum of 1 / (k + rank from 0) over rankings of (key, rank)."""
    rows = rankings[0].select(key, "rank")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select(key, "rank"))
    return rows.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"))


def graph_expand(edges: DataFrame, seeds: DataFrame, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """(id, depth, score): nodes within ``depth`` steps, least depth each, score 1 / (depth + 1)."""
    e = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    e = e.select("src_id", F.col("dst_id").alias("next")).distinct()
    front = materialise(seeds.select(F.col("id")).distinct().withColumn("depth", F.lit(0)), "graph")
    levels = [front]
    for d in range(1, depth + 1):
        new = front.join(e, F.col("id") == F.col("src_id")).select(F.col("next").alias("id")).distinct().join(read_all(levels).select("id"), "id", "left_anti")
        front = materialise(new.withColumn("depth", F.lit(d)), "graph")
        if front.isEmpty():
            break
        levels.append(front)
    return read_all(levels).withColumn("score", 1.0 / (F.col("depth") + 1))


def would_cycle(edges: DataFrame, kind: str, src: int, dst: int) -> bool:
    """Whether an edge src -> dst of an acyclic kind would close a cycle."""
    from tidewell.operators.relational import recursive_union

    e = edges.where(F.col("kind") == kind).select("src_id", F.col("dst_id").alias("next"))
    seed = edges.sparkSession.createDataFrame([(dst,)], "id long")
    reach = recursive_union(seed, lambda new: new.join(e, F.col("id") == F.col("src_id")).select(F.col("next").alias("id")))
    return src == dst or not reach.where(F.col("id") == src).isEmpty()


def evolve_score(created: Column, access_count: Column, now: Column) -> Column:
    """recency x (1 + ln(1 + accesses)); recency halves every 30 days from creation."""
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 86_400_000_000.0
    return F.pow(F.lit(0.5), F.greatest(days, F.lit(0.0)) / HALF_LIFE_DAYS) * (1 + F.log(1.0 + F.greatest(access_count, F.lit(0))))


def evict(atoms: DataFrame, policy: str, **p) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted) under a policy; immutable atoms are spared, except by a purge.

    ``stale`` (before): never accessed and created before that time.
    ``low_score`` (score, confidence): below both.  ``lru`` (keep_fraction):
    of each region the least recently accessed (then accessed least, then the
    smallest id) go, the floor of the other fraction of those not immutable.
    ``purge_region`` (region_id): all.  ``predicate_match`` (payload):
    payload contains that JSON.
    """
    free = ~F.coalesce(F.col("immutable") == 1, F.lit(False))
    if policy == "lru":
        share = 1.0 - min(max(p["keep_fraction"], 0.0), 1.0)
        rows = atoms.where(free)
        go = rows.groupBy("region_id").agg(F.floor(F.count("*") * F.lit(share) + 1e-9).alias("__go"))
        w = Window.partitionBy("region_id").orderBy(F.col("accessed_at").asc_nulls_first(), F.col("access_count").asc_nulls_first(), "id")
        ranked = rows.withColumn("__r", F.row_number().over(w)).join(go, rows["region_id"].eqNullSafe(go["region_id"])).drop(go["region_id"])
        gone = ranked.where(F.col("__r") <= F.col("__go")).select(*atoms.columns)
        stay = ranked.where(F.col("__r") > F.col("__go")).select(*atoms.columns)
        return atoms.where(~free).unionByName(stay), gone
    cond = {
        "stale": lambda: (F.col("access_count") == 0) & (F.col("created_at") < F.lit(p["before"]).cast("timestamp_ntz")),
        "low_score": lambda: (F.col("score") < p["score"]) & (F.col("confidence") < p["confidence"]),
        "purge_region": lambda: F.col("region_id") == p["region_id"],
        "predicate_match": lambda: J.contains(F.col("payload"), p["payload"]),
    }[policy]()
    hit = F.coalesce(cond, F.lit(False)) & (F.lit(policy == "purge_region") | free)
    return atoms.where(~hit), atoms.where(hit)


def summarize(atoms: DataFrame) -> DataFrame:
    """Per kind: (kind, n, min_score, max_score, avg_score)."""
    return atoms.groupBy("kind").agg(F.count("*").alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("avg_score"))


def recall(atoms: DataFrame, region: int, query_vector: list[float], query_text: str, k: int, now_micros: int, metric: Callable[[Column, list[float]], Column], weights: dict[str, float] | None = None, where: Column | None = None) -> DataFrame:
    """Hybrid recall: filter, nearest max(4k, 4096), BM25 of those, fuse, first k."""
    rows = atoms.where(F.col("region_id") == region)
    rows = rows if where is None else rows.where(where)
    near = rows.withColumn("dist", metric(F.col("embedding"), query_vector)).where(F.col("dist").isNotNull()).orderBy("dist", "id").limit(max(4 * k, 4096))
    near = materialise(near, "recall")
    scored = near.join(bm25(near, "id", "text_content", query_text), "id").select("id", "dist", F.col("bm25").alias("text_rank"), F.coalesce("score", F.lit(0.0)).alias("importance"), F.unix_micros(F.col("created_at").cast("timestamp")).cast("double").alias("created_micros"))
    return fuse(scored, now_micros, weights).orderBy(F.col("fused").desc(), "id").limit(k)
