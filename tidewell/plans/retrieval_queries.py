"""Full-text search, vectors and memory recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import vector
from tidewell.operators import memory, memory_store
from tidewell.plans.registry import query
from tidewell.session import configure, table

#: The query vector of the vector queries is this row's.
PROBE = 3
_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    configure(spark)
    e = table(spark, d, "embeddings")
    return e, [float(x) for x in e.where(F.col("vec_id") == PROBE).select("embedding").first()[0]]


def _sql(name: str) -> str:
    f = {"l2": "list_distance(CAST(embedding AS DOUBLE[]), {q})", "inner": "-list_inner_product(CAST(embedding AS DOUBLE[]), {q})", "cosine": "list_cosine_distance(CAST(embedding AS DOUBLE[]), {q})"}
    return f[name].format(q=_Q)


@query(f"SELECT vec_id, round({_sql('l2')}, 6) AS d FROM embeddings")
def vec_l2(spark: SparkSession, d: str) -> DataFrame:
    e, q = _vectors(spark, d)
    return e.select("vec_id", F.round(vector.l2(F.col("embedding"), q), 6).alias("d"))


@query(f"SELECT vec_id, round({_sql('inner')}, 6) AS d FROM embeddings")
def vec_inner(spark: SparkSession, d: str) -> DataFrame:
    e, q = _vectors(spark, d)
    return e.select("vec_id", F.round(vector.inner(F.col("embedding"), q), 6).alias("d"))


@query(f"SELECT vec_id, round({_sql('cosine')}, 6) + 0.0 AS d FROM embeddings")
def vec_cosine(spark: SparkSession, d: str) -> DataFrame:
    e, q = _vectors(spark, d)
    return e.select("vec_id", (F.round(vector.cosine(F.col("embedding"), q), 6) + 0.0).alias("d"))


@query(f"SELECT vec_id FROM embeddings ORDER BY {_sql('cosine')}, vec_id LIMIT 10")
def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    e, q = _vectors(spark, d)
    return vector.top_k(e, "embedding", q, 10, "cosine").select("vec_id")


@query(f"SELECT vec_id, label FROM embeddings WHERE label IN (1, 2) ORDER BY {_sql('l2')}, vec_id LIMIT 10")
def vec_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    e, q = _vectors(spark, d)
    return vector.top_k(e, "embedding", q, 10, "l2", where=F.col("label").isin(1, 2)).select("vec_id", "label")


def _pairs(metric: str) -> str:
    return {"l2": "list_distance(a.v, b.v)", "inner": "-list_inner_product(a.v, b.v)", "cosine": "list_cosine_distance(a.v, b.v)"}[metric]


@query(
    f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    p AS (SELECT a.vec_id AS query, b.vec_id, round({_pairs('l2')}, 9) AS d FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
    SELECT query, vec_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS r FROM p) WHERE r <= 5"""
)
def vec_knn_batch(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 50, among all."""
    configure(spark)
    e = table(spark, d, "embeddings")
    near = vector.knn_batch(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, "l2")
    return near.select("query", "vec_id", F.round("dist", 6).alias("d"))


_ANN: dict[tuple[str, str], vector.AnnIndex] = {}


def ann(spark: SparkSession, d: str) -> vector.AnnIndex:
    """The stored index of ``embeddings``, made once for a session and folder."""
    configure(spark)
    at = (spark.sparkContext.applicationId, d)
    if at not in _ANN:
        _ANN[at] = vector.build_ann(table(spark, d, "embeddings"), "vec_id", "embedding", "l2", ("label",))
    return _ANN[at]


@query(f"SELECT vec_id FROM embeddings ORDER BY {_sql('l2')}, vec_id LIMIT 10")
def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """Top-k over the stored cells nearest to the query."""
    _, q = _vectors(spark, d)
    return vector.ann_top_k(ann(spark, d), q, 10, probes=64).select("vec_id")


@query(f"SELECT vec_id, label FROM embeddings WHERE label = 1 ORDER BY {_sql('l2')}, vec_id LIMIT 10")
def ann_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """A predicate on a stored column is pushed to the cells' scan."""
    _, q = _vectors(spark, d)
    return vector.ann_top_k(ann(spark, d), q, 10, probes=64, where=F.col("label") == 1).select("vec_id", "label")


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, true AS same FROM embeddings")
def vec_literal(spark: SparkSession, d: str) -> DataFrame:
    """VECTOR to text and back, with its dimension."""
    configure(spark)
    text = F.to_json("embedding")
    back = F.from_json(text, "array<float>")
    return table(spark, d, "embeddings").select("vec_id", F.size(back).alias("dim"), (back == F.col("embedding")).alias("same"))


_BM = "recall summary of the window"
_TERMS = sorted(set(_BM.split()))


@query(
    "WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), "
    "s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t), "
    "x AS (SELECT doc_id, q, len(list_filter(w, lambda z: z = q)) AS f, len(w) AS l FROM t, (SELECT unnest([" + ", ".join(f"'{t}'" for t in _TERMS) + "]) AS q)), "
    "df AS (SELECT q, count(*) FILTER (WHERE f > 0) AS d FROM x GROUP BY q) "
    "SELECT doc_id, round(sum(ln((n - d + 0.5) / (d + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / a))), 6) AS bm25 FROM x JOIN df USING (q), s GROUP BY doc_id"
)
def bm25(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return memory.bm25(table(spark, d, "documents"), "doc_id", "text", _BM).select("doc_id", F.round("bm25", 6).alias("bm25"))


_HARBOR = "a AS (SELECT DISTINCT id, CAST(embedding AS DOUBLE[]) AS v, text_content, coalesce(score, 0) AS importance, epoch_us(created_at) AS us FROM atoms WHERE region_id = 1 AND len(embedding) = 48 AND len(list_filter(embedding, lambda z: z IS NULL OR isnan(z))) = 0 AND (score IS NULL OR NOT isnan(score)))"
_ASK = "which patient met the referee"
_FUSED = f"""{_HARBOR},
    q AS (SELECT v AS q FROM a WHERE len(list_filter(v, lambda z: z <> 0)) > 0 ORDER BY id LIMIT 1),
    near AS (SELECT a.*, list_cosine_distance(v, q) AS dist FROM a, q WHERE len(list_filter(v, lambda z: z <> 0)) > 0),
    t AS (SELECT *, regexp_extract_all(lower(coalesce(text_content, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM near),
    s AS (SELECT count(*) AS n, avg(len(w)) AS av FROM t),
    x AS (SELECT id, term, len(list_filter(w, lambda z: z = term)) AS f, len(w) AS l FROM t, (SELECT unnest({sorted(set(_ASK.split()))}) AS term)),
    df AS (SELECT term, count(*) FILTER (WHERE f > 0) AS d FROM x GROUP BY term),
    b AS (SELECT id, sum(ln((n - d + 0.5) / (d + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / av))) AS bm FROM x JOIN df USING (term), s GROUP BY id),
    c AS (SELECT near.id, text_content, dist, bm, importance, greatest(1767225600000000 - us, 0) / 86400000000.0 AS age FROM near JOIN b USING (id)),
    e AS (SELECT min(dist) AS d0, max(dist) AS d1, min(importance) AS i0, max(importance) AS i1, max(bm) AS k1 FROM c),
    u AS (SELECT id, text_content, 0.45 * (1 - CASE WHEN d1 > d0 THEN (dist - d0) / (d1 - d0) ELSE 0 END) + 0.2 * CASE WHEN k1 > 0 THEN bm / k1 ELSE 0 END + 0.2 * pow(0.5, age / 30) + 0.15 * CASE WHEN i1 > i0 THEN (importance - i0) / (i1 - i0) ELSE 1 END AS fused FROM c, e)"""


def _harbor(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    """Usable atoms of the largest region, and the vector of the smallest of them."""
    configure(spark)
    fine = "region_id = 1 AND size(embedding) = 48 AND NOT exists(embedding, x -> x IS NULL OR isnan(x)) AND (score IS NULL OR NOT isnan(score))"
    a = table(spark, d, "atoms").where(fine).dropDuplicates(["id"])
    first = a.where("exists(embedding, x -> x <> 0)").orderBy("id").select("embedding").first()
    return a, [float(x) for x in first[0]] if first else [1.0] * 48


@query(f"WITH {_FUSED} SELECT id, round(fused, 6) AS fused FROM u ORDER BY u.fused DESC, id LIMIT 20")
def fusion(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid recall in the largest region with the vector of its smallest atom."""
    a, q = _harbor(spark, d)
    return memory.recall(a, 1, q, _ASK, 20, 1_767_225_600_000_000, vector.cosine).select("id", F.round("fused", 6).alias("fused"))


@query("SELECT id, round(sum(1.0 / (20 + rank)), 9) AS rrf FROM (SELECT id, row_number() OVER (ORDER BY score DESC NULLS LAST, id) - 1 AS rank FROM (SELECT DISTINCT id, score FROM atoms) UNION ALL SELECT id, row_number() OVER (ORDER BY access_count DESC NULLS LAST, id) - 1 FROM (SELECT DISTINCT id, access_count FROM atoms)) WHERE rank < 256 GROUP BY id")
def rrf(spark: SparkSession, d: str) -> DataFrame:
    """Atoms' reciprocal ranks by score and by use, in the first 256 places of either."""
    from pyspark.sql import Window

    configure(spark)
    a = table(spark, d, "atoms").select("id", "score", "access_count").dropDuplicates(["id"])
    # The 256 first rows are few enough for one window.
    by = lambda c: a.orderBy(F.col(c).desc_nulls_last(), "id").limit(256).select("id", (F.row_number().over(Window.orderBy(F.col(c).desc_nulls_last(), "id")) - 1).alias("rank"))
    return memory.rrf([by("score"), by("access_count")], "id").select("id", F.round("rrf", 9).alias("rrf"))


_SOME = _FUSED.replace("WHERE region_id = 1 AND", "WHERE region_id = 1 AND kind IN ('fact', 'event') AND json_valid(payload) AND CAST(payload AS JSON)->>'topic' = 'law' AND", 1).replace("q AS (SELECT v AS q FROM a", "q AS (SELECT v AS q FROM (" + _HARBOR.removeprefix("a AS (") + " a").replace("SELECT v AS q FROM (SELECT", "SELECT v AS q FROM (SELECT")


@query(f"WITH {_SOME} SELECT id, round(fused, 6) AS fused FROM u ORDER BY u.fused DESC, id LIMIT 20")
def recall_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Recall of two kinds whose payload contains a topic."""
    a, q = _harbor(spark, d)
    m = memory_store.Memory(spark, a)
    m.create_region("harbor", len(q), "cosine", 1)
    return m.recall("harbor", q, _ASK, 20, 1_767_225_600_000_000, kinds=["fact", "event"], payload='{"topic": "law"}').select("id", F.round("fused", 6).alias("fused"))


_SECOND = "len(list_filter(regexp_extract_all(lower(coalesce(text_content, '')), '[a-z]+'), lambda z: z IN ('atom', 'recall', 'window')))"
_POOL = f"pool AS (SELECT id, fused, CAST({_SECOND} AS DOUBLE) AS ce FROM (SELECT * FROM u ORDER BY u.fused DESC, id LIMIT 256))"


def _reranked(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    a, q = _harbor(spark, d)
    fused = memory.recall(a, 1, q, _ASK, 100_000, 1_767_225_600_000_000, vector.cosine).select("id", "fused").join(a.select("id", "text_content"), "id")

    def score(query: str, passages: list[str]) -> list[float]:
        import re

        return [float(sum(w in ("atom", "recall", "window") for w in re.findall("[a-z]+", p.lower()))) for p in passages]

    return memory_store.rerank(fused, _ASK, score, 10, strategy)


@query(f"WITH {_FUSED}, {_POOL} SELECT id, ce AS score FROM pool ORDER BY ce DESC, id LIMIT 10")
def rerank_replace(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, "replace")


@query(f"WITH {_FUSED}, {_POOL}, r AS (SELECT id, 1.0 / (19 + row_number() OVER (ORDER BY ce DESC, id)) + 1.0 / (19 + row_number() OVER (ORDER BY fused DESC, id)) AS score FROM pool) SELECT id, round(score, 9) AS score FROM r ORDER BY r.score DESC, id LIMIT 10")
def rerank_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d, "rrf").select("id", F.round("score", 9).alias("score"))


def _memory(spark: SparkSession, d: str) -> memory_store.Memory:
    configure(spark)
    atoms = table(spark, d, "atoms").dropDuplicates(["id"])
    edges = table(spark, d, "memory_edges").select("src_id", "dst_id", "kind", "weight", "evidence_ref").dropDuplicates(["src_id", "dst_id", "kind"])
    m = memory_store.Memory(spark, atoms, edges, memory_store.mock_embedder(48))
    r = table(spark, d, "memory_regions").where("id = 1").first()
    m.create_region(r["name"], r["embedding_dim"], r["embedding_metric"], 1)
    return m


@query("WITH t AS (SELECT input_id, text, row_number() OVER (ORDER BY input_id) AS n, len(list_filter(string_split_regex(text, '\\s+'), lambda z: z <> '')) AS words FROM atom_inputs WHERE text IS NOT NULL) SELECT n + (SELECT max(id) FROM atoms) AS id, text AS text_content, CAST(words AS DOUBLE) AS words FROM t")
def remember_batch(spark: SparkSession, d: str) -> DataFrame:
    """All inputs stored in one region, numbered and embedded."""
    m = _memory(spark, d)
    rows = table(spark, d, "atom_inputs").where("text IS NOT NULL").select("input_id", "text")
    new = m.remember_batch("harbor", rows, [F.col("input_id")])
    return new.select("id", "text_content", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")).alias("words"))


@query("SELECT DISTINCT id, kind, text_content FROM atoms WHERE region_id = 1 AND kind = 'fact' AND json_valid(payload) AND CAST(payload AS JSON)->>'topic' = 'law' ORDER BY id LIMIT 20")
def memory_fetch(spark: SparkSession, d: str) -> DataFrame:
    return _memory(spark, d).fetch("Harbor", "fact", 20, '{"topic": "law"}').select("id", "kind", "text_content")


@query("SELECT (SELECT max(id) FROM atoms WHERE region_id = 1 AND kind = 'fact') AS last_id, (SELECT count(DISTINCT id) FROM atoms WHERE region_id = 1 AND kind = 'fact') AS n, (SELECT min(id) FROM atoms WHERE region_id = 1) AS one_id")
def memory_lookup(spark: SparkSession, d: str) -> DataFrame:
    """fetch_last, count and fetch_one."""
    m = _memory(spark, d)
    low = m.atoms.where("region_id = 1").agg(F.min("id")).first()[0]
    one = m.fetch_one("harbor", low).select(F.col("id").alias("one_id"))
    return m.fetch_last("harbor", "fact").select(F.col("id").alias("last_id")).join(m.count("harbor", "fact"), how="cross").join(one, how="cross")  # one row each


@query("SELECT DISTINCT src_id, dst_id, kind FROM memory_edges WHERE kind = 'supersedes'")
def memory_edges_of(spark: SparkSession, d: str) -> DataFrame:
    return _memory(spark, d).fetch_edges(kind="supersedes").select("src_id", "dst_id", "kind")


@query("SELECT * FROM (VALUES ('new', 1, 2, 0.5), ('new', 2, 3, 0.25)) t(what, src_id, dst_id, weight) UNION ALL SELECT 'cycle', 3, 1, 1.0")
def memory_link(spark: SparkSession, d: str) -> DataFrame:
    """Edges linked at once; those of an acyclic kind that would close a cycle are refused."""
    configure(spark)
    m = memory_store.Memory(spark)
    new = spark.createDataFrame([(1, 2, "depends_on", 0.5), (2, 3, "depends_on", 0.25)], "src_id long, dst_id long, kind string, weight double")
    done = m.link(new).select(F.lit("new").alias("what"), "src_id", "dst_id", "weight")
    back = spark.createDataFrame([(3, 1, "depends_on", 1.0)], "src_id long, dst_id long, kind string, weight double")
    try:
        m.link(back)
    except memory_store.CycleError:
        done = done.unionByName(back.select(F.lit("cycle").alias("what"), "src_id", "dst_id", "weight"))
    return done.select("what", F.col("src_id").cast("int").alias("src_id"), F.col("dst_id").cast("int").alias("dst_id"), "weight")


@query("SELECT (SELECT count(DISTINCT id) FROM atoms WHERE region_id <> 1 OR region_id IS NULL) AS atoms_left, (SELECT count(*) FROM (SELECT DISTINCT src_id, dst_id, kind FROM memory_edges) e WHERE NOT EXISTS (SELECT 1 FROM atoms a WHERE a.region_id = 1 AND a.id IN (e.src_id, e.dst_id))) AS edges_left")
def drop_region(spark: SparkSession, d: str) -> DataFrame:
    """A region goes with its atoms and their edges."""
    m = _memory(spark, d)
    m.drop_region("harbor")
    return m.atoms.agg(F.count("*").alias("atoms_left")).join(m.edges.agg(F.count("*").alias("edges_left")), how="cross")  # one row each


@query(
    f"""WITH a AS (SELECT DISTINCT id, CAST(embedding AS DOUBLE[]) AS v FROM atoms WHERE region_id = 1 AND len(embedding) = 48 AND len(list_filter(embedding, lambda z: z IS NULL OR isnan(z))) = 0 AND len(list_filter(embedding, lambda z: z <> 0)) > 0),
    p AS (SELECT a.id AS src_id, b.id AS dst_id, list_cosine_distance(a.v, b.v) AS d FROM a JOIN a b ON a.id % 50 = 0 AND a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY round(d, 12), dst_id) AS n FROM p)
    SELECT src_id, dst_id, round(1 / (1 + greatest(d, 0)), 6) AS weight FROM r WHERE n <= 3 AND d <= 0.9"""
)
def evolve_edges(spark: SparkSession, d: str) -> DataFrame:
    """derived_from edges of the atoms whose id is divisible by 50."""
    m = _memory(spark, d)
    fine = "NOT exists(embedding, x -> x IS NULL OR isnan(x)) AND exists(embedding, x -> x <> 0)"
    m.atoms = m.atoms.where(fine)
    edges, _ = m.evolve("harbor", m.atoms.where("id % 50 = 0").select("id"), 3, 0.9, 1_767_225_600_000_000)
    return edges.select("src_id", "dst_id", F.round("weight", 6).alias("weight"))


@query(
    """WITH RECURSIVE w(id, depth) AS (SELECT DISTINCT id, 0 FROM atoms WHERE id % 50 = 0
    UNION SELECT e.dst_id, w.depth + 1 FROM w JOIN memory_edges e ON e.src_id = w.id WHERE w.depth < 3)
    SELECT id, CAST(min(depth) AS INTEGER) AS depth, round(1.0 / (min(depth) + 1), 6) AS score FROM w GROUP BY id"""
)
def graph_expand(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    seeds = table(spark, d, "atoms").where("id % 50 = 0").select("id")
    return memory.graph_expand(table(spark, d, "memory_edges"), seeds, 3).select("id", "depth", F.round("score", 6).alias("score"))


@query("SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY accessed_at NULLS FIRST, access_count NULLS FIRST, id) AS r, count(*) OVER (PARTITION BY region_id) AS n FROM (SELECT DISTINCT id, region_id, accessed_at, access_count, immutable FROM atoms) WHERE coalesce(immutable, 0) <> 1) WHERE r <= floor(n * 0.25)")
def evict_lru(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    _, gone = memory.evict(table(spark, d, "atoms").select("id", "region_id", "accessed_at", "access_count", "immutable").distinct(), "lru", keep_fraction=0.75)
    return gone.select("id")


_ATOM = "(SELECT DISTINCT id, region_id, kind, payload, score, confidence, access_count, immutable, created_at FROM atoms)"


@query(
    f"""SELECT 'stale' AS policy, id FROM {_ATOM} WHERE coalesce(immutable, 0) <> 1 AND access_count = 0 AND created_at < TIMESTAMP '2025-06-01'
    UNION ALL SELECT 'low_score', id FROM {_ATOM} WHERE coalesce(immutable, 0) <> 1 AND score < 0.2 AND confidence < 0.6
    UNION ALL SELECT 'purge_region', id FROM {_ATOM} WHERE region_id = 2
    UNION ALL SELECT 'predicate_match', id FROM {_ATOM} WHERE coalesce(immutable, 0) <> 1 AND json_valid(payload) AND CAST(payload AS JSON)->>'topic' = 'law'"""
)
def evict_policies(spark: SparkSession, d: str) -> DataFrame:
    """Stale, LowScore, PurgeRegion and PredicateMatch."""
    configure(spark)
    a = table(spark, d, "atoms").select("id", "region_id", "kind", "payload", "score", "confidence", "access_count", "immutable", "created_at").distinct()
    how = {"stale": {"before": "2025-06-01 00:00:00"}, "low_score": {"score": 0.2, "confidence": 0.6}, "purge_region": {"region_id": 2}, "predicate_match": {"payload": '{"topic": "law"}'}}
    out = None
    for policy, p in how.items():
        gone = memory.evict(a, policy, **p)[1].select(F.lit(policy).alias("policy"), "id")
        out = gone if out is None else out.unionByName(gone)
    return out


@query("SELECT kind, count(*) AS n, min(score) AS min_score, max(score) AS max_score, round(avg(score), 6) AS avg_score FROM (SELECT DISTINCT id, kind, score FROM atoms) GROUP BY kind")
def summarize(spark: SparkSession, d: str) -> DataFrame:
    """A NaN counts as the largest score and makes the mean NaN."""
    configure(spark)
    a = table(spark, d, "atoms").select("id", "kind", "score").distinct()
    return memory.summarize(a).withColumn("avg_score", F.round("avg_score", 6))


@query("SELECT DISTINCT id, round(pow(0.5, greatest(epoch_us(TIMESTAMP '2026-01-01') - epoch_us(created_at), 0) / 86400000000.0 / 30) * (1 + ln(1 + access_count)), 6) AS s FROM atoms")
def evolve(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, d, "atoms").select("id", F.round(memory.evolve_score(F.col("created_at"), F.col("access_count"), now), 6).alias("s")).distinct()
