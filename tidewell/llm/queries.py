"""Registered queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import fusion_rank, knn, leaks, neardup, packing, pii, subjects, topn
from tidewell.session import configure, join_checked, join_shuffled, materialise, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_ranked(spark, d).select("region_id", "atom_id")


def p1_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Place and score too."""
    configure(spark)
    top = topn.top_n_per_group(table(spark, d, "atoms").select("region_id", "score", "id"), "region_id", "score", "id", 10)
    return top.withColumnRenamed("id", "atom_id").withColumnRenamed("rank", "place")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "atoms").select(F.lit("atoms").alias("tbl"), F.col("id").alias("row_id"), F.col("text_content").alias("text"))
    i = table(spark, d, "atom_inputs").select(F.lit("atom_inputs").alias("tbl"), F.col("input_id").alias("row_id"), "text")
    return a.unionByName(i)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    a = pii.find_pii(table(spark, d, "atoms"), "id", "text_content").select(F.lit("atoms").alias("tbl"), F.col("id").alias("row_id"), "pii_type", "start_pos")
    i = pii.find_pii(table(spark, d, "atom_inputs"), "input_id", "text").select(F.lit("atom_inputs").alias("tbl"), F.col("input_id").alias("row_id"), "pii_type", "start_pos")
    return a.unionByName(i)


def p2_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders."""
    configure(spark)
    rows, key = _texts(spark, d), ["tbl", "row_id"]
    # Only texts whose id occurs more than once are shuffled to drop the repeated ones.
    twice = materialise(rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "repeated")
    once = join_checked(rows, twice, key, "left_anti").unionByName(join_checked(rows, twice, key, "left_semi").dropDuplicates(key))
    return pii.mask_pii(once, "text", "masked").select(*key, "masked")


def _ranking(spark: SparkSession, d: str, top: int | None) -> DataFrame:
    configure(spark)
    scores = fusion_rank.recall_signals(table(spark, d, "recall_candidates"))
    weights = fusion_rank.recall_weights(table(spark, d, "recall_queries"))
    return fusion_rank.median_rank(scores, "query_id", "atom_id", list(fusion_rank.DEFAULT_WEIGHTS), weights, top)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d, 3).select("query_id", "atom_id")


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The whole ranking of every query."""
    return _ranking(spark, d, None).select("query_id", "atom_id", F.round("median_rank", 6).alias("median_rank"), F.round("mean_rank", 6).alias("mean_rank"), F.col("place").cast("long").alias("place"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    near = knn.nearest(table(spark, d, "atoms"), table(spark, d, "memory_regions"), 5)
    return knn.pairs(near).select(F.col("a").alias("atom_a"), F.col("b").alias("atom_b"))


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of the atoms whose id is divisible by 50, searched among all."""
    configure(spark)
    near = knn.nearest(table(spark, d, "atoms"), table(spark, d, "memory_regions"), 5)
    return near.where("id % 50 = 0").select(F.col("region").alias("region_id"), F.col("id").alias("atom_id"), F.col("near").alias("near_id"), F.round("distance", 6).alias("distance"))


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    configure(spark)
    return neardup.near_duplicates(table(spark, d, "atom_inputs"), "input_id", ["text", "payload"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    links, members = _near(spark, d)
    return neardup.expand(links, members).select(F.col("a").alias("input_a"), F.col("b").alias("input_b"))


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """Every input with words and the smallest input of the same text and payload; copies have the pairs of it."""
    configure(spark)
    copies = neardup.bags(table(spark, d, "atom_inputs"), "input_id", ["text", "payload"]).select("copy", "k").distinct()
    lead = copies.groupBy("copy").agg(F.min("k").alias("representative"))
    return join_shuffled(copies, lead, "copy").select(F.col("k").alias("input_id"), "representative").distinct()


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Group and number of links of every input with words."""
    links, members = _near(spark, d)
    return neardup.groups(links, members).select(F.col("k").alias("input_id"), "group_id", F.col("n_links").cast("long").alias("n_links"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return packing.pack(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_matches(spark, d).select("doc_id", "item_id").distinct()


def p8_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every longest verbatim match and its place."""
    configure(spark)
    return leaks.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents without the affected ones."""
    return leaks.remove_leaked(table(spark, d, "documents"), p8_matches(spark, d)).select("doc_id", "lang", "source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return subjects.subjects(table(spark, d, "documents")).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sentences of each subject."""
    configure(spark)
    return subjects.subjects(table(spark, d, "documents")).groupBy("subject").agg(F.count("*").alias("n_docs"), F.sum("n_sentences").alias("n_sentences"))


QUERIES = {f.__name__: f for f in (p1_found, p1_ranked, p2_found, p2_masked, p3_found, p3_ranking, p5_found, p5_neighbours, p6_found, p6_members, p6_groups, p7_containers, p8_found, p8_matches, p8_clean, p9_found, p9_composition)}

_TOP = """
SELECT region_id, id AS atom_id, score, CAST(place AS INTEGER) AS place FROM (
  SELECT region_id, id, score, row_number() OVER (PARTITION BY region_id ORDER BY score DESC, id) AS place
  FROM (SELECT DISTINCT region_id, id, score FROM atoms WHERE score IS NOT NULL AND NOT isnan(score)))
WHERE place <= 10"""

_RANKS = """
WITH c AS (SELECT DISTINCT query_id, atom_id,
    CASE WHEN dist IS NULL OR isnan(dist) OR isinf(dist) OR dist >= 9999 THEN '-infinity'::DOUBLE ELSE -dist END AS v0,
    CASE WHEN text_rank IS NULL OR isnan(text_rank) OR isinf(text_rank) OR text_rank < 0 THEN '-infinity'::DOUBLE ELSE text_rank END AS v1,
    CASE WHEN created_micros IS NULL OR created_micros <= 0 THEN '-infinity'::DOUBLE
         WHEN created_micros < 1e11 THEN created_micros * 1e6 WHEN created_micros < 1e14 THEN created_micros * 1e3 ELSE created_micros END AS v2,
    CASE WHEN importance IS NULL OR isnan(importance) OR isinf(importance) OR importance < 0 THEN '-infinity'::DOUBLE ELSE importance END AS v3
  FROM recall_candidates),
w AS (SELECT DISTINCT query_id,
    CASE WHEN coalesce(semantic, keyword, recency, importance) IS NULL THEN 0.45 ELSE coalesce(semantic, 0) END AS w0,
    CASE WHEN coalesce(semantic, keyword, recency, importance) IS NULL THEN 0.2 ELSE coalesce(keyword, 0) END AS w1,
    CASE WHEN coalesce(semantic, keyword, recency, importance) IS NULL THEN 0.2 ELSE coalesce(recency, 0) END AS w2,
    CASE WHEN coalesce(semantic, keyword, recency, importance) IS NULL THEN 0.15 ELSE coalesce(importance, 0) END AS w3
  FROM recall_queries),
r AS (SELECT query_id, atom_id,
    rank() OVER (PARTITION BY query_id ORDER BY v0 DESC) + (count(*) OVER (PARTITION BY query_id, v0) - 1) / 2.0 AS r0,
    rank() OVER (PARTITION BY query_id ORDER BY v1 DESC) + (count(*) OVER (PARTITION BY query_id, v1) - 1) / 2.0 AS r1,
    rank() OVER (PARTITION BY query_id ORDER BY v2 DESC) + (count(*) OVER (PARTITION BY query_id, v2) - 1) / 2.0 AS r2,
    rank() OVER (PARTITION BY query_id ORDER BY v3 DESC) + (count(*) OVER (PARTITION BY query_id, v3) - 1) / 2.0 AS r3 FROM c),
x AS (SELECT r.*, coalesce(w0, 1) AS w0, coalesce(w1, 1) AS w1, coalesce(w2, 1) AS w2, coalesce(w3, 1) AS w3 FROM r LEFT JOIN w USING (query_id)),
l AS (SELECT query_id, atom_id, r0 AS r, w0 AS w, 0 AS s FROM x UNION ALL SELECT query_id, atom_id, r1, w1, 1 FROM x
  UNION ALL SELECT query_id, atom_id, r2, w2, 2 FROM x UNION ALL SELECT query_id, atom_id, r3, w3, 3 FROM x),
u AS (SELECT *, sum(w) OVER (PARTITION BY query_id, atom_id ORDER BY r, w, s ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY query_id, atom_id) AS total FROM l),
m AS (SELECT query_id, atom_id, min(CASE WHEN upto >= total / 2 - 1e-9 AND w > 0 THEN r END) AS median_rank, round(sum(r * w) / sum(w), 9) AS mean_rank FROM u GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY median_rank, mean_rank, atom_id) AS place FROM m)"""

_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"

ORACLES = {
    "p1_found": f"SELECT region_id, atom_id FROM ({_TOP})",
    "p1_ranked": _TOP,
    "p3_found": f"{_RANKS} SELECT query_id, atom_id FROM o WHERE place <= 3",
    "p3_ranking": f"{_RANKS} SELECT query_id, atom_id, round(median_rank, 6) AS median_rank, round(mean_rank, 6) AS mean_rank, place FROM o",
    "p8_found": f"""
WITH d AS (SELECT DISTINCT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d WHERE len(w) >= 12)),
b AS (SELECT DISTINCT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM b WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)""",
}
ORACLES["p8_clean"] = f"SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({ORACLES['p8_found']}))"

_D = "d AS (SELECT DISTINCT doc_id, {w} AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT DISTINCT item_id, {v} AS w FROM benchmark WHERE text IS NOT NULL)".format(w=_WORDS.format("text"), v=_WORDS.format("text"))
ORACLES["p8_matches"] = f"""
WITH f AS ({ORACLES['p8_found']}), {_D},
dw AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM f)),
bw AS (SELECT item_id, unnest(w) AS x, unnest(range(0, len(w))) AS j FROM b WHERE item_id IN (SELECT item_id FROM f)),
m AS (SELECT doc_id, item_id, i, j, i - j AS g, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM f JOIN dw USING (doc_id) JOIN bw USING (item_id) WHERE dw.x = bw.x)
SELECT doc_id, item_id, count(*) AS n_words, CAST(min(i) AS BIGINT) AS doc_word, CAST(min(j) AS BIGINT) AS item_word FROM m GROUP BY doc_id, item_id, g, run HAVING count(*) >= 12"""

# The exact answers, which the hashed and sampled searches are compared with.
_NEAR = """
WITH u AS (SELECT DISTINCT a.region_id, a.id, CAST(a.embedding AS DOUBLE[]) AS v, r.embedding_metric AS metric FROM atoms a JOIN memory_regions r ON a.region_id = r.id
    WHERE len(a.embedding) = r.embedding_dim AND len(list_filter(a.embedding, lambda z: z IS NULL OR isnan(z))) = 0 AND len(list_filter(a.embedding, lambda z: z <> 0)) > 0),
p AS (SELECT a.region_id, a.id, b.id AS near, CASE a.metric WHEN 'l2' THEN list_distance(a.v, b.v) WHEN 'inner' THEN -list_inner_product(a.v, b.v) ELSE list_cosine_distance(a.v, b.v) END AS dist
    FROM u a JOIN u b ON a.region_id = b.region_id AND a.id <> b.id),
n AS (SELECT *, row_number() OVER (PARTITION BY region_id, id ORDER BY round(dist, 12), near) AS r FROM p)"""
ORACLES["p5_found"] = f"{_NEAR} SELECT DISTINCT least(id, near) AS atom_a, greatest(id, near) AS atom_b FROM n WHERE r <= 5"
ORACLES["p5_neighbours"] = f"{_NEAR} SELECT region_id, id AS atom_id, near AS near_id, round(dist, 6) AS distance FROM n WHERE r <= 5 AND id % 50 = 0"

_UNITS = f"""
WITH w AS (SELECT input_id, unnest({_WORDS.format("concat_ws(' ', text, payload)")}) AS x FROM (SELECT DISTINCT input_id, text, payload FROM atom_inputs)),
t AS (SELECT input_id, x, row_number() OVER (PARTITION BY input_id, x) AS m FROM w),
s AS (SELECT input_id, count(*) AS n FROM w GROUP BY input_id)"""
_LINKED = """
c AS (SELECT a.input_id AS input_a, b.input_id AS input_b, count(*) AS shared FROM t a JOIN t b ON a.x = b.x AND a.m = b.m AND a.input_id < b.input_id GROUP BY ALL),
pairs AS (SELECT input_a, input_b FROM c JOIN s p ON p.input_id = input_a JOIN s q ON q.input_id = input_b WHERE shared >= 0.7 * (p.n + q.n - shared) - 1e-9)"""
ORACLES["p6_found"] = f"{_UNITS}, {_LINKED} SELECT input_a, input_b FROM pairs"
ORACLES["p6_members"] = f"""{_UNITS}
SELECT input_id, min(input_id) OVER (PARTITION BY text, payload) AS representative FROM (SELECT DISTINCT input_id, text, payload FROM atom_inputs) JOIN s USING (input_id)"""
ORACLES["p6_groups"] = f"""
WITH RECURSIVE {_UNITS.strip().removeprefix('WITH ')}, {_LINKED},
g AS (SELECT input_id, string_agg(x || '#' || m, ' ' ORDER BY x, m) AS bag FROM t GROUP BY input_id),
k AS (SELECT input_id, min(input_id) OVER (PARTITION BY bag) AS rep FROM g),
e AS (SELECT DISTINCT p.rep AS a, q.rep AS b FROM (SELECT input_a, input_b FROM pairs UNION ALL SELECT input_b, input_a FROM pairs) JOIN k p ON p.input_id = input_a JOIN k q ON q.input_id = input_b WHERE p.rep <> q.rep),
r AS (SELECT DISTINCT rep AS v, rep AS u FROM k UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
o AS (SELECT v, min(u) AS group_id FROM r GROUP BY v), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT input_id, group_id, coalesce(n.n, 0) AS n_links FROM k JOIN o ON o.v = rep LEFT JOIN n ON n.a = rep"""
