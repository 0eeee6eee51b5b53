"""Full-text search over stored postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import fts
from tidewell.plans.registry import query
from tidewell.session import configure, table

_INDEXES: dict[tuple[str, str, str], fts.Index] = {}


def index(spark: SparkSession, d: str, config: str) -> fts.Index:
    """The postings of ``documents``, made once for a session and folder, as CREATE INDEX would."""
    configure(spark)
    at = (spark.sparkContext.applicationId, d, config)
    if at not in _INDEXES:
        _INDEXES[at] = fts.build_index(table(spark, d, "documents"), "doc_id", "text", config)
    return _INDEXES[at]


_WORD = "[\\p{L}\\p{N}]+(?:['’.][\\p{L}]+)*"
#: Words of each document, in order.
_T = f"(SELECT doc_id, text, regexp_extract_all(lower(text), '{_WORD.replace(chr(39), chr(39) * 2)}') AS w FROM documents WHERE text IS NOT NULL)"
_LEN = "length(list_filter(w, lambda z: z = '{0}'))"


def _tf(word: str) -> str:
    return f"len(list_filter(w, lambda z: z = '{word}'))"


def _any(*words: str) -> str:
    """Whether a document has one of the words (all forms of one stem)."""
    return f"list_has_any(w, {list(words)})"


@query(f"SELECT doc_id FROM {_T} WHERE {_any('recipe', 'recipes')} AND ({_any('oven', 'ovens')} OR {_any('onion', 'onions')}) AND NOT {_any('court', 'courts')}")
def fts_match(spark: SparkSession, d: str) -> DataFrame:
    return fts.search(index(spark, d, "english"), fts.to_tsquery("recipes & (oven | onions) & !courts")).select(F.col("k").alias("doc_id"))


@query(f"SELECT doc_id FROM {_T} WHERE NOT {_any('court', 'courts')} OR {_any('verdict', 'verdicts')}")
def fts_not(spark: SparkSession, d: str) -> DataFrame:
    """A query that documents without any of its words match."""
    return fts.search(index(spark, d, "english"), fts.to_tsquery("!court | verdict")).select(F.col("k").alias("doc_id"))


@query(f"SELECT doc_id FROM {_T} WHERE ({_any('verdict')} AND NOT {_any('bail')}) OR len(list_filter(range(1, len(w)), lambda i: w[i] = 'criminal' AND w[i + 1] = 'court')) > 0")
def fts_websearch(spark: SparkSession, d: str) -> DataFrame:
    """Words, a quoted phrase, ``or`` and a minus."""
    return fts.search(index(spark, d, "simple"), fts.websearch_to_tsquery('verdict -bail or "criminal court"', "simple")).select(F.col("k").alias("doc_id"))


_PHRASE = "len(list_filter(range(1, len(w)), lambda i: w[i] = 'criminal' AND w[i + 1] = 'court')) > 0"


@query(f"SELECT doc_id FROM {_T} WHERE {_PHRASE}")
def fts_phrase(spark: SparkSession, d: str) -> DataFrame:
    return fts.search(index(spark, d, "simple"), fts.phraseto_tsquery("criminal court", "simple")).select(F.col("k").alias("doc_id"))


@query(f"SELECT count(*) AS n FROM {_T} WHERE {_PHRASE}")
def fts_count_phrase(spark: SparkSession, d: str) -> DataFrame:
    """COUNT(*) of a phrase, from the postings alone."""
    return fts.search_count(index(spark, d, "simple"), fts.phraseto_tsquery("criminal court", "simple"))


@query(f"SELECT count(*) AS n FROM {_T} WHERE {_any('verdict')} AND {_any('bail')}")
def fts_count(spark: SparkSession, d: str) -> DataFrame:
    return fts.search_count(index(spark, d, "simple"), fts.plainto_tsquery("verdict bail", "simple"))


@query(f"SELECT doc_id FROM {_T} WHERE len(list_filter(w, lambda z: starts_with(z, 'telesc'))) > 0")
def fts_prefix(spark: SparkSession, d: str) -> DataFrame:
    return fts.search(index(spark, d, "simple"), fts.to_tsquery("telesc:*", "simple")).select(F.col("k").alias("doc_id"))


_R = "(CASE WHEN {0} > 0 THEN 0.1 * {0} * (1 + ln(1.0 + {0})) ELSE 0 END)"


def _rank(*words: str) -> str:
    return " + ".join(_R.format(_tf(x)) for x in words)


@query(
    f"""SELECT doc_id, round(r / CASE WHEN n > 1 THEN 1 + ln(n) ELSE 1 END, 6) AS rank FROM (
    SELECT doc_id, {_rank('verdict', 'judge')} AS r, len(w) AS n FROM {_T} WHERE ({_any('verdict')} OR {_any('judge')}) AND NOT {_any('bail')})
    ORDER BY r / CASE WHEN n > 1 THEN 1 + ln(n) ELSE 1 END DESC, doc_id LIMIT 50"""
)
def fts_rank(spark: SparkSession, d: str) -> DataFrame:
    """Top-k by rank, normed by length."""
    q = fts.to_tsquery("(verdict | judge) & !bail", "simple")
    return fts.search_ranked(index(spark, d, "simple"), q, 50, norm=1).select(F.col("k").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query(
    f"""SELECT doc_id, round(r / n, 9) AS by_length, round(r / u, 9) AS by_words, round(r / CASE WHEN u > 1 THEN 1 + ln(u) ELSE 1 END, 9) AS by_log, round(r / (r + 1), 9) AS scaled
    FROM (SELECT doc_id, {_rank('verdict')} AS r, len(w) AS n, len(list_distinct(w)) AS u FROM {_T} WHERE {_any('verdict')})"""
)
def fts_rank_norms(spark: SparkSession, d: str) -> DataFrame:
    """The norm bits 2, 8, 16 and 32."""
    q = fts.to_tsquery("verdict", "simple")
    found = fts.search(index(spark, d, "simple"), q, sizes=True)
    by = lambda bit: F.round(fts.ts_rank(F.col("v"), q, bit, (F.col("n"), F.col("u"))), 9)
    return found.select(F.col("k").alias("doc_id"), by(2).alias("by_length"), by(8).alias("by_words"), by(16).alias("by_log"), by(32).alias("scaled"))


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'judge') AS a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'verdict') AS b FROM {_T} WHERE {_any('judge')} AND {_any('verdict')}),
    e AS (SELECT doc_id, unnest(a) AS pos, 0 AS t FROM p UNION ALL SELECT doc_id, unnest(b), 1 FROM p),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n,
        max(CASE WHEN t = 0 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS la,
        max(CASE WHEN t = 1 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS lb FROM e),
    c AS (SELECT doc_id, n, pos, CASE WHEN la IS NULL OR lb IS NULL THEN NULL ELSE least(la, lb) END AS s FROM o),
    g AS (SELECT *, max(s) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c),
    x AS (SELECT g.doc_id, g.n, g.pos, f.n AS fn, f.pos AS fpos FROM g JOIN o f ON f.doc_id = g.doc_id AND f.pos <= g.s AND (g.prev IS NULL OR f.pos > g.prev) WHERE g.s IS NOT NULL)
    SELECT doc_id, round(max(0.1 * (n - fn + 1) / (pos - fpos + 1)), 6) AS rank FROM x GROUP BY doc_id"""
)
def fts_rank_cd(spark: SparkSession, d: str) -> DataFrame:
    """Best window with all words of the query."""
    q = fts.plainto_tsquery("judge verdict", "simple")
    found = fts.search(index(spark, d, "simple"), q)
    return found.select(F.col("k").alias("doc_id"), F.round(fts.ts_rank_cd(F.col("v"), q), 6).alias("rank"))


_HA, _HD = "len(list_filter(s, lambda z: z = 'harbor'))", _tf("harbor")


@query(
    f"""SELECT doc_id, round(({_HA} * 1.0 + {_HD} * 0.1) * (1 + ln(1.0 + {_HA} + {_HD})), 6) AS rank, {_HA} > 0 AS titled FROM (
    SELECT doc_id, w, regexp_extract_all(lower(coalesce(source, '')), '{_WORD.replace(chr(39), chr(39) * 2)}') AS s FROM {_T} JOIN (SELECT doc_id, source FROM documents) USING (doc_id)) WHERE {_HA} + {_HD} > 0"""
)
def fts_weights(spark: SparkSession, d: str) -> DataFrame:
    """SETWEIGHT and ``||``: the source with weight A, the text with D."""
    configure(spark)
    both = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", fts.to_tsvector(F.coalesce("source", F.lit("")), "simple").alias("s"), fts.to_tsvector(F.col("text"), "simple").alias("t"))
    rows = both.select("doc_id", fts.concat(fts.setweight(F.col("s"), "A"), F.col("t")).alias("v"))
    q = fts.to_tsquery("harbor", "simple")
    return rows.where(fts.match(F.col("v"), q)).select("doc_id", F.round(fts.ts_rank(F.col("v"), q), 6).alias("rank"), fts.match(F.col("v"), fts.to_tsquery("harbor:A", "simple")).alias("titled"))


@query("SELECT item_id, regexp_replace(text, '(?i)\\b(court|judge|verdict)\\b', '<b>\\1</b>', 'g') AS headline FROM benchmark WHERE text IS NOT NULL")
def fts_headline(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    q = fts.to_tsquery("court | judge | verdict", "simple")
    return table(spark, d, "benchmark").where("text IS NOT NULL").select("item_id", fts.ts_headline(F.col("text"), q, "simple").alias("headline"))


@query("SELECT * FROM (VALUES ('running', 'run'), ('caresses', 'caress'), ('ponies', 'poni'), ('national', 'nation'), ('hopping', 'hop'), ('relational', 'relat'), ('the', NULL), ('agreed', 'agre')) t(word, lexeme)")
def fts_lexize(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    words = spark.createDataFrame([(w,) for w in "running caresses ponies national hopping relational the agreed".split()], "word string")
    return words.select("word", fts.ts_lexize(F.col("word")).alias("lexeme"))


@query(f"SELECT doc_id, CAST(len(list_distinct(w)) AS BIGINT) AS n_lexemes, CAST(0 AS BIGINT) AS n_found, CAST(5 AS INTEGER) AS nodes FROM {_T}")
def fts_strip(spark: SparkSession, d: str) -> DataFrame:
    """LENGTH, STRIP (nothing is found without positions) and NUMNODE."""
    configure(spark)
    v = fts.to_tsvector(F.col("text"), "simple")
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", v.alias("v"))
    found = fts.match(fts.strip(F.col("v")), fts.to_tsquery("the", "simple"))
    return rows.select("doc_id", fts.length(F.col("v")).alias("n_lexemes"), found.cast("long").alias("n_found"), F.lit(fts.numnode(fts.to_tsquery("a & (b | !c)", "simple")) - 1).alias("nodes"))
