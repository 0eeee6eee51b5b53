"""Scans, joins, aggregates, windows, sorts, set operations, subqueries, CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import scalar as S
from tidewell.operators import relational as R
from tidewell.operators.ranges import number_rows, ranked, sliding
from tidewell.plans.registry import query, sql
from tidewell.session import configure, join_shuffled, table

# Flagship.
sql(
    "revenue_by_nation",
    """SELECT n_name, CAST(count(*) AS BIGINT) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE l_returnflag <> 'R' GROUP BY n_name HAVING count(*) > 1 ORDER BY revenue DESC, n_name LIMIT 20""",
)

# Scans, projections, predicates.
sql("scan_all", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem")
sql("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
sql("range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
sql("index_range", "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey = 7 AND l_quantity > 20 AND l_quantity <= 40")
sql("partial_index", "SELECT id, text_content FROM atoms WHERE expires_at IS NOT NULL AND immutable = 0")
sql("expression_index", "SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) = 'building'")
sql("count_star", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
sql("no_from", "SELECT 1 + 2 AS three, 'a' || 'b' AS ab, CAST(NULL AS BIGINT) AS nothing")
sql("project_exprs", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_quantity AS neg, l_quantity + 1 AS q1, NOT (l_returnflag = 'A') AS not_a FROM lineitem")
sql("three_valued", "SELECT id, (score > 1 AND region_id = 1) AS a, (score > 1 OR region_id = 1) AS o, (score IS NULL) AS n FROM atoms")
sql("typed_literals", "SELECT o_orderkey, o_orderdate >= DATE '1995-01-01' AS d, o_orderdate < TIMESTAMP '1996-01-01 12:00:00' AS t, CAST(DATE '1995-01-31' + INTERVAL '1' MONTH AS DATE) AS i FROM orders")
sql("filter_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
sql("filter_between", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.04 AND l_quantity NOT BETWEEN 10 AND 20")
sql("case_when", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS s, CASE WHEN o_totalprice > 200000 THEN 2 WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS band FROM orders")
@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%' AND p_type NOT ILIKE 'std%'")
def filter_like_ci(spark: SparkSession, d: str) -> DataFrame:
    """LIKE without ASCII case."""
    configure(spark)
    return table(spark, d, "part").where(S.like(F.col("p_name"), "%A%") & ~S.like(F.col("p_type"), "std%")).select("p_partkey", "p_name")


@query("SELECT id, coalesce(score, confidence, 0.0) AS c, nullif(kind, 'fact') AS k, CASE WHEN access_count > 3 THEN 'hot' ELSE 'cold' END AS heat FROM atoms")
def coalesce_nullif_iif(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    c = F.col
    return table(spark, d, "atoms").select("id", F.coalesce(c("score"), c("confidence"), F.lit(0.0)).alias("c"), F.nullif(c("kind"), F.lit("fact")).alias("k"), S.iif(c("access_count") > 3, F.lit("hot"), F.lit("cold")).alias("heat"))


@query("SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY lower(lang) NULLS FIRST, doc_id) AS BIGINT) AS pos FROM documents")
def collate_nocase_sort(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    rows = table(spark, d, "documents").select("doc_id", "lang").withColumn("__k", S.collate(F.col("lang"), "nocase"))
    return number_rows(rows, [F.col("__k").asc_nulls_first(), F.col("doc_id")], "pos").select("doc_id", "lang", "pos")


@query("SELECT lower(kind) AS kind, count(*) AS n, rtrim('a  ') = 'a' AS same FROM atom_inputs GROUP BY lower(kind)")
def collate_group(spark: SparkSession, d: str) -> DataFrame:
    """GROUP BY under NOCASE and a comparison under RTRIM."""
    configure(spark)
    rows = table(spark, d, "atom_inputs").groupBy(S.collate(F.col("kind"), "nocase").alias("kind")).agg(F.count("*").alias("n"))
    return rows.select("kind", "n", (S.collate(F.lit("a  "), "rtrim") == S.collate(F.lit("a"), "rtrim")).alias("same"))


@query("SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS any_, o_orderkey > 7 AND o_orderkey > 9 AS all_, o_totalprice > 1000 OR o_totalprice > 90000 AS above, o_orderkey <> 3 AND o_orderkey <> 4 AS none_ FROM orders")
def any_array(spark: SparkSession, d: str) -> DataFrame:
    """Comparison with ANY and ALL of an array."""
    configure(spark)
    c = F.col
    return table(spark, d, "orders").select(
        "o_orderkey", R.any_of(c("o_orderstatus"), "=", F.array(F.lit("F"), F.lit("P"))).alias("any_"), R.all_of(c("o_orderkey"), ">", F.array(F.lit(7), F.lit(9))).alias("all_"),
        R.any_of(c("o_totalprice"), ">", F.array(F.lit(1000.0), F.lit(90000.0))).alias("above"), R.all_of(c("o_orderkey"), "<>", F.array(F.lit(3), F.lit(4))).alias("none_"),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42 AND o_totalprice > 50000")
def parameters(spark: SparkSession, d: str) -> DataFrame:
    """Positional parameters of a prepared statement."""
    from tidewell.sources.catalog import Catalog

    configure(spark)
    cat = Catalog(spark)
    cat.create("orders", table(spark, d, "orders"))
    return cat.prepare("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = $1 AND o_totalprice > $2")(42, 50000)


sql("distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")

# Joins.
sql("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000")
sql("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 250000")
sql("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL OUTER JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON s_suppkey = c_custkey")
sql("join_cross", "SELECT a.r_name AS x, b.n_name AS y FROM region a CROSS JOIN nation b")
sql("join_theta", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_acctbal > n_nationkey * 500 AND s_suppkey < n_nationkey * 3")
sql("join_residual", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_quantity > 45")
sql("join_multiway", "SELECT r_name, CAST(count(*) AS BIGINT) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey JOIN lineitem ON s_suppkey = l_suppkey GROUP BY r_name")
sql("join_null_keys", "SELECT f.atom_id, r.name FROM forgotten_atoms f LEFT JOIN memory_regions r ON f.region_id = r.id")
sql("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
sql("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 20)")
sql("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30)")
def anti_not_in(spark: SparkSession, d: str) -> DataFrame:
    """Spark's own NOT IN sends the subquery through the driver, whatever its size."""
    configure(spark)
    lines = table(spark, d, "lineitem").where("l_quantity > 30")
    return R.compare_all(table(spark, d, "part").select("p_partkey"), "p_partkey", "<>", lines, "l_partkey")


sql("anti_not_in_null", "SELECT s_suppkey, s_suppkey IN (SELECT c_custkey FROM customer WHERE c_custkey < 50) AS known FROM supplier WHERE s_nationkey NOT IN (SELECT CASE WHEN n_nationkey < 20 THEN n_nationkey END FROM nation WHERE n_regionkey < 2) OR s_suppkey < 5")


@query("SELECT 'add' AS op, true AS refused UNION ALL SELECT 'multiply', true UNION ALL SELECT 'abs', true UNION ALL SELECT 'zero', true")
def arith_overflow(spark: SparkSession, d: str) -> DataFrame:
    """Integers beyond 64 bits and division by zero are errors."""
    configure(spark)
    most, least = F.lit(2**63 - 1).cast("long"), F.lit(-(2**63)).cast("long")
    out = []
    for op, c in (("add", most + F.lit(1).cast("long")), ("multiply", most * F.lit(2).cast("long")), ("abs", S.abs_(least)), ("zero", S.div(F.lit(1).cast("long"), F.lit(0).cast("long")))):
        try:
            table(spark, d, "region").select(c.alias("x")).collect()
            out.append((op, False))
        except Exception as e:  # noqa: BLE001
            out.append((op, "overflow" in str(e).lower() or "zero" in str(e).lower()))
    return spark.createDataFrame(out, "op string, refused boolean")


@query("SELECT c_custkey, hex(encode(c_name || c_mktsegment)) AS blob FROM customer")
def concat_blob(spark: SparkSession, d: str) -> DataFrame:
    """``||`` of bytes."""
    configure(spark)
    return table(spark, d, "customer").select("c_custkey", F.hex(F.concat(F.encode("c_name", "UTF-8"), F.encode("c_mktsegment", "UTF-8"))).alias("blob"))


@query("SELECT c_custkey, o_orderkey, o_totalprice, CAST(rn AS INTEGER) AS rn FROM customer JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) ON c_custkey = o_custkey WHERE rn <= 3")
def lateral_topk(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return R.lateral_top_k(c, o, c["c_custkey"] == o["o_custkey"], "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3, "rn").select("c_custkey", "o_orderkey", "o_totalprice", "rn")


sql(
    "lateral_left",
    "SELECT c_custkey, big.n, big.total FROM customer c LEFT JOIN LATERAL (SELECT CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) big ON true",
)


@query("SELECT c_custkey, o.o_orderkey, o.share FROM customer c, LATERAL (SELECT o_orderkey, o_totalprice / (c.c_acctbal + 20000) AS share FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > c.c_acctbal * 40) o")
def lateral_comma(spark: SparkSession, d: str) -> DataFrame:
    """As a join on the key; Spark pairs every order with every balance that the LATERAL names."""
    configure(spark)
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    both = join_shuffled(c, o, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal") * 40))
    base = F.col("c_acctbal") + 20000
    # A zero divisor gives infinity or NaN as in the SQL, not an error.
    share = F.when(base == 0, F.col("o_totalprice") * F.lit(float("inf"))).otherwise(F.col("o_totalprice") / base)
    return both.select("c_custkey", "o_orderkey", share.alias("share"))


# Aggregates.
sql("agg_global", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(l_returnflag) AS BIGINT) AS nf, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_shipdate) AS lo, max(l_shipdate) AS hi, CAST(sum(l_linenumber) AS BIGINT) AS ln FROM lineitem")
sql("agg_groupby", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev, round(avg(l_quantity), 6) AS aq FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("agg_distinct", "SELECT o_orderpriority, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderpriority")
sql("agg_having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND avg(o_totalprice) > 100000")
sql("agg_filter", "SELECT o_orderstatus, CAST(count(*) FILTER (WHERE o_totalprice > 200000) AS BIGINT) AS big, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent FROM orders GROUP BY o_orderstatus")
sql("agg_ordered", "SELECT o_custkey, array_join(transform(array_sort(collect_list(struct(o_totalprice AS p, o_orderkey AS k))), x -> CAST(x.k AS STRING)), ',') AS ks FROM orders GROUP BY o_custkey", "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_totalprice, o_orderkey) AS ks FROM orders GROUP BY o_custkey")
sql("agg_expr_key", "SELECT o_orderkey % 7 AS k, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderkey % 7")
sql("agg_date_trunc", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP_NTZ) AS m, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1", "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, count(*) AS n FROM orders GROUP BY 1")
sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)")

# Windows.
_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey)"
sql("row_number", f"SELECT o_orderkey, CAST(row_number() {_W} AS BIGINT) AS rn FROM orders")
@query("SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS r FROM orders")
def rank(spark: SparkSession, d: str) -> DataFrame:
    """Few and large groups: ranks by ranges."""
    configure(spark)
    return ranked(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus"], "o_orderpriority", "r", "dense").select("o_orderkey", "r")


@query("SELECT o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS r FROM orders")
def dense_rank(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return ranked(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus"], "o_orderpriority", "rank", "r").select("o_orderkey", "r")


@query("SELECT event_id, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)")
def win_minmax_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Few and large groups: frames in blocks."""
    configure(spark)
    rows = table(spark, d, "events").select("event_id", "event_type", "ts", "value")
    return sliding(rows, ["event_type"], [F.col("ts"), F.col("event_id")], 5, 5, {"lo": F.min("value"), "hi": F.max("value")}).select("event_id", "lo", "hi")


sql("ntile", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS q FROM customer")
sql("lag_lead", f"SELECT o_orderkey, lag(o_totalprice) {_W} AS before, lead(o_totalprice, 2, 0.0) {_W} AS after2 FROM orders")
sql("first_last_value", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)")
sql("win_sum_rows", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS s, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events")
sql("win_avg_range", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 7.3, 3) AS a FROM orders")
sql("win_whole_partition", "SELECT c_custkey, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey), 2) AS s, CAST(count(*) OVER (PARTITION BY c_nationkey) AS BIGINT) AS n FROM customer")
sql("win_over_agg", "SELECT c_nationkey, n, CAST(rank() OVER (ORDER BY n DESC) AS BIGINT) AS r FROM (SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_nationkey) x")

# Sort, limit, set operations.
sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql("limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20 OFFSET 40")
@query("SELECT id, CAST(row_number() OVER (ORDER BY expires_at ASC NULLS FIRST, id) AS BIGINT) AS a, CAST(row_number() OVER (ORDER BY expires_at DESC NULLS LAST, id) AS BIGINT) AS b FROM (SELECT DISTINCT id, expires_at FROM atoms) x")
def nulls_placement(spark: SparkSession, d: str) -> DataFrame:
    """Places in two global orders, by ranges of the order."""
    configure(spark)
    rows = table(spark, d, "atoms").select("id", "expires_at").distinct()
    a = number_rows(rows, [F.col("expires_at").asc_nulls_first(), F.col("id")], "a")
    return number_rows(a, [F.col("expires_at").desc_nulls_last(), F.col("id")], "b").select("id", "a", "b")


sql("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
sql("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql("except", "SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
sql("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql("compound_order_limit", "SELECT k FROM (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier) x ORDER BY k DESC LIMIT 15")

# Subqueries and CTEs.
sql("scalar_corr", "SELECT c_custkey, (SELECT CAST(count(*) AS BIGINT) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS m FROM customer c")
sql("scalar_uncorr", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
sql("correlated_in", "SELECT c_custkey FROM customer c WHERE c_nationkey IN (SELECT s_nationkey FROM supplier s WHERE s.s_acctbal > c.c_acctbal * 1.2)")
sql("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 1500000) SELECT c_name, round(t, 2) AS t FROM top JOIN customer ON c_custkey = o_custkey")
sql("recursive_series", "WITH RECURSIVE s(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f + n FROM s WHERE n < 60) SELECT n, f FROM s")


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey")
def view(spark: SparkSession, d: str) -> DataFrame:
    """CREATE VIEW, read, DROP VIEW."""
    from tidewell.sources.catalog import Catalog

    configure(spark)
    cat = Catalog(spark)
    cat.create("customer", table(spark, d, "customer"))
    cat.create_view("rich", "SELECT * FROM customer WHERE c_acctbal > 0")
    out = cat.execute("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM rich GROUP BY c_nationkey")
    cat.drop_view("rich")
    return out


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F')")
def all_subquery(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    o = table(spark, d, "orders")
    return R.compare_all(o, "o_totalprice", ">=", o.where("o_orderstatus = 'F'"), "o_totalprice").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal < ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey = 3)")
def any_subquery(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return R.compare_any(c, "c_acctbal", "<", s.where("s_nationkey = 3"), "s_acctbal").select("c_custkey")


@query("WITH RECURSIVE w(id) AS (SELECT DISTINCT dst_id FROM memory_edges WHERE src_id % 50 = 0 UNION SELECT e.dst_id FROM w JOIN memory_edges e ON e.src_id = w.id AND e.kind IN ('derived_from', 'supersedes')) SELECT id FROM w")
def recursive_union_graph(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    e = table(spark, d, "memory_edges")
    steps = e.where(F.col("kind").isin("derived_from", "supersedes")).select("src_id", F.col("dst_id").alias("next"))
    seed = e.where("src_id % 50 = 0").select(F.col("dst_id").alias("id"))
    return R.recursive_union(seed, lambda new: new.join(steps, F.col("id") == F.col("src_id")).select(F.col("next").alias("id")))
