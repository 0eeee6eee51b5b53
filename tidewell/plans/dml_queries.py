"""DML transforms, constraints, materialized views, merges and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import dml
from tidewell.plans.registry import query
from tidewell.session import configure, table
from tidewell.sources import sinks
from tidewell.sources.catalog import Catalog, ConstraintError, Constraints, ForeignKey

c = F.col


def _customers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All customers, and a batch of as many with other balances, of which a part has new keys."""
    configure(spark)
    all_ = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return all_, all_.withColumn("c_custkey", c("c_custkey") + 750).withColumn("c_acctbal", c("c_acctbal") + 100)


_T = "(SELECT c_custkey, c_name, c_acctbal FROM customer)"
_S = "(SELECT c_custkey + 750 AS c_custkey, c_name, c_acctbal + 100 AS c_acctbal FROM customer)"


@query(f"SELECT * FROM {_T} UNION ALL SELECT * FROM {_S} WHERE c_acctbal > 1000")
def insert_select(spark: SparkSession, d: str) -> DataFrame:
    t, s = _customers(spark, d)
    return dml.insert(t, s.where("c_acctbal > 1000"))[0]


@query(f"SELECT * FROM {_T} UNION ALL SELECT * FROM {_S} WHERE c_custkey NOT IN (SELECT c_custkey FROM {_T})")
def upsert_do_nothing(spark: SparkSession, d: str) -> DataFrame:
    t, s = _customers(spark, d)
    return dml.upsert_do_nothing(t, s, ["c_custkey"])[0]


@query(f"SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(t.c_name, s.c_name) AS c_name, CASE WHEN t.c_custkey IS NOT NULL AND s.c_custkey IS NOT NULL AND s.c_acctbal > 0 THEN t.c_acctbal + s.c_acctbal ELSE coalesce(t.c_acctbal, s.c_acctbal) END AS c_acctbal FROM {_T} t FULL JOIN {_S} s ON t.c_custkey = s.c_custkey")
def upsert_do_update(spark: SparkSession, d: str) -> DataFrame:
    t, s = _customers(spark, d)
    return dml.upsert_do_update(t, s, ["c_custkey"], {"c_acctbal": lambda old, new: old("c_acctbal") + new("c_acctbal")}, lambda old, new: new("c_acctbal") > 0)[0]


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def update_expr(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return dml.update(table(spark, d, "orders"), {"o_totalprice": c("o_totalprice") * 2}, c("o_totalprice") > 100000)[0].select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice AS before, o_totalprice + 1 AS after FROM orders WHERE o_orderstatus = 'P'")
def update_returning(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    _, r = dml.update(table(spark, d, "orders"), {"o_totalprice": c("o_totalprice") + 1}, c("o_orderstatus") == "P")
    return r.select(c("old.o_orderkey").alias("o_orderkey"), c("old.o_totalprice").alias("before"), c("new.o_totalprice").alias("after"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_totalprice < 50000)")
def delete_where(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return dml.delete(table(spark, d, "orders"), c("o_totalprice") < 50000)[0].select("o_orderkey")


@query("SELECT DISTINCT atom_id, region_id FROM forgotten_atoms WHERE region_id IS NOT NULL AND region_id NOT IN (SELECT id FROM memory_regions)")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return dml.fk_violations(table(spark, d, "forgotten_atoms"), "region_id", table(spark, d, "memory_regions"), "id").select("atom_id", "region_id").distinct()


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def fk_cascade(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    gone = table(spark, d, "customer").where("c_acctbal < 0")
    return dml.fk_on_delete(table(spark, d, "orders"), "o_custkey", gone, "c_custkey").select("o_orderkey")


@query("SELECT DISTINCT id, score FROM atoms WHERE score < 0")
def check_violations(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return dml.check_violations(table(spark, d, "atoms"), c("score") >= 0).select("id", "score").distinct()


def _catalog(spark: SparkSession, d: str, *names: str) -> Catalog:
    configure(spark)
    cat = Catalog(spark)
    for n in names:
        cat.create(n, table(spark, d, n))
    return cat


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END * 2 AS twice FROM customer")
def generated_col(spark: SparkSession, d: str) -> DataFrame:
    """A stored generated column follows an update of what it is made of."""
    cat = _catalog(spark, d)
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    cat.create("account", rows, Constraints(primary_key=("c_custkey",), generated={"twice": ("c_acctbal * 2", True)}))
    cat.update("account", {"c_acctbal": F.lit(0.0)}, c("c_acctbal") < 0)
    return cat.tables["account"]


@query("SELECT c_custkey, c_name, 0.0 AS balance FROM customer")
def insert_defaults(spark: SparkSession, d: str) -> DataFrame:
    """INSERT with a DEFAULT for the missing column, and RETURNING."""
    cat = _catalog(spark, d)
    cat.create("account", spark.createDataFrame([], "c_custkey long, c_name string, balance double"), Constraints(primary_key=("c_custkey",), defaults={"balance": 0.0}))
    return cat.insert("account", table(spark, d, "customer").select("c_custkey", "c_name"))


@query("SELECT 'orders_pkey' AS constraint_name, 'o_orderkey' AS failed UNION ALL SELECT 'check', 'o_totalprice' UNION ALL SELECT 'foreign', 'o_custkey' UNION ALL SELECT 'not_null', 'o_custkey'")
def constraint_errors(spark: SparkSession, d: str) -> DataFrame:
    """Statements that a primary key, CHECK, foreign key and NOT NULL refuse."""
    cat = _catalog(spark, d, "customer")
    rules = Constraints(primary_key=("o_orderkey",), not_null=("o_custkey",), checks={"price": "o_totalprice > 0"}, foreign=[ForeignKey("o_custkey", "customer", "c_custkey")])
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(table(spark, d, "customer").select(c("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")
    cat.create("orders", rows, rules)
    out = []
    for name, column, change in (
        ("orders_pkey", "o_orderkey", {"o_orderkey": F.lit(1).cast("long")}), ("check", "o_totalprice", {"o_totalprice": F.lit(-1.0)}),
        ("foreign", "o_custkey", {"o_custkey": F.lit(-5).cast("long")}), ("not_null", "o_custkey", {"o_custkey": F.lit(None).cast("long")}),
    ):
        try:
            cat.update("orders", change)
        except ConstraintError:
            out.append((name, column))
    return spark.createDataFrame(out, "constraint_name string, failed string")


_GONE = "o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"


@query(f"SELECT o_orderkey, CASE WHEN {_GONE} THEN NULL ELSE o_custkey END AS nulled, CASE WHEN {_GONE} THEN 1 ELSE o_custkey END AS defaulted, true AS refused FROM orders")
def fk_actions(spark: SparkSession, d: str) -> DataFrame:
    """ON DELETE SET NULL, SET DEFAULT and RESTRICT."""
    configure(spark)
    o, gone = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").where("c_acctbal < 0")
    nulled = dml.fk_on_delete(o, "o_custkey", gone, "c_custkey", "set_null").withColumnRenamed("o_custkey", "nulled")
    defaulted = dml.fk_on_delete(o, "o_custkey", gone, "c_custkey", "set_default", 1).withColumnRenamed("o_custkey", "defaulted")
    try:
        dml.fk_on_delete(o, "o_custkey", gone, "c_custkey", "restrict")
        refused = False
    except ValueError:
        refused = True
    return nulled.join(defaulted, "o_orderkey").withColumn("refused", F.lit(refused))


@query("SELECT 'statement' AS at, true AS refused UNION ALL SELECT 'commit', true UNION ALL SELECT 'mended', false")
def fk_deferred(spark: SparkSession, d: str) -> DataFrame:
    """A deferrable key is checked by each statement outside a transaction, at COMMIT inside one."""
    cat = _catalog(spark, d, "region")
    rules = Constraints(primary_key=("n_nationkey",), foreign=[ForeignKey("n_regionkey", "region", "r_regionkey", deferred=True)])
    cat.create("nation", table(spark, d, "nation").select("n_nationkey", "n_regionkey"), rules)
    out = []

    def tried(at: str, change) -> None:
        try:
            change()
            out.append((at, False))
        except ConstraintError:
            out.append((at, True))

    stray = spark.createDataFrame([(900, 77)], "n_nationkey long, n_regionkey long")
    tried("statement", lambda: cat.insert("nation", stray))
    cat.begin()
    cat.insert("nation", stray)
    tried("commit", cat.commit)
    cat.insert("region", spark.createDataFrame([(77, "X")], "r_regionkey long, r_name string"))
    tried("mended", cat.commit)
    return spark.createDataFrame(out, "at string, refused boolean")


@query("SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def trigger_before(spark: SparkSession, d: str) -> DataFrame:
    """BEFORE INSERT row triggers in name order, one with WHEN."""
    cat = _catalog(spark, d)
    cat.create("account", spark.createDataFrame([], "c_custkey long, c_name string, c_acctbal double"))
    cat.create_trigger("account", dml.Trigger("b_floor", "insert", lambda old, new: new.withColumn("c_acctbal", F.lit(0.0)), "before", "row", c("c_acctbal") < 0))
    cat.create_trigger("account", dml.Trigger("a_upper", "insert", lambda old, new: new.withColumn("c_name", F.upper("c_name")), "before", "row"))
    cat.insert("account", table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"))
    return cat.tables["account"]


@query("SELECT o_orderkey, o_totalprice AS before, o_totalprice + 1 AS after, 'row' AS via FROM orders WHERE o_orderstatus = 'P' AND o_totalprice + 1 > 200000 UNION ALL SELECT o_orderkey, o_totalprice, o_totalprice + 1, 'statement' FROM orders WHERE o_orderstatus = 'P'")
def trigger_after(spark: SparkSession, d: str) -> DataFrame:
    """AFTER UPDATE triggers over transition tables: one a statement, one for rows with WHEN."""
    cat = _catalog(spark, d)
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    cat.create("orders", rows)
    log: list[DataFrame] = []

    def note(via: str):
        return lambda old, new: log.append(old.select("o_orderkey", c("o_totalprice").alias("before")).join(new.select("o_orderkey", c("o_totalprice").alias("after")), "o_orderkey").withColumn("via", F.lit(via)))

    cat.create_trigger("orders", dml.Trigger("t1", "update", note("statement")))
    cat.create_trigger("orders", dml.Trigger("t2", "update", note("row"), level="row", when=c("o_totalprice") > 200000))
    cat.update("orders", {"o_totalprice": c("o_totalprice") + 1}, c("o_orderstatus") == "P")
    return log[0].unionByName(log[1])


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS stored FROM customer")
def trigger_instead(spark: SparkSession, d: str) -> DataFrame:
    """INSTEAD OF INSERT takes the rows; the table stays as it is."""
    cat = _catalog(spark, d)
    cat.create("account", spark.createDataFrame([], "c_custkey long"))
    taken: list[DataFrame] = []
    cat.create_trigger("account", dml.Trigger("t", "insert", lambda old, new: taken.append(new), "instead_of", "row"))
    cat.insert("account", table(spark, d, "customer").select("c_custkey"))
    return taken[0].agg(F.count("*").alias("n")).withColumn("stored", F.lit(cat.tables["account"].count()).cast("long"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS gone FROM orders WHERE o_totalprice < 50000 GROUP BY o_orderstatus")
def with_dml(spark: SparkSession, d: str) -> DataFrame:
    """WITH gone AS (DELETE ... RETURNING *) SELECT ... FROM gone."""
    cat = _catalog(spark, d, "orders")
    return cat.with_dml("gone", lambda: cat.delete("orders", c("o_totalprice") < 50000), "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS gone FROM gone GROUP BY o_orderstatus")


@query("SELECT CAST(25 AS BIGINT) AS in_savepoint, CAST(0 AS BIGINT) AS truncated, count(*) AS rolled_back, CAST(25 AS BIGINT) AS view_rows FROM nation")
def transactions(spark: SparkSession, d: str) -> DataFrame:
    """BEGIN, SAVEPOINT, TRUNCATE, ROLLBACK: tables and materialized views come back."""
    cat = _catalog(spark, d, "nation")
    cat.create_matview("names", "SELECT n_nationkey, n_name FROM nation")
    cat.begin()
    cat.delete("nation", c("n_nationkey") >= 25)
    cat.begin("s")
    cat.truncate("nation")
    cat.drop_matview("names")
    empty = cat.tables["nation"].count()
    cat.rollback("s")
    at_savepoint = cat.tables["nation"].count()
    cat.rollback()
    return spark.createDataFrame([(at_savepoint, empty, cat.tables["nation"].count(), cat.execute("SELECT * FROM names").count())], "in_savepoint long, truncated long, rolled_back long, view_rows long")


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY c_nationkey")
def matview_refresh(spark: SparkSession, d: str) -> DataFrame:
    """REFRESH MATERIALIZED VIEW CONCURRENTLY merges only the difference."""
    cat = _catalog(spark, d, "customer")
    cat.create_matview("m", "SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY c_nationkey", keys=("c_nationkey",))
    cat.delete("customer", c("c_acctbal") < 0)
    cat.refresh_matview("m", concurrently=True)
    return cat.execute("SELECT c_nationkey, n FROM m")


@query(f"SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NULL THEN 'insert' WHEN s.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS op FROM {_T} t FULL JOIN {_S} s ON t.c_custkey = s.c_custkey WHERE t.c_acctbal IS DISTINCT FROM s.c_acctbal OR t.c_name IS DISTINCT FROM s.c_name")
def merkle_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rows that differ, found by hashes of buckets first."""
    t, s = _customers(spark, d)
    return dml.merkle_diff(t, s, ["c_custkey"]).select("c_custkey", "op")


@query(f"SELECT * FROM {_S}")
def sync_patch(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot patched by the difference equals the other one."""
    t, s = _customers(spark, d)
    return dml.patch(t, dml.merkle_diff(t, s, ["c_custkey"]), ["c_custkey"])


@query(f"SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN t.c_custkey IS NULL THEN 'insert' WHEN s.c_custkey IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal FROM {_T} t FULL JOIN {_S} s ON t.c_custkey = s.c_custkey WHERE t.c_acctbal IS DISTINCT FROM s.c_acctbal")
def matview_diff(spark: SparkSession, d: str) -> DataFrame:
    t, s = _customers(spark, d)
    return dml.diff(t, s, ["c_custkey"]).select("c_custkey", "op", "c_acctbal")


@query("SELECT atom_id, policy FROM (SELECT *, row_number() OVER (PARTITION BY atom_id ORDER BY forgotten_at DESC, policy DESC) AS r FROM forgotten_atoms) WHERE r = 1")
def lww_merge(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    f = table(spark, d, "forgotten_atoms")
    older = f.withColumn("forgotten_at", c("forgotten_at") - F.expr("INTERVAL 1 DAY"))
    return dml.lww_merge([older, f], ["atom_id"], "forgotten_at", "policy").select("atom_id", "policy")


@query("SELECT table_name, column_name, CAST(ordinal AS BIGINT) AS ordinal FROM (SELECT 'nation' AS table_name, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name, unnest([1, 2, 3]) AS ordinal UNION ALL SELECT 'region', unnest(['r_regionkey', 'r_name']), unnest([1, 2]))")
def catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    return _catalog(spark, d, "nation", "region").columns().select("table_name", "column_name", c("ordinal_position").alias("ordinal"))


def _described(spark: SparkSession, d: str) -> Catalog:
    cat = _catalog(spark, d)
    cat.create("region", table(spark, d, "region"), Constraints(primary_key=("r_regionkey",), unique=[("r_name",)]))
    cat.create("nation", table(spark, d, "nation"), Constraints(primary_key=("n_nationkey",), checks={"name": "n_name <> ''"}, foreign=[ForeignKey("n_regionkey", "region", "r_regionkey")]))
    cat.create_trigger("nation", dml.Trigger("note", "update", lambda old, new: None, "before", "row"))
    cat.create_matview("names", "SELECT n_name FROM nation")
    return cat


@query("SELECT * FROM (VALUES ('names', 'MATERIALIZED VIEW'), ('nation', 'BASE TABLE'), ('region', 'BASE TABLE')) t(table_name, table_type)")
def catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    return _described(spark, d).list_tables()


@query("SELECT * FROM (VALUES ('nation_pkey', 'nation', 'n_nationkey', 1), ('nation_n_regionkey_fkey', 'nation', 'n_regionkey', 1), ('region_pkey', 'region', 'r_regionkey', 1), ('region_r_name_key', 'region', 'r_name', 1)) t(constraint_name, table_name, column_name, ordinal_position)")
def catalog_keys(spark: SparkSession, d: str) -> DataFrame:
    return _described(spark, d).key_column_usage().withColumn("ordinal_position", c("ordinal_position").cast("int"))


@query("SELECT * FROM (VALUES ('nation_pkey', 'nation', 'PRIMARY KEY'), ('nation_n_regionkey_fkey', 'nation', 'FOREIGN KEY'), ('nation_name_check', 'nation', 'CHECK'), ('region_pkey', 'region', 'PRIMARY KEY'), ('region_r_name_key', 'region', 'UNIQUE')) t(constraint_name, table_name, constraint_type)")
def catalog_constraints(spark: SparkSession, d: str) -> DataFrame:
    return _described(spark, d).table_constraints()


@query("SELECT 'note' AS trigger_name, 'nation' AS event_object_table, 'UPDATE' AS event_manipulation, 'BEFORE' AS action_timing, 'ROW' AS action_orientation")
def catalog_triggers(spark: SparkSession, d: str) -> DataFrame:
    """information_schema.triggers and SHOW TRIGGERS ON nation."""
    return _described(spark, d).list_triggers("nation")


@query("SELECT 'names' AS matviewname, 'SELECT n_name FROM nation' AS definition")
def catalog_matviews(spark: SparkSession, d: str) -> DataFrame:
    return _described(spark, d).list_matviews()


@query("SELECT * FROM (VALUES ('UTC', 0), ('Asia/Tokyo', 32400), ('Asia/Kolkata', 19800)) t(name, utc_offset_seconds)")
def catalog_timezones(spark: SparkSession, d: str) -> DataFrame:
    return Catalog(spark).timezone_names().where(c("name").isin("UTC", "Asia/Tokyo", "Asia/Kolkata")).select("name", c("utc_offset_seconds").cast("int").alias("utc_offset_seconds"))


@query("SELECT abbrev, utc_offset_seconds FROM (VALUES ('JST', 32400), ('UTC', 0)) t(abbrev, utc_offset_seconds)")
def catalog_timezone_abbrevs(spark: SparkSession, d: str) -> DataFrame:
    return Catalog(spark).timezone_abbrevs().where(c("abbrev").isin("JST", "UTC")).select("abbrev", c("utc_offset_seconds").cast("int").alias("utc_offset_seconds"))


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS local FROM events")
def set_time_zone(spark: SparkSession, d: str) -> DataFrame:
    cat = _catalog(spark, d)
    cat.set_time_zone("Asia/Tokyo")
    return table(spark, d, "events").select("event_id", cat.local_time(c("ts")).alias("local"))


@query("SELECT r_regionkey AS k, r_name AS name, 'n;a' AS note FROM region")
def alter_table(spark: SparkSession, d: str) -> DataFrame:
    """ALTER TABLE add, rename and drop column, rename table; a script with a semicolon in a text."""
    cat = _catalog(spark, d, "region")
    cat.add_column("region", "extra", F.lit(1))
    cat.drop_column("region", "extra")
    cat.rename_column("region", "r_regionkey", "k")
    cat.rename_column("region", "r_name", "name")
    cat.rename("region", "area")
    return cat.script("SELECT 1 AS x; -- a comment; here\nSELECT k, name, 'n;a' AS note FROM area")[-1]


@query("SELECT true AS scans, true AS pushed")
def explain(spark: SparkSession, d: str) -> DataFrame:
    """EXPLAIN shows the scan and the filter pushed to it."""
    cat = _catalog(spark, d, "orders")
    text = cat.explain("SELECT o_orderkey FROM orders WHERE o_custkey = 7")
    return spark.createDataFrame([("Scan parquet" in text, "EqualTo(o_custkey,7)" in text)], "scans boolean, pushed boolean")


@query("SELECT concat_ws(',', c_custkey, CASE WHEN regexp_matches(c_name, '[,\"\\n\\r]') THEN '\"' || c_name || '\"' ELSE c_name END, c_mktsegment, c_nationkey) AS line FROM customer")
def sink_csv(spark: SparkSession, d: str) -> DataFrame:
    """Rows as CSV lines, made where they are."""
    configure(spark)
    return sinks.lines(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"))


@query("SELECT concat('{\"c_custkey\":', c_custkey, ',\"c_name\":\"', c_name, '\",\"nothing\":null}') AS line FROM customer")
def sink_json(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return sinks.lines(table(spark, d, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("nothing")), "json")


@query(
    """SELECT 'nation' AS table_name, 0 AS part, 'CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER, PRIMARY KEY (n_nationkey));' AS line
    UNION ALL SELECT 'nation', 1, concat('INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (', n_nationkey, ', ''', replace(n_name, '''', ''''''), ''', ', n_regionkey, ');') FROM nation"""
)
def sink_dump(spark: SparkSession, d: str) -> DataFrame:
    """CREATE and INSERT statements of a table."""
    cat = _catalog(spark, d)
    cat.create("nation", table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), Constraints(primary_key=("n_nationkey",)))
    return sinks.dump(cat, "nation")


@query("SELECT count(*) AS n, sum(o_orderkey) AS s FROM orders")
def row_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Rows read one by one."""
    configure(spark)
    n = s = 0
    for r in sinks.cursor(table(spark, d, "orders").select("o_orderkey")):
        n, s = n + 1, s + r["o_orderkey"]
    return spark.createDataFrame([(n, s)], "n long, s long")
