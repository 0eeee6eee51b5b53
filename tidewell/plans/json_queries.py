"""JSON operators, functions, table functions and SQL/JSON path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import json as J
from tidewell.plans.registry import query
from tidewell.session import configure, table

def p():
    return F.col("payload")

_INPUTS = "(SELECT input_id, CAST(payload AS JSON) AS j FROM atom_inputs WHERE payload IS NOT NULL)"


def inputs(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return table(spark, d, "atom_inputs").where("payload IS NOT NULL").select("input_id", "payload")


@query("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, (props->'k') IS NOT NULL AS there FROM events")
def json_get(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return table(spark, d, "events").select("event_id", J.get_text(F.col("props"), "k").cast("long").alias("k"), J.get(F.col("props"), "k").isNotNull().alias("there"))


@query(f"SELECT input_id, j->>'topic' AS topic, j#>>'{{tags,0}}' AS tag, j->'tags'->>-1 AS last_tag, j#>>'{{model,name}}' AS model FROM {_INPUTS}".replace("j#>>'{tags,0}'", "j->'tags'->>0").replace("j#>>'{model,name}'", "j->'model'->>'name'"))
def json_get_text(spark: SparkSession, d: str) -> DataFrame:
    return inputs(spark, d).select("input_id", J.get_text(p(), "topic").alias("topic"), J.get_path_text(p(), "{tags,0}").alias("tag"), J.get_path_text(p(), "{tags,-1}").alias("last_tag"), J.get_path_text(p(), "{model,name}").alias("model"))


@query(f"SELECT input_id, j->>'topic' IS NOT DISTINCT FROM 'law' AS law, json_contains(j, '{{\"topic\": \"sport\"}}') AS sport FROM {_INPUTS}")
def json_contains(spark: SparkSession, d: str) -> DataFrame:
    return inputs(spark, d).select("input_id", J.contains(p(), '{"topic": "law"}').alias("law"), J.contains(p(), '{"topic": "sport"}').alias("sport"))


@query(f"SELECT input_id, list_contains(json_keys(j), 'tags') AS has, list_has_any(json_keys(j), ['tags', 'model']) AS some, list_has_all(json_keys(j), ['tags', 'model']) AS every FROM {_INPUTS}")
def json_has_key(spark: SparkSession, d: str) -> DataFrame:
    return inputs(spark, d).select("input_id", J.has_key(p(), "tags").alias("has"), J.has_any_key(p(), ["tags", "model"]).alias("some"), J.has_all_keys(p(), ["tags", "model"]).alias("every"))


@query(f"SELECT input_id, lower(json_type(j)) AS kind, CAST(coalesce(json_array_length(j, '$.tags'), -1) AS BIGINT) AS n_tags, CAST(len(json_keys(j)) AS BIGINT) AS n_keys FROM {_INPUTS}")
def json_typeof(spark: SparkSession, d: str) -> DataFrame:
    return inputs(spark, d).select("input_id", J.typeof(p()).alias("kind"), F.coalesce(J.array_length(J.get_path(p(), "{tags}")), F.lit(-1)).cast("long").alias("n_tags"), J.object_length(p()).alias("n_keys"))


@query(f"SELECT input_id, unnest(CAST(j->'tags' AS VARCHAR[])) AS tag FROM {_INPUTS} WHERE (j->'tags') IS NOT NULL")
def json_array_elements(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs(spark, d).withColumn("tags", J.get_path(p(), "{tags}"))
    return J.array_elements(rows, "tags", "tag", text=True).select("input_id", "tag")


@query(f"SELECT input_id, e.key AS key, e.value->>'$' AS value FROM {_INPUTS}, json_each(j) e WHERE json_type(e.value) NOT IN ('OBJECT', 'ARRAY') UNION ALL SELECT input_id, e.key, CAST(json_type(e.value) AS VARCHAR) FROM {_INPUTS}, json_each(j) e WHERE json_type(e.value) IN ('OBJECT', 'ARRAY')")
def json_each(spark: SparkSession, d: str) -> DataFrame:
    """Every key; a nested value comes out as its type."""
    kinds = J.each(inputs(spark, d), "payload").select("input_id", "key", F.upper(J.typeof(F.col("value"))).alias("kind"))
    rows = J.each(inputs(spark, d), "payload", text=True).select("input_id", "key", "value")
    return rows.join(kinds, ["input_id", "key"]).select("input_id", "key", F.when(F.col("kind").isin("OBJECT", "ARRAY"), F.col("kind")).otherwise(F.col("value")).alias("value"))


@query(f"SELECT kind, CAST(count(DISTINCT k) AS BIGINT) AS n FROM (SELECT lower(kind) AS kind, unnest(json_keys(CAST(payload AS JSON))) AS k FROM atom_inputs WHERE payload IS NOT NULL) GROUP BY kind")
def json_object_keys(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    rows = table(spark, d, "atom_inputs").where("payload IS NOT NULL").select(F.lower("kind").alias("kind"), "payload")
    return J.object_keys(rows, "payload").groupBy("kind").agg(F.count_distinct("key").alias("n"))


@query(f"SELECT input_id, row_number() OVER (PARTITION BY input_id ORDER BY i) AS pos, tag FROM (SELECT input_id, unnest(CAST(j->'tags' AS VARCHAR[])) AS tag, generate_subscripts(CAST(j->'tags' AS VARCHAR[]), 1) AS i FROM {_INPUTS} WHERE (j->'tags') IS NOT NULL)")
def json_table(spark: SparkSession, d: str) -> DataFrame:
    return J.json_table(inputs(spark, d), "payload", "$.tags[*]", [("tag", "string", "$")], "pos").select("input_id", "pos", "tag")


@query(
    f"""SELECT input_id, CASE WHEN json_type(j->'model') = 'OBJECT' THEN '7' END AS set, CASE WHEN json_type(j->'tags') = 'ARRAY' THEN 'new' END AS ins,
    CASE WHEN json_type(j->'tags') = 'ARRAY' THEN coalesce(json_array_length(j->'tags') + 1, -1) ELSE -1 END AS n_ins, list_contains(json_keys(j), 'topic') AS had, false AS has,
    CASE WHEN json_type(j->'tags') = 'ARRAY' THEN greatest(json_array_length(j->'tags') - 1, 0) ELSE -1 END AS n_del, CASE WHEN json_type(j) = 'OBJECT' THEN len(json_keys(j)) + 1 END AS n_merged, CASE WHEN json_type(j) = 'OBJECT' THEN len(json_keys(j)) END AS n_stripped FROM {_INPUTS}"""
)
def json_edit(spark: SparkSession, d: str) -> DataFrame:
    """Set, insert, delete, delete path, merge and strip nulls, seen through what they change."""
    merged = J.merge(p(), F.lit('{"x": null}'))
    n = lambda c: F.coalesce(c, F.lit(-1).cast("long"))
    size = lambda c: F.when(J.typeof(c) == "object", J.object_length(c))
    return inputs(spark, d).select(
        "input_id",
        J.get_path_text(J.set_(p(), "{model,build}", "7"), "{model,build}").alias("set"), J.get_path_text(J.insert(p(), "{tags,0}", '"new"'), "{tags,0}").alias("ins"),
        n(J.array_length(J.get_path(J.insert(p(), "{tags,0}", '"new"'), "{tags}"))).alias("n_ins"), J.has_key(p(), "topic").alias("had"), J.has_key(J.delete(p(), "topic"), "topic").alias("has"),
        n(J.array_length(J.get_path(J.delete_path(p(), "{tags,0}"), "{tags}"))).alias("n_del"), size(merged).alias("n_merged"), size(J.strip_nulls(merged)).alias("n_stripped"),
    )


@query(f"SELECT input_id, j->>'$.topic' AS a, j->>'$.tags[0]' AS b, j->>'$.model.name' AS c, json_valid(CAST(j AS VARCHAR)) AS ok FROM {_INPUTS}")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return inputs(spark, d).select("input_id", J.extract(p(), "$.topic").alias("a"), J.extract(p(), "$.tags[0]").alias("b"), J.extract(p(), "$.model.name").alias("c"), J.valid(p()).alias("ok"))


@query(
    """SELECT c_custkey, concat('{"k":', c_custkey, ',"n":"', c_name, '","z":null}') AS built, concat('[', c_custkey, ',"', c_mktsegment, '",null]') AS arr,
    concat('{"', c_name, '":"', c_mktsegment, '"}') AS obj, concat('{"a":"1","', c_mktsegment, '":"x"}') AS pairs, concat('{"c_custkey":', c_custkey, ',"c_name":"', c_name, '"}') AS row_, concat('"', c_name, '"') AS js FROM customer"""
)
def json_build(spark: SparkSession, d: str) -> DataFrame:
    """Objects and arrays built from columns; TO_JSON, ROW_TO_JSON and JSON_OBJECT."""
    configure(spark)
    k, n, m = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    none = F.lit(None).cast("string")
    return table(spark, d, "customer").select(
        "c_custkey", J.build_object("k", F.lit(0), "k", k, none, n, "n", n, "z", none).alias("built"), J.build_array(k, m, none).alias("arr"),
        J.object_of(F.array(n), F.array(m)).alias("obj"), J.object_of(F.array(F.lit("a"), F.lit("1"), m, F.lit("x"))).alias("pairs"), J.to_json(F.struct(k, n)).alias("row_"), J.to_json(n).alias("js"),
    )


@query(f"SELECT input_id, CASE WHEN json_type(j->'tags') = 'ARRAY' THEN (SELECT string_agg(x, '|') FROM (SELECT unnest(CAST(j->'tags' AS VARCHAR[])) AS x)) END AS tags, coalesce(j->>'topic', 'none') AS topic, CASE WHEN json_type(j->'tags') = 'ARRAY' AND json_array_length(j->'tags') > 1 THEN 'many' WHEN json_type(j->'tags') = 'ARRAY' AND json_array_length(j->'tags') = 1 THEN 'one' ELSE 'empty' END AS n FROM {_INPUTS}")
def json_query(spark: SparkSession, d: str) -> DataFrame:
    """JSON_QUERY with wrapper, JSON_VALUE with ON EMPTY and ON ERROR."""
    wrapped = J.json_query(p(), "$.tags[*]", wrapper="with")
    bare = J.json_query(p(), "$.tags[*]", wrapper="without", on_empty='"empty"', on_error='"many"')
    tags = F.array_join(F.from_json(wrapped, "array<string>"), "|")
    kind = F.when(bare == '"empty"', "empty").when(bare == '"many"', "many").otherwise("one")
    return inputs(spark, d).select("input_id", F.nullif(tags, F.lit("")).alias("tags"), J.json_value(p(), "$.topic", on_empty="none", on_error="error").alias("topic"), kind.alias("n"))


@query(
    f"""WITH t AS (SELECT input_id, j, CASE WHEN json_type(j->'tags') = 'ARRAY' AND json_array_length(j->'tags') > 0 THEN CAST(j->'tags' AS VARCHAR[]) ELSE [NULL] END AS tags FROM {_INPUTS} WHERE json_type(j) <> 'NULL' OR true)
    SELECT input_id, CAST(1 AS BIGINT) AS pos, j->>'topic' AS topic, unnest(tags) AS tag, (j->'model') IS NOT NULL AS has_model, CASE WHEN json_type(j->'model') = 'OBJECT' THEN j->'model'->>'name' END AS model FROM t"""
)
def json_table_nested(spark: SparkSession, d: str) -> DataFrame:
    """Two sibling nested paths; one without items gives a row of NULLs."""
    cols = [("topic", "string", "$.topic"), ("nested", "$.tags[*]", [("tag", "string", "$")]), ("has_model", "exists", "$.model"), ("nested", "$.model", [("model", "string", "$.name")])]
    return J.json_table(inputs(spark, d), "payload", "$", cols, "pos").select("input_id", "pos", "topic", "tag", "has_model", "model")


@query(f"SELECT input_id FROM {_INPUTS} WHERE j->>'topic' = 'law'")
def json_gin(spark: SparkSession, d: str) -> DataFrame:
    """Containment by stored postings and a recheck."""
    rows = inputs(spark, d)
    return J.gin_contains(rows, "input_id", "payload", J.build_gin(rows, "input_id", "payload"), '{"topic": "law"}').select("input_id")


@query(f"SELECT input_id, json_type(j) = 'OBJECT' AND len(json_keys(j)) = 0 AS inside, list_contains(json_keys(j), 'topic') AS pretty FROM {_INPUTS}")
def json_contained(spark: SparkSession, d: str) -> DataFrame:
    """``<@`` and JSON_PRETTY."""
    return inputs(spark, d).select("input_id", J.contained(p(), '{"topic": "no such"}').alias("inside"), J.pretty(p()).contains('\n  "topic": ').alias("pretty"))


@query("SELECT r_regionkey, CAST(r_regionkey + 1 AS BIGINT) AS a, r_name AS b FROM region UNION ALL SELECT r_regionkey, CAST(r_regionkey * 10 AS BIGINT), NULL FROM region")
def json_populate(spark: SparkSession, d: str) -> DataFrame:
    """JSONB_POPULATE_RECORDSET over arrays built from rows."""
    configure(spark)
    k, n = F.col("r_regionkey"), F.col("r_name")
    doc = J.build_array(F.struct((k + 1).alias("a"), n.alias("b")), F.struct((k * 10).alias("a"), F.lit(None).cast("string").alias("b")))
    return J.populate(table(spark, d, "region").select("r_regionkey", doc.alias("doc")), "doc", "a bigint, b string").select("r_regionkey", "a", "b")


@query(f"SELECT input_id, coalesce(CAST(j->>'session' AS BIGINT) > 50000, false) AS late, coalesce(j->'model'->>'name', '-') AS model FROM {_INPUTS}")
def jsonpath_filter(spark: SparkSession, d: str) -> DataFrame:
    return inputs(spark, d).select("input_id", J.path_exists(p(), "$.session ? (@ > 50000)").alias("late"), F.coalesce(J.json_value(p(), "$.model.name"), F.lit("-")).alias("model"))


@query(
    f"""SELECT input_id, CASE WHEN json_type(j->'tags') = 'ARRAY' THEN len(list_filter(CAST(j->'tags' AS VARCHAR[]), lambda z: starts_with(z, 't') OR regexp_matches(z, 'x$'))) WHEN json_type(j->'tags') IS NULL THEN 0 ELSE 0 END AS n_tags,
    coalesce(j->>'topic' = 'law' AND TRY_CAST(j->>'session' AS BIGINT) > 10, false) AS law, j->>'session' AS session FROM {_INPUTS}"""
)
def jsonpath_query(spark: SparkSession, d: str) -> DataFrame:
    return inputs(spark, d).select(
        "input_id", F.size(F.from_json(J.path_query_array(p(), '$.tags[*] ? (@ starts with "t" || @ like_regex "x$")'), "array<string>")).cast("long").alias("n_tags"),
        F.coalesce(J.path_match(p(), '$.topic == "law" && $.session > 10'), F.lit(False)).alias("law"), J.path_query_first(p(), "$.session").alias("session"),
    )


@query(f"SELECT input_id, unnest(CAST(j->'tags' AS VARCHAR[])) AS tag FROM {_INPUTS} WHERE json_type(j->'tags') = 'ARRAY'")
def jsonpath_rows(spark: SparkSession, d: str) -> DataFrame:
    """JSONB_PATH_QUERY: one row an item."""
    return J.path_query(inputs(spark, d), "payload", "$.tags[*]").select("input_id", F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0].alias("tag"))


@query("SELECT o_orderkey, o_orderdate >= TIMESTAMP '1995-06-01 02:00:00' AS late, false AS without FROM orders")
def jsonpath_tz(spark: SparkSession, d: str) -> DataFrame:
    """``@?_tz``: times of several zones are compared as instants."""
    configure(spark)
    doc = F.date_format(F.col("o_orderdate").cast("timestamp"), "'{\"at\":\"'yyyy-MM-dd'T'HH:mm:ss'\"}'")
    path = '$.at ? (@.datetime() >= "1995-06-01T04:00:00+02:00".datetime())'
    return table(spark, d, "orders").select("o_orderkey", J.path_exists(doc, path, tz=True).alias("late"), F.coalesce(J.path_exists(doc, path), F.lit(False)).alias("without"))


@query("SELECT region_id, concat('[', string_agg(coalesce('\"' || query_text || '\"', 'null'), ',' ORDER BY query_id), ']') AS texts, concat('{', string_agg('\"' || query_id || '\":' || k, ',' ORDER BY query_id), '}') AS ks FROM recall_queries GROUP BY region_id")
def json_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """JSON_AGG and JSON_OBJECT_AGG, ordered."""
    configure(spark)
    q = F.col("query_id")
    return table(spark, d, "recall_queries").groupBy("region_id").agg(J.json_agg(F.col("query_text"), q).alias("texts"), J.json_object_agg(q, F.col("k"), q).alias("ks"))
