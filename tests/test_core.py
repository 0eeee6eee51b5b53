import importlib.util
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import datetime as D
from tidewell.functions import fts, jsonpath, vector
from tidewell.functions import json as J
from tidewell.functions import scalar as S
from tidewell.operators import dml, memory
from tidewell.operators import relational as R
from tidewell.sources.catalog import Catalog


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_scalar_quirks(spark):
    s = F.lit("héllo World")
    r = one(spark, S.upper(s), S.substr(F.lit("hello"), 0, 2), S.substr(F.lit("hello"), -3, 2), S.substr(F.lit("hello"), -3), S.trim(F.lit("xxaxx"), "x"), S.replace(F.lit("abc"), "", "z"), S.instr(F.lit("abc"), "c"), S.concat(F.lit(None).cast("string"), F.lit("a")), S.sqrt(F.lit(-1.0)), S.round_(F.lit(-7.5)), S.round_(F.lit(2.5)), S.div(F.lit(-7), F.lit(2)), S.sign(F.lit(-2.5)), S.typeof(F.lit(1.5)))
    assert tuple(r) == ("HéLLO WORLD", "h", "", "llo", "a", "abc", 3, "a", None, -8.0, 3.0, -3, -1, "real")
    r = one(spark, S.like(F.lit("HeLLo"), "hel%"), S.like(F.lit("a\\b"), "a\\b"), S.like(F.lit("50%"), "50!%", "!"), S.like(F.lit("505"), "50!%", "!"), S.to_bool(F.lit(" Yes")), S.to_int(F.lit("-3.9")))
    assert tuple(r) == (True, True, True, False, True, -3)
    with pytest.raises(Exception, match="BOOLEAN"):
        one(spark, S.to_bool(F.lit("maybe")))


def ts(x):
    return F.lit(x).cast("timestamp_ntz")


def test_datetime(spark):
    r = one(spark, D.add(ts("2024-01-31 10:00:00"), D.interval(1, 2)), D.add(ts("2024-03-31"), D.interval(1), -1), D.age(ts("2024-03-15 12:00:00"), ts("2023-01-31")), D.minus(ts("2024-01-03 01:00:00"), ts("2024-01-01")), D.extract("dow", ts("2024-01-07")), D.timediff(ts("2024-01-01"), ts("2024-01-02 00:00:01")), D.strftime("%Y-%j %f", ts("2024-02-01 00:00:00.5")))
    assert r[0] == datetime(2024, 3, 2, 10) and r[1] == datetime(2024, 2, 29)
    assert tuple(r[2]) == (13, 15, 12 * D.HOUR) and tuple(r[3]) == (0, 2, D.HOUR)
    assert r[4] == 0 and r[5] == "-0001-00-00 00:00:01.000000" and r[6] == "2024-032 500000"
    iv = D.interval(1, 40, 90_000_000_000)
    r = one(spark, D.justify_interval(iv), D.iv_times(D.interval(1), 0.5), D.iv_total(iv), D.time_add(F.lit(23 * D.HOUR), D.interval(0, 0, 2 * D.HOUR)), D.date_trunc("decade", ts("1999-05-05")), D.date_bin((0, 0, 900_000_000), ts("2024-01-01 00:20:00"), ts("2024-01-01")))
    assert tuple(r[0]) == (2, 11, 3_600_000_000) and tuple(r[1]) == (0, 15, 0)
    assert r[2] == 70 * D.DAY + 90_000_000_000 and r[3] == D.HOUR and r[4] == datetime(1990, 1, 1) and r[5] == datetime(2024, 1, 1, 0, 15)
    assert D.parse_interval("1 year 2 days 04:05:06") == (12, 2, 14_706_000_000)
    assert D.parse_interval("P1Y2M3DT4H") == (14, 3, 4 * D.HOUR) and D.parse_interval("3 weeks ago") == (0, -21, 0)
    with pytest.raises(ValueError):
        D.at_time_zone(ts("2024-01-01"), "UTC+5")


@pytest.mark.parametrize(
    ("doc", "path", "want"),
    [
        ({"a": [1, 2, {"b": 3}]}, "$.a[*]", [1, 2, {"b": 3}]),
        ({"a": [1, 2, 3]}, "$.a[1 to last]", [2, 3]),
        ({"a": [1, 2, 3]}, "$.a ? (@ > 1)", [2, 3]),
        ({"a": {"b": {"c": 1}}}, "$.**.c", [1]),
        ({"a": 12}, "$.a + 3 * 2", [18]),
        ({"a": ["x", "yy"]}, '$.a ? (@ like_regex "^y+$")', ["yy"]),
        ({"a": "abc"}, '$.a ? (@ starts with "ab")', ["abc"]),
        ([1, "a", None, {}], "$[*].type()", ["number", "string", "null", "object"]),
        ({"a": [1, 2]}, "$.a.size()", [2]),
        ({"a": -1.5}, "$.a.abs().ceiling()", [2]),
        ({"a": [{"b": 1}, {"c": 2}]}, "$.a[*] ? (exists(@.b) && @.b == 1)", [{"b": 1}]),
        ({"a": 1}, "lax $.x.y", []),
        ({"a": [1, "x"]}, "$.a[*] ? ((@ > 0) is unknown)", ["x"]),
        ({"a": 5}, "$.a > 3", [True]),
        ({"k": {"z": 1}}, "$.k.keyvalue().key", ["z"]),
    ],
)
def test_jsonpath(doc, path, want):
    assert jsonpath.query(doc, path) == want


def test_jsonpath_strict_and_variables():
    assert jsonpath.query({"a": [3, 8]}, "$.a[*] ? (@ > $m)", {"m": 5}) == [8]
    with pytest.raises(jsonpath.PathError):
        jsonpath.query({"a": 1}, "strict $.b")
    assert jsonpath.query({"a": 1}, "strict $.b", silent=True) == [] and jsonpath.exists({"a": 1}, "strict $.b") is None
    mixed = '$.a ? (@.datetime() < "2024-01-01T10:00:00+02:00".datetime())'
    assert jsonpath.query({"a": "2024-01-01T07:00:00"}, mixed, tz=True) == ["2024-01-01T07:00:00"] and not jsonpath.exists({"a": "2024-01-01T07:00:00"}, mixed)
    assert jsonpath.match({"a": 1}, "$.a == 1") is True and jsonpath.match({"a": 1}, "$.a") is None


def test_json_functions(spark):
    j = F.lit('{"b":[1,{"c":null}],"a":"x"}')
    r = one(spark, J.get(j, "b"), J.get_text(j, "a"), J.get_path_text(j, "{b,-1,c}"), J.contains(j, '{"b":[1]}'), J.set_(j, "{b,0}", "9"), J.delete_path(j, "{b,1,c}"), J.strip_nulls(j), J.merge(j, F.lit('{"a":2}')), J.has_key(F.lit('["q"]'), "q"), J.typeof(F.lit("[1]")), J.get(F.lit("not json"), "a"), J.build_array(F.lit(1), F.lit(None).cast("string"), F.lit("z")))
    assert tuple(r) == ('[1,{"c":null}]', "x", None, True, '{"a":"x","b":[9,{"c":null}]}', '{"a":"x","b":[1,{}]}', '{"a":"x","b":[1,{}]}', '{"a":2,"b":[1,{"c":null}]}', True, "array", None, '[1,null,"z"]')
    df = spark.createDataFrame([(1, '[{"a":1,"b":"x"},{"a":2}]'), (2, None)], "id int, d string")
    rows = J.json_table(df, "d", "$[*]", [("a", "int", "$.a"), ("b", "string", "$.b"), ("has", "exists", "$.b")], "n").collect()
    assert [(r["id"], r["n"], r["a"], r["b"], r["has"]) for r in rows] == [(1, 1, 1, "x", True), (1, 2, 2, None, False)]
    assert [tuple(r) for r in J.populate(df, "d", "a int, b string").select("a", "b").collect()] == [(1, "x"), (2, None)] and df.count() == 2
    agg = spark.createDataFrame([(1, "x"), (1, None)], "k int, v string").groupBy("k").agg(J.json_agg(F.col("v")).alias("j")).first()["j"]
    assert sorted(json.loads(agg), key=str) == [None, "x"]


def test_stemmer():
    pairs = {"running": "run", "caresses": "caress", "ponies": "poni", "national": "nation", "hopping": "hop", "hoping": "hope", "relational": "relat", "happily": "happili", "generously": "generous", "cries": "cri", "ties": "tie", "agreed": "agre", "consistency": "consist", "knightly": "knight", "sky": "sky", "news": "news"}
    assert {w: fts.stem(w) for w in pairs} == pairs


def test_fts(spark):
    df = spark.createDataFrame([(1, "The quick brown fox jumps"), (2, "A brown quick dog"), (3, None), (4, "")], "id int, t string").withColumn("v", fts.to_tsvector(F.col("t")))
    ids = lambda q: [r["id"] for r in df.where(fts.match(F.col("v"), q)).orderBy("id").collect()]
    assert ids(fts.to_tsquery("quick & !dog")) == [1]
    assert ids(fts.to_tsquery("quick <-> brown")) == [1] and ids(fts.to_tsquery("quick <2> jump")) == [] and ids(fts.to_tsquery("brown | cat")) == [1, 2]
    assert ids(fts.to_tsquery("jum:*")) == [1] and ids(fts.websearch_to_tsquery('"brown fox" or dog')) == [1, 2] and ids(fts.plainto_tsquery("the")) == []
    q = fts.to_tsquery("quick & brown")
    r = df.where("id = 1").select(fts.ts_rank(F.col("v"), q).alias("r"), fts.ts_rank_cd(F.col("v"), q).alias("c"), fts.ts_headline(F.col("t"), q).alias("h")).first()
    assert abs(r["r"] - 2 * 0.1 * (1 + 0.6931471805599453)) < 1e-12 and abs(r["c"] - 0.1) < 1e-12
    assert r["h"] == "The <b>quick</b> <b>brown</b> fox jumps" and fts.numnode(q) == 3
    with pytest.raises(ValueError):
        fts.to_tsquery("a &")


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert tuple(one(spark, vector.l2(v, [0, 0]), vector.inner(v, [1, 1]), vector.cosine(v, [3, 4]), vector.cosine(v, [0, 0]))) == (5.0, -7.0, 0.0, None)
    assert vector.parse("[1, 2.5]", 2) == [1.0, 2.5]
    with pytest.raises(ValueError):
        vector.parse("[1]", 2)


def test_relational(spark):
    t = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id int, v int")
    s = spark.createDataFrame([(3,), (5,)], "w int")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(R.compare_all(t, "v", ">=", s, "w")) == [1, 3] and ids(R.compare_any(t, "v", ">", s, "w")) == [1, 3]
    assert ids(R.compare_all(t, "v", ">", s.limit(0), "w")) == [1, 2, 3] and ids(R.compare_any(t, "v", "=", s, "w")) == [1]
    holes = spark.createDataFrame([(3,), (None,)], "w int")
    assert ids(R.compare_all(t, "v", ">", holes, "w")) == [] and ids(R.compare_all(t, "v", "<>", s, "w")) == [3]
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8)], "a long, b long")
    seed = spark.createDataFrame([(1,)], "x long")
    out = R.recursive_union(seed, lambda n: n.join(e, F.col("x") == F.col("a")).select(F.col("b").alias("x")))
    assert sorted(r["x"] for r in out.collect()) == [1, 2, 3]


def test_dml(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "C"), (3, "D")], "k int, v string")
    got = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert got(dml.upsert_do_nothing(t, s, ["k"], [F.col("v")])[0]) == [(1, "a"), (2, "b"), (3, "C"), (None, "n")]
    new, changed = dml.upsert_do_update(t, s, ["k"], {"v": lambda old, ex: F.concat(old("v"), ex("v"))}, order=[F.col("v")])
    assert got(new) == [(1, "a"), (2, "bB"), (3, "C"), (None, "n")] and got(changed) == [(2, "bB"), (3, "C")]
    assert got(dml.delete(t, F.col("k") > 1)[0]) == [(1, "a"), (None, "n")]
    assert got(dml.update(t, {"v": F.lit("z")}, F.col("k") == 1)[0]) == [(1, "z"), (2, "b"), (None, "n")]
    assert got(dml.diff(t.where("k IS NOT NULL"), s.limit(1), ["k"])) == [(1, "delete", "a"), (2, "update", "B")]
    assert got(dml.fk_on_delete(t, "k", s, "k", "set_null")) == [(1, "a"), (None, "b"), (None, "n")]
    with pytest.raises(ValueError):
        dml.fk_on_delete(t, "k", s, "k", "restrict")
    rows = spark.createDataFrame([(1, 5, "x", False), (1, 5, "a", True), (2, 1, "a", True), (2, 2, "b", False)], "k int, t int, node string, dead boolean")
    assert [(r["k"], r["t"]) for r in dml.lww_merge([rows], ["k"], "t", "node", "dead").collect()] == [(2, 2)]
    assert dml.unique_violations(t, ["k"]).count() == 0 and dml.check_violations(t, F.col("k") > 1).count() == 1


def test_memory(spark):
    e = spark.createDataFrame([(1, 2, "depends_on"), (2, 3, "depends_on"), (3, 1, "causes")], "src_id long, dst_id long, kind string")
    out = {r["id"]: (r["depth"], r["score"]) for r in memory.graph_expand(e, spark.createDataFrame([(1,)], "id long"), 5).collect()}
    assert out == {1: (0, 1.0), 2: (1, 0.5), 3: (2, 1 / 3)}
    assert memory.would_cycle(e, "depends_on", 3, 1) and not memory.would_cycle(e, "depends_on", 1, 3)
    empty = spark.createDataFrame([], "id long, t string")
    assert memory.bm25(empty, "id", "t", "x").count() == 0


def test_catalog(spark):
    c = Catalog(spark)
    c.create("t1", spark.range(3))
    c.begin("s")
    c.create("t1", spark.range(9))
    c.create("t2", spark.range(1))
    c.rollback("s")
    assert c.execute("SELECT count(*) AS n FROM t1 WHERE id >= :lo", lo=1).first()["n"] == 2 and set(c.tables) == {"t1"}
    c.create_matview("m", "SELECT id * 2 AS d FROM t1")
    assert c.execute("SELECT max(d) AS d FROM m").first()["d"] == 4
    assert [tuple(r)[:2] for r in c.list_tables().collect()] == [("m", "MATERIALIZED VIEW"), ("t1", "BASE TABLE")]


def test_stream_buckets_equal_batch(spark, tmp_path):
    from tidewell.streaming.buckets import bucket_counts

    rows = spark.createDataFrame([(datetime(2024, 1, 1, 0, i), "a" if i % 2 else "b", float(i)) for i in range(40)], "ts timestamp_ntz, kind string, v double")
    rows.write.parquet(str(tmp_path / "in"))
    aggs = [F.count("*").alias("n"), F.sum("v").alias("s")]
    batch = sorted(map(tuple, bucket_counts(rows, "ts", "10 minutes", "1 hour", ["kind"], aggs).collect()))
    stream = bucket_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "10 minutes", "1 hour", ["kind"], aggs)
    q = stream.writeStream.format("memory").queryName("buckets").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("buckets").collect())) == batch and len(batch) == 8


def test_entry_points():
    spec = importlib.util.find_spec("__spark_entry__")
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    assert set(m.oracle_sql()) <= set(m.queries()) and "revenue_by_nation" in m.queries()
