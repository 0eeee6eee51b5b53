import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell import session
from tidewell.functions import datetime as D
from tidewell.functions import fts, vector
from tidewell.functions import json as J
from tidewell.functions import scalar as S
from tidewell.operators import dml, memory, memory_store
from tidewell.operators.ranges import number_rows, running_total
from tidewell.sources import sinks
from tidewell.sources.catalog import Catalog, ConstraintError, Constraints, ForeignKey, statements


def test_running_total_over_nulls_ties_and_hot_groups(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", i // 4, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, i long").repartition(6)
    out = running_total(df.withColumn("n", F.lit(1).cast("long")), ["g"], [F.col("v").desc(), F.col("i")], "n", "place")
    want = {}
    for g in {r[0] for r in rows}:
        for p, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = p
    assert {r["i"]: r["place"] for r in out.collect()} == want
    assert number_rows(df.limit(0), [F.col("i")], "p").count() == 0
    assert [r["p"] for r in number_rows(df, [F.col("i")], "p").orderBy("i").collect()] == list(range(1, 401))


def test_join_checked_by_bytes(spark):
    big, small = spark.range(100), spark.range(10).withColumn("t", F.lit("x"))
    assert session.join_checked(big, small, "id").count() == 10 and session.join_checked(big, small, "id", max_bytes=100).count() == 10
    assert session.row_bytes(spark.createDataFrame([], "a array<float>, b long")) > 500


def test_written_tables_can_be_discarded(spark):
    import os

    a, b = session.materialise(spark.range(5)), session.materialise(spark.range(6))
    where = [f.removeprefix("file://") for f in a.inputFiles()]
    session.discard(a)
    assert not any(map(os.path.exists, where)) and session.read_all([b, b]).count() == 12


def test_fts_index_agrees_with_vectors(spark):
    docs = [(1, "The quick brown fox jumps"), (2, "A brown quick dog"), (3, None), (4, ""), (5, "foxes and dogs: the quick brown fox quick"), (None, "fox")]
    df = spark.createDataFrame(docs, "id long, t string")
    ix = fts.build_index(df, "id", "t")
    v = df.where("id IS NOT NULL AND t IS NOT NULL").withColumn("v", fts.to_tsvector(F.col("t")))
    for text in ("quick & !dog", "quick <-> brown", "fox | dog", "!fox", "qui:*", "fox & (dog | jump)", "the"):
        q = fts.to_tsquery(text)
        direct = sorted(r["id"] for r in v.where(fts.match(F.col("v"), q)).collect())
        assert sorted(r["k"] for r in fts.search(ix, q).collect()) == direct, text
        assert fts.search_count(ix, q).first()["n"] == len(direct)
    q = fts.to_tsquery("quick & fox")
    for norm in (0, 1, 2, 8, 16, 32):
        for cover in (False, True):
            rank = (fts.ts_rank_cd if cover else fts.ts_rank)(F.col("v"), q, norm)
            want = {r["id"]: round(r["r"], 9) for r in v.where(fts.match(F.col("v"), q)).select("id", rank.alias("r")).collect()}
            assert {r["k"]: round(r["rank"], 9) for r in fts.search_ranked(ix, q, 9, norm, cover).collect()} == want
    empty = fts.build_index(df.limit(0), "id", "t")
    assert fts.search(empty, q).count() == 0 and fts.search(empty, None).count() == 0


def test_fts_weights_and_overflow(spark):
    df = spark.createDataFrame([(1, "fox", "the fox and a dog")], "id int, a string, b string").select("id", fts.to_tsvector(F.col("a")).alias("a"), fts.to_tsvector(F.col("b")).alias("b"))
    v = fts.concat(fts.setweight(F.col("a"), "A"), fts.setweight(F.col("b"), "B", ["dog"]))
    r = df.select(*[fts.match(v, fts.to_tsquery(t)).alias(f"c{i}") for i, t in enumerate(("fox:A", "fox:B", "dog:B", "dog:A", "fox:AD"))], fts.length(v).alias("n"), fts.match(fts.strip(v), fts.to_tsquery("fox")).alias("s"), fts.ts_rank(v, fts.to_tsquery("fox")).alias("rank")).first()
    assert tuple(r)[:7] == (True, False, True, False, True, 2, False) and abs(r["rank"] - 1.1 * (1 + np.log(3))) < 1e-9
    assert fts.query_text(fts.to_tsquery("a1 & !(b1 | c1) <-> d1")) and fts.query_text(None) == ""
    with pytest.raises(ValueError):
        fts.setweight(F.col("a"), "E")
    long = spark.createDataFrame([(1, "alpha beta " * 9000)], "id long, t string")
    ix = fts.build_index(long, "id", "t", "simple")
    assert fts.search(ix, fts.to_tsquery("alpha & beta", "simple")).count() == 1
    with pytest.raises(Exception, match="overflow"):
        fts.search(ix, fts.phraseto_tsquery("alpha beta", "simple")).collect()


def test_json_containment_in_the_jvm(spark):
    docs = ['{"a":1,"b":[1,"x",{"c":null}]}', '{"a":"1"}', "[1,2]", '"x"', "null", "bad", None, '{"a":1.0}', '{"b":["x"]}', "[]", "{}", '{"a":true}']
    parts = ['{"a":1}', '{"b":["x"]}', '{"b":[{"c":null}]}', "1", '"x"', "[]", "{}", "null", '{"a":true}', '{"b":[[1]]}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, d string")
    for p in parts:
        want = [None if not ok else J._contains(x, __import__("json").loads(p)) for ok, x in map(J._load, docs)]
        assert [r["c"] for r in df.select("id", J.contains(F.col("d"), p).alias("c")).orderBy("id").collect()] == want, p
    ix = J.build_gin(df, "id", "d")
    for p in parts:
        want = [i for i, (ok, x) in enumerate(map(J._load, docs)) if ok and J._contains(x, __import__("json").loads(p))]
        assert sorted(r["id"] for r in J.gin_contains(df, "id", "d", ix, p).collect()) == want, p
    r = df.select("id", J.has_key(F.col("d"), "x").alias("k"), J.typeof(F.col("d")).alias("t"), J.valid(F.col("d")).alias("v"), J.get(F.col("d"), -1).alias("last"), J.has_all_keys(F.col("d"), []).alias("all")).orderBy("id").collect()
    assert [x["k"] for x in r] == [False, False, False, True, False, None, None, False, False, False, False, False]
    assert [x["t"] for x in r] == ["object", "object", "array", "string", "null", None, None, "object", "object", "array", "object", "object"]
    assert [x["v"] for x in r][4:7] == [True, False, False] and r[2]["last"] == "2" and r[9]["last"] is None


def test_json_builders(spark):
    one = lambda *c: tuple(spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(c)]).first())
    none = F.lit(None).cast("string")
    assert one(J.build_object("a", F.lit(1), none, F.lit(2), "a", F.lit('q"')), J.object_of(F.array(F.lit("k"), F.lit("v"), F.lit("odd"))), J.to_json(none), J.build_object()) == ('{"a":"q\\""}', '{"k":"v"}', "null", "{}")
    with pytest.raises(ValueError):
        J.build_object("a")
    with pytest.raises(Exception, match="one length"):
        one(J.object_of(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("c"))))
    d = F.lit('{"a":[1,2],"b":{"c":"x"}}')
    assert one(J.json_query(d, "$.a[*]"), J.json_query(d, "$.a[*]", "without", on_error='"e"'), J.json_query(d, "$.z", on_empty="[]"), J.json_value(d, "$.b", on_error="bad"), J.extract(d, "$.a[1]"), J.extract_path_text(d, "b", "c"), J.extract_path(d, "a", "-1")) == ("[1,2]", '"e"', "[]", "bad", "2", "x", "2")
    df = spark.createDataFrame([(1, '[{"x":1,"a":[1,2],"b":[]},{"x":2}]'), (2, None), (3, "[]")], "id int, d string")
    rows = J.json_table(df, "d", "$[*]", [("x", "int", "$.x"), ("nested", "$.a[*]", [("a", "int", "$")], "n"), ("nested", "$.b[*]", [("b", "int", "$")])], "pos").drop("d").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 1, 1, 1, None), (1, 1, 1, 2, 2, None), (1, 2, 2, None, None, None)]


def test_intervals_and_time(spark):
    one = lambda *c: tuple(spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(c)]).first())
    iv = D.interval(14, -3, 3_661_000_000)
    assert one(D.iv_text(iv), D.iv_text(D.interval()), D.iv_compare(D.interval(1), "=", D.interval(0, 30)), D.iv_trunc("year", iv)["months"], D.time_trunc("hour", F.lit(5 * D.HOUR + 7)), D.time_minus(F.lit(5), F.lit(7))["micros"]) == ("1 year 2 mons -3 days 01:01:01", "00:00:00", True, 12, 5 * D.HOUR, -2)
    df = spark.createDataFrame([("1 month",), ("2 days 01:00",), (None,)], "t string").select(D.parse_intervals(F.col("t")).alias("i"))
    r = df.agg(D.iv_sum(F.col("i")).alias("s"), D.iv_avg(F.col("i")).alias("a")).first()
    assert tuple(r["s"]) == (1, 2, D.HOUR) and tuple(r["a"]) == (0, 16, D.HOUR // 2)
    assert df.limit(0).agg(D.iv_sum(F.col("i")).alias("s"), D.iv_avg(F.col("i")).alias("a")).first()["s"] is None
    for bad in (D.parse_time(F.lit("25:00")), D.parse_time(F.lit("x")), D.iv_div(iv, 0), S.abs_(F.lit(-(2**63)).cast("long"))):
        with pytest.raises(Exception):
            one(bad)
    with pytest.raises(TypeError):
        D.add(F.current_timestamp(), 5)
    assert one(D.date_of(F.lit("now"), "text") == F.current_date(), D.datetime_of(F.lit(86400), "integer").cast("string"))[0]


def test_knn_batch_and_index(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 6)).round(1)
    x[:40] = x[0]  # equal vectors: ties by key
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(900, None, 0), (901, [None] * 6, 0), (902, [1.0], 0), (None, [0.0] * 6, 0)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g int").repartition(4)
    for metric in ("l2", "inner", "cosine"):
        got = {}
        for r in vector.knn_batch(df, df.where("id % 10 = 0"), "id", "v", 4, metric, block=16).collect():
            got.setdefault(r["query"], set()).add(r["id"])
        for q in range(0, 300, 10):
            want = sorted((vector._exact(metric, x[q], x[j]), j) for j in range(300) if j != q and (metric != "cosine" or np.any(x[j])) and (metric != "cosine" or np.any(x[q])))[:4]
            assert got[q] == {j for _, j in want}, (metric, q)
    assert vector.knn_batch(df, df.limit(0), "id", "v", 4).count() == 0
    ix = vector.build_ann(df.where("size(v) = 6"), "id", "v", "l2", ("g",))
    q = x[7].tolist()
    exact = [r["id"] for r in vector.top_k(df.where("size(v) = 6 AND NOT exists(v, y -> y IS NULL) AND id IS NOT NULL"), "v", q, 5, "l2", "id").collect()]
    assert [r["id"] for r in vector.ann_top_k(ix, q, 5, probes=64).collect()] == exact
    assert len(vector.ann_top_k(ix, q, 5, probes=1, where=F.col("g") == 2).collect()) == 5
    vector.ann_add(ix, spark.createDataFrame([(5000, q, 1)], df.schema))
    assert 5000 in [r["id"] for r in vector.ann_top_k(ix, q, 41, probes=64).collect()]


def test_memory_store(spark):
    m = memory_store.Memory(spark, embedder=memory_store.mock_embedder(8))
    m.create_region("Notes", 8)
    with pytest.raises(ValueError):
        m.create_region("notes", 9)
    texts = spark.createDataFrame([(2, "a b"), (1, "a b c"), (3, "z"), (4, "")], "n int, text string")
    new = m.remember_batch("notes", texts, [F.col("n")]).orderBy("id").collect()
    assert [r["text_content"] for r in new] == ["a b c", "a b", "z", ""] and [sum(r["embedding"]) for r in new] == [3, 2, 1, 0]
    assert m.remember("NOTES", "later", kind="plan").first()["id"] == 5
    assert m.fetch_last("notes", "fact").first()["id"] == 4 and m.count("notes", "plan").first()["n"] == 1 and m.fetch_one("notes", 9).count() == 0
    edge = lambda *rows: spark.createDataFrame(list(rows), "src_id long, dst_id long, kind string, weight double")
    m.link(edge((1, 2, "depends_on", 0.5), (2, 1, "causes", 0.1)))
    m.link(edge((1, 2, "depends_on", 0.9)))
    assert m.fetch_edges(src=1).first()["weight"] == 0.9 and m.fetch_edges(kind="causes").count() == 1
    with pytest.raises(memory_store.CycleError):
        m.link(edge((2, 3, "depends_on", 1.0), (3, 1, "depends_on", 1.0)))
    assert m.edges.count() == 2
    edges, scores = m.evolve("notes", spark.createDataFrame([(1,)], "id long"), 1, 0.9, 4_000_000_000_000_000)
    assert [(r["src_id"], r["dst_id"]) for r in edges.collect()] == [(1, 2)] and scores.count() == 1
    m.drop_region("notes")
    assert m.atoms.count() == 0 and m.edges.count() == 0
    with pytest.raises(KeyError):
        m.region("notes")
    assert memory_store.acyclic(edge((1, 2, "x", 0.0), (2, 3, "x", 0.0))) and not memory_store.acyclic(edge((1, 1, "x", 0.0)))
    cands = spark.createDataFrame([(1, "x", 0.9), (2, "x x", 0.5), (3, None, 0.7)], "id long, text_content string, fused double")
    count = lambda q, ps: [float(p.count("x")) for p in ps]
    assert [r["id"] for r in memory_store.rerank(cands, "q", count, 2).collect()] == [2, 1]
    assert [r["id"] for r in memory_store.rerank(cands, "q", count, 3, "rrf").collect()] == [1, 2, 3]
    assert memory_store.rerank(cands.limit(0), "q", count, 2).count() == 0
    atoms = spark.createDataFrame([(i, 1 if i < 8 else None, i % 4 == 0, i) for i in range(10)], "id long, region_id long, fixed boolean, access_count long").selectExpr("id", "region_id", "CAST(fixed AS LONG) AS immutable", "access_count", "CAST(NULL AS TIMESTAMP_NTZ) AS accessed_at")
    kept, gone = memory.evict(atoms, "lru", keep_fraction=0.5)
    assert sorted(r["id"] for r in gone.collect()) == [1, 2, 3] and kept.count() == 7


def test_catalog_rules_and_triggers(spark):
    c = Catalog(spark)
    c.create("p", spark.createDataFrame([(1,), (2,)], "k long"), Constraints(primary_key=("k",)))
    c.create("q", spark.createDataFrame([(10, 1)], "id long, k long"), Constraints(primary_key=("id",), foreign=[ForeignKey("k", "p", "k", "cascade", deferred=True)], generated={"twice": ("id * 2", True)}))
    with pytest.raises(ConstraintError):
        c.insert("p", spark.createDataFrame([(1,)], "k long"))
    with pytest.raises(ConstraintError):
        c.insert("p", spark.createDataFrame([(None,)], "k long"))
    with pytest.raises(ConstraintError):
        c.insert("q", spark.createDataFrame([(11, 9)], "id long, k long"))
    c.begin()
    c.insert("q", spark.createDataFrame([(11, 9)], "id long, k long"))
    with pytest.raises(ConstraintError):
        c.commit()
    c.insert("p", spark.createDataFrame([(9,)], "k long"))
    c.commit()
    assert sorted(r["twice"] for r in c.tables["q"].collect()) == [20, 22]
    c.delete("p", F.col("k") == 9)
    assert [r["id"] for r in c.tables["q"].collect()] == [10]
    seen = []
    c.create_trigger("p", dml.Trigger("t", "delete", lambda old, new: seen.append(sorted(r["k"] for r in old.collect()))))
    c.create("deep", spark.createDataFrame([], "k long"))
    c.create_trigger("deep", dml.Trigger("deep", "insert", lambda old, new: c.insert("deep", spark.range(1).withColumnRenamed("id", "k")), "after"))
    c.delete("p", F.col("k") == 2)
    assert seen == [[2]]
    with pytest.raises(RecursionError):
        c.insert("deep", spark.createDataFrame([(100,)], "k long"))
    assert c.tables["deep"].count() == dml.MAX_DEPTH + 1
    c.drop_trigger("deep", "deep")
    assert c.list_triggers("p").count() == 1 and c.list_triggers("deep").count() == 0
    c.create_view("v", "SELECT k FROM p")
    c.begin("s")
    c.drop_view("v")
    c.rollback("s")
    assert c.execute("SELECT count(*) AS n FROM v").first()["n"] >= 1
    with pytest.raises(ValueError):
        c.create_matview("m", "SELECT now() AS t")
    assert list(statements("SELECT ';' AS a; -- x;y\nSELECT 2 /* ; */;")) == ["SELECT ';' AS a", "-- x;y\nSELECT 2 /* ; */"]
    assert c.prepare("SELECT $2 AS b, $1 AS a, '$1' AS t")(1, 2).first().asDict() == {"b": 2, "a": 1, "t": "$1"}


def test_dml_on_repeated_and_null_keys(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    s = spark.createDataFrame([(2, "z"), (2, "b"), (None, "n"), (None, "m")], "k int, v string").repartition(3)
    assert sorted(map(tuple, dml.upsert_do_nothing(t, s, ["k"])[0].collect()), key=repr) == sorted([(1, "a"), (2, "b"), (None, "n"), (None, "m")], key=repr)
    a = spark.createDataFrame([(i, f"v{i}") for i in range(200)], "k int, v string")
    b = a.where("k <> 5").withColumn("v", F.when(F.col("k") == 7, "new").otherwise(F.col("v"))).unionByName(spark.createDataFrame([(500, None)], a.schema))
    delta = dml.merkle_diff(a, b, ["k"], 64)
    assert sorted(map(tuple, delta.collect()), key=repr) == sorted([(5, "delete", "v5"), (7, "update", "new"), (500, "insert", None)], key=repr)
    assert sorted(map(tuple, dml.patch(a, delta, ["k"]).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    assert dml.merkle_diff(a, a, ["k"]).count() == 0 and dml.merkle_diff(a.limit(0), a.limit(0), ["k"]).count() == 0


def test_sinks(spark):
    df = spark.createDataFrame([(1, 'a,"b"', None), (2, None, 1.5)], "id long, t string, x double")
    assert sinks.render(df, "csv") == 'id,t,x\n1,"a,""b""",NULL\n2,NULL,1.5'
    assert sinks.render(df, "line").splitlines()[:3] == ["id = 1", ' t = a,"b"', " x = NULL"]
    assert sinks.render(df, "box").splitlines()[0].startswith("┌") and sinks.render(df, "table").endswith("(2 rows)")
    assert sinks.render(df.limit(0), "json") == "[]" and '"x": null' in sinks.render(df, "json")
    assert [r["line"] for r in sinks.inserts(df, "t").collect()] == ["INSERT INTO t (id, t, x) VALUES (1, 'a,\"b\"', NULL);", "INSERT INTO t (id, t, x) VALUES (2, NULL, 1.5);"]
    assert [r["id"] for r in sinks.cursor(df)] == [1, 2]
    with pytest.raises(ValueError):
        sinks.render(df, "xml")
