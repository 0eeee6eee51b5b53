from tidewell.plans import registry


def written(spark, folder, **tables):
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_not_in_is_not_broadcast(spark, tmp_path):
    parts = ("p_partkey long", [(1,), (2,), (2,), (3,), (None,)])
    lines = {"some": [(1, 40.0), (1, 50.0), (2, 10.0)], "hole": [(1, 40.0), (None, 31.0)], "unused_hole": [(1, 40.0), (None, 30.0)], "none": [(1, 30.0), (2, None)]}
    want = {"some": [2, 2, 3], "hole": [], "unused_hole": [2, 2, 3], "none": [1, 2, 2, 3, None]}
    for name, rows in lines.items():
        d = written(spark, tmp_path / name, part=parts, lineitem=("l_partkey long, l_quantity double", rows))
        out = registry.QUERIES["anti_not_in"](spark, d)
        assert sorted((r[0] for r in out.collect()), key=lambda x: (x is None, x)) == want[name]
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_lateral_comma_is_a_join_on_the_key(spark, tmp_path):
    customers = [(1, 10.0), (1, 10.0), (2, -20000.0), (3, None), (None, 1.0), (4, 10.0), (5, 2.0)]
    orders = [(10, 1, 500.0), (11, 1, 400.0), (12, 2, 7.0), (13, 3, 9.0), (14, None, 900.0), (15, 6, 900.0), (16, 5, None), (17, 5, 81.0)]
    d = written(spark, tmp_path, customer=("c_custkey long, c_acctbal double", customers), orders=("o_orderkey long, o_custkey long, o_totalprice double", orders))
    out = registry.QUERIES["lateral_comma"](spark, d)
    assert sorted(map(tuple, out.collect())) == [(1, 10, 500 / 20010), (1, 10, 500 / 20010), (2, 12, float("inf")), (5, 17, 81 / 20002)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Broadcast" not in plan
