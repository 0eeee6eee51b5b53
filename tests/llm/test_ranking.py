import math
import random

from tidewell import session
from tidewell.llm import fusion_rank, topn


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merge_runs_against_sorting():
    rng = random.Random(5)
    for _ in range(60):
        runs, every = [], set()
        for _ in range(rng.randint(1, 9)):
            run = sorted((rng.randint(0, 4), float(rng.randint(0, 6)), rng.randint(0, 30)) for _ in range(rng.randint(0, 40)))
            every |= set(run)
            runs.append(tuple(map(list, zip(*run))) if run else ([], [], []))
        n = rng.randint(1, 5)
        g, k, i, r = topn.merge_runs(runs, n)
        want = [(a, b, c, at) for grp in sorted({x[0] for x in every}) for at, (a, b, c) in enumerate(sorted(x for x in every if x[0] == grp)[:n], 1)]
        assert list(zip(g, k, i, r)) == want


def test_top_n_dirty_rows_ties_and_skew(spark):
    rng = random.Random(1)
    data = [(1, float(rng.randint(0, 50)), i, "x") for i in range(3000)]  # a hot group
    data += [(2, 1.0, 7, "a"), (2, 1.0, 3, "b"), (2, 1.0, 3, "b"), (2, None, 1, "c"), (2, math.nan, 2, "d"), (None, 5.0, 9, "e"), (3, -0.0, 2, "f"), (3, 0.0, 1, "g"), (4, None, 1, "h")]
    df = spark.createDataFrame(data, "g long, rank double, bucket long, run string").repartition(7)
    got = topn.top_n_per_group(df, "g", "rank", "bucket", 3, fan_in=2).collect()
    by = {}
    for g, i, s, r in sorted(map(tuple, got), key=lambda x: (x[0], x[3])):
        by.setdefault(g, []).append(i)
    hot = [i for _, i in sorted((-s, i) for g, s, i, _ in data if g == 1)][:3]
    assert by == {1: hot, 2: [3, 7], 3: [1, 2]}
    empty = spark.createDataFrame([], df.schema)
    assert topn.top_n_per_group(empty, "g", "rank", "bucket").count() == 0


def test_top_n_string_keys(spark):
    df = spark.createDataFrame([("ä", 1.0, "b"), ("ä", 1.0, "a"), ("z", 2.0, "c")], "g string, s double, i string")
    assert [(r[0], r[1], r[3]) for r in topn.top_n_per_group(df, "g", "s", "i", 1).orderBy("g").collect()] == [("z", "c", 1), ("ä", "a", 1)]


def brute_rank(items, weights):
    """items: {id: [scores]}; larger is better; None is worst."""
    n = len(weights)
    ranks = {}
    for s in range(n):
        v = {i: (-math.inf if x[s] is None or math.isnan(x[s]) else x[s]) for i, x in items.items()}
        for i in v:
            better = sum(v[j] > v[i] for j in v)
            same = sum(v[j] == v[i] for j in v)
            ranks.setdefault(i, []).append(better + (same + 1) / 2)
    out = []
    for i, r in ranks.items():
        order, total, acc, med = sorted(zip(r, weights)), sum(weights), 0.0, None
        for x, w in order:
            acc += w
            if med is None and w > 0 and acc >= total / 2 - 1e-9:
                med = x
        out.append((med, round(sum(x * w for x, w in zip(r, weights)) / total, 9), i))
    return [i for _, _, i in sorted(out)]


def test_median_rank_against_brute_force(spark):
    rng = random.Random(3)
    data, queries = [], {}
    for q in range(6):
        for i in range(rng.randint(1, 40) if q else 400):
            sc = [rng.choice([None, math.nan, float(rng.randint(0, 8)) * 10**s]) for s in range(3)]
            queries.setdefault(q, {})[i] = sc
            data.append((q, i, *sc))
    data += data[:5]
    w = {0: [0.5, 0.3, 0.2], 1: [0.0, 0.0, 0.0], 2: [None, 0.7, 0.3], 3: [1.0, 1.0, 1.0], 4: [0.1, 0.8, 0.1]}
    df = spark.createDataFrame(data, "q long, i long, a double, b double, c double")
    wd = spark.createDataFrame([(q, *x) for q, x in w.items()], "q long, a double, b double, c double")
    out = fusion_rank.median_rank(df, "q", "i", ["a", "b", "c"], wd)
    for q, items in queries.items():
        x = [v or 0.0 for v in w.get(q, [1.0] * 3)]
        x = x if sum(x) else [1.0] * 3
        assert [r["i"] for r in out.where(f"q = {q}").orderBy("place").collect()] == brute_rank(items, x)
    top = fusion_rank.median_rank(df, "q", "i", ["a", "b", "c"], wd, 2)
    assert rows(top.select("q", "i", "place")) == rows(out.where("place <= 2").select("q", "i", "place"))
    assert fusion_rank.median_rank(df.limit(0), "q", "i", ["a", "b", "c"], wd).count() == 0


def test_hot_groups_rank_alike(spark, monkeypatch):
    r = random.Random(8)
    rows = [(r.choice([1, 1, 1, 2, 3]), i, r.choice([None, float("nan"), 1.0, 2.0, 3.5]), float(r.randint(0, 9))) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:20], "q long, i long, a double, b double").repartition(5)
    w = spark.createDataFrame([(1, 0.3, 0.7), (2, None, None)], "q long, a double, b double")
    ways = []
    for hot in (10**9, 50):
        monkeypatch.setattr(session, "HOT_ROWS", hot)
        ways.append([{tuple(x) for x in fusion_rank.median_rank(df, "q", "i", ["a", "b"], w, top).collect()} for top in (None, 3)])
    assert ways[0] == ways[1] and len(ways[0][0]) == 300 and len(ways[0][1]) == 9


def test_recall_signals(spark):
    df = spark.createDataFrame([(1, 1, 9999.0, -1.0, -1.0, 1_700_000_000.0), (1, 2, 0.5, 0.0, 2.0, 1_700_000_000_000.0), (1, 3, None, math.nan, None, 0.0)], "query_id long, atom_id long, dist double, text_rank double, importance double, created_micros double")
    got = {r["atom_id"]: r for r in fusion_rank.recall_signals(df).collect()}
    assert got[1]["semantic"] is None and got[1]["keyword"] is None and got[1]["importance"] is None
    assert got[1]["recency"] == got[2]["recency"] == 1.7e15
    assert got[2]["semantic"] == -0.5 and got[3]["recency"] is None
    q = spark.createDataFrame([(1, None, None, None, None), (2, None, 0.4, 0.3, 0.3)], "query_id long, semantic double, keyword double, recency double, importance double")
    w = {r["query_id"]: r for r in fusion_rank.recall_weights(q).collect()}
    assert w[1]["semantic"] == 0.45 and w[2]["semantic"] is None
