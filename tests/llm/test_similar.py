import random
from collections import Counter

import numpy as np

from tidewell.llm import knn, neardup, queries


def brute(rows, regions, k):
    out = set()
    by = {}
    for i, r, v in {(i, r, None if v is None else tuple(v)) for i, r, v in rows}:
        dim, metric = regions[r]
        if v is None or len(v) != dim or any(x is None or np.isnan(x) for x in v) or not any(v):
            continue
        by.setdefault(r, []).append((i, np.array(v, np.float32).astype(float)))
    for r, xs in by.items():
        for i, x in xs:
            d = []
            for j, y in xs:
                if i != j:
                    m = regions[r][1]
                    v = np.linalg.norm(x - y) if m == "l2" else -(x @ y) if m == "inner" else 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y)
                    d.append((round(float(v), 9), j))
            out |= {(i, j) for _, j in sorted(d)[:k]}
    return out


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    regions = {1: (8, "cosine"), 2: (8, "l2"), 3: (4, "inner"), 4: (4, "l2")}
    rows = []
    for i in range(900):
        r = int(rng.choice([1, 2, 3], p=[0.6, 0.2, 0.2]))
        c = np.random.default_rng(int(rng.integers(40))).standard_normal(regions[r][0])
        rows.append((i, r, (c + 0.15 * rng.standard_normal(len(c))).tolist()))
    same = rng.standard_normal(8).tolist()
    rows += [(1000 + i, 1, same) for i in range(60)]  # copies under different ids
    rows += [(2000, 1, None), (2001, 1, [1.0]), (2002, 1, [0.0] * 8), (2003, 1, [float("nan")] * 8), (2004, 4, [1.0] * 4), (2005, 9, [1.0] * 4), (2006, 1, [None] * 8)]
    rows += rows[:20]
    a = spark.createDataFrame([(i, r, v, i) for i, r, v in rows], "id long, region_id long, embedding array<float>, near long").repartition(5)
    g = spark.createDataFrame([(r, d, m, r) for r, (d, m) in regions.items()], "id long, embedding_dim long, embedding_metric string, region long")
    want = brute([x for x in rows if x[1] in regions], regions, 5)
    whole = {(r["id"], r["near"]) for r in knn.nearest(a, g, 5).collect()}
    assert len(whole & want) >= 0.99 * len(want) and len(whole) == len(want)
    cells = {(r["id"], r["near"]) for r in knn.nearest(a, g, 5, cell=100).collect()}
    assert len(cells & want) >= 0.9 * len(want)
    assert {x for x in cells if x[0] >= 1000} == {x for x in want if x[0] >= 1000}
    assert knn.nearest(a.limit(0), g, 5).count() == 0 and knn.nearest(a, g.limit(0), 5).count() == 0


def test_cells_that_are_too_full_are_cut_again(spark):
    rng = np.random.default_rng(5)
    near = 0.01 * (np.repeat(rng.standard_normal((35, 6)), 20, 0) + 0.4 * rng.standard_normal((700, 6)))  # one clump, and far points that stretch the projections
    far = 100 * rng.standard_normal((30, 6))
    rows = [(i, 1, v.tolist()) for i, v in enumerate(np.concatenate((near, far)))]
    regions = {1: (6, "l2")}
    a = spark.createDataFrame(rows, "id long, region_id long, embedding array<float>").repartition(4)
    g = spark.createDataFrame([(1, 6, "l2")], "id long, embedding_dim long, embedding_metric string")
    want = brute(rows, regions, 5)
    got = {(r["id"], r["near"]) for r in knn.nearest(a, g, 5, cell=60).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert {i for i, _ in got} == {i for i, _ in want}


def test_samples_agree_as_weighted_jaccard():
    rng = np.random.default_rng(3)
    h = np.concatenate((np.arange(20), np.arange(10, 30))).astype(np.int64) * 7919
    w = np.concatenate((rng.random(20) + 0.5, rng.random(20) + 0.5))
    s = neardup.Sampler(h, w, np.array([0, 20]))
    hits = np.mean([len(set(s.draw(k).tolist())) == 1 for k in range(3000)])
    a, b = dict(zip(h[:20], w[:20])), dict(zip(h[20:], w[20:]))
    j = sum(min(a.get(x, 0), b.get(x, 0)) for x in {*a, *b}) / sum(max(a.get(x, 0), b.get(x, 0)) for x in {*a, *b})
    assert abs(hits - j) < 0.03


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(4)
    vocab = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(150):
        ws = r.choices(vocab, k=r.randint(8, 40))
        rows.append((len(rows), " ".join(ws), None))
        for _ in range(r.choice([0, 0, 1, 2])):
            x = ws[:]
            for _ in range(r.randint(0, 4)):
                x[r.randrange(len(x))] = r.choice(vocab)
            r.shuffle(x)
            rows.append((len(rows), " ".join(x[:3]).upper(), '{"a": "' + "-".join(x[3:]) + '"}'))
    rows += [(5000 + i, "hot text of many copies", f'{{"n": "{i % 40} {i % 7} z{i}"}}') for i in range(200)]  # many in one band
    rows += [(6000 + i, "the very same", None) for i in range(100)]  # equal bags
    rows += [(7000, None, None), (7001, "", ""), (7002, "!!", None), rows[3]]
    df = spark.createDataFrame(rows, "k long, text string, payload string").selectExpr("k AS input_id", "text", "payload", "1 AS total", "2 AS band").repartition(3)
    bags = {k: neardup.bag([a, b]) for k, a, b in rows}

    def sim(x: Counter, y: Counter) -> float:
        common = sum((x & y).values())
        return common / (sum(x.values()) + sum(y.values()) - common)

    keys = sorted(k for k, b in bags.items() if b)
    want = {(a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if sim(bags[a], bags[b]) >= 0.7}
    links, members = neardup.near_duplicates(df, "input_id", ["text", "payload"], wide=8)
    got = {tuple(x) for x in neardup.expand(links, members, largest=1000).collect()}
    assert not got - want and len(got) >= 0.995 * len(want)
    star = {tuple(x) for x in neardup.expand(links, members, largest=10).collect()}
    assert {(6000, 6000 + i) for i in range(1, 100)} <= star and star <= got
    group = {x["k"]: x["group_id"] for x in neardup.groups(links, members).collect()}
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(got):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert group == {k: root(k) for k in keys}
    links, members = neardup.near_duplicates(df.limit(0), "input_id", ["text", "payload"])
    assert links.count() == 0 and members.count() == 0


def test_frequent_words_shared_and_rare_ones_differing(spark):
    # a third of the rows: pairs have a plain share of exactly 0.7, but 0.34 under TF-IDF weights
    family = [(i, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 " + " ".join(f"own{i}x{j}" for j in range(3))) for i in range(200)]
    # another third, just below: 13 and 4 of 17
    below = [(1000 + i, "v0 v1 v2 v3 v4 v5 v6 v7 v8 v9 v10 v11 v12 " + " ".join(f"own{i}y{j}" for j in range(4))) for i in range(200)]
    other = [(2000 + i, " ".join(f"x{i}z{j}" for j in range(17))) for i in range(200)]
    df = spark.createDataFrame(family + below + other, "input_id long, text string").repartition(3)
    want = {(a, b) for a in range(200) for b in range(a + 1, 200)}
    for wide in (neardup.WIDE, 10_000):  # the exact way, and the bands alone
        links, _ = neardup.near_duplicates(df, "input_id", ["text"], wide=wide)
        got = {(r["a"], r["b"]) for r in links.collect()}
        assert not got - want and len(got) >= 0.995 * len(want)


def test_star_only_for_exact_copies(spark, tmp_path):
    ws = [f"w{i}" for i in range(12)]
    r = random.Random(5)
    rows = [(i, " ".join(r.sample(ws, 12)), None) for i in range(40)]  # one bag, other order
    rows += [(100 + i, " ".join(ws).upper(), f'{{"n{i}": 1}}'.replace(f"n{i}", "w0")) for i in range(70)]  # exact copies, near
    rows += [(200 + i, ", ".join(ws) + "!" * i, None) for i in range(40)]  # the same bag, punctuation
    rows += [(300, " ".join(ws[:11]), None), (301, " ".join(ws), ""), (302, " ".join(ws), None)]  # near; NULL is not empty
    df = spark.createDataFrame(rows, "input_id long, text string, payload string").repartition(3)
    df.write.parquet(str(tmp_path / "atom_inputs.parquet"))
    links, members = neardup.near_duplicates(df, "input_id", ["text", "payload"])
    got = {tuple(x) for x in neardup.expand(links, members).collect()}
    copies = set(range(101, 170))  # all but the first
    keys = sorted(k for k, _, _ in rows)
    bags = {k: neardup.bag([a, b]) for k, a, b in rows}
    near = {(a, b) for n, a in enumerate(keys) for b in keys[n + 1 :] if (bags[a] & bags[b]).total() >= 0.7 * (bags[a] | bags[b]).total()}
    assert got == {p for p in near if not copies & set(p)} | {(100, k) for k in copies}
    lead = {x["input_id"]: x["representative"] for x in queries.p6_members(spark, str(tmp_path)).collect()}
    assert lead == {k: 100 if k in copies else k for k in keys}
    assert {tuple(sorted((x, y))) for a, b in got for x in keys if lead[x] == a for y in keys if lead[y] == b if x != y} | {(x, y) for x in keys for y in keys if x < y and lead[x] == lead[y]} == near


def test_no_side_is_broadcast_by_estimate(spark):
    """Spark sizes an array of words as one element, and would send hundreds of MB through the driver."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice("abcdefgh") * 3 + str(r.randrange(4)) for _ in range(8)), None) for i in range(60)]
    rows += [(100 + i, rows[i][1] + " more", None) for i in range(20)] + [(200 + i, rows[i][1], None) for i in range(5)]
    df = spark.createDataFrame(rows, "input_id long, text string, payload string")
    store = spark._jsparkSession.sharedState().statusStore()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        before = store.executionsCount()
        links, members = neardup.near_duplicates(df, "input_id", ["text", "payload"], wide=2)
        assert neardup.expand(links, members).count() >= 25
        assert neardup.groups(links, members).count() == 85
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        plans = store.executionsList()
        done = [plans.apply(i).physicalPlanDescription() for i in range(plans.size()) if i >= before]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    done = [p.split("== Initial Plan ==")[0] for p in done]
    assert sum("SortMergeJoin" in p for p in done) >= 8
    sides = [p for p in done if "BroadcastExchange" in p]
    # Only the frequent words of wide bands, which their share of the records bounds, where the rarest are collected.
    assert all("ObjectHashAggregate" in p and p.count("BroadcastExchange") == 1 for p in sides) and len(sides) <= 1
