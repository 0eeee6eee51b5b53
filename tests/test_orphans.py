import random
from datetime import datetime, timedelta

import pytest

from tidewell import session
from tidewell.operators.orphans import Parent, Reference, cascade, direct_orphans, report

T0 = datetime(2025, 1, 1)
DAY = timedelta(days=1)


def frames(spark, n=300, seed=1):
    r = random.Random(seed)
    atoms = [(i, T0 + r.randint(0, 60) * DAY, "x") for i in range(n) if i % 5]
    gone = [(r.randrange(n), T0 + r.randint(0, 60) * DAY) for _ in range(40)] + [(None, T0), (3, None)]
    edges = [(r.randrange(n) if r.random() < 0.7 else 5, r.randrange(n), r.choice("ab"), T0 + r.randint(0, 90) * DAY) for _ in range(800)]
    edges = list({e[:3]: e for e in edges}.values())
    edges += [(None, 7, "a", T0), (7, None, "a", T0), (8, 9, "z", None)]
    a = spark.createDataFrame(atoms + atoms[:9], "id long, ingested_at timestamp_ntz, side string")
    f = spark.createDataFrame(gone, "atom_id long, forgotten_at timestamp_ntz")
    e = spark.createDataFrame(edges + edges[:9], "src long, dst long, kind string, linked_at timestamp_ntz").selectExpr("*", "1 AS k", "'q' AS reason")
    return atoms, gone, edges, a, f, e


def bad(atoms, gone, ref, at):
    stored = dict(a[:2] for a in atoms).get(ref)
    if ref is None:
        return False
    last = max([t for i, t in gone if i == ref and t], default=None)
    return stored is None or (last is not None and last >= stored) or (at is not None and stored > at)


def test_direct_against_brute_force(spark):
    atoms, gone, edges, a, f, e = frames(spark)
    p = Parent("atoms", a, "id", "ingested_at", f, "atom_id", "forgotten_at")
    for side, at in (("src", 0), ("dst", 1)):
        out = direct_orphans(Reference("edges", e, side, p, ("src", "dst", "kind"), side, "linked_at")).collect()
        got = [(r["src"], r["dst"], r["kind"]) for r in out]
        want = {x[:3] for x in edges if bad(atoms, gone, x[at], x[3])}
        assert len(got) == len(set(got)) and set(got) == want
        assert direct_orphans(Reference("edges", e.limit(0), side, p, ("src", "dst", "kind"), side, "linked_at")).count() == 0
    none = Parent("atoms", a.limit(0), "id")
    assert direct_orphans(Reference("edges", e, "src", none, ("src", "dst", "kind"), "src")).count() == len({x[:3] for x in edges if x[0] is not None})


def test_cascade_follows_chains_and_cycles(spark):
    roots = spark.createDataFrame([(1,)], "id long")
    nodes = spark.createDataFrame([(10, 1, T0), (11, 2, T0), (12, None, T0)], "id long, root long, at timestamp_ntz")
    links = spark.createDataFrame([(20, 11), (21, 20), (22, 21), (20, 22), (30, 10)], "id long, parent long")
    r = Parent("roots", roots, "id")
    every = Parent("nodes", nodes.select("id").union(links.select("id")), "id")
    refs = [Reference("nodes", nodes, "root", r, ("id",), "root", "at"), Reference("nodes", links, "parent", every, ("id", "parent"), "parent")]
    out = cascade(refs)
    got = {(x["record"], x["origin"], x["depth"]) for x in out.collect()}
    assert got == {('{"k0":11}', "direct", 0), ('{"k0":20,"k1":11}', "inherited", 1), ('{"k0":21,"k1":20}', "inherited", 2), ('{"k0":22,"k1":21}', "inherited", 3), ('{"k0":20,"k1":22}', "inherited", 4)}
    assert {(x["origin"], x["n"]) for x in report(out).groupBy("origin").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {("direct", 1), ("inherited", 4)}


def test_hot_parents_and_the_cap(spark, monkeypatch):
    atoms, gone, edges, a, f, e = frames(spark, seed=2)
    p = Parent("atoms", a, "id", "ingested_at", f, "atom_id", "forgotten_at")
    ref = Reference("edges", e, "src", p, ("src", "dst", "kind"), "src", "linked_at")
    plain = {tuple(r) for r in direct_orphans(ref).collect()}
    monkeypatch.setattr(session, "HOT_ROWS", 3)
    assert {tuple(r) for r in direct_orphans(ref).collect()} == plain and plain
    chain = spark.createDataFrame([(i + 1, i) for i in range(6)] + [(20 + i, 6) for i in range(9)], "id long, parent long")
    every = Parent("nodes", chain.select("id"), "id")
    refs = [Reference("nodes", chain, "parent", every, ("id", "parent"), "parent")]
    got = sorted((r["depth"], r["record"]) for r in cascade(refs).collect())
    assert [d for d, _ in got] == [0, 1, 2, 3, 4, 5, *[6] * 9]
    with pytest.raises(RuntimeError):
        cascade(refs, max_rounds=2)
    assert cascade([Reference("nodes", chain.limit(0), "parent", every, ("id", "parent"), "parent")]).count() == 0
    assert session.release(spark) > 0
