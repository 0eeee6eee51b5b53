"""References to records that do not exist (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.orphans import Parent, Reference, cascade, report
from tidewell.plans.registry import query
from tidewell.session import configure, table

EDGE_KEY = ("src_id", "dst_id", "kind")
#: Edge kinds whose source record depends on the target record.
DEPENDS = ("derived_from", "depends_on")

_FOUND = """
WITH a AS (SELECT id, max(ingested_at) AS stored FROM atoms GROUP BY id),
f AS (SELECT atom_id AS id, max(forgotten_at) AS gone FROM forgotten_atoms GROUP BY atom_id),
e AS (SELECT DISTINCT src_id, dst_id, kind, linked_at FROM memory_edges),
x AS (SELECT src_id AS ref, 'src' AS side, e.* FROM e UNION ALL SELECT dst_id, 'dst', e.* FROM e)
SELECT DISTINCT src_id, dst_id, kind, side, linked_at FROM x LEFT JOIN a ON x.ref = a.id LEFT JOIN f ON x.ref = f.id
WHERE ref IS NOT NULL AND (a.id IS NULL OR gone >= stored OR stored > linked_at)"""


def edge_references(spark: SparkSession, d: str) -> list[Reference]:
    edges = table(spark, d, "memory_edges").select(*EDGE_KEY, "linked_at")
    atoms = Parent("atoms", table(spark, d, "atoms").select("id", "ingested_at"), "id", "ingested_at", table(spark, d, "forgotten_atoms"), "atom_id", "forgotten_at")
    return [Reference("memory_edges", edges, f"{side}_id", atoms, EDGE_KEY, side, "linked_at") for side in ("src", "dst")]


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans of the whole foreign-key graph.

    Atoms refer to their region and, by the edges that say so, to the atoms
    they depend on; edges refer to both their ends.
    """
    configure(spark)
    refs = edge_references(spark, d)
    atoms, edges = refs[0].parent, refs[0].rows
    regions = Parent("memory_regions", table(spark, d, "memory_regions").select("id"), "id")
    own = table(spark, d, "atoms").select("id", "region_id", "created_at").distinct()
    refs.append(Reference("atoms", own, "region_id", regions, ("id",), "region", "created_at"))
    for kind in DEPENDS:
        rows = edges.where(F.col("kind") == kind).select(F.col("src_id").alias("id"), F.col("dst_id").alias("parent"), "linked_at")
        refs.append(Reference("atoms", rows, "parent", atoms, ("id", "parent"), kind, "linked_at"))
    return cascade(refs)


def _edges_direct(spark: SparkSession, d: str) -> DataFrame:
    """Level 0 of the cascade for edges: the orphans that problem 4 asks for."""
    return orphans(spark, d).where("tbl = 'memory_edges' AND origin = 'direct'")


@query(f"SELECT src_id, dst_id, kind, side FROM ({_FOUND})")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    key = F.from_json("record", "k0 long, k1 long, k2 string")
    return _edges_direct(spark, d).select(key.alias("k"), "side").select(F.col("k.k0").alias("src_id"), F.col("k.k1").alias("dst_id"), F.col("k.k2").alias("kind"), "side")


@query(f"SELECT 'memory_edges' AS tbl, side, date_trunc('month', linked_at) AS period, 'direct' AS origin, count(*) AS n FROM ({_FOUND}) GROUP BY ALL")
def p4_by_period(spark: SparkSession, d: str) -> DataFrame:
    return report(_edges_direct(spark, d))


@query(
    f"""
WITH RECURSIVE fnd AS MATERIALIZED ({_FOUND}),
d AS (SELECT DISTINCT a.id, CASE WHEN r.id IS NULL THEN 1 ELSE 0 END AS bad, a.created_at AS made FROM atoms a LEFT JOIN memory_regions r ON a.region_id = r.id WHERE a.region_id IS NOT NULL),
l AS (SELECT DISTINCT src_id AS id, dst_id AS parent, kind, linked_at AS made FROM memory_edges WHERE kind IN ('derived_from', 'depends_on')),
walk AS (
  SELECT id, CAST(NULL AS BIGINT) AS via FROM d WHERE bad = 1
  UNION SELECT src_id, dst_id FROM fnd WHERE side = 'dst' AND kind IN ('derived_from', 'depends_on')
  UNION SELECT l.id, l.parent FROM walk JOIN l ON l.parent = walk.id),
bad AS (SELECT DISTINCT id FROM walk),
e AS (SELECT DISTINCT src_id, dst_id, kind, linked_at FROM memory_edges),
rows_ AS (
  SELECT 'atoms' AS tbl, 'region' AS side, CAST(id AS VARCHAR) AS rec, made, 'direct' AS origin FROM d WHERE bad = 1
  UNION SELECT 'atoms', kind, concat(src_id, ',', dst_id), linked_at, 'direct' FROM fnd WHERE side = 'dst' AND kind IN ('derived_from', 'depends_on')
  UNION SELECT 'atoms', kind, concat(l.id, ',', l.parent), l.made, 'inherited' FROM l JOIN bad ON l.parent = bad.id
    WHERE NOT EXISTS (SELECT 1 FROM fnd f WHERE f.side = 'dst' AND f.src_id = l.id AND f.dst_id = l.parent AND f.kind = l.kind)
  UNION SELECT 'memory_edges', side, concat(src_id, ',', dst_id, ',', kind), linked_at, 'direct' FROM fnd
  UNION SELECT 'memory_edges', 'src', concat(e.src_id, ',', e.dst_id, ',', e.kind), e.linked_at, 'inherited' FROM e JOIN bad ON e.src_id = bad.id
    WHERE NOT EXISTS (SELECT 1 FROM fnd f WHERE f.side = 'src' AND f.src_id = e.src_id AND f.dst_id = e.dst_id AND f.kind = e.kind)
  UNION SELECT 'memory_edges', 'dst', concat(e.src_id, ',', e.dst_id, ',', e.kind), e.linked_at, 'inherited' FROM e JOIN bad ON e.dst_id = bad.id
    WHERE NOT EXISTS (SELECT 1 FROM fnd f WHERE f.side = 'dst' AND f.src_id = e.src_id AND f.dst_id = e.dst_id AND f.kind = e.kind))
SELECT tbl, side, date_trunc('month', made) AS period, origin, count(*) AS n FROM rows_ GROUP BY ALL"""
)
def p4_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table, side and month."""
    return report(orphans(spark, d))
