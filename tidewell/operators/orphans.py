"""References to records that do not exist, direct and inherited.

A reference is orphaned *directly* when its parent is missing, was deleted
last at or after it was stored, or was stored only after the reference was
made.  A record whose parent is itself orphaned is orphaned by *inheritance*;
those are found by a fixpoint of semi-joins down the foreign-key graph.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import hot_keys, join_hot, materialise, read_all


@dataclass(frozen=True)
class Parent:
    """Records that others refer to.

    ``stored_at`` and ``deleted`` (with ``deleted_key``, ``deleted_at``) are
    optional; without them only missing records make orphans.
    """

    name: str
    rows: DataFrame
    key: str
    stored_at: str | None = None
    deleted: DataFrame | None = None
    deleted_key: str | None = None
    deleted_at: str | None = None


@dataclass(frozen=True)
class Reference:
    """``rows.column`` of table ``child`` names a key of ``parent``.

    ``key`` identifies a reference of the child; where the child is itself a
    parent, others refer to the key's first column.  ``made_at`` is when the reference
    was made, for late parents and for the report's period.
    """

    child: str
    rows: DataFrame
    column: str
    parent: Parent
    key: tuple[str, ...]
    side: str
    made_at: str | None = None
    kept: tuple[str, ...] = field(default=())


def parent_state(parent: Parent, asked: DataFrame) -> DataFrame:
    """For each asked (k, first_made): (k, reason, stored) of doubtful parents only.

    ``reason`` is missing, deleted, or NULL where only lateness is possible
    (some reference was made before ``stored``).
    """
    stored = F.max(parent.stored_at) if parent.stored_at else F.lit(None).cast("timestamp_ntz")
    kind = asked.schema["k"].dataType
    there = parent.rows.where(F.col(parent.key).isNotNull()).groupBy(F.col(parent.key).cast(kind).alias("k")).agg(stored.alias("stored"), F.lit(True).alias("there"))
    state = asked.join(there, "k", "left")
    gone: Column = F.lit(False)
    if parent.deleted is not None:
        last = parent.deleted.groupBy(F.col(parent.deleted_key).cast(kind).alias("k")).agg(F.max(parent.deleted_at).alias("gone_at"))
        state = state.join(last, "k", "left")
        gone = F.coalesce(F.col("gone_at") >= F.col("stored"), F.lit(False))
    reason = F.when(F.col("there").isNull(), "missing").when(gone, "deleted")
    return state.select("k", reason.alias("reason"), "stored", "first_made").where(F.col("reason").isNotNull() | (F.col("stored") > F.col("first_made"))).select("k", "reason", "stored")


def direct_orphans(ref: Reference) -> DataFrame:
    """Rows of ``ref`` whose parent is not there: (*key, *kept, side, made_at, reason).

    The references are first reduced to their distinct keys (combined before
    the shuffle, so a much-used key is one row), the doubtful ones found, and
    only then joined back; references to a hot key stay where they are and
    meet its one broadcast row.  A NULL reference refers to nothing and is no
    orphan; a NULL time settles no comparison.  Repeated rows count once.
    """
    made = F.col(ref.made_at) if ref.made_at else F.lit(None).cast("timestamp_ntz")
    names = list(dict.fromkeys([*ref.key, *ref.kept]))
    refs = ref.rows.where(F.col(ref.column).isNotNull()).select(*[F.col(c) for c in names], F.col(ref.column).alias("__k"), made.alias("__made"))
    asked = materialise(refs.groupBy(F.col("__k").alias("k")).agg(F.min("__made").alias("first_made"), F.count("*").alias("n")), "asked")
    hot = hot_keys(asked.select(F.col("k").alias("__k"), "n"), ["__k"])
    state = parent_state(ref.parent, asked.drop("n")).select(F.col("k").alias("__k"), "reason", F.col("stored").alias("__stored"))
    out = join_hot(refs, state, ["__k"], hot).where(F.col("reason").isNotNull() | (F.col("__stored") > F.col("__made")))
    return out.select(*names, F.lit(ref.side).alias("side"), F.col("__made").alias("made_at"), F.coalesce("reason", F.lit("late")).alias("reason")).dropDuplicates([*ref.key, "side"])


def _name(ref: Reference) -> Column:
    """What others call a child row: the first column of its key."""
    return F.col(ref.key[0]).cast("string")


def _keys(df: DataFrame, ref: Reference) -> Column:
    return F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(ref.key)]), {"ignoreNullFields": "false"})


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cascade(refs: list[Reference], max_rounds: int = 10_000) -> DataFrame:
    """All orphaned records: (tbl, side, record, made_at, origin, depth).

    ``record`` is the row's key as JSON.  ``origin`` is ``direct`` (depth 0) or
    ``inherited``; a row and side that is both counts as direct, and an
    inherited one has its least depth.  All references are written once, under
    the names of their record and parent; the state of a parent is asked once
    for all references to it.  Each round semi-joins the references with the
    records orphaned in the round before, and writes the newly orphaned ones;
    known records are taken out, so that a cycle ends.  The inherited rows
    themselves are made at the end.  More than ``max_rounds`` rounds raise an
    error.  Tables without references give no rows.
    """
    keys = ["__p", "__k"]
    parts = []
    for r in refs:
        rows = r.rows.where(F.col(r.column).isNotNull())
        made = F.col(r.made_at) if r.made_at else F.lit(None).cast("timestamp_ntz")
        parts.append(rows.select(F.lit(r.child).alias("tbl"), F.lit(r.side).alias("side"), _keys(rows, r).alias("record"), made.alias("made_at"), _name(r).alias("id"), F.lit(r.parent.name).alias("__p"), F.col(r.column).cast("string").alias("__k")))
    links = materialise(_union(parts), "links")
    asked = materialise(links.groupBy(*keys).agg(F.min("made_at").alias("first_made"), F.count("*").alias("n")), "asked")
    hot = hot_keys(asked, keys)
    states = []
    for parent in {r.parent.name: r.parent for r in refs}.values():
        mine = asked.where(F.col("__p") == parent.name).select(F.col("__k").alias("k"), "first_made")
        states.append(parent_state(parent, mine).select(F.lit(parent.name).alias("__p"), F.col("k").alias("__k"), "reason", "stored"))
    bad = join_hot(links, _union(states), keys, hot).where(F.col("reason").isNotNull() | (F.col("stored") > F.col("made_at")))
    direct = bad.select("tbl", "side", "record", "made_at", "id").dropDuplicates(["tbl", "side", "record"])
    direct = materialise(direct.withColumn("origin", F.lit("direct")).withColumn("depth", F.lit(0)), "orphans")
    both = sorted({r.child for r in refs} & {r.parent.name for r in refs})
    if not both:
        return direct.drop("id")
    links = links.where(F.col("__p").isin(both))
    steps = links.where(F.col("tbl").isin(both) & F.col("id").isNotNull()).select(*keys, F.col("tbl").alias("c"), F.col("id").alias("i"))
    named = direct.where(F.col("tbl").isin(both) & F.col("id").isNotNull())
    frontier = materialise(named.select(F.col("tbl").alias("__p"), F.col("id").alias("__k"), F.lit(1).alias("depth")).distinct(), "frontier")
    levels = [frontier]
    for depth in range(1, max_rounds + 1):
        reached = join_hot(steps, frontier.select(*keys), keys, hot).select(F.col("c").alias("__p"), F.col("i").alias("__k")).distinct()
        frontier = materialise(reached.join(read_all(levels).select(*keys), keys, "left_anti").withColumn("depth", F.lit(depth + 1)), "frontier")
        if frontier.isEmpty():
            break
        levels.append(frontier)
    else:
        raise RuntimeError(f"records are still orphaned after {max_rounds} rounds")
    rows = join_hot(links, read_all(levels), keys, hot).groupBy("tbl", "side", "record").agg(F.min("made_at").alias("made_at"), F.min("depth").alias("depth"))
    inherited = rows.join(direct.select("tbl", "side", "record"), ["tbl", "side", "record"], "left_anti").withColumn("origin", F.lit("inherited"))
    return direct.drop("id").unionByName(inherited)


def report(orphans: DataFrame, period: str = "month") -> DataFrame:
    """Orphans per table, side, period and origin: (tbl, side, period, origin, n)."""
    return orphans.groupBy("tbl", "side", F.date_trunc(period, F.col("made_at").cast("timestamp")).cast("timestamp_ntz").alias("period"), "origin").agg(F.count("*").alias("n"))
