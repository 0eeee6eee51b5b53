"""DML as transforms of snapshots: each gives a new frame, and what RETURNING would."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(target: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, inserted rows)."""
    rows = source.select(*target.columns)
    return target.unionByName(rows), rows


def _first(source: DataFrame, keys: list[str], order: list[Column] | None) -> DataFrame:
    """The first row of each key; without an order, the least of its rows (by all columns), whatever their place.

    A key with a NULL clashes with none, so its rows all stay.
    """
    rest = [c for c in source.columns if c not in keys]
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    known = source.where(~null)
    if order is None and rest:
        first = known.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("__r")).select(*keys, "__r.*").select(*source.columns)
    elif order is None:
        first = known.dropDuplicates(keys)
    else:
        first = known.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *[F.col(c) for c in rest]))).where("__r = 1").drop("__r")
    return first.unionByName(source.where(null))


def upsert_do_nothing(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """ON CONFLICT DO NOTHING: the first source row of a new key is inserted."""
    new = _first(source, keys, order).join(target.select(*keys), keys, "left_anti").select(*target.columns)
    return target.unionByName(new), new


def upsert_do_update(target: DataFrame, source: DataFrame, keys: list[str], sets: dict[str, Callable[[Callable[[str], Column], Callable[[str], Column]], Column]], where=None, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """ON CONFLICT DO UPDATE: ``sets[column](old, excluded)`` gives the new value.

    One full join by key; ``where(old, excluded)`` may leave a row as it is.
    The second frame holds the inserted and updated rows.
    """
    s = _first(source, keys, order)
    old = lambda c: F.col(f"__t.{c}")
    new = lambda c: F.col(f"__s.{c}")
    cond = None
    for k in keys:
        cond = (old(k) == new(k)) if cond is None else cond & (old(k) == new(k))
    both = target.withColumn("__old", F.lit(True)).alias("__t").join(s.withColumn("__new", F.lit(True)).alias("__s"), cond, "full")
    clash = F.col("__old").isNotNull() & F.col("__new").isNotNull()
    if where is not None:
        clash = clash & F.coalesce(where(old, new), F.lit(False))
    cols = []
    for c in target.columns:
        kept = F.when(F.col("__old").isNull(), new(c)).otherwise(old(c))
        cols.append(F.when(clash, sets[c](old, new)).otherwise(kept).alias(c) if c in sets else kept.alias(c))
    out = both.select(*cols, (F.col("__old").isNull() | clash).alias("__changed"))
    return out.drop("__changed"), out.where("__changed").drop("__changed")


def update(target: DataFrame, sets: dict[str, Column], where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, RETURNING with structs ``old`` and ``new``); right sides see the old row."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    new = [F.when(hit, sets[c]).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in target.columns]
    changed = target.where(hit).select(F.struct(*target.columns).alias("old"), F.struct(*[sets.get(c, F.col(c)).alias(c) for c in target.columns]).alias("new"))
    return target.select(*new), changed


def delete(target: DataFrame, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return target.where(~hit), target.where(hit)


def truncate(target: DataFrame) -> DataFrame:
    return target.limit(0)


def check_violations(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which a CHECK is false (NULL passes)."""
    return df.where(~F.coalesce(check, F.lit(True)))


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; keys with a NULL never clash."""
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def fk_violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference has no parent (a NULL reference passes)."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti").select(*child.columns)


def fk_on_delete(child: DataFrame, column: str, deleted: DataFrame, key: str, action: str = "cascade", default=None) -> DataFrame:
    """The child after its parents ``deleted`` went: cascade, set_null, set_default or restrict."""
    gone = deleted.select(F.col(key).alias(column)).distinct()
    if action == "cascade":
        return child.join(gone, column, "left_anti").select(*child.columns)
    marked = child.join(gone.withColumn("__gone", F.lit(True)), column, "left")
    if action in ("restrict", "no_action"):
        if not marked.where("__gone").limit(1).isEmpty():
            raise ValueError("foreign key violation: the record is still referred to")
        return child
    new = F.when(F.col("__gone").isNotNull(), F.lit(default if action == "set_default" else None).cast(child.schema[column].dataType)).otherwise(F.col(column))
    return marked.withColumn(column, new).select(*child.columns)


def lww_merge(frames: list[DataFrame], keys: list[str], time: str, node: str, deleted: str | None = None) -> DataFrame:
    """Last writer wins: of each key the row with the latest time, then node; deleted ones drop out.

    A tombstone wins a tie in time.
    """
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    dead = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(F.col(time), dead, F.col(node))).alias("r")).select("r.*")
    return best.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else best


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``op`` insert, delete or update between two snapshots (update: the new row)."""
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*rest).alias("__a"))
    b = new.select(*keys, F.struct(*rest).alias("__b"))
    both = a.join(b, keys, "full").where(~F.col("__a").eqNullSafe(F.col("__b")))
    op = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull(), "delete").otherwise("update")
    return both.select(*keys, op.alias("op"), F.coalesce("__b", "__a").alias("r")).select(*keys, "op", *[F.col(f"r.{c}").alias(c) for c in rest])


def patch(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """A snapshot after the changes that ``diff`` found."""
    rest = [c for c in old.columns if c not in keys]
    kept = old.join(delta.select(*keys), keys, "left_anti").select(*old.columns)
    return kept.unionByName(delta.where("op <> 'delete'").select(*keys, *rest).select(*old.columns))


def merkle(df: DataFrame, keys: list[str], buckets: int = 4096) -> DataFrame:
    """(bucket, hash, n): what the rows of each bucket of keys hash to, whatever their order."""
    row = F.xxhash64(*[F.coalesce(F.to_json(F.struct(F.col(c).alias("c")), {"ignoreNullFields": "false"}), F.lit("")) for c in sorted(df.columns)])
    rows = df.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("bucket"), row.alias("h"))
    return rows.groupBy("bucket").agg(F.bit_xor("h").alias("hash"), F.count("*").alias("n"))


def merkle_diff(old: DataFrame, new: DataFrame, keys: list[str], buckets: int = 4096) -> DataFrame:
    """``diff`` of two snapshots that compares rows only in buckets whose hashes differ."""
    a, b = merkle(old, keys, buckets), merkle(new, keys, buckets)
    apart = a.join(b.select("bucket", F.col("hash").alias("h2"), F.col("n").alias("n2")), "bucket", "full").where(~(F.col("hash").eqNullSafe(F.col("h2")) & F.col("n").eqNullSafe(F.col("n2")))).select("bucket")
    few = F.broadcast(apart)  # at most as many rows as buckets
    mine = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).join(few, "bucket", "left_semi").select(*df.columns)
    return diff(mine(old), mine(new), keys)


@dataclass(frozen=True)
class Trigger:
    """What is done around a change.

    ``timing`` is before, after or instead_of, ``level`` row or statement.  A
    BEFORE ROW action gets (old, new) rows and gives the new rows that are to
    be stored; the others get the transition tables and give nothing that is
    kept.  ``when`` is a condition on the new (deleted: old) rows of a row
    trigger; the others are stored unchanged.
    """

    name: str
    event: str
    action: Callable[[DataFrame, DataFrame], DataFrame | None]
    timing: str = "after"
    level: str = "statement"
    when: Column | None = None


_depth = 0
MAX_DEPTH = 32


def _run(trigger: Trigger, old: DataFrame, new: DataFrame) -> DataFrame | None:
    global _depth
    if _depth >= MAX_DEPTH:
        raise RecursionError("triggers nest too deeply")
    _depth += 1
    try:
        return trigger.action(old, new)
    finally:
        _depth -= 1


def before_triggers(triggers: list[Trigger], old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(old, new rows to store, whether to store them) after BEFORE and INSTEAD OF triggers, in name order."""
    for t in sorted((t for t in triggers if t.timing == "before"), key=lambda t: t.name):
        if t.level == "statement":
            _run(t, old, new)
        elif t.event == "delete":
            _run(t, old if t.when is None else old.where(F.coalesce(t.when, F.lit(False))), new)
        else:
            hit = F.lit(True) if t.when is None else F.coalesce(t.when, F.lit(False))
            changed = _run(t, old, new.where(hit))
            if changed is not None:
                new = changed.select(*new.columns).unionByName(new.where(~hit))
    instead = sorted((t for t in triggers if t.timing == "instead_of"), key=lambda t: t.name)
    for t in instead:
        _run(t, old, new)
    return old, new, not instead


def after_triggers(triggers: list[Trigger], old: DataFrame, new: DataFrame) -> None:
    """AFTER triggers in name order; a row trigger gets the rows that its condition holds for, in one frame."""
    for t in sorted((t for t in triggers if t.timing == "after"), key=lambda t: t.name):
        if t.when is None or t.level == "statement":
            _run(t, old, new)
        elif t.event == "delete":
            _run(t, old.where(F.coalesce(t.when, F.lit(False))), new)
        else:
            _run(t, old, new.where(F.coalesce(t.when, F.lit(False))))


def run_triggers(triggers: list[tuple[str, Callable[[DataFrame, DataFrame], DataFrame | None]]], old: DataFrame, new: DataFrame) -> list[DataFrame]:
    """Statement triggers in name order over the transition tables; at most 32 deep."""
    return [r for name, f in sorted(triggers, key=lambda t: t[0]) if (r := _run(Trigger(name, "any", f), old, new)) is not None]
