"""Numbering and running totals without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import materialise


def running_total(df: DataFrame, group: list[str], order: list[Column], amount: str, out: str) -> DataFrame:
    """Sum of ``amount`` up to and with each row, within group, in order.

    The order must be total inside a group.  Rows are range-partitioned by
    group and order, each partition counts its own part, and a small table of
    part totals gives the offsets, so that a group (or the whole table, with
    no group) spans many tasks.  The sorted rows are written with their
    partition number, because a range partitioning made twice may cut at other
    places.
    """
    parts = df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("__part", F.spark_partition_id())
    parts = materialise(parts, "ranges")
    inside = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = parts.groupBy(*group, "__part").agg(F.sum(amount).alias("__t"))
    key = group or ["__all"]
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # A row a partition and group: the rows of one group are as many as partitions.
    offsets = totals.withColumn("__all", F.lit(0)).select(*group, "__part", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"))
    local = parts.withColumn("__in", F.sum(amount).over(inside))
    return local.join(offsets.select(*[F.col(c).alias(f"__o_{c}") for c in [*group, "__part"]], "__off"), _same(group), "inner").withColumn(out, F.col("__in") + F.col("__off")).drop("__in", "__off", "__part", *[f"__o_{c}" for c in [*group, "__part"]])


def _same(group: list[str]) -> Column:
    cond = F.col("__part") == F.col("__o___part")
    for c in group:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    return cond


def number_rows(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """ROW_NUMBER() OVER (ORDER BY ...) of a whole table; the order must be total."""
    return running_total(df.withColumn("__one", F.lit(1).cast("long")), [], order, "__one", out).drop("__one")


def ranked(df: DataFrame, group: list[str], value: str, rank: str, dense: str, descending: bool = False) -> DataFrame:
    """``df`` with RANK and DENSE_RANK by ``value`` inside each group, however few and large the groups are.

    The distinct values are counted before the shuffle and numbered by ranges;
    NULL is the least value.
    """
    by = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    values = df.groupBy(*group, value).agg(F.count("*").alias("__n")).withColumn("__one", F.lit(1).cast("long"))
    places = running_total(values, group, [by], "__n", "__upto")
    places = running_total(places, group, [by], "__one", dense).select(*group, value, (F.col("__upto") - F.col("__n") + 1).alias(rank), dense)
    keys = [*group, value]
    renamed = places.select(*[F.col(c).alias(f"__p_{c}") for c in keys], rank, dense)
    cond = None
    for c in keys:
        eq = F.col(c).eqNullSafe(F.col(f"__p_{c}"))
        cond = eq if cond is None else cond & eq
    return df.join(renamed, cond).drop(*[f"__p_{c}" for c in keys])


def sliding(df: DataFrame, group: list[str], order: list[Column], preceding: int, following: int, aggregates: dict[str, Column], size: int = 100_000) -> DataFrame:
    """Window aggregates over ROWS BETWEEN ``preceding`` AND ``following`` with bounded tasks.

    Rows are numbered by ranges and cut into blocks of ``size``; the rows that
    frames of a neighbouring block reach are copied to it.  The order must be
    total inside a group; a frame may reach at most one block further.
    """
    if max(preceding, following) > size:
        raise ValueError("a frame must not be longer than a block")
    n = running_total(df.withColumn("__one", F.lit(1).cast("long")), group, order, "__one", "__i").drop("__one").withColumn("__i", F.col("__i") - 1)
    own = F.floor(F.col("__i") / size).cast("long")
    at = F.pmod(F.col("__i"), F.lit(size))
    blocks = F.array_compact(F.array(own, F.when((at < following) & (own > 0), own - 1), F.when(at >= size - preceding, own + 1)))
    cut = n.withColumn("__own", own).withColumn("__block", F.explode(blocks))
    w = Window.partitionBy(*group, "__block").orderBy("__i").rowsBetween(-preceding, following)
    for name, a in aggregates.items():
        cut = cut.withColumn(name, a.over(w))
    return cut.where(F.col("__own") == F.col("__block")).drop("__own", "__block", "__i")
