"""One ranking from several differently scaled scores: median rank aggregation.

Every item's rank in each score depends only on order, so no score counts more
for its range.  Items are ordered by weighted median rank, then weighted mean
rank, then identifier.

A group that fits a task is ranked by windows after one shuffle.  The ranks of
a hot group, found by a count, are made without ever giving it to one task: the
distinct values (combined before the shuffle) are range-partitioned by group
and value, each partition counts its own part, and a small table of part totals
gives the offsets.  Both ways give equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.ranges import running_total
from tidewell.session import hot_keys, join_checked

#: Weights that hold where a query has none (fixed values).
DEFAULT_WEIGHTS = {"semantic": 0.45, "keyword": 0.2, "recency": 0.2, "importance": 0.15}
#: A logged distance from here on means that there was none (fixed value).
NO_DISTANCE = 9999.0


def average_ranks(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """``rows`` with ``rank`` by value descending; equal values share their mean rank."""
    values = rows.groupBy(*group, value).agg(F.count("*").alias("__n"))
    ranked = running_total(values, group, [F.col(value).desc()], "__n", "__upto")
    ranked = ranked.select(*group, value, (F.col("__upto") - (F.col("__n") - 1) / 2.0).alias("rank"))
    return rows.join(ranked, [*group, value])


def window_ranks(base: DataFrame, group: str, signals: list[str]) -> DataFrame:
    """``base`` with ``__r0``, ``__r1``, ...: the ranks in each signal, equal values sharing their mean rank."""
    out = base
    for i, s in enumerate(signals):
        w = Window.partitionBy(group).orderBy(F.col(s).desc())
        upto = F.count("*").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn(f"__r{i}", (F.rank().over(w) + upto) / 2.0)
    return out


def weighted_median(pairs: Column) -> Column:
    """Least rank at which the weights of an array<struct<rank, w>> reach half."""
    ordered = F.array_sort(pairs)
    total = F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["w"])
    start = F.struct(F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("rank"))

    def step(acc: Column, x: Column) -> Column:
        w = acc["w"] + x["w"]
        reached = F.when(acc["rank"].isNull() & (x["w"] > 0) & (w >= total / 2 - 1e-9), x["rank"]).otherwise(acc["rank"])
        return F.struct(w.alias("w"), reached.alias("rank"))

    return F.aggregate(ordered, start, step)["rank"]


def median_rank(scores: DataFrame, group: str, item: str, signals: list[str], weights: DataFrame, top: int | None = None) -> DataFrame:
    """One order of the items of each group: (group, item, median_rank, mean_rank, place).

    ``scores`` has one double column a signal, larger is better; NULL or NaN
    is the worst of its group.  ``weights`` has one row a group with a column
    of the signal's name: NULL, NaN or negative counts as 0, and a group that
    has no row or only zeros gets equal weights.  Repeated rows count once;
    rows whose group or item is NULL are left out; an empty table gives no
    rows.  With ``top`` only the first places come out, cut before the shuffle.
    """
    worst = F.lit(float("-inf"))
    clean = [F.when(F.col(s).isNull() | F.isnan(s), worst).otherwise(F.col(s) + F.lit(0.0)).alias(s) for s in signals]
    rows = scores.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item, *clean)
    w = weights.select(F.col(group), *[F.col(s).cast("double").alias(f"__w{i}") for i, s in enumerate(signals)]).dropDuplicates([group])
    hot = hot_keys(rows.groupBy(group).agg(F.count("*").alias("n")), [group])

    def scored(ranked: DataFrame) -> DataFrame:
        both = join_checked(ranked, w, group, "left")
        ws = [F.when((F.col(f"__w{i}") > 0) & ~F.isnan(f"__w{i}"), F.col(f"__w{i}")).otherwise(0.0) for i in range(len(signals))]
        total = sum(ws[1:], ws[0])
        ws = [F.when(total > 0, x).otherwise(1.0) for x in ws]
        pairs = F.array(*[F.struct(F.col(f"__r{i}").alias("rank"), ws[i].alias("w")) for i in range(len(signals))])
        mean = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["rank"] * x["w"]) / F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["w"])
        return both.select(group, item, weighted_median(pairs).alias("median_rank"), F.round(mean, 9).alias("mean_rank"))

    place = F.row_number().over(Window.partitionBy(group).orderBy("median_rank", "mean_rank", item))
    cold = rows if hot is None else rows.join(F.broadcast(hot), group, "left_anti")
    out = scored(window_ranks(cold.repartition(group).distinct(), group, signals)).withColumn("place", place)
    out = out if top is None else out.where(F.col("place") <= top)
    if hot is None:
        return out
    base = rows.join(F.broadcast(hot), group, "left_semi").distinct()
    long = base.select(group, item, F.explode(F.array(*[F.struct(F.lit(i).alias("signal"), F.col(s).alias("v")) for i, s in enumerate(signals)])).alias("x")).select(group, item, "x.*")
    ranked = average_ranks(long, [group, "signal"], "v").groupBy(group, item).agg(*[F.max(F.when(F.col("signal") == i, F.col("rank"))).alias(f"__r{i}") for i in range(len(signals))])
    big = scored(ranked)
    if top is not None:  # cut before the shuffle, so a hot group sends few rows
        return out.unionByName(big.withColumn("place", place).where(F.col("place") <= top))
    one = running_total(big.withColumn("__one", F.lit(1)), [group], [F.col("median_rank"), F.col("mean_rank"), F.col(item)], "__one", "place").drop("__one")
    return out.unionByName(one.withColumn("place", F.col("place").cast("int")))


def recall_signals(candidates: DataFrame) -> DataFrame:
    """Logged candidates with the four signals as 'larger is better'.

    Impossible values become NULL: a distance that is NULL, NaN, infinite or
    the sentinel, a negative keyword rank or importance, a time at or before
    1970.  Times in seconds or milliseconds become microseconds.
    """
    d, k, i, t = (F.col(c).cast("double") for c in ("dist", "text_rank", "importance", "created_micros"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return candidates.select(
        "query_id",
        "atom_id",
        F.when(fine(d) & (d < NO_DISTANCE), -d).alias("semantic"),
        F.when(fine(k) & (k >= 0), k).alias("keyword"),
        F.when(fine(t) & (t > 0), F.when(t < 1e11, t * 1e6).when(t < 1e14, t * 1e3).otherwise(t)).alias("recency"),
        F.when(fine(i) & (i >= 0), i).alias("importance"),
    )


def recall_weights(queries: DataFrame) -> DataFrame:
    """One row a query; a query without any weight gets the defaults."""
    none = F.coalesce(*[F.col(c) for c in DEFAULT_WEIGHTS]).isNull()
    return queries.select("query_id", *[F.when(none, F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in DEFAULT_WEIGHTS.items()]).dropDuplicates(["query_id"])
