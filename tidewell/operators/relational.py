"""Relational operators that Spark SQL lacks or gets wrong."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.session import join_shuffled, materialise, read_all

_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b,
}


def lateral_top_k(outer: DataFrame, inner: DataFrame, on: Column, key: str, order: list[Column], k: int, rank: str = "rn", how: str = "inner") -> DataFrame:
    """The first ``k`` inner rows for each outer row (LATERAL ... ORDER BY ... LIMIT k).

    The inner side is cut by its join key first, a window whose limit Spark
    applies before the shuffle, so a hot key costs no more than the others.
    """
    cut = inner.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= k)
    return outer.join(cut, on, how)


def any_of(a: Column, op: str, values: Column) -> Column:
    """``a op ANY (array)``: NULL where no element decides and one (or ``a``) is NULL; false for an empty array."""
    return F.exists(values, lambda x: _OPS[op](a, x))


def all_of(a: Column, op: str, values: Column) -> Column:
    """``a op ALL (array)``: true for an empty array."""
    return F.forall(values, lambda x: _OPS[op](a, x))


def _extremes(sub: DataFrame, column: str) -> DataFrame:
    return sub.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"), F.count(column).alias("__n"), F.count("*").alias("__all"), F.count_distinct(column).alias("__d"))


def compare_all(df: DataFrame, column: str, op: str, sub: DataFrame, sub_column: str) -> DataFrame:
    """Rows where ``column op ALL (sub)`` is true: one aggregate row decides.

    True for an empty subquery; never true where the subquery has a NULL.
    """
    a = F.col(column)
    e = F.broadcast(_extremes(sub, sub_column))  # always one row
    nulls = F.col("__all") > F.col("__n")
    if op in ("<", "<="):
        hit = _OPS[op](a, F.col("__lo"))
    elif op in (">", ">="):
        hit = _OPS[op](a, F.col("__hi"))
    elif op == "=":
        hit = (a == F.col("__lo")) & (F.col("__lo") == F.col("__hi"))
    else:
        if not sub.where(F.col(sub_column).isNull()).isEmpty():
            return df.where(F.lit(False))
        values = sub.select(F.col(sub_column).alias("__s")).distinct()
        return join_shuffled(df, values, a == F.col("__s"), "left_anti").where(a.isNotNull() | F.lit(sub.isEmpty()))
    return df.join(e, how="cross").where((F.col("__all") == 0) | (~nulls & hit)).select(*df.columns)


def compare_any(df: DataFrame, column: str, op: str, sub: DataFrame, sub_column: str) -> DataFrame:
    """Rows where ``column op ANY (sub)`` is true."""
    a = F.col(column)
    if op == "=":
        return df.join(sub.select(F.col(sub_column).alias("__s")), a == F.col("__s"), "left_semi")
    e = F.broadcast(_extremes(sub, sub_column))  # always one row
    if op in ("<", "<="):
        hit = _OPS[op](a, F.col("__hi"))
    elif op in (">", ">="):
        hit = _OPS[op](a, F.col("__lo"))
    else:
        hit = (a != F.col("__lo")) | (a != F.col("__hi"))
    return df.join(e, how="cross").where(hit).select(*df.columns)


def recursive_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 10_000, distinct: bool = True) -> DataFrame:
    """WITH RECURSIVE: the seed and what ``step`` makes of each round's new rows.

    With ``distinct`` (UNION) rows seen before are taken out, so cycles end;
    otherwise (UNION ALL) the step must run dry by itself.  Each round is
    written to the shared folder, and only new rows are expanded.
    """
    new = materialise(seed.distinct() if distinct else seed, "recursive")
    levels = [new]
    for _ in range(max_rounds):
        if new.isEmpty():
            return read_all(levels)
        nxt = step(new)
        if distinct:
            # Null-safe, so that rows with NULLs are recognised too.
            nxt = nxt.distinct()
            cond = None
            old = read_all(levels).select(*[F.col(c).alias(f"__{c}") for c in new.columns])
            for c in new.columns:
                eq = F.col(c).eqNullSafe(F.col(f"__{c}"))
                cond = eq if cond is None else cond & eq
            nxt = nxt.join(old, cond, "left_anti")
        new = materialise(nxt.select(*new.columns), "recursive")
        levels.append(new)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
