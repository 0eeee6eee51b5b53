"""All registered queries of the core and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.session import configure, table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings memory_regions atoms memory_edges forgotten_atoms atom_inputs recall_queries recall_candidates subject_labels benchmark".split()

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that must agree."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sql(name: str, text: str, duck: str | None = None) -> None:
    """Register SQL over the tables it names; ``duck`` only where the dialects differ."""
    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, d: str) -> DataFrame:
        configure(spark)
        for t in names:
            table(spark, d, t).createOrReplaceTempView(t)
        return spark.sql(text)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = duck or text


from tidewell.plans import dml_queries, fts_queries, function_queries, json_queries, orphan_queries, relational_queries, retrieval_queries  # noqa: E402,F401
