"""Results as text: lines made where the rows are, printers, dumps, scripts and a row cursor.

``lines`` and ``dump`` give frames of text, which any number of tasks can
write; the printers stream rows to one place and are for results of a size
that someone reads.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.catalog import Catalog

MODES = ("box", "table", "csv", "json", "line")


def text_of(c: Column, kind: T.DataType, null: str = "NULL") -> Column:
    """A value as it is shown."""
    if isinstance(kind, T.BinaryType):
        shown = F.concat(F.lit("X'"), F.hex(c), F.lit("'"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        shown = F.to_json(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        shown = F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit(null))


def _quoted(c: Column) -> Column:
    return F.when(c.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def lines(df: DataFrame, mode: str = "csv", null: str = "NULL") -> DataFrame:
    """(line): one text a row, CSV without a header or a JSON object."""
    if mode == "csv":
        return df.select(F.concat_ws(",", *[_quoted(text_of(F.col(f.name), f.dataType, null)) for f in df.schema.fields]).alias("line"))
    if mode == "json":
        return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}).alias("line"))
    raise ValueError(f"{mode} has no line a row")


def literal(c: Column, kind: T.DataType) -> Column:
    """A value as an SQL literal."""
    shown = text_of(c, kind, "NULL")
    if isinstance(kind, (T.NumericType, T.BooleanType, T.BinaryType)):
        return shown
    return F.when(c.isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(shown, F.lit("'"), F.lit("''")), F.lit("'")))


def inserts(df: DataFrame, table: str) -> DataFrame:
    """(line): an INSERT statement a row."""
    names = ", ".join(df.columns)
    values = F.concat_ws(", ", *[literal(F.col(f.name), f.dataType) for f in df.schema.fields])
    return df.select(F.concat(F.lit(f"INSERT INTO {table} ({names}) VALUES ("), values, F.lit(");")).alias("line"))


# The types' names in a dump.
_SQL_TYPES = {"long": "INTEGER", "integer": "INTEGER", "short": "INTEGER", "byte": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "boolean": "BOOLEAN", "binary": "BLOB", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


def create_table(catalog: Catalog, table: str) -> str:
    """The CREATE TABLE statement of a table."""
    from tidewell.sources.catalog import Constraints

    rules = catalog.rules.get(table, Constraints())
    parts = []
    for f in catalog.tables[table].schema.fields:
        part = f"{f.name} {_SQL_TYPES.get(f.dataType.typeName(), 'TEXT')}"
        part += " NOT NULL" if f.name in rules.not_null else ""
        parts.append(part)
    if rules.primary_key:
        parts.append(f"PRIMARY KEY ({', '.join(rules.primary_key)})")
    parts += [f"UNIQUE ({', '.join(k)})" for k in rules.unique] + [f"CHECK ({x})" for x in rules.checks.values()]
    parts += [f"FOREIGN KEY ({k.column}) REFERENCES {k.parent} ({k.key})" for k in rules.foreign]
    return f"CREATE TABLE {table} ({', '.join(parts)});"


def dump(catalog: Catalog, table: str | None = None) -> DataFrame:
    """(table_name, part, line): CREATE (part 0) and INSERT (part 1) statements of one or all tables."""
    out = None
    for t in sorted(catalog.tables) if table is None else [table.lower()]:
        head = catalog.spark.createDataFrame([(t, 0, create_table(catalog, t))], "table_name string, part int, line string")
        both = head.unionByName(inserts(catalog.tables[t], t).select(F.lit(t).alias("table_name"), F.lit(1).alias("part"), "line"))
        out = both if out is None else out.unionByName(both)
    return out


def read_script(catalog: Catalog, path: str) -> list[DataFrame]:
    """The statements of a file, one after the other."""
    with open(path) as f:
        return catalog.script(f.read())


def cursor(df: DataFrame, prefetch: bool = True) -> Iterator[Row]:
    """Rows one by one; the driver holds a partition at a time."""
    return df.toLocalIterator(prefetch)


def render(df: DataFrame, mode: str = "box", null: str = "NULL", header: bool = True) -> str:
    """A result as one text, in the shape of a box, table, csv, json or line printer."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode == "json":
        return json.dumps([json.loads(r["line"]) for r in cursor(lines(df, "json"))], indent=2, ensure_ascii=False)
    if mode == "csv":
        head = [",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in ',"\n\r') else c for c in df.columns)] if header else []
        return "\n".join([*head, *(r["line"] for r in cursor(lines(df, "csv", null)))])
    shown = df.select(*[text_of(F.col(f.name), f.dataType, null).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
    rows = [list(r) for r in cursor(shown)]
    if mode == "line":
        wide = max(map(len, df.columns), default=0)
        return "\n\n".join("\n".join(f"{c:>{wide}} = {v}" for c, v in zip(df.columns, r)) for r in rows)
    widths = [max(len(x) for x in col) for col in zip(df.columns, *rows)]
    if mode == "box":
        top, mid, low, side = ("┌┬┐", "├┼┤", "└┴┘", "│")
    else:
        top, mid, low, side = ("+++", "+++", "+++", "|")
    dash = "─" if mode == "box" else "-"
    rule = lambda ends: ends[0] + ends[1].join(dash * (w + 2) for w in widths) + ends[2]
    row = lambda xs: side + side.join(f" {x:<{w}} " for x, w in zip(xs, widths)) + side
    body = [rule(top), *([row(df.columns), rule(mid)] if header else []), *map(row, rows), rule(low)]
    return "\n".join([*body, f"({len(rows)} row{'' if len(rows) == 1 else 's'})"])
