"""JSON operators and functions on JSON text.

Reading goes through Spark's own parser and the VARIANT type, in the JVM; what
has no built-in form (edits, SQL/JSON path beyond plain steps) runs in
Arrow-batched UDFs.  A NULL or malformed document gives NULL.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import jsonpath
from tidewell.functions.datetime import let
from tidewell.session import materialise


def _load(s: str | None) -> tuple[bool, Any]:
    if s is None:
        return False, None
    try:
        return True, json.loads(s)
    except ValueError:
        return False, None


def dump(x: Any) -> str:
    """Canonical text: keys by length, then bytes; no blanks."""
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v)}" for k, v in sorted(x.items(), key=lambda kv: (len(kv[0].encode()), kv[0].encode()))) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(dump, x)) + "]"
    return json.dumps(x, ensure_ascii=False)


def _map(f, kind: str, doc: Column) -> Column:
    """``f(parsed)`` for each document; an exception of the data gives NULL."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            ok, x = _load(t)
            return f(x) if ok else None

        return pd.Series([one(t) for t in s], index=s.index, dtype=object)

    return run(doc)


def spark_path(steps: list[str | int]) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)


def _variant(doc: Column) -> Column:
    return F.try_parse_json(doc)


def _kind(v: Column) -> Column:
    """Type of a variant: STRING, BOOLEAN, VOID, BIGINT, DOUBLE, DECIMAL(..), ARRAY<..>, OBJECT<..>; NULL where there is none."""
    return F.schema_of_variant(v)


def _is_number(v: Column) -> Column:
    return _kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def _at(v: Column, steps: list[str | int]) -> Column:
    """A part of a variant; NULL where it has none."""
    return F.variant_get(v, spark_path(steps), "variant") if steps else v


def _item(doc: Column, key: int) -> Column:
    """An element counted from the end, as a variant."""
    items = F.try_variant_get(_variant(doc), "$", "array<variant>")
    return F.when(F.size(items) >= -key, F.try_element_at(items, F.lit(key)))


def _plain(key: str) -> bool:
    return "'" not in key and "\\" not in key


def get(doc: Column, key: str | int) -> Column:
    """``->``: JSON of a key or of an array place (negative from the end).

    Objects keep their keys in alphabetical order; ``canonical`` gives the order of a binary document.
    """
    if isinstance(key, int) and key < 0:
        return F.to_json(_item(doc, key))
    return F.to_json(_at(_variant(doc), [key])) if isinstance(key, int) or _plain(key) else _map(lambda x: None if (v := _step(x, key)) is _NONE else dump(v), "string", doc)


def get_text(doc: Column, key: str | int) -> Column:
    """``->>``: text of a key or place; JSON null is NULL."""
    if isinstance(key, int) and key < 0:
        return _item(doc, key).cast("string")
    return F.get_json_object(doc, spark_path([key])) if isinstance(key, int) or _plain(key) else _map(lambda x: _text(_step(x, key)), "string", doc)


_NONE = ...  # stays itself when functions are sent to the workers


def _step(x: Any, key: str | int) -> Any:
    if isinstance(x, dict) and isinstance(key, str):
        return x.get(key, _NONE)
    if isinstance(x, list):
        try:
            i = int(key)
        except ValueError:
            return _NONE
        return x[i] if -len(x) <= i < len(x) else _NONE
    return _NONE


def _text(v: Any) -> str | None:
    if v is _NONE or v is None:
        return None
    return v if isinstance(v, str) else dump(v)


def parse_path(path: str) -> list[str]:
    """Steps of ``{a,0,b}``."""
    inner = path.strip()
    if not (inner.startswith("{") and inner.endswith("}")):
        raise ValueError(f"bad path {path}")
    return [a if a else b.strip() for a, b in re.findall(r'"((?:[^"\\]|\\.)*)"|([^,{}"]+)', inner[1:-1])]


def _follow(x: Any, steps: list[str]) -> Any:
    for s in steps:
        x = _step(x, s)
        if x is _NONE:
            return _NONE
    return x


def _forms(steps: list[str]) -> list[list[str | int]] | None:
    """Ways to read a text path, where a number may be a place or a key; None if it needs the general way."""
    forms: list[list[str | int]] = [[]]
    for s in steps:
        if not _plain(s) or re.fullmatch(r"-\d+", s):
            return None
        ways: list[str | int] = [int(s), s] if s.isdigit() else [s]
        forms = [[*f, w] for f in forms for w in ways]
    return forms if 0 < len(forms) <= 4 else None


def get_path(doc: Column, path: str) -> Column:
    """``#>``"""
    return _get_path(doc, parse_path(path))


def _get_path(doc: Column, steps: list[str]) -> Column:
    if forms := _forms(steps):
        return F.to_json(F.coalesce(*[_at(_variant(doc), f) for f in forms]))
    return _map(lambda x: None if (v := _follow(x, steps)) is _NONE else dump(v), "string", doc)


def get_path_text(doc: Column, path: str) -> Column:
    """``#>>``"""
    return _get_path_text(doc, parse_path(path))


def _get_path_text(doc: Column, steps: list[str]) -> Column:
    if forms := _forms(steps):
        return F.coalesce(*[_at(_variant(doc), f) for f in forms]).cast("string")
    return _map(lambda x: _text(_follow(x, steps)), "string", doc)


def extract_path(doc: Column, *steps: str) -> Column:
    """JSON_EXTRACT_PATH(doc, step, ...)"""
    return _get_path(doc, list(steps))


def extract_path_text(doc: Column, *steps: str) -> Column:
    """JSON_EXTRACT_PATH_TEXT(doc, step, ...)"""
    return _get_path_text(doc, list(steps))


def extract(doc: Column, path: str) -> Column:
    """JSON_EXTRACT(doc, '$.a[0].b'): text, JSON null as NULL."""
    if not re.fullmatch(r"\$(?:\.[\w-]+|\.\"[^\"']+\"|\[\d+\])*", path):
        raise ValueError(f"bad path {path}")
    steps = [int(i) if i else k or q for k, q, i in re.findall(r"\.([\w-]+)|\.\"([^\"']+)\"|\[(\d+)\]", path)]
    return _at(_variant(doc), steps).cast("string")


def _contains(a: Any, b: Any, top: bool = True) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _contains(a[k], v, False) for k, v in b.items())
    if isinstance(a, list):
        if isinstance(b, list):
            return all(any(_contains(x, y, False) for x in a) for y in b)
        return top and not isinstance(b, dict) and any(_same(x, b) for x in a)
    return not isinstance(b, (dict, list)) and _same(a, b)


def _same(a: Any, b: Any) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return type(a) is type(b) and a == b or isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == b


def _holds(v: Column, want: Any, top: bool = False) -> Column:
    """Containment of a constant in a variant, as a predicate of the JVM."""
    no = lambda c: F.coalesce(c, F.lit(False))
    if isinstance(want, dict):
        out = no(_kind(v).startswith("OBJECT"))
        for k, x in want.items():
            out = out & _holds(_at(v, [k]), x)
        return out
    items = F.try_variant_get(v, "$", "array<variant>")
    if isinstance(want, list):
        out = no(_kind(v).startswith("ARRAY"))
        for x in want:
            out = out & no(_some(items, x))
        return out
    if want is None:
        same = no(_kind(v) == "VOID")
    elif isinstance(want, bool):
        same = no((_kind(v) == "BOOLEAN") & (v.try_cast("boolean") == F.lit(want)))
    elif isinstance(want, str):
        same = no((_kind(v) == "STRING") & (v.try_cast("string") == F.lit(want)))
    else:
        same = no(_is_number(v) & (v.try_cast("double") == F.lit(float(want))))
    return same | no(_kind(v).startswith("ARRAY") & F.exists(items, lambda e: _holds(e, want))) if top else same


def _some(items: Column, want: Any) -> Column:
    return F.exists(items, lambda e: _holds(e, want))


def _keys_plain(x: Any) -> bool:
    if isinstance(x, dict):
        return all(_plain(k) and _keys_plain(v) for k, v in x.items())
    return all(map(_keys_plain, x)) if isinstance(x, list) else True


def contains(doc: Column, part: str) -> Column:
    """``@>`` with a constant right side, compiled to predicates of the JVM."""
    want = json.loads(part)
    if not _keys_plain(want):
        return _map(lambda x: _contains(x, want), "boolean", doc)
    v = _variant(doc)
    return F.when(v.isNotNull(), _holds(v, want, True))


def contained(doc: Column, whole: str) -> Column:
    """``<@`` with a constant right side."""
    have = json.loads(whole)
    return _map(lambda x: _contains(have, x), "boolean", doc)


def has_key(doc: Column, key: str) -> Column:
    """``?``: a top-level key, a string element of an array, or that very string."""
    v = _variant(doc)
    items = F.try_variant_get(v, "$", "array<variant>")
    kind = _kind(v)
    same = lambda x: (_kind(x) == "STRING") & (x.try_cast("string") == F.lit(key))
    there = F.when(kind.startswith("OBJECT"), F.array_contains(F.json_object_keys(doc), key)).when(kind.startswith("ARRAY"), F.exists(items, same)).otherwise(same(v))
    return F.when(v.isNotNull(), F.coalesce(there, F.lit(False)))


def has_any_key(doc: Column, keys: list[str]) -> Column:
    """``?|``: false for anything but an object."""
    return F.when(_variant(doc).isNotNull(), F.coalesce(F.arrays_overlap(F.json_object_keys(doc), F.array(*map(F.lit, keys))), F.lit(False)) if keys else F.lit(False))


def has_all_keys(doc: Column, keys: list[str]) -> Column:
    """``?&``: for anything but an object, whether no key is asked for."""
    have = F.json_object_keys(doc)
    every = F.lit(True)
    for k in keys:
        every = every & F.coalesce(F.array_contains(have, k), F.lit(False))
    return F.when(_variant(doc).isNotNull(), every)


def delete(doc: Column, key: str | int) -> Column:
    """``-``: without a key, an array place, or equal strings of an array."""

    def run(x):
        if isinstance(x, dict):
            return dump({k: v for k, v in x.items() if k != key})
        if isinstance(x, list) and isinstance(key, int):
            i = key + len(x) if key < 0 else key
            return dump([v for j, v in enumerate(x) if j != i])
        if isinstance(x, list):
            return dump([v for v in x if v != key])
        return None

    return _map(run, "string", doc)


def _edit(x: Any, steps: list[str], f) -> Any:
    """A copy of ``x`` with ``f(container, last step)`` applied where the path leads."""
    if not steps:
        return x
    if len(steps) == 1:
        return f(x, steps[0])
    if isinstance(x, dict) and steps[0] in x:
        return {k: _edit(v, steps[1:], f) if k == steps[0] else v for k, v in x.items()}
    if isinstance(x, list) and re.fullmatch(r"-?\d+", steps[0]) and -len(x) <= int(steps[0]) < len(x):
        i = int(steps[0]) % len(x)
        return [_edit(v, steps[1:], f) if j == i else v for j, v in enumerate(x)]
    return x


def _place(x: list, step: str) -> int | None:
    if not re.fullmatch(r"-?\d+", step):
        return None
    i = int(step)
    return i + len(x) if i < 0 else i


def delete_path(doc: Column, path: str) -> Column:
    """``#-``"""
    steps = parse_path(path)

    def drop(x, s):
        if isinstance(x, dict):
            return {k: v for k, v in x.items() if k != s}
        if isinstance(x, list) and (i := _place(x, s)) is not None:
            return [v for j, v in enumerate(x) if j != i]
        return x

    return _map(lambda x: dump(_edit(x, steps, drop)), "string", doc)


def set_(doc: Column, path: str, value: str, create: bool = True) -> Column:
    """JSONB_SET: replaces, and creates a missing last step unless told not to."""
    steps, new = parse_path(path), json.loads(value)

    def put(x, s):
        if isinstance(x, dict):
            return {**x, s: new} if create or s in x else x
        if isinstance(x, list) and (i := _place(x, s)) is not None:
            if 0 <= i < len(x):
                return [new if j == i else v for j, v in enumerate(x)]
            return ([new, *x] if i < 0 else [*x, new]) if create else x
        return x

    return _map(lambda x: dump(_edit(x, steps, put)), "string", doc)


def insert(doc: Column, path: str, value: str, after: bool = False) -> Column:
    """JSONB_INSERT: before (or after) an array place; an object key only if missing."""
    steps, new = parse_path(path), json.loads(value)

    def put(x, s):
        if isinstance(x, dict):
            return x if s in x else {**x, s: new}
        if isinstance(x, list) and (i := _place(x, s)) is not None:
            i = min(max(i + (1 if after else 0), 0), len(x))
            return [*x[:i], new, *x[i:]]
        return x

    return _map(lambda x: dump(_edit(x, steps, put)), "string", doc)


def merge(a: Column, b: Column) -> Column:
    """``||``: objects merge (right wins), arrays and scalars concatenate."""

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(s, t):
            (ok1, p), (ok2, q) = _load(s), _load(t)
            if not (ok1 and ok2):
                return None
            if isinstance(p, dict) and isinstance(q, dict):
                return dump({**p, **q})
            return dump((p if isinstance(p, list) else [p]) + (q if isinstance(q, list) else [q]))

        return pd.Series([one(s, t) for s, t in zip(x, y)], index=x.index, dtype=object)

    return run(a, b)


def typeof(doc: Column) -> Column:
    v = _variant(doc)
    k = _kind(v)
    return F.when(v.isNull(), F.lit(None)).when(k == "VOID", "null").when(k == "BOOLEAN", "boolean").when(k == "STRING", "string").when(k.startswith("ARRAY"), "array").when(k.startswith("OBJECT"), "object").otherwise("number")


def array_length(doc: Column) -> Column:
    return F.json_array_length(doc).cast("long")


def object_length(doc: Column) -> Column:
    return F.size(F.json_object_keys(doc)).cast("long")


def valid(doc: Column) -> Column:
    """JSON_VALID: whether a text is JSON; NULL is not."""
    return _variant(doc).isNotNull()


def _strip(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _strip(v) for k, v in x.items() if v is not None}
    return [_strip(v) for v in x] if isinstance(x, list) else x


def strip_nulls(doc: Column) -> Column:
    return _map(lambda x: dump(_strip(x)), "string", doc)


def canonical(doc: Column) -> Column:
    """Equal documents have equal canonical text, whatever their key order and spacing."""
    return _map(dump, "string", doc)


def pretty(doc: Column) -> Column:
    return _map(lambda x: json.dumps(json.loads(dump(x)), indent=2, ensure_ascii=False), "string", doc)


def to_json(value: Column) -> Column:
    """TO_JSON and, of a struct, ROW_TO_JSON: NULL is JSON null, fields that are NULL stay."""
    inner = F.regexp_extract(F.to_json(F.array(value), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", 1)
    return F.when(value.isNull(), "null").otherwise(inner)


def build_object(*args) -> Column:
    """JSON_BUILD_OBJECT(key, value, ...): a NULL key drops its pair, the last of equal keys holds, an odd number is an error."""
    if len(args) == 1 or args and isinstance(args[0], tuple):
        args = tuple(x for pair in args for x in pair)
    if len(args) % 2:
        raise ValueError("an even number of arguments is needed")
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return _object(F.array(*[F.struct(lit(k).cast("string").alias("k"), to_json(lit(v)).alias("v")) for k, v in zip(args[::2], args[1::2])]) if args else F.array().cast("array<struct<k:string,v:string>>"))


def _object(pairs: Column) -> Column:
    """JSON text of array<struct<k, v>>, ``v`` JSON: pairs with a NULL key drop out, the last of equal keys holds."""
    known = F.filter(pairs, lambda p: p["k"].isNotNull())
    # By key, the latest first; the first of each key stays, and the old order is made again.
    by_key = F.array_sort(F.transform(known, lambda p, i: F.struct(p["k"].alias("k"), (-i).alias("o"), p["v"].alias("v"))))
    last = let(by_key, lambda xs: F.filter(xs, lambda p, i: (i == 0) | (F.get(xs, i - 1)["k"] != p["k"])))
    ordered = F.array_sort(F.transform(last, lambda p: F.struct((-p["o"]).alias("o"), p["k"].alias("k"), p["v"].alias("v"))))
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda p: F.concat(quoted(p["k"]), F.lit(":"), p["v"])), ","), F.lit("}"))


def build_array(*values: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[to_json(v) for v in values]), F.lit("]"))


def object_of(keys: Column, values: Column | None = None) -> Column:
    """JSON_OBJECT(array of keys and values in turn), or JSON_OBJECT(keys, values) of one length."""
    if values is None:
        n = F.floor(F.size(keys) / 2).cast("int")
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return _object(F.transform(places, lambda i: F.struct(F.element_at(keys, i * 2 - 1).alias("k"), to_json(F.element_at(keys, i * 2)).alias("v"))))
    bad = F.raise_error(F.lit("json_object: keys and values must be of one length")).cast("string")
    return F.when(F.size(keys) != F.size(values), bad).otherwise(_object(F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), to_json(v).alias("v")))))


_PLAIN_PATH = re.compile(r"(?:lax\s+)?\$((?:\.[A-Za-z_]\w*)*)")


def _plain_steps(path: str) -> list[str] | None:
    """Steps of a path of keys only, which lax mode reads as a plain access unless it meets an array."""
    m = _PLAIN_PATH.fullmatch(path.strip())
    return m.group(1).split(".")[1:] if m else None


def path_exists(doc: Column, path: str, variables: dict | None = None, tz: bool = False) -> Column:
    """``@?`` (``@?_tz``), JSON_EXISTS and JSONB_PATH_EXISTS (_TZ)."""
    return _map(lambda x: jsonpath.exists(x, path, variables, tz), "boolean", doc)


def path_match(doc: Column, path: str, variables: dict | None = None, tz: bool = False) -> Column:
    """``@@`` (``@@_tz``) and JSONB_PATH_MATCH (_TZ)."""
    return _map(lambda x: jsonpath.match(x, path, variables, tz), "boolean", doc)


def path_query_array(doc: Column, path: str, variables: dict | None = None, silent: bool = True, tz: bool = False) -> Column:
    """JSONB_PATH_QUERY_ARRAY (_TZ)."""
    return _map(lambda x: dump(jsonpath.query(x, path, variables, silent, tz)), "string", doc)


def path_query_first(doc: Column, path: str, variables: dict | None = None, silent: bool = True, tz: bool = False) -> Column:
    """JSONB_PATH_QUERY_FIRST (_TZ); NULL where there is none."""
    return _map(lambda x: dump(r[0]) if (r := jsonpath.query(x, path, variables, silent, tz)) else None, "string", doc)


def path_query(df: DataFrame, doc: str, path: str, out: str = "value", variables: dict | None = None, silent: bool = True, tz: bool = False) -> DataFrame:
    """JSONB_PATH_QUERY (_TZ): one row an item."""
    items = _map(lambda x: [dump(v) for v in jsonpath.query(x, path, variables, silent, tz)], "array<string>", F.col(doc))
    return df.withColumn(out, F.explode(items))


def json_query(doc: Column, path: str, wrapper: str = "conditional", on_empty: str | None = None, on_error: str | None = None) -> Column:
    """JSON_QUERY: several items become an array.

    ``wrapper``: ``conditional`` wraps only several items, ``with`` always,
    ``without`` makes several items an error.  ``on_empty`` and ``on_error``
    are JSON texts for no item and for an error (default NULL).
    """
    if wrapper not in ("conditional", "with", "without"):
        raise ValueError(f"unknown wrapper {wrapper!r}")

    def run(x):
        try:
            r = jsonpath.query(x, path, None, False)
        except jsonpath.PathError:
            return on_error
        if not r:
            return on_empty
        if wrapper == "without" and len(r) > 1:
            return on_error
        return dump(r if wrapper == "with" or len(r) > 1 else r[0])

    return _map(run, "string", doc)


def json_value(doc: Column, path: str, on_empty: str | None = None, on_error: str | None = None) -> Column:
    """JSON_VALUE: the one scalar item as text; else ``on_empty`` (no item) or ``on_error`` (several, or no scalar)."""

    def run(x):
        try:
            r = jsonpath.query(x, path, None, False)
        except jsonpath.PathError:
            return on_error
        if not r:
            return on_empty
        return _text(r[0]) if len(r) == 1 and not isinstance(r[0], (dict, list)) else on_error

    return _map(run, "string", doc)


def json_agg(value: Column, order: Column | None = None) -> Column:
    """JSON_AGG(value [ORDER BY order]): array of the group's values, NULLs included; without an order, sorted by their text."""
    one = to_json(value)
    if order is None:
        return F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(one)), ","), F.lit("]"))
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), one.alias("v"))))
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["v"]), ","), F.lit("]"))


def json_object_agg(key: Column, value: Column, order: Column) -> Column:
    """JSON_OBJECT_AGG(key, value ORDER BY order): a NULL key drops its pair, the last of equal keys holds."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), key.cast("string").alias("k"), to_json(value).alias("v"))))
    return _object(F.transform(rows, lambda r: F.struct(r["k"].alias("k"), r["v"].alias("v"))))


def array_elements(df: DataFrame, doc: str, out: str = "value", text: bool = False) -> DataFrame:
    """One row an array element: JSON (or text, JSON null as NULL)."""
    items = F.explode(F.try_variant_get(_variant(F.col(doc)), "$", "array<variant>"))
    item = F.col("__item")
    return df.select("*", items.alias("__item")).withColumn(out, item.cast("string") if text else F.coalesce(F.to_json(item), F.lit("null"))).drop("__item")


def each(df: DataFrame, doc: str, text: bool = False) -> DataFrame:
    """One row a key of the object: ``key``, ``value`` (JSON, or text with JSON null as NULL)."""
    v = F.try_variant_get(_variant(F.col(doc)), "$", "map<string,variant>")
    rows = df.select("*", F.explode(v).alias("key", "__value"))
    value = F.col("__value")
    return rows.withColumn("value", value.cast("string") if text else F.coalesce(F.to_json(value), F.lit("null"))).drop("__value")


def object_keys(df: DataFrame, doc: str) -> DataFrame:
    return df.withColumn("key", F.explode(F.json_object_keys(doc)))


def populate(df: DataFrame, doc: str, schema: str) -> DataFrame:
    """JSONB_POPULATE_RECORD(SET): the record's fields as columns; a NULL document gives no row."""
    one = F.from_json(doc, schema)
    many = F.from_json(doc, f"array<struct<{schema}>>")
    rows = F.when(F.ltrim(F.col(doc)).startswith("["), many).otherwise(F.array(one))
    return df.where(F.col(doc).isNotNull()).select("*", F.inline(rows))


def json_table(df: DataFrame, doc: str, path: str, columns: list[tuple], ordinality: str | None = None) -> DataFrame:
    """JSON_TABLE(doc, path COLUMNS(...)): one row an item of ``path``; a NULL document gives none.

    A column is (name, type, path) with a path from its item, the type
    ``exists`` or ``json``, or ("nested", path, columns, ordinality or None).
    ``ordinality`` names a column that numbers the items from 1.  Siblings of
    nested paths are combined each with each; one without items gives NULLs.
    """

    def names(cols, ordinal):
        out = [(ordinal, "long")] if ordinal else []
        for c in cols:
            out += names(c[2], c[3] if len(c) > 3 else None) if c[0] == "nested" else [(c[0], {"exists": "boolean", "json": "string"}.get(c[1], c[1]))]
        return out

    def rows(x, at, cols, ordinal):
        out = [{ordinal: str(at)} if ordinal else {}]
        for c in cols:
            if c[0] == "nested":
                inner = [r for i, y in enumerate(jsonpath.query(x, c[1], None, True), 1) for r in rows(y, i, c[2], c[3] if len(c) > 3 else None)] or [{}]
                out = [{**a, **b} for a in out for b in inner]
                continue
            found = jsonpath.query(x, c[2], None, True)
            if c[1] == "exists":
                v = "true" if found else "false"
            elif c[1] == "json":
                v = dump(found[0]) if found else None
            else:
                v = _text(found[0]) if found else None
            out = [{**a, c[0]: v} for a in out]
        return out

    have = names(columns, ordinality)
    fields = ",".join(f"f{i}:string" for i in range(len(have)))
    items = _map(lambda x: [tuple(r.get(n) for n, _ in have) for i, y in enumerate(jsonpath.query(x, path, None, True), 1) for r in rows(y, i, columns, ordinality)], f"array<struct<{fields}>>", F.col(doc))
    out = df.select("*", F.explode(items).alias("__row"))
    for i, (n, t) in enumerate(have):
        out = out.withColumn(n, F.col(f"__row.f{i}").try_cast(t))
    return out.drop("__row")


# Postings of JSON documents, for containment.
def _entries(x: Any, at: str = "") -> set[str]:
    """Index entries of a document: each path of keys with the scalar it leads to (places in arrays do not count), and each path itself."""
    if isinstance(x, dict):
        out = {f"{at}{{}}"}
        for k, v in x.items():
            out |= _entries(v, f"{at}.{json.dumps(k)}")
        return out
    if isinstance(x, list):
        out = {f"{at}[]"}
        for v in x:
            out |= _entries(v, at)
        return out
    if isinstance(x, float) and x.is_integer():
        x = int(x)
    return {f"{at}={json.dumps(x)}"}


def build_gin(df: DataFrame, key: str, doc: str) -> DataFrame:
    """(entry, key): stored postings of every document's entries, ordered by entry."""
    rows = df.select(key, F.explode(_map(lambda x: sorted(_entries(x)), "array<string>", F.col(doc))).alias("entry")).distinct()
    return materialise(rows.repartitionByRange("entry", key).sortWithinPartitions("entry", key), "gin")


def gin_contains(df: DataFrame, key: str, doc: str, postings: DataFrame, part: str) -> DataFrame:
    """Rows of ``df`` whose document contains ``part``: candidates by the postings of its entries, then a recheck.

    Every entry of ``part`` occurs in a document that contains it, except that
    a scalar may stand for an array that has it, which has the same entry.
    """
    want = json.loads(part)
    entries = sorted(_entries(want))
    found = postings.where(F.col("entry").isin(entries)).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") == len(entries)).select(key)
    return df.join(found, key, "left_semi").where(contains(F.col(doc), part))
