"""String, number and misc functions with the engine's semantics (all JVM-side)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOWER, _UPPER = string.ascii_lowercase, string.ascii_uppercase


def upper(c: Column) -> Column:
    """ASCII letters only; others stay."""
    return F.translate(c, _LOWER, _UPPER)


def lower(c: Column) -> Column:
    """ASCII letters only; others stay."""
    return F.translate(c, _UPPER, _LOWER)


def like(c: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE and ILIKE: ASCII case does not count; no escape character unless given."""
    if escape is not None and len(escape) != 1:
        raise ValueError("ESCAPE must be one character")
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if escape is not None and ch == escape and i + 1 < len(pattern):
            out.append("\\" + pattern[i + 1] if pattern[i + 1] in "%_\\" else pattern[i + 1])
            i += 2
            continue
        out.append("\\\\" if ch == "\\" else ch)
        i += 1
    return lower(c).like("".join(out).translate(str.maketrans(_UPPER, _LOWER)))


def substr(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based by characters.  Two arguments: a negative start counts from the end.

    Three arguments: a start before 1 shortens the length by what lies before.
    """
    p = F.lit(start) if isinstance(start, int) else start
    if length is None:
        n = F.char_length(s)
        return F.when(p < 0, F.substring(s, F.greatest(n + p + 1, F.lit(1)).cast("int"), n)).otherwise(F.substring(s, F.greatest(p, F.lit(1)).cast("int"), n))
    k = F.lit(length) if isinstance(length, int) else length
    take = F.when(p < 1, k + p - 1).otherwise(k)
    return F.when(s.isNull() | p.isNull() | k.isNull(), F.lit(None)).when(take <= 0, F.lit("")).otherwise(F.substring(s, F.greatest(p, F.lit(1)).cast("int"), take.cast("int")))


def _trim(c: Column, chars: str, head: bool, tail: bool) -> Column:
    cls = "[" + "".join("\\" + x if x in "\\]^-[&" else x for x in chars) + "]+"
    if head:
        c = F.regexp_replace(c, f"^{cls}", "")
    return F.regexp_replace(c, f"{cls}$", "") if tail else c


def trim(c: Column, chars: str = " ") -> Column:
    return _trim(c, chars, True, True) if chars else c


def ltrim(c: Column, chars: str = " ") -> Column:
    return _trim(c, chars, True, False) if chars else c


def rtrim(c: Column, chars: str = " ") -> Column:
    return _trim(c, chars, False, True) if chars else c


def replace(c: Column, old: str, new: str) -> Column:
    """An empty ``old`` changes nothing."""
    return F.replace(c, F.lit(old), F.lit(new)) if old else c


def instr(c: Column, needle: str) -> Column:
    return F.instr(c, needle).cast("long")


def concat(*cols: Column) -> Column:
    """NULLs are skipped; no arguments give the empty string."""
    return F.concat_ws("", *cols) if cols else F.lit("")


def length(c: Column) -> Column:
    return F.char_length(c).cast("long")


def hex_(c: Column) -> Column:
    return F.hex(c)


def div(a: Column, b: Column) -> Column:
    """Integer division toward zero; division by zero raises."""
    return F.call_function("div", a, b)


def round_(c: Column, n: int = 0) -> Column:
    """Half away from zero on the scaled double; always REAL."""
    x = c.cast("double") * F.lit(10.0**n)
    return F.signum(x) * F.floor(F.abs(x) + 0.5) / F.lit(10.0**n)


def ceil(c: Column) -> Column:
    return F.ceil(c.cast("double")).cast("long")


def floor(c: Column) -> Column:
    return F.floor(c.cast("double")).cast("long")


def sign(c: Column) -> Column:
    return F.signum(c.cast("double")).cast("long")


def sqrt(c: Column) -> Column:
    """NULL for negative numbers."""
    return F.when(c >= 0, F.sqrt(c))


def iif(cond: Column, a: Column, b: Column) -> Column:
    return F.when(cond, a).otherwise(b)


def least2(a: Column, b: Column) -> Column:
    """MIN(a, b): a NULL is skipped."""
    return F.least(a, b)


def greatest2(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def to_bool(c: Column) -> Column:
    """CAST(text AS BOOLEAN): true/1/yes/on and false/0/no/off, else an error."""
    t = F.lower(F.trim(c))
    bad = F.raise_error(F.concat(F.lit("cannot cast to BOOLEAN: "), c)).cast("boolean")
    return F.when(c.isNull(), F.lit(None).cast("boolean")).when(t.isin("true", "1", "yes", "on", "t", "y"), F.lit(True)).when(t.isin("false", "0", "no", "off", "f", "n"), F.lit(False)).otherwise(bad)


def to_int(c: Column) -> Column:
    """CAST(text or REAL AS INTEGER): truncates; text may hold a decimal number."""
    return c.cast("double").cast("long")


_TYPE_NAMES = {"bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "real", "float": "real", "string": "text", "boolean": "boolean", "binary": "blob", "date": "date", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "void": "null"}


def typeof(c: Column) -> Column:
    """Lower-case type name of a value; a NULL's is ``null``."""
    names = F.create_map(*[F.lit(x) for kv in _TYPE_NAMES.items() for x in kv])
    t = F.typeof(c)
    return F.when(c.isNull(), "null").when(t.startswith("array"), "array").otherwise(F.coalesce(names[t], t))


def collate(c: Column, name: str) -> Column:
    """What a collation compares, sorts and groups by: ``binary``, ``nocase`` (ASCII) or ``rtrim`` (blanks at the end)."""
    if name.lower() not in ("binary", "nocase", "rtrim"):
        raise ValueError(f"unknown collation {name}")
    return {"binary": lambda: c, "nocase": lambda: lower(c), "rtrim": lambda: F.rtrim(c)}[name.lower()]()


def abs_(c: Column) -> Column:
    """ABS: the least INTEGER has none and is an error."""
    bad = F.raise_error(F.lit("integer overflow")).cast("long")
    return F.when(c == F.lit(-(2**63)).cast("long"), bad).otherwise(F.abs(c))
