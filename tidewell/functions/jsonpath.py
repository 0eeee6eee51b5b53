"""SQL/JSON path: parser and evaluator, compiled once per path.

Modes lax and strict; ``$ @ last``, ``.key .* .** [*] [i, j to k] ?(...)``;
arithmetic; methods type size double ceiling floor abs keyvalue datetime;
predicates with comparison, exists, and/or/not, is unknown, starts with,
like_regex.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable
from contextvars import ContextVar
from datetime import UTC, datetime

_TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?|\.\d+)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<var>\$[A-Za-z_]\w*|\$"(?:[^"\\]|\\.)*")"""
    r"""|(?P<name>[^\W\d]\w*)|(?P<op>\*\*|==|!=|<>|<=|>=|&&|\|\||[$@.*\[\](){},?<>!+\-/%]))"""
)


#: Whether times with and without a zone may be compared.
_zones: ContextVar[bool] = ContextVar("zones", default=False)


class PathError(ValueError):
    """The path is malformed, or strict mode met a structural error."""


class _Unknown(Exception):
    pass


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PathError(f"bad path at {at}: {text!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return [*out, ("end", "")]


def _unquote(s: str) -> str:
    import json

    return json.loads(s)


def _num(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


Eval = Callable[[list, dict], list]  # (stack of [root, current, last], variables) -> items


class _Parser:
    def __init__(self, text: str):
        self.t = _tokens(text)
        self.i = 0
        self.strict = False
        if self.t[0] in (("name", "strict"), ("name", "lax")):
            self.strict = self.t[0][1] == "strict"
            self.i = 1

    def peek(self, *values: str) -> bool:
        return self.t[self.i][0] in ("op", "name") and self.t[self.i][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise PathError(f"expected {value!r} before {self.t[self.i][1]!r}")

    def parse(self):
        start = self.i
        try:
            e = self.expr()
            if self.t[self.i][0] == "end":
                return e, False
        except PathError:
            pass
        self.i = start
        p = self.predicate()
        if self.t[self.i][0] != "end":
            raise PathError(f"unexpected {self.t[self.i][1]!r}")

        def value(c, v):
            try:
                return [p(c, v)]
            except _Unknown:
                return [None]

        return value, True

    # Predicates are functions to True/False, raising _Unknown.
    def predicate(self):
        a = self.conjunction()
        while self.take("||"):
            a = self._either(a, self.conjunction(), True)
        return a

    def conjunction(self):
        a = self.unary()
        while self.take("&&"):
            a = self._either(a, self.unary(), False)
        return a

    @staticmethod
    def _either(a, b, decides: bool):
        def run(c, v):
            unknown = False
            for p in (a, b):
                try:
                    if p(c, v) is decides:
                        return decides
                except _Unknown:
                    unknown = True
            if unknown:
                raise _Unknown
            return not decides

        return run

    def unary(self):
        if self.take("!"):
            p = self.unary()
            return lambda c, v: not p(c, v)
        if self.peek("exists"):
            self.i += 1
            self.need("(")
            e = self.expr()
            self.need(")")

            def exists(c, v):
                try:
                    return bool(e(c, v))
                except PathError:
                    raise _Unknown from None

            return exists
        if self.peek("("):
            at = self.i
            self.i += 1
            try:
                p = self.predicate()
                self.need(")")
            except PathError:
                self.i = at
                return self.comparison()
            if self.take("is"):
                self.need("unknown")

                def unknown(c, v):
                    try:
                        p(c, v)
                    except _Unknown:
                        return True
                    return False

                return unknown
            return p
        return self.comparison()

    def comparison(self):
        a = self.expr()
        if self.take("starts"):
            self.need("with")
            b = self.expr()
            return self._test(a, b, lambda x, y: x.startswith(y) if isinstance(x, str) and isinstance(y, str) else None)
        if self.take("like_regex"):
            pattern, flags = _unquote(self.t[self.i][1]), 0
            self.i += 1
            if self.take("flag"):
                letters = _unquote(self.t[self.i][1])
                self.i += 1
                flags = sum({"i": re.I, "s": re.S, "m": re.M, "x": re.X}.get(f, 0) for f in set(letters))
                if "q" in letters:
                    pattern = re.escape(pattern)
            r = re.compile(pattern, flags)
            return self._test(a, lambda c, v: [0], lambda x, _: bool(r.search(x)) if isinstance(x, str) else None)
        for op in ("==", "!=", "<>", "<=", ">=", "<", ">"):
            if self.take(op):
                return self._test(a, self.expr(), functools.partial(_compare, op))
        raise PathError("a predicate needs a comparison")

    def _test(self, a, b, f):
        strict = self.strict

        def run(c, v):
            try:
                xs, ys = a(c, v), b(c, v)
            except PathError:
                raise _Unknown from None
            if not strict:
                xs = [y for x in xs for y in (x if isinstance(x, list) else [x])]
                ys = [y for x in ys for y in (x if isinstance(x, list) else [x])]
            hit = unknown = False
            for x in xs:
                for y in ys:
                    r = f(x, y)
                    if r is None:
                        unknown = True
                    elif r:
                        if not strict:
                            return True
                        hit = True
            if unknown:
                raise _Unknown
            return hit

        return run

    # Expressions give lists of items.
    def expr(self):
        a = self.term()
        while self.peek("+", "-"):
            op = self.t[self.i][1]
            self.i += 1
            a = self._arith(op, a, self.term())
        return a

    def term(self):
        a = self.signed()
        while self.peek("*", "/", "%"):
            op = self.t[self.i][1]
            self.i += 1
            a = self._arith(op, a, self.signed())
        return a

    def signed(self):
        if self.peek("+", "-"):
            k = -1 if self.t[self.i][1] == "-" else 1
            self.i += 1
            e = self.signed()
            strict = self.strict

            def run(c, v):
                out = []
                for x in e(c, v):
                    for y in x if isinstance(x, list) and not strict else [x]:
                        if not _num(y):
                            raise PathError("unary sign needs a number")
                        out.append(k * y)
                return out

            return run
        return self.accessors()

    def _arith(self, op, a, b):
        strict = self.strict

        def one(xs):
            if not strict and len(xs) == 1 and isinstance(xs[0], list):
                xs = xs[0]
            if len(xs) != 1 or not _num(xs[0]):
                raise PathError(f"operand of {op} is not a single number")
            return xs[0]

        def run(c, v):
            x, y = one(a(c, v)), one(b(c, v))
            if op == "+":
                return [x + y]
            if op == "-":
                return [x - y]
            if op == "*":
                return [x * y]
            if y == 0:
                raise PathError("division by zero")
            if op == "/":
                q = x / y
                return [int(q) if isinstance(x, int) and isinstance(y, int) and x % y == 0 else q]
            return [math.fmod(x, y) if isinstance(x, float) or isinstance(y, float) else int(math.fmod(x, y))]

        return run

    def primary(self):
        kind, text = self.t[self.i]
        self.i += 1
        if kind == "num":
            x = int(text) if re.fullmatch(r"\d+", text) else float(text)
            return lambda c, v: [x]
        if kind == "str":
            s = _unquote(text)
            return lambda c, v: [s]
        if kind == "var":
            name = _unquote(text[1:]) if text[1] == '"' else text[1:]

            def var(c, v):
                if name not in v:
                    raise PathError(f"no variable {name}")
                return [v[name]]

            return var
        if (kind, text) == ("op", "$"):
            return lambda c, v: [c[0]]
        if (kind, text) == ("op", "@"):
            return lambda c, v: [c[1]]
        if kind == "name" and text in ("true", "false", "null"):
            x = {"true": True, "false": False, "null": None}[text]
            return lambda c, v: [x]
        if (kind, text) == ("name", "last"):
            return lambda c, v: [c[2]]
        if (kind, text) == ("op", "("):
            e = self.expr()
            self.need(")")
            return e
        raise PathError(f"unexpected {text!r}")

    def accessors(self):
        e = self.primary()
        while True:
            if self.take("."):
                kind, text = self.t[self.i]
                self.i += 1
                if text == "**" and kind == "op":
                    lo, hi = 0, None
                    if self.take("{"):
                        lo = self._level()
                        hi = self._level() if self.take("to") else lo
                        self.need("}")
                    e = self._each(e, functools.partial(_descend, lo, hi))
                elif text == "*" and kind == "op":
                    e = self._member(e, None)
                elif kind == "name" and self.peek("(") and text in _METHODS:
                    self.i += 1
                    arg = None
                    if not self.peek(")"):
                        arg = _unquote(self.t[self.i][1])
                        self.i += 1
                    self.need(")")
                    e = self._method(e, text, arg)
                elif kind in ("name", "str"):
                    e = self._member(e, _unquote(text) if kind == "str" else text)
                else:
                    raise PathError(f"bad accessor {text!r}")
            elif self.take("["):
                if self.take("*"):
                    self.need("]")
                    e = self._each(e, self._all)
                else:
                    parts = []
                    while True:
                        a = self.expr()
                        b = self.expr() if self.take("to") else None
                        parts.append((a, b))
                        if not self.take(","):
                            break
                    self.need("]")
                    e = self._subscript(e, parts)
            elif self.take("?"):
                self.need("(")
                p = self.predicate()
                self.need(")")
                e = self._filter(e, p)
            else:
                return e

    def _level(self):
        kind, text = self.t[self.i]
        self.i += 1
        return 1 << 30 if text == "last" else int(text)

    @staticmethod
    def _each(e, f):
        return lambda c, v: [y for x in e(c, v) for y in f(x)]

    def _all(self, x):
        if isinstance(x, list):
            return x
        if self.strict:
            raise PathError("[*] needs an array")
        return [x]

    def _member(self, e, name):
        strict = self.strict

        def run(c, v):
            out = []
            for x in e(c, v):
                for y in x if isinstance(x, list) and not strict else [x]:
                    if not isinstance(y, dict):
                        if strict:
                            raise PathError("member accessor needs an object")
                    elif name is None:
                        out.extend(y.values())
                    elif name in y:
                        out.append(y[name])
                    elif strict:
                        raise PathError(f"no key {name}")
            return out

        return run

    def _subscript(self, e, parts):
        strict = self.strict

        def run(c, v):
            out = []
            for x in e(c, v):
                if not isinstance(x, list):
                    if strict:
                        raise PathError("subscript needs an array")
                    x = [x]
                inner = [c[0], c[1], len(x) - 1]
                for a, b in parts:
                    lo = a(inner, v)
                    hi = b(inner, v) if b else lo
                    if len(lo) != 1 or len(hi) != 1 or not _num(lo[0]) or not _num(hi[0]):
                        raise PathError("subscript is not a single number")
                    lo, hi = int(lo[0]), int(hi[0])
                    if strict and (lo < 0 or hi >= len(x) or lo > hi):
                        raise PathError("subscript out of bounds")
                    out.extend(x[max(lo, 0) : hi + 1])
            return out

        return run

    def _filter(self, e, p):
        strict = self.strict

        def run(c, v):
            out = []
            for x in e(c, v):
                for y in x if isinstance(x, list) and not strict else [x]:
                    try:
                        if p([c[0], y, c[2]], v):
                            out.append(y)
                    except _Unknown:
                        pass
            return out

        return run

    def _method(self, e, name, arg):
        strict, f = self.strict, _METHODS[name]

        def run(c, v):
            out = []
            for x in e(c, v):
                for y in x if isinstance(x, list) and not strict and name not in ("type", "size") else [x]:
                    out.extend(f(y, strict, arg))
            return out

        return run


def _descend(lo, hi, x, depth=0):
    out = [x] if depth >= lo and (hi is None or depth <= hi) and not (lo == 1 << 30) else []
    kids = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
    if lo == 1 << 30 and not kids:
        out.append(x)
    if hi is None or depth < hi:
        for k in kids:
            out.extend(_descend(lo, hi, k, depth + 1))
    return out


def _compare(op, x, y):
    if x is None or y is None:
        if x is None and y is None:
            return op in ("==", "<=", ">=")
        return op in ("!=", "<>") if not isinstance(x, (list, dict)) and not isinstance(y, (list, dict)) else None
    same = (_num(x) and _num(y)) or (type(x) is type(y) and isinstance(x, (str, bool, datetime)))
    if not same:
        return None
    if isinstance(x, datetime) and (x.tzinfo is None) != (y.tzinfo is None):
        if not _zones.get():
            raise PathError("a time with a zone and one without are compared in the _tz functions only")
        x, y = (z if z.tzinfo else z.replace(tzinfo=UTC) for z in (x, y))
    return {"==": x == y, "!=": x != y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _type(x, strict, arg):
    return ["null" if x is None else "boolean" if isinstance(x, bool) else "number" if _num(x) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object" if isinstance(x, dict) else "timestamp without time zone"]


def _size(x, strict, arg):
    if isinstance(x, list):
        return [len(x)]
    if strict:
        raise PathError("size() needs an array")
    return [1]


def _double(x, strict, arg):
    try:
        if isinstance(x, bool) or not isinstance(x, (int, float, str)):
            raise ValueError
        r = float(x)
        if math.isinf(r) or math.isnan(r):
            raise ValueError
        return [r]
    except ValueError:
        raise PathError("double() needs a number or numeric string") from None


def _numeric(f):
    def run(x, strict, arg):
        if not _num(x):
            raise PathError("method needs a number")
        return [f(x)]

    return run


def _keyvalue(x, strict, arg):
    if not isinstance(x, dict):
        raise PathError("keyvalue() needs an object")
    return [{"id": 0, "key": k, "value": v} for k, v in sorted(x.items(), key=lambda kv: (len(kv[0]), kv[0]))]


def _datetime(x, strict, arg):
    try:
        return [datetime.fromisoformat(x)]
    except (TypeError, ValueError):
        raise PathError("datetime() needs a date string") from None


_METHODS = {"type": _type, "size": _size, "double": _double, "ceiling": _numeric(math.ceil), "floor": _numeric(math.floor), "abs": _numeric(abs), "keyvalue": _keyvalue, "datetime": _datetime}


@functools.lru_cache(maxsize=512)
def compile_path(text: str):
    return _Parser(text).parse()


def _items(doc, path: str, variables: dict | None, tz: bool) -> list:
    e, _ = compile_path(path)
    before = _zones.set(tz)
    try:
        return e([doc, doc, -1], variables or {})
    finally:
        _zones.reset(before)


def query(doc, path: str, variables: dict | None = None, silent: bool = False, tz: bool = False) -> list:
    """Items that the path selects in a parsed document; with ``tz`` a time without a zone counts as UTC."""
    try:
        return _items(doc, path, variables, tz)
    except PathError:
        if silent:
            return []
        raise


def exists(doc, path: str, variables: dict | None = None, tz: bool = False) -> bool | None:
    """``@?``: errors give NULL."""
    try:
        return bool(_items(doc, path, variables, tz))
    except PathError:
        return None


def match(doc, path: str, variables: dict | None = None, tz: bool = False) -> bool | None:
    """``@@``: any item true; NULL where none is a boolean or on an error."""
    try:
        items = [x for x in _items(doc, path, variables, tz) if isinstance(x, bool)]
    except PathError:
        return None
    return any(items) if items else None
