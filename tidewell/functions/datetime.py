"""Date, time and interval functions (all JVM-side).

Timestamps are TIMESTAMP_NTZ in UTC, TIME is microseconds of the day (long),
and an INTERVAL is struct<months int, days int, micros long>.
"""

from __future__ import annotations

import re
import time

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
HOUR = 3_600_000_000
_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": HOUR}


def let(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def micros(ts: Column) -> Column:
    """Microseconds since 1970."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def _fdiv(a: Column, b: Column | int) -> Column:
    """Floor division of longs."""
    b = F.lit(b).cast("long") if isinstance(b, int) else b
    q = F.call_function("div", a, b)
    return F.when((a % b != 0) & ((a < 0) != (b < 0)), q - 1).otherwise(q)


def julian_day(ts: Column) -> Column:
    return F.lit(2440587.5) + micros(ts) / float(DAY)


def extract(field: str, ts: Column) -> Column:
    """EXTRACT / DATE_PART of a date or timestamp; Sunday is dow 0."""
    f = field.lower()
    t = ts.cast("timestamp_ntz")
    year = F.year(t)
    whole = micros(t)
    simple = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "quarter": F.quarter, "doy": F.dayofyear, "week": F.weekofyear}
    if f in simple:
        return simple[f](t).cast("long")
    more = {
        "second": lambda: F.pmod(whole, F.lit(60_000_000)) / 1e6,
        "microseconds": lambda: F.pmod(whole, F.lit(60_000_000)).cast("long"),
        "milliseconds": lambda: F.pmod(whole, F.lit(60_000_000)) / 1e3,
        "epoch": lambda: whole / 1e6,
        "dow": lambda: (F.dayofweek(t) - 1).cast("long"),
        "isodow": lambda: (F.weekday(t) + 1).cast("long"),
        "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), t).cast("long"),
        "decade": lambda: _fdiv(year.cast("long"), 10),
        "century": lambda: F.when(year > 0, _fdiv(year.cast("long") - 1, 100) + 1).otherwise(_fdiv(year.cast("long"), 100) - 0),
        "millennium": lambda: F.when(year > 0, _fdiv(year.cast("long") - 1, 1000) + 1).otherwise(_fdiv(year.cast("long"), 1000)),
        "julian": lambda: F.lit(2440588.0) + whole / float(DAY),
    }
    if f not in more:
        raise ValueError(f"unknown field {field}")
    return more[f]()


def date_trunc(unit: str, ts: Column, zone: str | None = None) -> Column:
    """Start of the unit; weeks begin on Monday; with a zone, the start in that zone."""
    u = unit.lower()
    if zone is not None:
        return F.to_utc_timestamp(date_trunc(unit, F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")).cast("timestamp"), zone).cast("timestamp_ntz")
    if u in ("decade", "century", "millennium"):
        y = F.year(ts).cast("long")
        n = {"decade": 10, "century": 100, "millennium": 1000}[u]
        first = _fdiv(y, 10) * 10 if u == "decade" else _fdiv(y - 1, n) * n + 1
        return F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.date_trunc(u.removesuffix("s") if u in ("microseconds", "milliseconds") else u, ts.cast("timestamp")).cast("timestamp_ntz")


def date_bin(stride: tuple[int, int, int], ts: Column, origin: Column) -> Column:
    """Start of the stride's bin from ``origin``; months in the stride are ignored."""
    w = stride[1] * DAY + stride[2]
    if w <= 0:
        raise ValueError("the stride must be positive")
    o = micros(origin)
    return from_micros(_fdiv(micros(ts) - o, w) * w + o)


def interval(months: Column | int = 0, days: Column | int = 0, us: Column | int = 0) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.struct(lit(months).cast("int").alias("months"), lit(days).cast("int").alias("days"), lit(us).cast("long").alias("micros"))


def make_interval(years=0, months=0, weeks=0, days=0, hours=0, minutes=0, seconds=0.0) -> Column:
    """NULL arguments count as 0."""
    z = [F.coalesce(F.lit(x) if not isinstance(x, Column) else x, F.lit(0)) for x in (years, months, weeks, days, hours, minutes, seconds)]
    return interval(z[0] * 12 + z[1], z[2] * 7 + z[3], z[4] * HOUR + z[5] * 60_000_000 + F.round(z[6] * 1_000_000).cast("long"))


def parse_interval(text: str) -> tuple[int, int, int]:
    """Months, days and microseconds of an interval literal.

    ``1 year 2 days 04:05:06``, ``3 weeks ago``, ISO ``P1Y2M3DT4H5M6.5S``.
    """
    s = text.strip()
    iso = re.fullmatch(r"([+-])?P(?:([\d.]+)Y)?(?:([\d.]+)M)?(?:([\d.]+)W)?(?:([\d.]+)D)?(?:T(?:([\d.]+)H)?(?:([\d.]+)M)?(?:([\d.]+)S)?)?", s, re.IGNORECASE)
    if iso and len(s) > 1:
        y, mo, w, d, h, mi, sec = (float(x or 0) for x in iso.groups()[1:])
        k = -1 if iso.group(1) == "-" else 1
        return k * int(y * 12 + mo), k * int(w * 7 + d), k * round((h * 3600 + mi * 60 + sec) * 1e6)
    months = days = us = 0
    ago = s.lower().endswith(" ago")
    for m in re.finditer(r"([+-]?\d+):(\d\d)(?::(\d\d(?:\.\d+)?))?|([+-]?\d+(?:\.\d+)?)\s*([a-z]+)", s[:-4] if ago else s, re.IGNORECASE):
        if m.group(1):
            k = -1 if m.group(1).startswith("-") else 1
            us += k * round((abs(int(m.group(1))) * 3600 + int(m.group(2)) * 60 + float(m.group(3) or 0)) * 1e6)
            continue
        n, u = float(m.group(4)), m.group(5).lower().rstrip("s")
        if u in ("year", "yr", "y", "month", "mon", "decade", "century", "millennium"):
            x = n * {"year": 12, "yr": 12, "y": 12, "month": 1, "mon": 1, "decade": 120, "century": 1200, "millennium": 12000}[u]
            months += int(x)
            days += int((x - int(x)) * 30)
        elif u in ("week", "w", "day", "d"):
            x = n * (7 if u.startswith("w") else 1)
            days += int(x)
            us += round((x - int(x)) * DAY)
        elif (unit := {"hour": HOUR, "hr": HOUR, "h": HOUR, "minute": 60_000_000, "min": 60_000_000, "m": 60_000_000, "second": 1_000_000, "sec": 1_000_000, "": 1_000_000, "millisecond": 1000, "microsecond": 1, "u": 1}.get(u)) is not None:
            us += round(n * unit)
        else:
            raise ValueError(f"unknown unit {m.group(5)}")
    k = -1 if ago else 1
    return k * months, k * days, k * us


def add(ts: Column, iv: Column, sign: int = 1) -> Column:
    """TIMESTAMP or DATE ± INTERVAL: months (clamped to the month's end), then days, then microseconds."""
    if not isinstance(iv, Column):
        raise TypeError("a timestamp takes an interval, not a number")
    t = ts.cast("timestamp_ntz")
    day = F.add_months(t.cast("date"), sign * iv["months"])
    within = F.pmod(micros(t), F.lit(DAY))
    return from_micros(micros(F.date_add(day, sign * iv["days"]).cast("timestamp_ntz")) + within + sign * iv["micros"])


def minus(a: Column, b: Column) -> Column:
    """TIMESTAMP - TIMESTAMP: days and microseconds, both toward zero."""
    d = micros(a) - micros(b)
    return interval(0, F.call_function("div", d, F.lit(DAY)), d % F.lit(DAY))


def date_minus(a: Column, b: Column) -> Column:
    """DATE - DATE in days."""
    return F.datediff(a, b).cast("long")


def iv_add(a: Column, b: Column, sign: int = 1) -> Column:
    return interval(a["months"] + sign * b["months"], a["days"] + sign * b["days"], a["micros"] + sign * b["micros"])


def iv_times(a: Column, k: Column | float) -> Column:
    """INTERVAL x number: fractional months become days (of 30), fractional days microseconds."""
    k = F.lit(float(k)) if not isinstance(k, Column) else k.cast("double")
    split = lambda x: x.cast("long")

    def months(x: Column) -> Column:
        mo = x["i"]["months"] * x["k"]
        dd = x["i"]["days"] * x["k"] + (mo - split(mo)) * 30
        return let(F.struct(split(mo).alias("mo"), dd.alias("dd"), (x["i"]["micros"] * x["k"]).alias("us")), lambda y: interval(y["mo"], split(y["dd"]), F.round(y["us"] + (y["dd"] - split(y["dd"])) * DAY).cast("long")))

    return let(F.struct(a.alias("i"), k.alias("k")), months)


def iv_total(a: Column) -> Column:
    """Microseconds for comparison: a month has 30 days, a day 24 hours."""
    return (a["months"].cast("long") * 30 + a["days"]) * DAY + a["micros"]


def justify_hours(a: Column) -> Column:
    return let(a, lambda x: interval(x["months"], x["days"] + F.call_function("div", x["micros"], F.lit(DAY)), x["micros"] % DAY))


def justify_days(a: Column) -> Column:
    return let(a, lambda x: interval(x["months"] + F.call_function("div", x["days"].cast("long"), F.lit(30).cast("long")), x["days"] % 30, x["micros"]))


def justify_interval(a: Column) -> Column:
    return justify_days(justify_hours(a))


def iv_extract(field: str, a: Column) -> Column:
    us = a["micros"]
    q = lambda x, y: F.call_function("div", x, F.lit(y).cast("long"))
    return {
        "year": lambda: q(a["months"].cast("long"), 12), "month": lambda: (a["months"] % 12).cast("long"), "day": lambda: a["days"].cast("long"),
        "hour": lambda: q(us, HOUR), "minute": lambda: q(us, 60_000_000) % 60, "second": lambda: (us % 60_000_000) / 1e6, "microseconds": lambda: us % 60_000_000,
        "epoch": lambda: iv_total(a) / 1e6,
    }[field.lower()]()


def age(a: Column, b: Column | None = None) -> Column:
    """Symbolic span from ``b`` (default: today) to ``a``: whole months, then days, then time."""
    if b is None:
        a, b = F.current_date().cast("timestamp_ntz"), a
    a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    ends = F.struct(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.when(a < b, F.lit(-1)).otherwise(F.lit(1)).alias("k"))

    def months(e: Column) -> Column:
        raw = ((F.year(e["hi"]) - F.year(e["lo"])) * 12 + F.month(e["hi"]) - F.month(e["lo"])).cast("int")
        whole = F.when(add(e["lo"], interval(raw)) > e["hi"], raw - 1).otherwise(raw)
        return let(F.struct(e["hi"].alias("hi"), e["lo"].alias("lo"), e["k"].alias("k"), whole.alias("m")), days)

    def days(e: Column) -> Column:
        rest = micros(e["hi"]) - micros(add(e["lo"], interval(e["m"])))
        return let(F.struct(e["k"].alias("k"), e["m"].alias("m"), rest.alias("r")), lambda x: interval(x["k"] * x["m"], x["k"] * F.call_function("div", x["r"], F.lit(DAY)), x["k"] * (x["r"] % DAY)))

    return let(ends, months)


def make_time(h: Column, m: Column, s: Column) -> Column:
    bad = F.raise_error(F.lit("invalid time")).cast("long")
    return F.when((h < 0) | (h > 23) | (m < 0) | (m > 59) | (s < 0) | (s >= 60), bad).otherwise(h * HOUR + m * 60_000_000 + F.round(s * 1_000_000).cast("long"))


def make_date(y: Column, m: Column, d: Column) -> Column:
    return F.make_date(y, m, d)


def make_timestamp(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    return from_micros(micros(F.make_date(y, mo, d).cast("timestamp_ntz")) + make_time(h, mi, s))


def time_of(ts: Column) -> Column:
    return F.pmod(micros(ts), F.lit(DAY))


def time_add(t: Column, iv: Column, sign: int = 1) -> Column:
    """TIME ± INTERVAL wraps at midnight; months or days are an error."""
    bad = F.raise_error(F.lit("TIME takes no months or days")).cast("long")
    return F.when((iv["months"] != 0) | (iv["days"] != 0), bad).otherwise(F.pmod(t + sign * iv["micros"], F.lit(DAY)))


def time_text(t: Column) -> Column:
    s = F.date_format(F.timestamp_micros(t), "HH:mm:ss.SSSSSS")
    return F.when(t % 1_000_000 == 0, F.substring(s, 1, 8)).otherwise(s)


def unixepoch(ts: Column, subsec: bool = False) -> Column:
    return micros(ts) / 1e6 if subsec else F.call_function("div", micros(ts), F.lit(1_000_000).cast("long"))


def timediff(a: Column, b: Column) -> Column:
    """Text ``±DDDD-00-00 HH:MM:SS.ffffff``."""
    d = F.abs(micros(a) - micros(b))
    days = F.call_function("div", d, F.lit(DAY))
    return F.concat(F.when(micros(a) < micros(b), "-").otherwise("+"), F.lpad(days.cast("string"), 4, "0"), F.lit("-00-00 "), F.date_format(F.timestamp_micros(d % DAY), "HH:mm:ss.SSSSSS"))


_STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "I": "hh", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy"}


def strftime(fmt: str, ts: Column) -> Column:
    parts: list[Column] = []
    t = ts.cast("timestamp")
    for m in re.finditer(r"%(.)|([^%]+)", fmt):
        c, plain = m.groups()
        if plain is not None:
            parts.append(F.lit(plain))
        elif c == "%":
            parts.append(F.lit("%"))
        elif c in _STRFTIME:
            parts.append(F.date_format(t, _STRFTIME[c]))
        elif c == "j":
            parts.append(F.lpad(F.dayofyear(t).cast("string"), 3, "0"))
        elif c == "f":
            parts.append(F.lpad((micros(ts) % 1_000_000).cast("string"), 6, "0"))
        elif c == "s":
            parts.append(unixepoch(ts).cast("string"))
        elif c == "J":
            parts.append(julian_day(ts).cast("string"))
        elif c == "w":
            parts.append((F.dayofweek(t) - 1).cast("string"))
        elif c == "u":
            parts.append((F.weekday(t) + 1).cast("string"))
        else:
            raise ValueError(f"unsupported %{c}")
    return F.concat(*parts)


def at_time_zone(ts: Column, zone: str) -> Column:
    """Text of the UTC timestamp in the zone; fixed offsets like ``UTC+5`` are rejected."""
    if re.match(r"(?i)^(utc|gmt)[+-]", zone):
        raise ValueError(f"unknown time zone {zone}")
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "yyyy-MM-dd HH:mm:ss")


def isfinite(c: Column) -> Column:
    """There is no infinite date here: every known value is finite."""
    return F.when(c.isNotNull(), F.lit(True))


# The clock.  A query's plan reads it once, so that all rows see one time, except for ``clock_timestamp``.
def now() -> Column:
    """NOW, CURRENT_TIMESTAMP, LOCALTIMESTAMP, STATEMENT_ and TRANSACTION_TIMESTAMP: the query's time, UTC."""
    return F.current_timestamp().cast("timestamp_ntz")


def current_date() -> Column:
    return now().cast("date")


def current_time() -> Column:
    """CURRENT_TIME and LOCALTIME: microseconds of the day."""
    return time_of(now())


def clock_timestamp() -> Column:
    """The wall clock at each row's evaluation (batch by batch)."""
    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([time.time_ns() // 1000] * len(x), index=x.index)

    return from_micros(run(F.lit(0)))


def random() -> Column:
    """RANDOM(): an integer of 64 bits, another one for each row."""
    return F.xxhash64(F.rand(), F.monotonically_increasing_id())


def parse_time(c: Column) -> Column:
    """Microseconds of the day of ``HH:MM[:SS[.ffffff]]``; other text is an error."""
    m = lambda g: F.regexp_extract(c, r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?))?\s*$", g)
    bad = F.raise_error(F.concat(F.lit("invalid time: "), c)).cast("long")
    value = make_time(m(1).cast("long"), m(2).cast("long"), F.coalesce(F.nullif(m(3), F.lit("")).cast("double"), F.lit(0.0)))
    return F.when(c.isNull(), F.lit(None).cast("long")).when(m(1) == "", bad).otherwise(value)


def date_of(c: Column, kind: str) -> Column:
    """DATE(x) of text (``now`` too), of seconds since 1970, or of a date or timestamp."""
    if kind == "text":
        return F.when(F.lower(F.trim(c)) == "now", current_date()).otherwise(F.to_date(c))
    return from_micros(c.cast("long") * 1_000_000).cast("date") if kind == "integer" else c.cast("date")


def time_from(c: Column, kind: str) -> Column:
    """TIME(x) of text (``now`` too), of a timestamp, or of a time."""
    if kind == "text":
        return F.when(F.lower(F.trim(c)) == "now", current_time()).otherwise(parse_time(F.when(F.lower(F.trim(c)) != "now", c)))
    return c if kind == "time" else time_of(c)


def datetime_of(c: Column, kind: str) -> Column:
    """DATETIME(x) of text (``now`` too), of seconds since 1970, or of a date or timestamp."""
    if kind == "text":
        return F.when(F.lower(F.trim(c)) == "now", now()).otherwise(c.try_cast("timestamp_ntz"))
    return from_micros(c.cast("long") * 1_000_000) if kind == "integer" else c.cast("timestamp_ntz")


def time_extract(field: str, t: Column) -> Column:
    """EXTRACT FROM a TIME."""
    part = lambda a, b: F.call_function("div", t % a, F.lit(b).cast("long"))
    fields = {
        "hour": lambda: part(DAY, HOUR), "minute": lambda: part(HOUR, 60_000_000), "second": lambda: (t % 60_000_000) / 1e6,
        "microseconds": lambda: t % 60_000_000, "milliseconds": lambda: (t % 60_000_000) / 1e3, "epoch": lambda: part(DAY, 1_000_000),
    }
    if field.lower() not in fields:
        raise ValueError(f"{field} from TIME")
    return fields[field.lower()]()


def time_minus(a: Column, b: Column) -> Column:
    """TIME - TIME: an interval of microseconds."""
    return interval(0, 0, a - b)


def time_trunc(unit: str, t: Column) -> Column:
    """DATE_TRUNC of a TIME."""
    u = unit.lower().rstrip("s")
    if u not in _UNITS:
        raise ValueError(f"{unit} is invalid for TIME")
    return t - t % _UNITS[u]


def iv_trunc(unit: str, a: Column) -> Column:
    """DATE_TRUNC of an INTERVAL."""
    u = unit.lower().rstrip("s")
    if u in _UNITS:
        return let(a, lambda x: interval(x["months"], x["days"], x["micros"] - x["micros"] % _UNITS[u]))
    if u == "day":
        return let(a, lambda x: interval(x["months"], x["days"], 0))
    n = {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200, "millennium": 12000}.get(u)
    if n is None:
        raise ValueError(f"unknown unit {unit}")
    return let(a, lambda x: interval(x["months"] - x["months"] % n, 0, 0))


def iv_div(a: Column, k: Column | float) -> Column:
    """INTERVAL / number; division by zero is an error."""
    k = F.lit(float(k)) if not isinstance(k, Column) else k.cast("double")
    bad = F.raise_error(F.lit("division by zero")).cast("double")
    return iv_times(a, F.when(k == 0, bad).otherwise(F.lit(1.0) / k))


def iv_compare(a: Column, op: str, b: Column) -> Column:
    """Comparison of intervals: a month counts as 30 days, a day as 24 hours."""
    x, y = iv_total(a), iv_total(b)
    return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def iv_sum(a: Column) -> Column:
    """SUM of intervals (aggregate), part by part; NULLs are skipped, no interval gives NULL."""
    parts = F.struct(F.sum(a["months"]).cast("int").alias("months"), F.sum(a["days"]).cast("int").alias("days"), F.sum(a["micros"]).alias("micros"))
    return F.when(F.count(a) > 0, parts)


def iv_avg(a: Column) -> Column:
    """AVG of intervals (aggregate)."""
    return iv_div(iv_sum(a), F.nullif(F.count(a), F.lit(0)).cast("double"))


def parse_intervals(c: Column) -> Column:
    """CAST(text AS INTERVAL) of a column."""
    @F.pandas_udf("struct<months:int,days:int,micros:long>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = [parse_interval(t) if t is not None else (None, None, None) for t in s]
        return pd.DataFrame(rows, columns=["months", "days", "micros"], index=s.index).astype("Int64")

    return F.when(c.isNotNull(), run(c))


def iv_text(a: Column) -> Column:
    """``1 year 2 mons 3 days 04:05:06``; a zero interval is ``00:00:00``."""
    unit = lambda n, one, many: F.when(n != 0, F.concat(n.cast("string"), F.lit(" "), F.when(F.abs(n) == 1, one).otherwise(many)))
    us = F.abs(a["micros"])
    div = lambda x, y: F.call_function("div", x, F.lit(y).cast("long"))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    fraction = F.when(us % 1_000_000 != 0, F.concat(F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0"))).otherwise("")
    hours = div(us, HOUR)
    clock = F.concat(F.when(a["micros"] < 0, "-").otherwise(""), F.when(hours < 10, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(div(us % HOUR, 60_000_000)), F.lit(":"), two(div(us % 60_000_000, 1_000_000)), fraction)
    years, months = div(a["months"].cast("long"), 12), a["months"] % 12
    return F.concat_ws(" ", unit(years, "year", "years"), unit(months, "mon", "mons"), unit(a["days"], "day", "days"), F.when((a["micros"] != 0) | (a["months"] == 0) & (a["days"] == 0), clock))
