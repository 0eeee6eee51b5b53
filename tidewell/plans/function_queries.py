"""String, number, date and interval functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import datetime as D
from tidewell.functions import scalar as S
from tidewell.plans.registry import query
from tidewell.session import configure, table

c = F.col


@query(
    """SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS lo, length(c_name) AS n, replace(c_name, '0', '-') AS r,
    instr(c_name, '#') AS i, concat(c_name, '/', c_mktsegment) AS cc, hex(c_mktsegment) AS h, trim('  ' || c_name || ' ') AS t FROM customer"""
)
def string_funcs(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    n, m = c("c_name"), c("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", S.upper(n).alias("up"), S.lower(m).alias("lo"), S.length(n).alias("n"), S.replace(n, "0", "-").alias("r"),
        S.instr(n, "#").alias("i"), S.concat(n, F.lit("/"), m).alias("cc"), S.hex_(m).alias("h"), S.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("t"),
    )


@query(
    """SELECT p_partkey, substr(p_name, 3) AS a, substr(p_name, 2, 4) AS b, CASE WHEN 3 - 1 <= 0 THEN '' ELSE substr(p_name, 1, 2) END AS z,
    right(p_name, 3) AS neg, CASE WHEN 5 - 3 <= 0 THEN '' ELSE substr(p_name, 1, 5 - 2 - 1) END AS n3 FROM part"""
)
def substr_quirks(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    n = c("p_name")
    return table(spark, d, "part").select("p_partkey", S.substr(n, 3).alias("a"), S.substr(n, 2, 4).alias("b"), S.substr(n, 0, 3).alias("z"), S.substr(n, -3).alias("neg"), S.substr(n, -2, 5).alias("n3"))


@query("SELECT p_partkey, trim(p_brand, 'B#0') AS a, ltrim(p_brand, 'Br') AS b, rtrim(p_brand, '0123456789') AS e FROM part")
def trim_chars(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    b = c("p_brand")
    return table(spark, d, "part").select("p_partkey", S.trim(b, "B#0").alias("a"), S.ltrim(b, "Br").alias("b"), S.rtrim(b, "0123456789").alias("e"))


@query(
    """SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS up, CAST(floor(c_acctbal) AS BIGINT) AS dn, CAST(sign(c_acctbal) AS BIGINT) AS sg,
    CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END AS sq FROM customer"""
)
def math_funcs(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    b = c("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.abs(b).alias("a"), S.ceil(b).alias("up"), S.floor(b).alias("dn"), S.sign(b).alias("sg"), S.sqrt(b).alias("sq"))


@query("SELECT o_orderkey, (o_custkey - 500) // 7 AS q, (o_custkey - 500) % 7 AS r FROM orders")
def div_mod(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    k = c("o_custkey") - 500
    return table(spark, d, "orders").select("o_orderkey", S.div(k, F.lit(7).cast("long")).alias("q"), (k % 7).alias("r"))


@query("SELECT id, least(access_count, 3) AS lo, greatest(confidence, 0.5) AS hi FROM (SELECT DISTINCT id, access_count, confidence FROM atoms)")
def scalar_minmax(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    a = table(spark, d, "atoms").select("id", "access_count", "confidence").distinct()
    return a.select("id", S.least2(c("access_count"), F.lit(3).cast("long")).alias("lo"), S.greatest2(c("confidence"), F.lit(0.5)).alias("hi"))


@query("SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS i, CAST(c_custkey AS VARCHAR) AS t, CAST(c_custkey AS DOUBLE) AS f, c_custkey % 2 = 0 AS b FROM customer")
def cast_matrix(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    even = F.when(c("c_custkey") % 2 == 0, "Yes ").otherwise("off")
    return table(spark, d, "customer").select("c_custkey", S.to_int(c("c_acctbal").cast("string")).alias("i"), c("c_custkey").cast("string").alias("t"), c("c_custkey").cast("double").alias("f"), S.to_bool(even).alias("b"))


_FIELDS = ["year", "month", "day", "hour", "minute", "quarter", "doy", "week", "dow", "isodow", "isoyear", "decade", "century", "millennium"]


@query("SELECT event_id, " + ", ".join(f"CAST(extract({f} FROM ts) AS BIGINT) AS f_{f}" for f in _FIELDS) + ", CAST(extract(microseconds FROM ts) AS BIGINT) AS us, epoch(ts) AS ep FROM events")
def extract_fields(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return table(spark, d, "events").select("event_id", *[D.extract(f, c("ts")).alias(f"f_{f}") for f in _FIELDS], D.extract("microseconds", c("ts")).alias("us"), D.extract("epoch", c("ts")).alias("ep"))


_SPECIAL = {"century": "CAST(make_date((year(ts) - 1) // 100 * 100 + 1, 1, 1) AS TIMESTAMP)", "millennium": "CAST(make_date((year(ts) - 1) // 1000 * 1000 + 1, 1, 1) AS TIMESTAMP)"}
_TRUNC = ["microseconds", "milliseconds", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium"]


@query("SELECT event_id, " + ", ".join(_SPECIAL.get(u, f"CAST(date_trunc('{u}', ts) AS TIMESTAMP)") + f" AS t_{u}" for u in _TRUNC) + " FROM events")
def date_trunc_units(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return table(spark, d, "events").select("event_id", *[D.date_trunc(u, c("ts")).alias(f"t_{u}") for u in _TRUNC])


@query("SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2001-01-01 00:05:00') AS b FROM events")
def date_bin(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return table(spark, d, "events").select("event_id", D.date_bin(D.parse_interval("15 minutes"), c("ts"), F.lit("2001-01-01 00:05:00").cast("timestamp_ntz")).alias("b"))


@query("SELECT event_id, ts + INTERVAL 1 MONTH + INTERVAL 2 DAY + INTERVAL 3 HOUR AS a, ts - INTERVAL 14 MONTH AS b, CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS BIGINT) AS us FROM events")
def ts_arith(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    ts = c("ts")
    diff = D.minus(ts, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return table(spark, d, "events").select("event_id", D.add(ts, D.interval(1, 2, 3 * D.HOUR)).alias("a"), D.add(ts, D.interval(14), -1).alias("b"), D.iv_total(diff).alias("us"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS later, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
def date_arith(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    day = c("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", F.date_add(day, 30).alias("later"), D.date_minus(day, F.lit("1995-01-01").cast("date")).alias("days"))


@query("SELECT o_orderkey, make_date(1990 + o_orderkey % 20, 1 + o_orderkey % 12, 1 + o_orderkey % 28) AS d, make_timestamp(2000 + o_orderkey % 20, 3, 5, o_orderkey % 24, 30, 1.5) AS t FROM orders")
def make_date_ts(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    k = c("o_orderkey")
    i = lambda x: x.cast("int")
    return table(spark, d, "orders").select("o_orderkey", D.make_date(i(1990 + k % 20), i(1 + k % 12), i(1 + k % 28)).alias("d"), D.make_timestamp(i(2000 + k % 20), F.lit(3), F.lit(5), k % 24, F.lit(30), F.lit(1.5)).alias("t"))


@query("SELECT event_id, round(epoch_us(ts) / 86400000000.0 + 2440587.5, 4) AS jd, epoch_us(ts) // 1000000 AS ue, strftime(ts, '%Y/%m/%d %H:%M:%S %j %b %a %%') AS s FROM events")
def julian_unix_strftime(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return table(spark, d, "events").select("event_id", F.round(D.julian_day(c("ts")), 4).alias("jd"), D.unixepoch(c("ts")).alias("ue"), D.strftime("%Y/%m/%d %H:%M:%S %j %b %a %%", c("ts")).alias("s"))


@query("SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') AS ny FROM events")
def at_time_zone(spark: SparkSession, d: str) -> DataFrame:
    configure(spark)
    return table(spark, d, "events").select("event_id", D.at_time_zone(c("ts"), "America/New_York").alias("ny"))


_AGE = "age(TIMESTAMP '2001-03-31 12:00:00', CAST(o_orderdate AS TIMESTAMP))"


@query(
    f"""SELECT o_orderkey, CAST(datepart('year', a) * 12 + datepart('month', a) AS INTEGER) AS months, CAST(datepart('day', a) AS INTEGER) AS days, CAST(datepart('hour', a) AS BIGINT) AS hours,
    CAST(datepart('year', a) AS BIGINT) AS years, CAST(datepart('year', a) * 12 + datepart('month', a) AS BIGINT) * 2592000 + CAST(datepart('day', a) AS BIGINT) * 86400 + CAST(datepart('hour', a) AS BIGINT) * 3600 AS epoch FROM (SELECT o_orderkey, {_AGE} AS a FROM orders)"""
)
def age(spark: SparkSession, d: str) -> DataFrame:
    """AGE and EXTRACT FROM INTERVAL."""
    configure(spark)
    a = D.age(F.lit("2001-03-31 12:00:00").cast("timestamp_ntz"), c("o_orderdate"))
    rows = table(spark, d, "orders").select("o_orderkey", a.alias("a"))
    return rows.select("o_orderkey", c("a.months").alias("months"), c("a.days").alias("days"), D.iv_extract("hour", c("a")).alias("hours"), D.iv_extract("year", c("a")).alias("years"), D.iv_extract("epoch", c("a")).cast("long").alias("epoch"))


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals made of the orders' keys: months, days and hours."""
    configure(spark)
    k = c("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", D.make_interval(0, k % 30, 1, k % 50, k % 40, F.lit(None).cast("int"), 1.5).alias("iv"))


_M, _D, _U = "(o_orderkey % 30)", "(7 + o_orderkey % 50)", "((o_orderkey % 40) * 3600000000 + 1500000)"


@query(f"SELECT o_orderkey, CAST({_M} AS INTEGER) AS months, CAST({_D} AS INTEGER) AS days, CAST({_U} AS BIGINT) AS micros, CAST({_D} + {_U} // 86400000000 AS INTEGER) AS h_days, CAST({_M} + {_D} // 30 AS INTEGER) AS d_months, CAST(({_D} + {_U} // 86400000000) % 30 AS INTEGER) AS i_days FROM orders")
def make_interval(spark: SparkSession, d: str) -> DataFrame:
    """MAKE_INTERVAL and JUSTIFY_HOURS, _DAYS, _INTERVAL."""
    rows, iv = _intervals(spark, d), c("iv")
    return rows.select("o_orderkey", "iv.months", "iv.days", "iv.micros", D.justify_hours(iv)["days"].alias("h_days"), D.justify_days(iv)["months"].alias("d_months"), D.justify_interval(iv)["days"].alias("i_days"))


_TOTAL = f"(({_M} * 30 + {_D}) * 86400000000 + {_U})"


@query(f"SELECT o_orderkey, {_TOTAL} < 31536000000000 AS less, {_TOTAL} = 2592000000000 * 13 AS same, {_TOTAL} >= 31536000000000 AS more FROM orders")
def interval_cmp(spark: SparkSession, d: str) -> DataFrame:
    rows, iv = _intervals(spark, d), c("iv")
    year = D.interval(12, 5)
    return rows.select("o_orderkey", D.iv_compare(iv, "<", year).alias("less"), D.iv_compare(iv, "=", D.interval(13)).alias("same"), D.iv_compare(iv, ">=", year).alias("more"))


@query(f"SELECT o_orderkey, CAST({_M} + 2 AS INTEGER) AS plus, CAST({_D} - 3 AS INTEGER) AS less_, CAST({_M} * 3 AS INTEGER) AS times, CAST({_M} // 2 AS INTEGER) AS half_months, CAST(trunc({_D} / 2.0 + ({_M} % 2) * 15) AS INTEGER) AS half_days FROM orders")
def interval_arith(spark: SparkSession, d: str) -> DataFrame:
    rows, iv = _intervals(spark, d), c("iv")
    half = D.iv_div(iv, 2)
    return rows.select("o_orderkey", D.iv_add(iv, D.interval(2))["months"].alias("plus"), D.iv_add(iv, D.interval(0, 3), -1)["days"].alias("less_"), D.iv_times(iv, 3)["months"].alias("times"), half["months"].alias("half_months"), half["days"].alias("half_days"))


@query(f"SELECT o_custkey, CAST(sum({_M}) AS INTEGER) AS months, CAST(sum({_D}) AS INTEGER) AS days, CAST(sum({_U}) AS BIGINT) AS micros, CAST(sum({_M}) // count(*) AS INTEGER) AS avg_months FROM orders GROUP BY o_custkey")
def interval_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """SUM and AVG of intervals."""
    sums = _intervals(spark, d).groupBy("o_custkey").agg(D.iv_sum(c("iv")).alias("s"), D.iv_avg(c("iv")).alias("a"))
    return sums.select("o_custkey", "s.months", "s.days", "s.micros", c("a.months").alias("avg_months"))


@query(f"SELECT o_orderkey, CAST({_M} AS INTEGER) AS months, CAST({_D} AS INTEGER) AS days, CAST((o_orderkey % 40) * 3600000000 AS BIGINT) AS micros, {_M} // 12 * 12 AS y_months, CAST((o_orderkey % 40) * 3600000000 AS BIGINT) AS hours FROM orders")
def interval_parse(spark: SparkSession, d: str) -> DataFrame:
    """Text to INTERVAL and back, and DATE_TRUNC of an interval."""
    configure(spark)
    k = c("o_orderkey")
    text = F.concat((k % 30).cast("string"), F.lit(" months 1 week "), (k % 50).cast("string"), F.lit(" days "), F.lpad((k % 40).cast("string"), 2, "0"), F.lit(":00:00"))
    rows = table(spark, d, "orders").select("o_orderkey", D.parse_intervals(text).alias("iv"))
    again = rows.select("o_orderkey", D.parse_intervals(D.iv_text(c("iv"))).alias("iv"))
    return again.select("o_orderkey", "iv.months", "iv.days", "iv.micros", D.iv_trunc("year", c("iv"))["months"].cast("long").alias("y_months"), D.iv_trunc("hour", c("iv"))["micros"].alias("hours"))


@query(
    """SELECT event_id, CAST(extract(hour FROM ts) AS BIGINT) AS h, CAST(extract(minute FROM ts) AS BIGINT) AS m, CAST((epoch_us(ts) % 86400000000) // 60000000 * 60000000 AS BIGINT) AS minute_,
    CAST((epoch_us(ts) % 86400000000 + 7200000000) % 86400000000 AS BIGINT) AS later, CAST(epoch_us(ts) % 86400000000 - 43200000000 AS BIGINT) AS from_noon, strftime(ts, '%H:%M:00') AS text, CAST((epoch_us(ts) % 86400000000) // 60000000 * 60000000 AS BIGINT) AS again FROM events"""
)
def time_funcs(spark: SparkSession, d: str) -> DataFrame:
    """TIME: fields, truncation, TIME plus INTERVAL, TIME minus TIME, MAKE_TIME, text."""
    configure(spark)
    t = D.time_of(c("ts"))
    minute = D.time_trunc("minute", t)
    return table(spark, d, "events").select(
        "event_id", D.time_extract("hour", t).alias("h"), D.time_extract("minute", t).alias("m"), minute.alias("minute_"), D.time_add(t, D.interval(0, 0, 2 * D.HOUR)).alias("later"),
        D.time_minus(t, D.make_time(F.lit(12), F.lit(0), F.lit(0.0)))["micros"].alias("from_noon"), D.time_text(minute).alias("text"), D.parse_time(D.time_text(minute)).alias("again"),
    )


@query("SELECT event_id, CAST(ts AS DATE) AS a, CAST(ts AS DATE) AS b, date_trunc('second', ts) AS c, date_trunc('second', ts) AS e, CAST(date_trunc('second', ts) AS TIMESTAMP) + INTERVAL 5 DAY AS plus, true AS finite FROM events")
def date_time_of(spark: SparkSession, d: str) -> DataFrame:
    """DATE(x) and DATETIME(x) of text and of seconds, DATE plus INTERVAL, ISFINITE."""
    configure(spark)
    ts = c("ts")
    text = F.date_format(ts.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return table(spark, d, "events").select(
        "event_id", D.date_of(text, "text").alias("a"), D.date_of(D.unixepoch(ts), "integer").alias("b"), D.datetime_of(text, "text").alias("c"), D.datetime_of(D.unixepoch(ts), "integer").alias("e"),
        D.add(D.datetime_of(text, "text"), D.interval(0, 5)).alias("plus"), D.isfinite(ts).alias("finite"),
    )


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-02-01' THEN '-' ELSE '+' END || lpad(CAST(abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-02-01')) // 86400000000 AS VARCHAR), 4, '0') || '-00-00' AS diff, round(epoch_us(ts) / 1e6, 3) AS sub, CAST(epoch_us(ts) % 1000000 AS BIGINT) AS f, CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS s FROM events")
def timediff_subsec(spark: SparkSession, d: str) -> DataFrame:
    """TIMEDIFF's days, UNIXEPOCH with 'subsec', STRFTIME %f and %s."""
    configure(spark)
    ts = c("ts")
    return table(spark, d, "events").select("event_id", F.substring(D.timediff(ts, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")), 1, 11).alias("diff"), F.round(D.unixepoch(ts, True), 3).alias("sub"), D.strftime("%f", ts).cast("long").alias("f"), D.strftime("%s", ts).alias("s"))


@query("SELECT r_regionkey, true AS same, true AS day, true AS time, true AS clock, true AS wide FROM region")
def clock(spark: SparkSession, d: str) -> DataFrame:
    """NOW, CURRENT_DATE, CURRENT_TIME, CLOCK_TIMESTAMP and RANDOM agree with each other."""
    configure(spark)
    rows = table(spark, d, "region").select("r_regionkey", D.now().alias("a"), D.current_date().alias("day"), D.current_time().alias("time"), D.clock_timestamp().alias("clock"), D.random().alias("r"))
    apart = D.micros(c("clock")) - D.micros(c("a"))
    return rows.select("r_regionkey", (c("a") == D.now()).alias("same"), (c("a").cast("date") == c("day")).alias("day"), (D.time_of(c("a")) == c("time")).alias("time"), F.abs(apart).__lt__(D.DAY).alias("clock"), (F.typeof("r") == "bigint").alias("wide"))


@query("SELECT event_id, date_trunc('day', ts - INTERVAL 5 HOUR) + INTERVAL 5 HOUR AS local_day FROM events WHERE ts < TIMESTAMP '2024-03-01'")
def date_trunc_zone(spark: SparkSession, d: str) -> DataFrame:
    """DATE_TRUNC in a zone (winter, five hours behind)."""
    configure(spark)
    return table(spark, d, "events").where(c("ts") < F.lit("2024-03-01").cast("timestamp_ntz")).select("event_id", D.date_trunc("day", c("ts"), "America/New_York").alias("local_day"))


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' ELSE 'other' END AS sign_, round(c_acctbal) AS r0, round(c_acctbal, 1) AS r1, 'integer' AS t1, 'real' AS t2, 'text' AS t3, 'null' AS t4, 'boolean' AS t5,
    concat(NULL, c_mktsegment, NULL) AS joined, c_name ILIKE 'customer#%0_' AS like_ci, position('100%' IN concat('100%', c_name)) = 1 AS like_escape, hex(encode(c_mktsegment)) AS bytes FROM customer"""
)
def scalar_more(spark: SparkSession, d: str) -> DataFrame:
    """IIF, ROUND, TYPEOF, CONCAT with NULLs, LIKE with ESCAPE, HEX of bytes."""
    configure(spark)
    b, m, n = c("c_acctbal"), c("c_mktsegment"), c("c_name")
    none = F.lit(None).cast("string")
    return table(spark, d, "customer").select(
        "c_custkey", S.iif(b < 0, F.lit("negative"), F.lit("other")).alias("sign_"), S.round_(b).alias("r0"), S.round_(b, 1).alias("r1"), S.typeof(c("c_custkey")).alias("t1"), S.typeof(b).alias("t2"), S.typeof(m).alias("t3"), S.typeof(none).alias("t4"), S.typeof(b > 0).alias("t5"),
        S.concat(none, m, none).alias("joined"), S.like(n, "customer#%0_").alias("like_ci"), S.like(F.concat(F.lit("100%"), n), "100!%%", "!").alias("like_escape"), S.hex_(F.encode(m, "UTF-8")).alias("bytes"),
    )


@query("SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_retailprice AS VARCHAR) AS t, CAST(CAST(p_size AS VARCHAR) AS DOUBLE) AS f, CAST('2024-01-' || lpad(CAST(1 + p_size % 28 AS VARCHAR), 2, '0') AS DATE) AS dd, CAST('2024-01-01 00:00:' || lpad(CAST(p_size % 60 AS VARCHAR), 2, '0') AS TIMESTAMP) AS ts, p_size % 2 = 1 AS b, hex(encode(p_brand)) AS blob, CAST((p_size % 24) AS BIGINT) * 3600000000 AS tm FROM part")
def cast_types(spark: SparkSession, d: str) -> DataFrame:
    """CAST to INTEGER, REAL, TEXT, DATE, TIMESTAMP, BOOLEAN, BLOB and TIME."""
    configure(spark)
    size, price = c("p_size"), c("p_retailprice")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return table(spark, d, "part").select(
        "p_partkey", S.to_int(price).alias("i"), price.cast("string").alias("t"), size.cast("string").cast("double").alias("f"), F.concat(F.lit("2024-01-"), two(1 + size % 28)).cast("date").alias("dd"),
        F.concat(F.lit("2024-01-01 00:00:"), two(size % 60)).cast("timestamp_ntz").alias("ts"), S.to_bool(F.when(size % 2 == 1, "on").otherwise("no")).alias("b"), F.hex(c("p_brand").cast("binary")).alias("blob"), D.parse_time(F.concat(two(size % 24), F.lit(":00"))).alias("tm"),
    )
