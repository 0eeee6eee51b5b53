"""Named snapshots with constraints, triggers, transactions, views, materialized views and catalog frames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import dml
from tidewell.session import materialise

#: Functions whose value changes from one evaluation to the next; a materialized view may not hold them.
VOLATILE = re.compile(r"\b(?:rand|random|randn|uuid|now|current_timestamp|current_date|current_time|clock_timestamp|localtimestamp|localtime)\b", re.IGNORECASE)


#: Statements on a table after which its rows are written.
CUT = 8


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    key: str
    on_delete: str = "no_action"
    deferred: bool = False
    default: object = None


@dataclass
class Constraints:
    """What a table's rows must satisfy."""

    primary_key: tuple[str, ...] = ()
    unique: list[tuple[str, ...]] = field(default_factory=list)
    not_null: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    foreign: list[ForeignKey] = field(default_factory=list)
    defaults: dict[str, object] = field(default_factory=dict)
    #: Generated columns: name to (SQL expression, stored); expressions see plain columns only.
    generated: dict[str, tuple[str, bool]] = field(default_factory=dict)


class ConstraintError(ValueError):
    """A statement would leave rows that a constraint forbids."""


def statements(text: str) -> Iterator[str]:
    """Statements of a script, split at ``;`` outside quotes and comments."""
    start, i, n = 0, 0, len(text)
    while i < n:
        c = text[i]
        if c in "'\"`":
            i += 1
            while i < n and text[i] != c:
                i += 1
        elif text.startswith("--", i):
            while i < n and text[i] != "\n":
                i += 1
        elif text.startswith("/*", i):
            i = text.find("*/", i + 2)
            i = n if i < 0 else i + 1
        elif c == ";":
            if text[start:i].strip():
                yield text[start:i].strip()
            start = i + 1
        i += 1
    if text[start:].strip():
        yield text[start:].strip()


class Catalog:
    """Tables are immutable frames under names; a statement replaces a name's frame.

    BEGIN and SAVEPOINT copy the name tables (not the data), ROLLBACK restores
    them, views and materialized views too.  Deferred foreign keys are checked
    at COMMIT, others by each statement.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.rules: dict[str, Constraints] = {}
        self.views: dict[str, str] = {}
        self.matviews: dict[str, tuple[str, DataFrame, tuple[str, ...]]] = {}
        self.triggers: dict[str, list[dml.Trigger]] = {}
        self.zone = "UTC"
        self._saved: list[tuple[str | None, tuple]] = []
        self._steps: dict[str, int] = {}

    # Tables.
    def create(self, name: str, df: DataFrame, rules: Constraints | None = None) -> None:
        name = name.lower()
        if rules is not None:
            self.rules[name] = rules
            df = self._generate(name, df)
            self._check(name, df)
        self.tables[name] = df
        df.createOrReplaceTempView(name)

    def read_parquet(self, name: str, path: str) -> None:
        self.create(name, self.spark.read.parquet(path))

    def drop(self, name: str) -> None:
        del self.tables[name.lower()]
        self.rules.pop(name.lower(), None)
        self.triggers.pop(name.lower(), None)
        self.spark.catalog.dropTempView(name.lower())

    def truncate(self, name: str) -> None:
        self.create(name, dml.truncate(self.tables[name.lower()]))

    def rename(self, old: str, new: str) -> None:
        df, rules = self.tables[old.lower()], self.rules.get(old.lower())
        triggers = self.triggers.get(old.lower(), [])
        self.drop(old)
        self.create(new, df)
        if rules:
            self.rules[new.lower()] = rules
        if triggers:
            self.triggers[new.lower()] = triggers

    def add_column(self, name: str, column: str, default) -> None:
        self.create(name, self.tables[name.lower()].withColumn(column, default if isinstance(default, Column) else F.lit(default)))

    def drop_column(self, name: str, column: str) -> None:
        self.create(name, self.tables[name.lower()].drop(column))

    def rename_column(self, name: str, old: str, new: str) -> None:
        self.create(name, self.tables[name.lower()].withColumnRenamed(old, new))

    # Statements.
    def execute(self, sql: str, **args) -> DataFrame:
        """A SELECT with named parameters."""
        return self.spark.sql(sql, args=args or None)

    def prepare(self, sql: str) -> Callable[..., DataFrame]:
        """A statement with positional parameters ``$1``, ``$2``, ... to be called with their values."""
        places: list[int] = []
        out = []
        for part in re.split(r"('(?:[^']|'')*')", sql):
            out.append(part if part.startswith("'") else re.sub(r"\$(\d+)", lambda m: places.append(int(m.group(1))) or "?", part))
        text = "".join(out)
        return lambda *values: self.spark.sql(text, args=[values[i - 1] for i in places] or None)

    def script(self, text: str) -> list[DataFrame]:
        return [self.execute(s) for s in statements(text)]

    def explain(self, sql: str) -> str:
        return self.spark.sql(f"EXPLAIN FORMATTED {sql}").first()[0]

    def set_time_zone(self, zone: str) -> None:
        """SET TIME ZONE: the zone in which ``local_time`` shows timestamps, which are kept in UTC."""
        self.spark.sql(f"SELECT from_utc_timestamp(current_timestamp(), '{zone}')").collect()  # an unknown zone is an error
        self.zone = zone

    def local_time(self, ts: Column) -> Column:
        """Text of a timestamp in the session's zone."""
        return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), self.zone), "yyyy-MM-dd HH:mm:ss")

    def _generate(self, name: str, df: DataFrame) -> DataFrame:
        rules = self.rules.get(name)
        for column, (expression, _) in (rules.generated if rules else {}).items():
            df = df.withColumn(column, F.expr(expression))
        return df

    def _check(self, name: str, df: DataFrame, deferred: bool = False) -> None:
        rules = self.rules.get(name)
        if rules is None:
            return
        tests: list[tuple[str, DataFrame]] = []
        if not deferred:
            for c in dict.fromkeys([*rules.not_null, *rules.primary_key]):
                tests.append((f"NOT NULL {c}", df.where(F.col(c).isNull())))
            for key in [*([rules.primary_key] if rules.primary_key else []), *rules.unique]:
                tests.append((f"UNIQUE {', '.join(key)}", dml.unique_violations(df, list(key))))
            for label, check in rules.checks.items():
                tests.append((f"CHECK {label}", dml.check_violations(df, F.expr(check))))
        for fk in rules.foreign:
            if fk.deferred == deferred and (deferred or not self._saved or not fk.deferred) and fk.parent in {*self.tables, name}:
                parent = df if fk.parent == name else self.tables[fk.parent]
                tests.append((f"FOREIGN KEY {fk.column}", dml.fk_violations(df, fk.column, parent, fk.key)))
        for label, bad in tests:
            if not bad.limit(1).isEmpty():
                raise ConstraintError(f"{name}: {label} violated")

    def _replace(self, name: str, df: DataFrame) -> None:
        df = self._generate(name, df.select(*self.tables[name].columns))
        self._check(name, df)
        if not self._saved:
            self._check(name, df, deferred=True)
        # Every statement adds to the plan of its table; it is cut from time to time.
        self._steps[name] = self._steps.get(name, 0) + 1
        self.create(name, materialise(df, "table") if self._steps[name] % CUT == 0 else df)

    def _changed(self, name: str, event: str, new_table: Callable[[DataFrame, DataFrame], DataFrame], old: DataFrame, new: DataFrame) -> None:
        """Run the table's triggers around one change."""
        mine = [t for t in self.triggers.get(name, []) if t.event == event]
        old, new, run = dml.before_triggers(mine, old, new)
        if run:
            self._replace(name, new_table(old, new))
        dml.after_triggers(mine, old, new)

    def _filled(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows with defaults for missing columns."""
        rules = self.rules.get(name) or Constraints()
        target = self.tables[name]
        for f in target.schema.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(rules.defaults.get(f.name)).cast(f.dataType))
        return self._generate(name, rows.select(*target.columns))

    def insert(self, name: str, rows: DataFrame) -> DataFrame:
        """INSERT; gives the inserted rows (RETURNING)."""
        name = name.lower()
        new = self._filled(name, rows)
        target = self.tables[name]
        self._changed(name, "insert", lambda _, n: target.unionByName(n), target.limit(0), new)
        return new

    def update(self, name: str, sets: dict[str, Column], where: Column | None = None) -> DataFrame:
        """UPDATE; gives the changed rows with structs ``old`` and ``new``."""
        name = name.lower()
        target = self.tables[name]
        _, changed = dml.update(target, sets, where)
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        new = self._generate(name, changed.select("new.*"))
        self._changed(name, "update", lambda _, n: target.where(~hit).unionByName(n), changed.select("old.*"), new)
        return changed

    def delete(self, name: str, where: Column | None = None) -> DataFrame:
        """DELETE with the foreign keys' actions; gives the deleted rows."""
        name = name.lower()
        target = self.tables[name]
        kept, gone = dml.delete(target, where)
        for child, rules in list(self.rules.items()):
            for fk in rules.foreign:
                if fk.parent == name and child in self.tables and not (fk.deferred and self._saved):
                    rows = dml.fk_on_delete(self.tables[child], fk.column, gone, fk.key, fk.on_delete, fk.default)
                    if child != name:
                        self.create(child, self._generate(child, rows))
                    else:
                        kept = rows.join(gone.select(fk.key), fk.key, "left_anti").select(*target.columns)
        self._changed(name, "delete", lambda *_: kept, gone, target.limit(0))
        return gone

    def with_dml(self, name: str, change: Callable[[], DataFrame], query: str) -> DataFrame:
        """WITH name AS (INSERT | UPDATE | DELETE ... RETURNING ...) SELECT: the change's rows under ``name``, then the query."""
        rows = materialise(change(), "returning")
        rows.createOrReplaceTempView(name)
        try:
            return self.spark.sql(query)
        finally:
            self.spark.catalog.dropTempView(name)

    def create_trigger(self, table: str, trigger: dml.Trigger) -> None:
        self.triggers.setdefault(table.lower(), []).append(trigger)

    def drop_trigger(self, table: str, name: str) -> None:
        self.triggers[table.lower()] = [t for t in self.triggers[table.lower()] if t.name != name]

    # Views.
    def create_view(self, name: str, sql: str) -> None:
        self.views[name.lower()] = sql
        self.spark.sql(sql).createOrReplaceTempView(name.lower())

    def drop_view(self, name: str) -> None:
        del self.views[name.lower()]
        self.spark.catalog.dropTempView(name.lower())

    def create_matview(self, name: str, sql: str, keys: tuple[str, ...] = ()) -> None:
        """A stored result; ``keys`` (a unique key of its rows) allow a refresh by difference."""
        if VOLATILE.search(sql):
            raise ValueError("a materialized view holds no volatile functions")
        df = materialise(self.spark.sql(sql), "matview")
        self.matviews[name.lower()] = (sql, df, keys)
        df.createOrReplaceTempView(name.lower())

    def refresh_matview(self, name: str, concurrently: bool = False) -> DataFrame | None:
        """Make the rows anew.  ``concurrently`` merges the difference into the stored rows and gives it (key columns, op, rest)."""
        sql, old, keys = self.matviews[name.lower()]
        if not concurrently:
            self.create_matview(name, sql, keys)
            return None
        if not keys:
            raise ValueError("a concurrent refresh needs a unique key")
        delta = materialise(dml.diff(old, self.spark.sql(sql), list(keys)), "delta")
        if not delta.isEmpty():
            df = materialise(dml.patch(old, delta, list(keys)), "matview")
            self.matviews[name.lower()] = (sql, df, keys)
            df.createOrReplaceTempView(name.lower())
        return delta

    def drop_matview(self, name: str) -> None:
        del self.matviews[name.lower()]
        self.spark.catalog.dropTempView(name.lower())

    # Transactions.
    def _state(self) -> tuple:
        return dict(self.tables), dict(self.views), dict(self.matviews), dict(self.rules), {t: list(x) for t, x in self.triggers.items()}

    def begin(self, savepoint: str | None = None) -> None:
        """BEGIN, or SAVEPOINT where a name is given."""
        self._saved.append((savepoint, self._state()))

    def commit(self) -> None:
        for name in self.tables:
            self._check(name, self.tables[name], deferred=True)
        self._saved.clear()

    def release(self, savepoint: str) -> None:
        """RELEASE SAVEPOINT: it and later ones are forgotten, what was done stays."""
        at = next(i for i, (n, _) in enumerate(self._saved) if n == savepoint)
        del self._saved[at:]

    def rollback(self, savepoint: str | None = None) -> None:
        """To the savepoint (which stays), or to BEGIN."""
        state = None
        while self._saved:
            name, state = self._saved[-1]
            if savepoint is not None and name == savepoint:
                break
            self._saved.pop()
            if savepoint is None and not self._saved:
                break
        if state is None:
            raise ValueError("no transaction is open")
        tables, views, matviews, rules, triggers = state
        for gone in ({*self.tables, *self.views, *self.matviews}) - {*tables, *views, *matviews}:
            self.spark.catalog.dropTempView(gone)
        self.tables, self.views, self.matviews, self.rules, self.triggers = dict(tables), dict(views), dict(matviews), dict(rules), {t: list(x) for t, x in triggers.items()}
        for t, df in self.tables.items():
            df.createOrReplaceTempView(t)
        for v, sql in self.views.items():
            self.spark.sql(sql).createOrReplaceTempView(v)
        for m, (_, df, _) in self.matviews.items():
            df.createOrReplaceTempView(m)

    # Catalog frames.
    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(sorted(rows, key=repr), schema)

    def list_tables(self) -> DataFrame:
        """information_schema.tables"""
        rows = [(t, "BASE TABLE") for t in self.tables] + [(v, "VIEW") for v in self.views] + [(m, "MATERIALIZED VIEW") for m in self.matviews]
        return self._frame(rows, "table_name string, table_type string")

    def columns(self) -> DataFrame:
        """information_schema.columns"""
        def nullable(t: str, f) -> str:
            rules = self.rules.get(t) or Constraints()
            return "YES" if f.nullable and f.name not in {*rules.not_null, *rules.primary_key} else "NO"

        rows = [(t, f.name, i, f.dataType.simpleString(), nullable(t, f)) for t, df in self.tables.items() for i, f in enumerate(df.schema.fields, 1)]
        return self._frame(rows, "table_name string, column_name string, ordinal_position long, data_type string, is_nullable string")

    def _keys(self) -> Iterator[tuple[str, str, str, tuple[str, ...]]]:
        for t, r in self.rules.items():
            if r.primary_key:
                yield t, f"{t}_pkey", "PRIMARY KEY", r.primary_key
            for key in r.unique:
                yield t, f"{t}_{'_'.join(key)}_key", "UNIQUE", key
            for fk in r.foreign:
                yield t, f"{t}_{fk.column}_fkey", "FOREIGN KEY", (fk.column,)

    def key_column_usage(self) -> DataFrame:
        """information_schema.key_column_usage"""
        return self._frame([(name, t, c, i) for t, name, _, key in self._keys() for i, c in enumerate(key, 1)], "constraint_name string, table_name string, column_name string, ordinal_position long")

    def table_constraints(self) -> DataFrame:
        """information_schema.table_constraints"""
        rows = [(name, t, kind) for t, name, kind, _ in self._keys()] + [(f"{t}_{label}_check", t, "CHECK") for t, r in self.rules.items() for label in r.checks]
        return self._frame(rows, "constraint_name string, table_name string, constraint_type string")

    def list_triggers(self, table: str | None = None) -> DataFrame:
        """information_schema.triggers and SHOW TRIGGERS [ON table]"""
        rows = [(t.name, name, t.event.upper(), t.timing.upper(), t.level.upper()) for name, ts in self.triggers.items() for t in ts if table is None or name == table.lower()]
        return self._frame(rows, "trigger_name string, event_object_table string, event_manipulation string, action_timing string, action_orientation string")

    def list_matviews(self) -> DataFrame:
        """pg_matviews and SHOW MATERIALIZED VIEWS"""
        return self._frame([(m, sql) for m, (sql, _, _) in self.matviews.items()], "matviewname string, definition string")

    def timezone_names(self) -> DataFrame:
        """pg_timezone_names: every zone with its present offset in seconds."""
        from datetime import datetime
        from zoneinfo import ZoneInfo, available_timezones

        now = datetime.now(ZoneInfo("UTC"))
        rows = []
        for z in available_timezones():
            at = now.astimezone(ZoneInfo(z))
            rows.append((z, at.tzname(), int(at.utcoffset().total_seconds()), bool(at.dst())))
        return self._frame(rows, "name string, abbrev string, utc_offset_seconds long, is_dst boolean")

    def timezone_abbrevs(self) -> DataFrame:
        """pg_timezone_abbrevs: the abbreviations in use at present, with their offsets."""
        return self.timezone_names().where(~F.col("abbrev").rlike("^[+-]")).groupBy("abbrev", "utc_offset_seconds").agg(F.max("is_dst").alias("is_dst"))
