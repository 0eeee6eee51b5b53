"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on; callers may override any of them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.cteRecursionLevelLimit": "10000",
}


def get_session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the engine's settings (for tests and the bench)."""
    b = SparkSession.builder.master(master).appName("tidewell")
    for k, v in {
        **SETTINGS,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> None:
    """Set the run-time settings on a session that someone else made."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is named (tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d is None:
        d = tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def materialise(df: DataFrame, name: str = "stage", rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a re-run of all
    stages before.  Also pins what a non-deterministic plan produced.
    ``rows_per_file`` bounds what a reader holds at once where rows are large.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths that ``materialise`` has written, by application.
_written: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more, before the application ends."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0].split("://")[-1].removeprefix("file:").replace("//", "/") for f in df.inputFiles()}
    mine = _written.get(spark.sparkContext.applicationId, [])
    for p in [p for p in mine if p.split("://")[-1].removeprefix("file:").replace("//", "/") in folders]:
        _delete(spark, p)
        mine.remove(p)


def release(spark: SparkSession) -> int:
    """Delete the tables that ``materialise`` wrote in this application, and say how many.

    To be called when the results that were built on them have been used;
    frames that still read them fail afterwards.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        _delete(spark, p)
    return len(paths)


def read_all(tables: list[DataFrame]) -> DataFrame:
    """Written tables of one schema as one scan, so that a plan does not grow with their number."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[f for t in tables for f in t.inputFiles()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A side may be broadcast up to so many bytes, estimated from a count and the width of its rows.
BROADCAST_BYTES = 64 << 20
#: Bytes of a value by type, where it has no fixed width or its elements are many.
_WIDTHS = {"string": 64, "binary": 64, "array": 512, "map": 512, "struct": 128, "boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4}


def row_bytes(df: DataFrame) -> int:
    """Estimated bytes of a row."""
    return 16 + sum(_WIDTHS.get(f.dataType.typeName(), 8) for f in df.schema.fields)


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join with ``small`` broadcast only if a count and its rows' width show that it is small.

    Beyond ``max_bytes`` it is a shuffled join, whose hot keys AQE splits.  The
    count stops at the bound; pass a written table, so that nothing runs twice.
    """
    from pyspark.sql import functions as F

    most = max_bytes // row_bytes(small)
    if small.limit(most + 1).count() <= most:
        small = F.broadcast(small)
    return big.join(small, on, how)


def join_shuffled(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join by a shuffle and sort whatever Spark takes the sizes for.

    Spark sizes a scan by its files and an array as one element: of (k, u
    array<long>) beside wide columns a twentieth of its bytes is left, as after
    an explode, and a side of hundreds of MB is broadcast through the driver.
    """
    return left.join(right.hint("merge"), on, how)


#: A key is hot with more than this many rows, and more than this share of all.
HOT_ROWS, HOT_SHARE = 100_000, 1e-5


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame | None:
    """Keys of ``counts`` (one row a key, ``n`` rows each) that no single task should get; None if there are none.

    At most 1 / HOT_SHARE keys can be hot, so their table may be broadcast.
    """
    from pyspark.sql import functions as F

    row = counts.agg(F.sum(n).alias("all"), F.max(n).alias("most")).first()
    least = max(HOT_ROWS, HOT_SHARE * (row["all"] or 0))
    if (row["most"] or 0) <= least:
        return None
    return materialise(counts.where(F.col(n) > least).select(*keys), "hot")


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame | None) -> DataFrame:
    """Inner join with a side of unique keys; rows of hot keys stay where they are and meet broadcast rows."""
    from pyspark.sql import functions as F

    if hot is None:
        return big.join(small, keys)
    few = F.broadcast(hot)
    there = big.join(F.broadcast(small.join(few, keys, "left_semi")), keys)
    return there.unionByName(big.join(few, keys, "left_anti").join(small, keys))
