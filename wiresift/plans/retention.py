"""Keeping the newest alerts of a growing table without sorting its history.

The table is a folder of parquet files and numbered manifests, the highest of which holds. A
manifest has a row a file: path, rows, and the first and last time in it. What is kept for certain and what goes
for certain follows from these rows; only files that the cut may run through are read and
written anew. Files that are no longer named stay until they are swept, so readers of an older manifest are not
disturbed.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wiresift.operators.alerts import STORE_SIZE, retain
from wiresift.schema import ALERT

MANIFEST = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("low_ms", T.LongType()),
    T.StructField("high_ms", T.LongType()),
])


def manifest(spark: SparkSession, root: str) -> list:
    """The rows of the manifest that holds: a row a file, on the driver."""
    try:
        every = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    last = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == last).collect()


def _swap(spark: SparkSession, root: str, before: list, files: list[tuple]) -> None:
    """A new manifest naming ``files``; it holds once it is written."""
    version = max((r["version"] for r in before), default=0) + 1
    # a table without files has a row without a path, so that its manifest is there
    rows = [(version, *f) for f in files] or [(version, None, 0, None, None)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def _named(rows: list) -> list[tuple]:
    return [(r["path"], r["n"], r["low_ms"], r["high_ms"]) for r in rows if r["path"] is not None]


def _write(alerts: DataFrame, root: str) -> list[tuple]:
    """New files with the alerts, in order of time, as manifest rows."""
    spark, path = alerts.sparkSession, f"{root}/files/{uuid.uuid4().hex}"
    alerts.select(*ALERT.names).repartitionByRange("timestamp_ms").write.parquet(path)
    named = spark.read.schema(ALERT).parquet(path).groupBy(F.input_file_name().alias("path")).agg(
        F.count("*").alias("n"), F.min("timestamp_ms").alias("low_ms"), F.max("timestamp_ms").alias("high_ms"))
    return [tuple(r) for r in named.collect()]


def append_alerts(alerts: DataFrame, root: str) -> None:
    """Add alerts to the table; nothing that is there is read."""
    spark = alerts.sparkSession
    before = manifest(spark, root)
    _swap(spark, root, before, _named(before) + _write(alerts, root))


def read_retained(spark: SparkSession, root: str) -> DataFrame:
    paths = [f[0] for f in _named(manifest(spark, root))]
    return spark.read.schema(ALERT).parquet(*paths) if paths else spark.createDataFrame([], ALERT)


def plan_cut(files: list[tuple], keep: int) -> tuple[list[tuple], list[tuple]]:
    """(files kept unread, files the cut may run through); all others go unread."""
    if sum(f[1] for f in files) <= keep:
        return files, []
    # at least ``keep`` alerts are not older than this, so whatever is goes
    total, oldest = 0, None
    for _, n, low, _ in sorted(files, key=lambda f: -f[2]):
        total, oldest = total + n, low
        if total >= keep:
            break
    # at most ``keep`` alerts are newer than this, so whatever is stays
    total, newest = 0, None
    for _, n, _, high in sorted(files, key=lambda f: -f[3]):
        total += n
        if total > keep:
            newest = high
            break
    safe = [f for f in files if f[2] > newest]
    return safe, [f for f in files if f[2] <= newest and f[3] >= oldest]


def trim(spark: SparkSession, root: str, keep: int = STORE_SIZE) -> list[str]:
    """Keep the newest ``keep`` alerts, as ``retain`` would; returns the paths that had to be read."""
    before = manifest(spark, root)
    files = _named(before)
    safe, cut = plan_cut(files, keep)
    if len(safe) == len(files):
        return []
    rest = keep - sum(f[1] for f in safe)
    paths = [f[0] for f in cut]
    new = _write(retain(spark.read.schema(ALERT).parquet(*paths), rest), root) if paths and rest > 0 else []
    _swap(spark, root, before, safe + new)
    return paths
