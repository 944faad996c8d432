"""Readers for event, alert and stats tables, in batch and as streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wiresift.functions.clock import ms_to_ts, seconds_to_ts
from wiresift.schema import CAPTURED_ALERT, EVENT, STATS


# The usual dialect: fields with commas, quotes or line breaks are quoted, and a
# quote in one is doubled. A row that does not fit the schema ends the reading.
CSV = {"header": True, "quote": '"', "escape": '"'}
CSV_IN = {**CSV, "multiLine": True, "mode": "FAILFAST"}


def read_csv(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """A CSV table; where none was written, an empty one."""
    try:
        return spark.read.schema(schema).options(**CSV_IN).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table of packet events."""
    return spark.read.schema(EVENT).parquet(path)


def stream_events(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Packet events from a directory into which parquet files land.

    ``max_files_per_trigger`` bounds a micro-batch: an overloaded query falls
    behind its source and loses nothing.
    """
    reader = spark.readStream.schema(EVENT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def read_alerts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Captured alerts, with ``ts`` from the millisecond column."""
    df = read_csv(spark, CAPTURED_ALERT, path)
    return df.withColumn("ts", ms_to_ts("timestamp_ms"))


def read_stats_csv(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Stats snapshots, with ``ts`` from the float seconds of ``poll_time``.

    A capture of a single run has no ``run_id`` column; name the run then.
    """
    fields = [f for f in STATS if run_id is None or f.name != "run_id"]
    schema = T.StructType(fields)
    df = read_csv(spark, schema, path)
    if run_id is not None:
        df = df.select(F.lit(run_id).alias("run_id"), "*")
    return df.withColumn("ts", seconds_to_ts("poll_time"))


def write_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV with a header, in place of any older one.

    Files without rows hold nothing, not even a header; the readers give an
    empty table for them.
    """
    df.write.mode("overwrite").options(**CSV).option("emptyValue", '""').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)
