"""Sinks that keep something between micro-batches, and the decoding of raw messages.

A micro-batch that is run again after a failure replaces what it wrote and gives the same rows: what it
reads of the past is what the batch before it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from wiresift.operators.alerts import number_alerts
from wiresift.operators.rule_table import rule_table_alerts
from wiresift.schema import EVENT
from wiresift.streaming.run import rocksdb_state

MARKS = T.StructType([T.StructField("detector", T.StringType()), T.StructField("last_id", T.LongType())])
BROKEN = "_broken"


def each_batch(out: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``write`` over every micro-batch of what has arrived; returns the finished query."""
    with rocksdb_state(out.sparkSession):
        query = out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# --- ids -----------------------------------------------------------------------------

def write_numbered(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that numbers alerts on: 1, 2, … per detector over all batches.

    Batches follow each other, and in a batch the order of arrival counts. Each batch leaves
    the highest id of every detector so far, and the next one goes on from there; history is not read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        alerts = batch.persist()
        try:
            before = spark.read.schema(MARKS).parquet(f"{path}/marks/{batch_id - 1}") if batch_id else spark.createDataFrame([], MARKS)
            numbered = number_alerts(alerts).join(before, "detector", "left")
            numbered = numbered.withColumn("id", F.col("id") + F.coalesce("last_id", F.lit(0))).select("id", *alerts.columns)
            numbered.write.mode("overwrite").parquet(f"{path}/alerts/batch_id={batch_id}")
        finally:
            alerts.unpersist()
        written = spark.read.schema(numbered.schema).parquet(f"{path}/alerts/batch_id={batch_id}")
        marks = written.groupBy("detector").agg(F.max("id").alias("last_id")).unionByName(before)
        marks.groupBy("detector").agg(F.max("last_id").alias("last_id")).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/{batch_id}")

    return write


def read_numbered(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All alerts with their ids and the micro-batch that brought them."""
    fields = [T.StructField("id", T.LongType()), *schema.fields, T.StructField("batch_id", T.LongType())]
    return spark.read.schema(T.StructType(fields)).parquet(f"{path}/alerts")


# --- rules that change ------------------------------------------------------------------

def write_rule_alerts(rules_path: str, path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that matches packets against the rule table as it is when the batch begins.

    The rules that a batch used are kept beside its alerts, so running it again does not
    pick up later ones.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, used = batch.sparkSession, f"{path}/rules/batch_id={batch_id}"
        try:
            rules = spark.read.parquet(used)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            spark.read.parquet(rules_path).write.parquet(used)
            rules = spark.read.parquet(used)
        packets = batch.persist()
        try:
            rule_table_alerts(packets, rules).write.mode("overwrite").parquet(f"{path}/alerts/batch_id={batch_id}")
        finally:
            packets.unpersist()

    return write


# --- messages -------------------------------------------------------------------------------

def decode_messages(lines: DataFrame, schema: T.StructType = EVENT, line: str = "value") -> DataFrame:
    """JSON messages as event columns, with ``reason`` and ``message`` where they are of no use.

    A message that is no JSON object, or has a value of another type, is ``unreadable``; one
    without a field is ``missing`` and the first such field. All others have null in both
    columns. Works on tables and streams alike, in one pass and without a shuffle.
    """
    fields = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema.fields], T.StructField(BROKEN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    read = lines.select(F.col(line).alias("message"), F.from_json(line, fields, options).alias("_e"))
    missing = F.coalesce(*[F.when(F.col("_e")[f.name].isNull(), F.lit(f"missing {f.name}")) for f in schema.fields])
    unreadable = F.col("message").isNull() | F.col("_e").isNull() | F.col("_e")[BROKEN].isNotNull()
    reason = F.when(unreadable, F.lit("unreadable")).otherwise(missing)
    rows = read.withColumn("reason", reason)
    return rows.select(*[F.when(F.col("reason").isNull(), F.col("_e")[f.name]).alias(f.name) for f in schema.fields], "reason",
                       F.when(F.col("reason").isNotNull(), F.col("message")).alias("message"))


def run_decoding(lines: DataFrame, path: str, checkpoint: str, schema: T.StructType = EVENT) -> StreamingQuery:
    """Write a stream of messages as events and, in a folder beside them, dead letters; returns the finished query."""
    out = decode_messages(lines, schema).withColumn("dead", F.col("reason").isNotNull())
    query = (
        out.writeStream.format("parquet").outputMode("append").partitionBy("dead")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def _decoded(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    more = [T.StructField("reason", T.StringType()), T.StructField("message", T.StringType()), T.StructField("dead", T.BooleanType())]
    return spark.read.schema(T.StructType([*schema.fields, *more])).parquet(path)


def read_decoded(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    return _decoded(spark, path, schema).where("NOT dead").select(*schema.names)


def read_dead_letters(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    return _decoded(spark, path, schema).where("dead").select("reason", "message")
