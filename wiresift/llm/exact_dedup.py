"""Exact deduplication as a stream with disk-backed keyed state.

The state has one entry a digest and never expires: how many rows had it, and of
the row that stays (the largest doc_id) the id and a locator, that is the file and
the row in it. RocksDB keeps it on the executors' disks and in the query's
checkpoint, so a lost executor costs a reload, and a later run over the same
checkpoint reads only files that are new. Rows are combined per task before
they reach the state; a text that a third of all rows share arrives as one row
a task.

A digest seen again is a hit. Hits are settled on the full bytes of the located
contents, and digests under which these differ are grouped by text instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wiresift.llm.common import stored
from wiresift.scratch import scratch_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.blockCacheSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every store reserves 4 MB of disk for its log
}
BYTES_PER_TRIGGER = 64 << 30


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def located(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text (null counts as empty), its digest, and where the row is stored."""
    text = F.coalesce("text", F.lit(""))
    at = F.struct(F.col("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return rows.select(F.col("doc_id"), text.alias("text"), digest(text).alias("digest"), at.alias("at"))


def own_schema(spark: SparkSession, path: str) -> T.StructType:
    """The two columns that are read; others might bear the name under which Spark gives a row's file."""
    return T.StructType([f for f in spark.read.parquet(path).schema.fields if f.name in ("doc_id", "text")])


def update_state(
    spark: SparkSession, path: str, checkpoint: str, digest: Callable[[Column], Column] = sha256, bytes_per_trigger: int = BYTES_PER_TRIGGER
) -> DataFrame:
    """Runs what has arrived at ``path`` (parquet, a folder or one file) through the state; gives the state as a table.

    Columns: digest, keep (doc_id, file, row of the row that stays), group_size.
    """
    session = spark.newSession()  # the store's settings are this query's own
    for key, value in {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), **SETTINGS}.items():
        session.conf.set(key, value)
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream's plain path must be a folder; a pattern may name one file as well
    rows = session.readStream.schema(own_schema(spark, path)).option("maxBytesPerTrigger", bytes_per_trigger).parquet(pattern)
    state = (
        located(rows, digest).select("digest", "at")
        .groupBy("digest").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    )
    query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None and not query.recentProgress:
        return spark.createDataFrame([], "digest string, keep struct<doc_id:long,file:string,row:long>, group_size long")
    kept = session.read.format("statestore").option("path", checkpoint).load()
    parts = kept.schema["value"].dataType.names
    at = next(n for n in parts if kept.schema["value"].dataType[n].dataType.simpleString().startswith("struct"))
    n = next(n for n in parts if n != at)
    out = scratch_dir(spark, "dedup-state")
    kept.select(F.col("key").getField(kept.schema["key"].dataType.names[0]).alias("digest"), F.col("value").getField(at).alias("keep"), F.col("value").getField(n).alias("group_size")).write.parquet(out)
    return spark.read.parquet(out)


def collisions(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Digests whose rows do not all have the bytes of the row that stays.

    Only hits are compared, that row among them: all are equal if the first and
    the last text in order are. Grouping by the reversed digest lets the join
    split a digest that many rows share, as each of its tasks then sends on two
    texts a digest.
    """
    hits = rows.select("digest", "text").join(state.where("group_size > 1").select("digest"), "digest")
    texts = hits.groupBy(F.reverse("digest").alias("turned")).agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return texts.where("low != high").select(F.reverse("turned").alias("digest"))


def exact_dedup(
    spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None, bytes_per_trigger: int = BYTES_PER_TRIGGER
) -> DataFrame:
    """One row for each row of the table at ``path``: doc_id, keep_id, group_size, kept, digest.

    Texts are equal when identical; null counts as empty. Of equal texts the
    row with the largest doc_id stays, a null id being the smallest; among equal
    ids the one stored last. Exactly one row of a group is kept. Other columns,
    whatever their names, play no part. An empty table gives no rows.
    """
    state = update_state(spark, path, checkpoint or scratch_dir(spark, "dedup-stream"), digest, bytes_per_trigger)
    rows = located(spark.read.schema(own_schema(spark, path)).parquet(path), digest)
    differ = stored(collisions(rows, state), "dedup-collisions")
    columns = ["doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("keep")).alias("kept"), "digest"]
    settled = rows.drop("text").join(state, "digest")
    if differ.isEmpty():
        return settled.select(*columns)
    clashing = rows.join(differ, "digest", "left_semi")
    by_text = clashing.groupBy("text").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return settled.join(differ, "digest", "left_anti").select(*columns).unionByName(clashing.join(by_text, "text").select(*columns))


def op8_stream_dedup(spark, sf_dir) -> DataFrame:
    """Every document with the row of its text that stays."""
    return exact_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet").withColumnRenamed("digest", "text_sha256")
