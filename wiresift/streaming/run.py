"""Running stream queries over what has arrived, and their sinks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from wiresift.schema import ALERT_KEY, EVENT, STATS
from wiresift.scratch import scratch_dir

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A query has a store for each operator and partition. By default each sets 4 MB of disk aside, and rows are
# compressed lightly in blocks of 4 KB.
ROCKSDB_OPTIONS = {
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.rocksdb.blockSizeKB": "16",
}
# The shuffle files of a micro-batch go with it; by default they stay until the driver's garbage is collected.
BATCH_OPTIONS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

# A SYN far past all others; its only purpose is to move the watermark on. Its
# own window never closes, so it is in no result.
CLOSING_MS = 7258118400000  # 2200-01-01
CLOSING = (-1, CLOSING_MS, 0, 0, 0, 0, "Tcp", 1, b"")

COUNTERS = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("poll_time", T.DoubleType()),
    T.StructField("events_processed", T.LongType()),
    T.StructField("events_dropped", T.LongType()),
    T.StructField("alerts_fired", T.LongType()),
    T.StructField("latest_ms", T.LongType()),
])


@contextmanager
def _unless_set(spark: SparkSession, options: dict[str, str]) -> Iterator[None]:
    """Set the options that the session does not set itself, for queries started inside."""
    own = [key for key in options if spark.conf.get(key, None) is None]
    for key in own:
        spark.conf.set(key, options[key])
    try:
        yield
    finally:
        for key in own:
            spark.conf.unset(key)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Keep the state of queries started inside in RocksDB, compressed.

    Keyed processors need it, and large windowed state then lies outside the heap.
    """
    previous = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        with _unless_set(spark, ROCKSDB_OPTIONS):
            yield
    finally:
        spark.conf.set(STATE_STORE, previous)


def append_stream(out: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream's rows to a parquet table; returns the started query.

    With ``every`` (such as "10 seconds") it keeps running on that rhythm;
    otherwise it ends when it has read what has arrived.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = (
        out.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger)
    )
    with rocksdb_state(out.sparkSession), _unless_set(out.sparkSession, BATCH_OPTIONS):
        return writer.start()


def run_available(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived; returns the finished query."""
    query = append_stream(out, path, checkpoint)
    query.awaitTermination()
    return query


def drain(packets: DataFrame, build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run ``build`` over a packet stream to its end and read back what it wrote.

    Append mode holds back windows that the watermark has not passed. After all
    packets are read, the same run gets one packet of a far later time, which
    closes them; a second run would load all state once more.
    """
    spark = packets.sparkSession
    root = scratch_dir(spark, name)
    spark.createDataFrame([], EVENT).write.parquet(f"{root}/closing")
    closing = spark.readStream.schema(EVENT).parquet(f"{root}/closing")
    out = build(packets.select(*EVENT.names).unionByName(closing))
    query = append_stream(out, f"{root}/out", f"{root}/checkpoint", every="0 seconds")
    try:
        query.processAllAvailable()
        spark.createDataFrame([CLOSING], EVENT).write.mode("append").parquet(f"{root}/closing")
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def run_with_counters(
    packets: DataFrame, detect: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, lateness_ms: int = 10_000
) -> StreamingQuery:
    """Append a stateless detector's alerts and count packets, late packets and alerts per micro-batch.

    All are counted while they stream through to the alert sink, in one pass. A
    packet is late, and counted as dropped, if it is more than ``lateness_ms``
    older than the newest of the batches before: a window that ended before
    that time would not take it. Every late packet counts, however many share a
    source and window. A batch that is run again after a failure replaces what
    it wrote before.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, None
        if batch_id:
            earlier = read_counters(spark, path).where(F.col("batch_id") < batch_id)
            before = earlier.agg(F.max("latest_ms").alias("ms")).first()["ms"]
        mark = F.lit(None if before is None else before - lateness_ms).cast("long")
        seen, fired = Observation(), Observation()
        counted = batch.observe(
            seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("timestamp_ms") < mark).alias("late"),
            F.max("timestamp_ms").alias("latest"))
        detect(counted).observe(fired, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(
            f"{path}/alerts/batch_id={batch_id}")
        latest = [ms for ms in (before, seen.get["latest"]) if ms is not None]
        row = (batch_id, time.time(), seen.get["n"], seen.get["late"], fired.get["n"], max(latest, default=None))
        spark.createDataFrame([row], COUNTERS).write.mode("overwrite").parquet(f"{path}/counters/part={batch_id}")

    query = (
        packets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """One row per micro-batch."""
    return spark.read.schema(COUNTERS).parquet(f"{path}/counters")


def counter_series(counters: DataFrame, run_id: str) -> DataFrame:
    """The counters as running totals in the schema of polled stats; one row per micro-batch."""
    upto = Window.partitionBy("run_id").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    totals = {c: F.sum(c).over(upto) for c in ("events_processed", "events_dropped", "alerts_fired")}
    series = counters.withColumn("run_id", F.lit(run_id)).withColumns(totals)
    return series.withColumn("queue_backpressure_events", F.col("events_dropped")).select(*STATS.names)


class StreamTotals(StreamingQueryListener):
    """Running totals over all stream queries of a session, however long they run.

    Register with ``spark.streams.addListener``. ``dropped`` is what Spark
    reports as dropped by the watermark: packets for keyed processors, but for
    window aggregates the rows left after a task has combined its packets.
    ``run_with_counters`` counts late packets themselves.
    """

    def __init__(self):
        self.read: dict[str, int] = {}
        self.dropped: dict[str, int] = {}
        self.finished: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress, query = event.progress, str(event.progress.id)
        late = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        self.read[query] = self.read.get(query, 0) + progress.numInputRows
        self.dropped[query] = self.dropped.get(query, 0) + late

    def onQueryTerminated(self, event) -> None:
        self.finished.add(str(event.runId))

    def await_end(self, query: StreamingQuery, seconds: float = 30.0) -> None:
        """Wait until the end of a terminated query has been reported; the totals are short before."""
        deadline = time.monotonic() + seconds
        while str(query.runId) not in self.finished:
            if time.monotonic() >= deadline:
                raise TimeoutError(f"the end of {query.runId} was not reported within {seconds} s")
            time.sleep(0.05)


def capture_unseen(
    alerts: DataFrame, horizon: str = "1 hour", key: Sequence[str] = tuple(ALERT_KEY)
) -> DataFrame:
    """A stream of polled alerts without the ones that came before.

    ``alerts`` may repeat alerts from poll to poll; keys are remembered for
    ``horizon`` of event time, which must exceed the reach of a poll.
    """
    timed = alerts.withColumn("ts", F.timestamp_millis("timestamp_ms")).withWatermark("ts", horizon)
    return timed.dropDuplicatesWithinWatermark(list(key)).drop("ts")
