"""Windows that begin with an event: the first one at or after the end of the window before.

Where a source pauses for a whole window, the next event begins one whatever came before. In
between, every event points to the first one at least a window later, and the beginnings are what is
reached along these pointers. They are followed by doubling: after r rounds, each a join on the
pointers that are left, all beginnings within 2^r windows of a pause are known. Nothing walks a
source's history in one task; lookups in time are cut into pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from wiresift.functions.clock import floor_div
from wiresift.functions.net import syn_only
from wiresift.operators.alerts import to_alert
from wiresift.operators.ordered import kth_row, previous_row
from wiresift.operators.rates import flood_detail
from wiresift.rules import SYN_FLOOD_RULE, SYN_FLOOD_SEVERITY, SYN_FLOOD_THRESHOLD, WINDOW_MS
from wiresift.scratch import scratch_dir

PIECE_WINDOWS = 4


def as_of(rows: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, mark: str, piece: int, forward: bool = False) -> DataFrame:
    """Rows with column ``mark``: the last mark of their keys at or before ``at`` (the first at or after it, if ``forward``), or null.

    ``marks`` has the keys and ``mark``. Both are cut into pieces of time, within which rows are sorted;
    what lies in other pieces comes from one row a piece.
    """
    own = rows.select(*keys, F.col(at).alias("_at"), F.lit(None).cast("long").alias("_mark"), F.struct(*rows.columns).alias("_row"))
    other = marks.select(*keys, F.col(mark).alias("_at"), F.col(mark).alias("_mark"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"))
    both = own.unionByName(other).withColumn("_piece", floor_div("_at", piece))
    pick = F.min if forward else F.max
    along = lambda c: F.col(c).desc() if forward else F.col(c).asc()
    cut = [*keys, "_piece"]
    before = Window.partitionBy(*keys).orderBy(along("_piece")).rowsBetween(Window.unboundedPreceding, -1)
    edges = both.groupBy(*cut).agg(pick("_mark").alias("_edge")).select(*cut, pick("_edge").over(before).alias("_edge"))
    local = Window.partitionBy(*cut).orderBy(along("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_near", pick("_mark").over(local)).where(F.col("_row").isNotNull()).join(edges, cut)
    return found.select("_row.*", F.coalesce("_near", "_edge").alias(mark))


def _stored(frame: DataFrame, purpose: str) -> DataFrame:
    path = scratch_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def window_beginnings(times: DataFrame, keys: Sequence[str], time: str, width: int, piece: int | None = None) -> DataFrame:
    """(keys, window_start): where the windows of each key begin. ``times`` is read more than once."""
    piece = piece or PIECE_WINDOWS * width
    keys = list(keys)
    distinct = _stored(times.select(*keys, F.col(time).alias("t")).where(F.col(time).isNotNull()).distinct(), "reset-times")
    paused = previous_row(distinct, keys, "t", floor_div("t", piece), ["t"])
    first = F.col("prev_t").isNull() | (F.col("t") - F.col("prev_t") >= width)
    known = _stored(paused.select(*keys, "t", first.alias("first")), "reset-events")
    reached = known.where("first").select(*keys, F.col("t").alias("window_start"))
    # pointers to an event after a pause are not needed: it is known
    jumps = as_of(known.select(*keys, "t", (F.col("t") + width).alias("end")),
                  known.select(*keys, F.col("t").alias("next")), keys, "end", "next", piece, forward=True).where("next IS NOT NULL")
    after_pause = known.where("first").select(*keys, F.col("t").alias("next"))
    jumps = _stored(jumps.select(*keys, "t", "next").join(after_pause, [*keys, "next"], "left_anti").select(*keys, "t", "next"), "reset-jumps")
    while not jumps.isEmpty():
        step = jumps.withColumnRenamed("t", "window_start")
        more = reached.join(step, [*keys, "window_start"]).select(*keys, F.col("next").alias("window_start"))
        reached = _stored(reached.union(more), "reset-reached")
        onward = jumps.select(*keys, F.col("t").alias("next"), F.col("next").alias("_after"))
        jumps = _stored(jumps.join(onward, [*keys, "next"]).select(*keys, "t", F.col("_after").alias("next")), "reset-jumps")
    return reached


def with_reset_windows(events: DataFrame, width_ms: int = WINDOW_MS, keys: Sequence[str] = ("src_ip",), time: str = "timestamp_ms", piece: int | None = None) -> DataFrame:
    """Events with ``window_start_ms``. All events of a key count for where its windows begin; those without a time have none."""
    begin = window_beginnings(events, keys, time, width_ms, piece).withColumnRenamed("window_start", "window_start_ms")
    return as_of(events, begin, keys, time, "window_start_ms", piece or PIECE_WINDOWS * width_ms)


def syn_counts_reset(events: DataFrame, width_ms: int = WINDOW_MS) -> DataFrame:
    """SYN-only packets per source and reset window."""
    rows = with_reset_windows(events.select("src_ip", "timestamp_ms", syn_only().alias("_syn")), width_ms)
    return rows.where("_syn").groupBy("src_ip", "window_start_ms").agg(F.count("*").alias("n_syn"))


def syn_floods_reset(events: DataFrame, threshold: int = SYN_FLOOD_THRESHOLD, width_ms: int = WINDOW_MS) -> DataFrame:
    """One alert per source and reset window, at the SYN that reaches the threshold."""
    rows = with_reset_windows(events.select("packet_id", "timestamp_ms", "src_ip", "dst_ip", syn_only().alias("_syn")), width_ms).where("_syn").drop("_syn")
    crossing = kth_row(rows, ["src_ip", "window_start_ms"], ["timestamp_ms", "packet_id"], threshold)
    return to_alert(crossing, SYN_FLOOD_RULE, SYN_FLOOD_SEVERITY, flood_detail(F.lit(threshold), width_ms), "Anomaly", stage=2)
