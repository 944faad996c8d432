"""Windowed counts on streams. Windows close when the watermark passes their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wiresift.functions.clock import ms_to_ts
from wiresift.functions.net import syn_only
from wiresift.rules import PORT_SCAN_THRESHOLD, SYN_FLOOD_THRESHOLD, WINDOW_MS

# How late packets may be. The reading side never drops earlier ones.
LATENESS = "10 seconds"


def with_event_time(packets: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Add the timestamp column ``ts`` and its watermark."""
    return packets.withColumn("ts", ms_to_ts("timestamp_ms")).withWatermark("ts", lateness)


def _windowed(packets: DataFrame, width_ms: int, slide_ms: int | None, *aggregates) -> DataFrame:
    slide = None if slide_ms is None else f"{slide_ms} milliseconds"
    pane = F.window("ts", f"{width_ms} milliseconds", slide)
    grouped = packets.groupBy(pane, "src_ip").agg(*aggregates)
    return grouped.withColumn("window_start_ms", F.unix_millis("window.start")).drop("window")


def stream_syn_counts(
    packets: DataFrame, width_ms: int = WINDOW_MS, lateness: str = LATENESS, slide_ms: int | None = None
) -> DataFrame:
    """SYN-only packets per source and window, in append mode; with ``slide_ms``, windows overlap."""
    syns = with_event_time(packets.where(syn_only()).select("src_ip", "timestamp_ms"), lateness)
    return _windowed(syns, width_ms, slide_ms, F.count("*").alias("n_syn")).select(
        "src_ip", "window_start_ms", "n_syn")


def stream_syn_floods(
    packets: DataFrame,
    threshold: int = SYN_FLOOD_THRESHOLD,
    width_ms: int = WINDOW_MS,
    lateness: str = LATENESS,
) -> DataFrame:
    """Flooding sources, one row per source and window, at the window's close."""
    return stream_syn_counts(packets, width_ms, lateness).where(F.col("n_syn") >= threshold)


def stream_port_counts(packets: DataFrame, width_ms: int = WINDOW_MS, lateness: str = LATENESS) -> DataFrame:
    """Distinct destination ports per source and window, exactly.

    State is a set of 16-bit ports, so at most 65,536 values per group, and
    each micro-batch is reduced to such sets before the shuffle.
    """
    timed = with_event_time(packets.select("src_ip", "dst_port", "timestamp_ms"), lateness)
    counted = _windowed(timed, width_ms, None, F.collect_set("dst_port").alias("ports"))
    return counted.select("src_ip", "window_start_ms", F.size("ports").cast("long").alias("n_ports"))


def stream_port_scans(
    packets: DataFrame,
    threshold: int = PORT_SCAN_THRESHOLD,
    width_ms: int = WINDOW_MS,
    lateness: str = LATENESS,
) -> DataFrame:
    """Scanning sources, one row per source and window, at the window's close."""
    return stream_port_counts(packets, width_ms, lateness).where(F.col("n_ports") >= threshold)
