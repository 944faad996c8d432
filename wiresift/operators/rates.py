"""Exact per-source rates over time windows: SYN floods and port scans."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from wiresift.functions.clock import duration_text, ms_to_ts, window_start
from wiresift.functions.net import ip_to_string, syn_only
from wiresift.operators.alerts import to_alert
from wiresift.operators.ordered import kth_row, spread
from wiresift.rules import (
    PORT_SCAN_RULE,
    PORT_SCAN_SEVERITY,
    PORT_SCAN_THRESHOLD,
    SYN_FLOOD_RULE,
    SYN_FLOOD_SEVERITY,
    SYN_FLOOD_THRESHOLD,
    WINDOW_MS,
)


def syn_counts(events: DataFrame, width_ms: int = WINDOW_MS, slide_ms: int | None = None) -> DataFrame:
    """SYN-only packets per source and window; with ``slide_ms``, windows overlap."""
    syns = events.where(syn_only())
    if slide_ms is None:
        start = window_start(width_ms)
    else:
        pane = F.window(
            ms_to_ts("timestamp_ms"), f"{width_ms} milliseconds", f"{slide_ms} milliseconds")
        start = F.unix_millis(pane["start"])
        syns = syns.select("src_ip", start.alias("window_start_ms"))
        return syns.groupBy("src_ip", "window_start_ms").agg(F.count("*").alias("n_syn"))
    return syns.groupBy("src_ip", start.alias("window_start_ms")).agg(F.count("*").alias("n_syn"))


def flood_detail(estimate, width_ms: int):
    return F.format_string(
        f"source %s sent an estimated %d+ SYNs within {duration_text(width_ms)} window",
        ip_to_string("src_ip"), estimate)


def scan_detail(estimate, width_ms: int):
    return F.format_string(
        "source %s touched an estimated %d distinct destination ports within "
        f"{duration_text(width_ms)} window",
        ip_to_string("src_ip"), estimate)


def syn_floods(
    events: DataFrame, threshold: int = SYN_FLOOD_THRESHOLD, width_ms: int = WINDOW_MS
) -> DataFrame:
    """One alert per source and window, at the SYN that reaches the threshold."""
    syns = events.where(syn_only()).select(
        "packet_id", "timestamp_ms", "src_ip", "dst_ip", window_start(width_ms).alias("window_start_ms"))
    crossing = kth_row(
        spread(syns, "packet_id"), ["src_ip", "window_start_ms"], ["timestamp_ms", "packet_id"], threshold)
    return to_alert(
        crossing, SYN_FLOOD_RULE, SYN_FLOOD_SEVERITY,
        flood_detail(F.lit(threshold), width_ms), "Anomaly", stage=2)


def port_counts(events: DataFrame, width_ms: int = WINDOW_MS) -> DataFrame:
    """Distinct destination ports per source and window, over all packets."""
    return events.groupBy("src_ip", window_start(width_ms).alias("window_start_ms")).agg(
        F.countDistinct("dst_port").alias("n_ports"))


def first_sightings(events: DataFrame, item: str, width_ms: int = WINDOW_MS) -> DataFrame:
    """The first packet per source, window and value of ``item``.

    A minimum, so each map task sends one row per group at most. Time and
    packet id are one decimal, which a hash aggregate can keep: nothing is
    sorted on the map side.
    """
    shift, unsigned = F.lit(Decimal(10**20)), F.lit(Decimal(2**63))
    order = F.col("timestamp_ms").cast("decimal(17,0)") * shift + (F.col("packet_id").cast("decimal(19,0)") + unsigned)
    first = F.col("_first")
    columns = dict.fromkeys(["src_ip", "timestamp_ms", item, "packet_id", "dst_ip"])
    return (
        spread(events.select(*columns), "packet_id")
        .groupBy("src_ip", window_start(width_ms).alias("window_start_ms"), item)
        .agg(F.min(order.cast("decimal(38,0)")).alias("_first"), F.min_by("dst_ip", order.cast("decimal(38,0)")).alias("dst_ip"))
        .select(
            "src_ip", "window_start_ms", item,
            F.floor(first / shift).cast("long").alias("timestamp_ms"),
            (first % shift - unsigned).cast("long").alias("packet_id"), "dst_ip")
    )


def port_scans(
    events: DataFrame, threshold: int = PORT_SCAN_THRESHOLD, width_ms: int = WINDOW_MS
) -> DataFrame:
    """One alert per source and window, at the packet that reaches the threshold."""
    crossing = kth_row(
        first_sightings(events, "dst_port", width_ms),
        ["src_ip", "window_start_ms"], ["timestamp_ms", "packet_id"], threshold)
    return to_alert(
        crossing, PORT_SCAN_RULE, PORT_SCAN_SEVERITY,
        scan_detail(F.lit(threshold), width_ms), "Anomaly", stage=3)
