"""The alert table: shaping, numbering, latest, retention, dedup, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiresift.functions.clock import floor_div
from wiresift.functions.net import ip_to_string
from wiresift.operators.ordered import running_total
from wiresift.schema import ALERT, ALERT_KEY, ARRIVAL, CAPTURED_ALERT

# Default page of the latest-alerts query, and how many alerts the
# store keeps.
LATEST_DEFAULT = 200
STORE_SIZE = 5000

# Alerts are numbered per detector and time slice of this length.
NUMBERING_SLICE_MS = 10000


def to_alert(
    events: DataFrame,
    rule: Column | str,
    severity: Column | str,
    detail: Column,
    detector: str,
    stage: int,
    match_pos: Column | None = None,
    match_end: Column | None = None,
) -> DataFrame:
    """Project event rows to alerts: copy the time, render addresses, attach the rule."""

    def literal(v):
        return F.lit(v) if isinstance(v, str) else v

    zero = F.lit(0)
    return events.select(
        "timestamp_ms",
        literal(rule).alias("rule_name"),
        literal(severity).alias("severity"),
        ip_to_string("src_ip").alias("src_ip"),
        ip_to_string("dst_ip").alias("dst_ip"),
        detail.alias("detail"),
        F.lit(detector).alias("detector"),
        "packet_id",
        F.lit(stage).alias("stage"),
        (zero if match_pos is None else match_pos).cast("int").alias("match_pos"),
        (zero if match_end is None else match_end).cast("int").alias("match_end"),
    ).to(ALERT)


def number_alerts(alerts: DataFrame, slice_ms: int = NUMBERING_SLICE_MS) -> DataFrame:
    """Add ``id``: 1, 2, … per detector in arrival order.

    Reads ``alerts`` twice, so give it a stored alert table.
    """
    numbered = running_total(
        alerts,
        keys=["detector"],
        order=ARRIVAL,
        piece=floor_div("timestamp_ms", slice_ms),
        value=F.lit(1),
        name="id",
    )
    return numbered.select("id", *alerts.columns)


def newest_first() -> list[Column]:
    return [F.desc(c) for c in ARRIVAL]


def latest_alerts(alerts: DataFrame, limit: int = LATEST_DEFAULT) -> DataFrame:
    """The newest ``limit`` alerts, newest first."""
    return alerts.orderBy(*newest_first()).limit(limit)


def retain(alerts: DataFrame, keep: int = STORE_SIZE) -> DataFrame:
    """The newest ``keep`` alerts, as a store compaction would leave them."""
    return alerts.orderBy(*newest_first()).limit(keep)


def dedup_alerts(alerts: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row per alert key."""
    return alerts.dropDuplicates(key or ALERT_KEY)


def unseen_alerts(alerts: DataFrame, seen: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Alerts whose key is not in ``seen``."""
    key = key or ALERT_KEY
    return alerts.join(seen.select(*key), key, "left_anti").select(*alerts.columns)


def alert_json(numbered: DataFrame) -> DataFrame:
    """Numbered alerts as JSON objects with the captured alert's fields, in order."""
    return numbered.select(
        "detector", "id", F.to_json(F.struct(*CAPTURED_ALERT.names)).alias("alert_json"))
