"""Queries an analyst runs on the alert table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiresift.functions.severity import SEVERITIES, severity_lane
from wiresift.operators.alerts import newest_first

# Rows of the triage page, length of the timeline.
PAGE_SIZE = 500
TIMELINE_MS = 600000


def triage_filter(alerts: DataFrame, severity: str = "all", detector: str = "all") -> DataFrame:
    """Alerts of one severity and one detector; ``all`` leaves a side open."""
    if severity != "all":
        alerts = alerts.where(F.col("severity") == severity)
    if detector != "all":
        alerts = alerts.where(F.col("detector") == detector)
    return alerts


def triage_page(
    alerts: DataFrame, severity: str = "all", detector: str = "all", rows: int = PAGE_SIZE
) -> DataFrame:
    """The newest alerts that pass the filter, newest first."""
    return triage_filter(alerts, severity, detector).orderBy(*newest_first()).limit(rows)


def recent(alerts: DataFrame, now_ms: Column | int, window_ms: int = TIMELINE_MS) -> DataFrame:
    """Alerts at most ``window_ms`` old."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return alerts.where(now - F.col("timestamp_ms") <= window_ms)


def alert_timeline(alerts: DataFrame, now_ms: Column | int, window_ms: int = TIMELINE_MS) -> DataFrame:
    """Recent alerts with a position (1 is now, 0 the window's start) and a severity lane."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    age = now - F.col("timestamp_ms")
    return recent(alerts, now, window_ms).select(
        "detector", "rule_name", "severity", "packet_id", "match_pos", "timestamp_ms",
        (1 - age / window_ms).alias("position"), severity_lane().alias("lane"))


def severity_distribution(alerts: DataFrame) -> DataFrame:
    """Alerts per severity in display order, absent severities as 0.

    One row of conditional counts, turned into a row per severity: neither a
    join to fill the gaps nor a sort is needed.
    """
    counts = alerts.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    entries = [
        F.struct(F.lit(s).alias("severity"), F.lit(i + 1).alias("severity_rank"), F.col(s).alias("n_alerts"))
        for i, s in enumerate(SEVERITIES)
    ]
    return counts.select(F.inline(F.array(*entries)))


def detector_distribution(alerts: DataFrame) -> DataFrame:
    """Alerts per detector, most first; detectors without alerts are left out."""
    return alerts.groupBy("detector").agg(F.count("*").alias("n_alerts")).orderBy(
        F.desc("n_alerts"), "detector")


def rule_breakdown(alerts: DataFrame) -> DataFrame:
    """Alerts per detector and rule, most first."""
    return alerts.groupBy("detector", "rule_name").agg(F.count("*").alias("n_alerts")).orderBy(
        F.desc("n_alerts"), "detector", "rule_name")


def rule_activity(catalogue: DataFrame, alerts: DataFrame) -> DataFrame:
    """The rule catalogue with the number of alerts each rule has raised."""
    counts = alerts.groupBy(F.col("rule_name").alias("name")).agg(F.count("*").alias("n_alerts"))
    return catalogue.join(counts, "name", "left").select(
        "name", "detector", "description", F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"))
