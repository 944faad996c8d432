"""Incremental capture: what repeated polls of the alert store collect."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wiresift.functions.clock import floor_div
from wiresift.operators.ordered import running_total
from wiresift.schema import ARRIVAL


def captured_by_polls(
    numbered: DataFrame, interval_ms: int, page: int | None = None, slice_ms: int = 60000
) -> DataFrame:
    """Every alert once, with ``poll_ms``: the time of the first poll after it.

    Polls come at the end of each interval and keep what they do not have yet.
    A ``page`` must be asked for: each poll then sees the newest ``page``
    alerts only, and what more than that many followed in its interval is lost
    to the capture.
    """
    polled = numbered.withColumn("poll_ms", (floor_div("timestamp_ms", interval_ms) + 1) * interval_ms)
    if page is None:
        return polled
    # Rank from the newest backwards: order and slices run on negated values.
    back = [f"_back_{c}" for c in ARRIVAL if c != "rule_name"]
    negated = polled.withColumns({b: -F.col(b.removeprefix("_back_")) for b in back})
    ranked = running_total(
        negated,
        keys=["poll_ms"],
        order=[*back, F.desc("rule_name")],
        piece=-floor_div("timestamp_ms", slice_ms),
        value=F.lit(1),
        name="_rank",
    )
    return ranked.where(F.col("_rank") <= page).select(*numbered.columns, "poll_ms")


def poll_counts(captured: DataFrame) -> DataFrame:
    """How many new alerts each poll brought, for the polls that brought any."""
    return captured.groupBy("poll_ms").agg(F.count("*").alias("n_captured"))
