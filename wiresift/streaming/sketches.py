"""Count-Min estimates on a stream: two stateful aggregates, one behind the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wiresift.functions.net import syn_only
from wiresift.operators.sketches import CELL_MAX, cms_cells
from wiresift.rules import CMS_DEPTH, CMS_WIDTH, SYN_FLOOD_THRESHOLD, WINDOW_MS
from wiresift.streaming.windows import LATENESS, with_event_time


def stream_cms_estimates(
    packets: DataFrame, width_ms: int = WINDOW_MS, lateness: str = LATENESS, width: int = CMS_WIDTH, depth: int = CMS_DEPTH
) -> DataFrame:
    """Estimated SYN count per source and window, at the window's close.

    First the cells of each window are counted, with the sources that fall into them; then a source's
    estimate is the least of its cells. The second aggregate takes the window's own time as event time, so
    the watermark that closes a window in the first closes it in the second as well. State is an
    entry per source, window and hash row, and goes with the window.
    """
    size = f"{width_ms} milliseconds"
    syns = with_event_time(packets.where(syn_only()).select("src_ip", "timestamp_ms"), lateness)
    cells = syns.select("ts", "src_ip", F.inline(cms_cells("src_ip", width, depth)))
    counted = cells.groupBy(F.window("ts", size), "cms_row", "cell").agg(
        F.least(F.count("*"), F.lit(CELL_MAX)).alias("n_cell"), F.collect_set("src_ip").alias("sources"))
    each = counted.select(F.window_time("window").alias("ts"), "n_cell", F.explode("sources").alias("src_ip"))
    least = each.groupBy(F.window("ts", size), "src_ip").agg(F.min("n_cell").alias("n_estimate"))
    return least.select("src_ip", F.unix_millis("window.start").alias("window_start_ms"), "n_estimate")


def stream_cms_flood_sources(packets: DataFrame, threshold: int = SYN_FLOOD_THRESHOLD, **options) -> DataFrame:
    """Sources and windows whose estimate reaches the threshold."""
    return stream_cms_estimates(packets, **options).where(F.col("n_estimate") >= threshold)
