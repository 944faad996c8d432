"""Floods on a stream, alerted at the packet that crosses the threshold instead of at the window's close."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wiresift.functions.clock import window_start
from wiresift.functions.net import syn_only
from wiresift.operators.alerts import to_alert
from wiresift.operators.rates import flood_detail
from wiresift.rules import SYN_FLOOD_RULE, SYN_FLOOD_SEVERITY, SYN_FLOOD_THRESHOLD, WINDOW_MS
from wiresift.streaming.windows import LATENESS, with_event_time

# Python workers get the processor with the task, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CROSSING = T.StructType([T.StructField(n, T.LongType()) for n in ("packet_id", "timestamp_ms", "src_ip", "dst_ip")])
_SEEN = T.StructType([T.StructField(n, T.LongType()) for n in ("timestamp_ms", "packet_id", "dst_ip")])
_FLAG = T.StructType([T.StructField("alerted", T.BooleanType())])


class CrossingPacket(StatefulProcessor):
    """Emits the k-th packet of a (source, window) as soon as the watermark has passed it.

    The buffer holds the k earliest packets in event order. Its last one is the crossing if no
    earlier packet is still to come, so a timer is set to its time; an earlier packet that does
    come shifts the crossing and sets another. After the crossing only a flag is left, which goes
    with the window.
    """

    def __init__(self, k: int, width_ms: int):
        self.k, self.width_ms = k, width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.earliest = handle.getListState("earliest", _SEEN)
        self.flag = handle.getValueState("alerted", _FLAG)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.flag.exists():
            return iter(())
        kept = [tuple(r) for r in self.earliest.get()] if self.earliest.exists() else []
        for pdf in rows:
            kept.extend(zip(pdf["timestamp_ms"].tolist(), pdf["packet_id"].tolist(), pdf["dst_ip"].tolist()))
            kept = sorted(kept)[: self.k]
        self.earliest.put(kept)
        if len(kept) == self.k:
            self.handle.registerTimer(kept[-1][0])
        self.handle.registerTimer(key[1] + self.width_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        over = passed >= key[1] + self.width_ms
        kept = [tuple(r) for r in self.earliest.get()] if self.earliest.exists() else []
        if len(kept) == self.k and kept[-1][0] <= passed:
            ms, packet_id, dst_ip = kept[-1]
            self.earliest.clear()
            if not over:
                self.flag.update((True,))
            yield pd.DataFrame({"packet_id": [packet_id], "timestamp_ms": [ms], "src_ip": [key[0]], "dst_ip": [dst_ip]})
        if over:
            self.earliest.clear()
            self.flag.clear()

    def close(self) -> None:
        pass


def stream_floods_at_crossing(
    packets: DataFrame,
    threshold: int = SYN_FLOOD_THRESHOLD,
    width_ms: int = WINDOW_MS,
    lateness: str = LATENESS,
) -> DataFrame:
    """The batch flood alerts, each once the watermark passes the packet that reaches the threshold."""
    syns = with_event_time(
        packets.where(syn_only()).select(
            "src_ip", window_start(width_ms).alias("window_start_ms"),
            "packet_id", "timestamp_ms", "dst_ip"),
        lateness)
    crossing = syns.groupBy("src_ip", "window_start_ms").transformWithStateInPandas(
        CrossingPacket(threshold, width_ms), CROSSING, "append", "EventTime")
    return to_alert(
        crossing, SYN_FLOOD_RULE, SYN_FLOOD_SEVERITY,
        flood_detail(F.lit(threshold), width_ms), "Anomaly", stage=2)
