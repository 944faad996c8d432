"""Keyed stateful detectors for streams, with event-time timers.

Rows of a micro-batch come in no particular order. The processors keep what
the watermark has not passed yet, work on it in event order once it has, and
drop all state of a key when its window or span is over.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wiresift.functions.clock import floor_div
from wiresift.functions.net import syn_only
from wiresift.functions.steps import StepTracker
from wiresift.operators.alerts import to_alert
from wiresift.operators.rates import flood_detail, scan_detail
from wiresift.operators.rule_set import folded_matches, step_mask
from wiresift.operators.sequence import SPAN_FACTOR, sequence_detail, with_spans
from wiresift.operators.signature import signature_alerts
from wiresift.rules import (
    DEFAULT_SEQUENCE,
    DEFAULT_SIGNATURES,
    PORT_SCAN_RULE,
    PORT_SCAN_SEVERITY,
    PORT_SCAN_THRESHOLD,
    SYN_FLOOD_RULE,
    SYN_FLOOD_SEVERITY,
    SYN_FLOOD_THRESHOLD,
    WINDOW_MS,
    SequenceRule,
    SignatureRule,
)
from wiresift.streaming.windows import LATENESS, with_event_time

# Python workers get the processors with the task, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CROSSING = T.StructType([
    T.StructField("packet_id", T.LongType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("src_ip", T.LongType()),
    T.StructField("dst_ip", T.LongType()),
])
_WAITING = T.StructType([
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("packet_id", T.LongType()),
    T.StructField("dst_ip", T.LongType()),
    T.StructField("steps", T.LongType()),
    T.StructField("own", T.BooleanType()),
])
_OPEN = T.StructType([
    T.StructField("done", T.IntegerType()),
    T.StructField("serial", T.LongType()),
    T.StructField("started", T.LongType()),
])
# A flood's packets are kept in so many rows a source and window: a row of state takes far more than a packet in it.
SLICES = 20
SEEN = ("timestamp_ms", "packet_id", "dst_ip")


def _crossings(src_ip: int, rows: list[tuple]) -> pd.DataFrame:
    """(timestamp_ms, packet_id, dst_ip, …) tuples as CROSSING rows."""
    return pd.DataFrame({
        "packet_id": pd.Series([r[1] for r in rows], dtype="int64"),
        "timestamp_ms": pd.Series([r[0] for r in rows], dtype="int64"),
        "src_ip": pd.Series([src_ip] * len(rows), dtype="int64"),
        "dst_ip": pd.Series([r[2] for r in rows], dtype="int64"),
    })


class StepSequence(StatefulProcessor):
    """Tracks the steps of a sequence rule for one (source, span)."""

    def __init__(self, n_steps: int, within: int, span: int):
        self.n_steps, self.within, self.span = n_steps, within, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.open = handle.getListState("open", _OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            names = ("timestamp_ms", "packet_id", "dst_ip", "steps", "own")
            self.waiting.appendList(list(zip(*(pdf[n].tolist() for n in names))))
            low = int(pdf["timestamp_ms"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first)
        self.handle.registerTimer((key[1] + 1) * self.span)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= passed]
        later = rows[len(ready):]
        tracker = StepTracker(self.n_steps, self.within)
        if self.open.exists():
            tracker.restore([tuple(o) for o in self.open.get()])
        done = [r for r in ready if tracker.feed(r[0], r[3]) is not None and r[4]]
        self.waiting.clear()
        self.open.clear()
        if passed < (key[1] + 1) * self.span:
            still_open = tracker.snapshot()
            if still_open:
                self.open.put(still_open)
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(later[0][0])
        if done:
            yield _crossings(key[0], done)

    def close(self) -> None:
        pass


def _kth_of_window(packets: DataFrame, part: Column, seen: Column, merged: Column, width_ms: int, k: int) -> DataFrame:
    """The k-th of the packets that stand for each (window, source), as CROSSING rows, at the window's close.

    ``seen`` is what goes on of the packets of a window, source and ``part``, as structs of timestamp_ms, packet_id and dst_ip.
    A second aggregate behind it, over the window's own time, puts that into one list by ``merged``.

    Source and part are one struct: its fields come behind the window in the key of the state, so that rows of a
    source and window lie side by side and take little when compressed.
    """
    window = F.window("ts", f"{width_ms} milliseconds")
    parts = packets.groupBy(window, F.struct("src_ip", part.alias("part")).alias("of")).agg(seen.alias("seen"))
    timed = parts.select(F.window_time("window").alias("ts"), "of.src_ip", "seen")
    whole = timed.groupBy(window, "src_ip").agg(merged.alias("seen"))
    kth = F.get(F.sort_array("seen"), F.lit(k - 1)).alias("p")
    return whole.where(F.size("seen") >= k).select("src_ip", kth).select("p.packet_id", "p.timestamp_ms", "src_ip", "p.dst_ip")


def stream_flood_alerts(
    packets: DataFrame,
    threshold: int = SYN_FLOOD_THRESHOLD,
    width_ms: int = WINDOW_MS,
    lateness: str = LATENESS,
) -> DataFrame:
    """The batch flood alerts, packet and destination included, at the window's close.

    The packets of a source and a short slice of the window come together first, and the earliest ``threshold``
    of them go on: what a window puts together is bounded by its slices, however many packets it has.
    """
    syns = with_event_time(packets.where(syn_only()).select("src_ip", "packet_id", "timestamp_ms", "dst_ip"), lateness)
    earliest = F.slice(F.sort_array(F.collect_list(F.struct(*SEEN))), 1, threshold)
    part = floor_div("timestamp_ms", max(1, width_ms // SLICES))
    return to_alert(
        _kth_of_window(syns, part, earliest, F.flatten(F.collect_list("seen")), width_ms, threshold),
        SYN_FLOOD_RULE, SYN_FLOOD_SEVERITY, flood_detail(F.lit(threshold), width_ms), "Anomaly", stage=2)


def stream_port_scan_alerts(
    packets: DataFrame,
    threshold: int = PORT_SCAN_THRESHOLD,
    width_ms: int = WINDOW_MS,
    lateness: str = LATENESS,
) -> DataFrame:
    """The batch scan alerts, packet and destination included, at the window's close.

    State is the first packet of each port, so at most 65,536 entries per source and window.
    """
    timed = with_event_time(packets.select("src_ip", "packet_id", "timestamp_ms", "dst_ip", "dst_port"), lateness)
    return to_alert(
        _kth_of_window(timed, F.col("dst_port"), F.min(F.struct(*SEEN)), F.collect_list("seen"), width_ms, threshold),
        PORT_SCAN_RULE, PORT_SCAN_SEVERITY, scan_detail(F.lit(threshold), width_ms), "Anomaly", stage=3)


def stream_all_alerts(
    packets: DataFrame,
    signatures: Sequence[SignatureRule] = DEFAULT_SIGNATURES,
    sequences: Sequence[SequenceRule] = (DEFAULT_SEQUENCE,),
    syn_threshold: int = SYN_FLOOD_THRESHOLD,
    port_threshold: int = PORT_SCAN_THRESHOLD,
    width_ms: int = WINDOW_MS,
    lateness: str = LATENESS,
) -> DataFrame:
    """All detectors on one stream: the alerts of ``all_alerts``.

    Signature alerts come with their batch, floods and scans when their window
    closes, sequences when their span does.
    """
    branches = [
        signature_alerts(packets, signatures),
        stream_flood_alerts(packets, syn_threshold, width_ms, lateness),
        stream_port_scan_alerts(packets, port_threshold, width_ms, lateness),
        *[stream_sequence_alerts(packets, rule, lateness) for rule in sequences],
    ]
    return reduce(DataFrame.unionByName, branches)


def stream_sequence_alerts(
    packets: DataFrame,
    rule: SequenceRule = DEFAULT_SEQUENCE,
    lateness: str = LATENESS,
    span_ms: int | None = None,
) -> DataFrame:
    """Sequence alerts, at the close of the span in which they complete.

    A source's packets are gathered per time span, led in by the tail of the span before as in batch,
    and folded as a rule set is. The spans are overlapping windows: a busy source is spread over tasks and the
    state of a span ends with it. ``stream_sequences_at_completion`` does not wait for the span to close, at several times the cost.
    """
    span, within = span_ms or SPAN_FACTOR * rule.within_ms, rule.within_ms
    if span < within:
        raise ValueError("a span must be at least as long as the limit")
    rules, names = [(rule.conditions(), within)], ["src_ip", "timestamp_ms", "packet_id", "dst_ip"]
    marked = packets.select(*names, step_mask(rules).alias("_mask")).where("_mask != 0")
    if len(rules[0][0]) < 2:
        done = marked.where("false")
    else:
        lead_and_span = F.window("ts", f"{span + within} milliseconds", f"{span} milliseconds", f"{span - within} milliseconds")
        spans = with_event_time(marked, lateness).select(*names, "_mask", lead_and_span.alias("window"))
        # the state has only what differs from row to row
        packet = F.struct(F.col("timestamp_ms").cast("long").alias("t"), "packet_id", F.col("_mask").alias("mask"), "dst_ip")
        gathered = spans.groupBy("window", "src_ip").agg(F.bit_or("_mask").alias("_any"), F.sort_array(F.collect_list(packet)).alias("_rows"))
        # spans without a last step end here
        able = gathered.where(F.col("_any").bitwiseAND(F.lit(1 << (len(rules[0][0]) - 1)).cast("long")) != 0)
        done = folded_matches(
            able, rules,
            own=lambda x: x["t"] - F.unix_millis("window.start") >= within,
            row=lambda x: F.struct("src_ip", x["t"].alias("timestamp_ms"), x["packet_id"].alias("packet_id"), x["dst_ip"].alias("dst_ip")))
    return to_alert(done, rule.name, rule.severity, sequence_detail(rule), "Cep", stage=4)


def stream_sequences_at_completion(
    packets: DataFrame,
    rule: SequenceRule = DEFAULT_SEQUENCE,
    lateness: str = LATENESS,
    span_ms: int | None = None,
) -> DataFrame:
    """The same alerts, each once the watermark passes the completing packet.

    Keyed by source and time span, with the tail of each span repeated as the
    lead-in of the next, as in batch: a busy source is spread over tasks and
    the state of a span ends with it.
    """
    conditions = rule.conditions()
    steps = sum(
        (F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0))
    marked = packets.select(
        "src_ip", "timestamp_ms", "packet_id", "dst_ip", steps.cast("long").alias("steps")
    ).where(F.col("steps") != 0)
    span = span_ms or SPAN_FACTOR * rule.within_ms
    keyed = with_event_time(
        with_spans(marked, "timestamp_ms", rule.within_ms, span).withColumnsRenamed(
            {"_span": "span", "_own": "own"}),
        lateness)
    done = keyed.groupBy("src_ip", "span").transformWithStateInPandas(
        StepSequence(len(conditions), rule.within_ms, span), CROSSING, "append", "EventTime")
    return to_alert(done, rule.name, rule.severity, sequence_detail(rule), "Cep", stage=4)
