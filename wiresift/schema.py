"""Table schemas shared by the batch and the streaming operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Packet events. IP addresses are unsigned 32-bit values, so they are longs.
# packet_id is unique and breaks ties between packets of one millisecond.
EVENT = T.StructType([
    T.StructField("packet_id", T.LongType(), False),
    T.StructField("timestamp_ms", T.LongType(), False),
    T.StructField("src_ip", T.LongType(), False),
    T.StructField("dst_ip", T.LongType(), False),
    T.StructField("src_port", T.IntegerType(), False),
    T.StructField("dst_port", T.IntegerType(), False),
    T.StructField("protocol", T.StringType(), False),
    T.StructField("flags", T.IntegerType(), False),
    T.StructField("payload_sample", T.BinaryType(), False),
])

# Alerts as the detectors emit them, before numbering. The last four columns
# identify an alert and give its place in arrival order: stage is the position
# of the detector in the per-packet order (1 signature, 2 flood, 3 scan,
# 4 sequence); match_pos and match_end are 0 unless it is a signature match.
ALERT = T.StructType([
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("detector", T.StringType()),
    T.StructField("packet_id", T.LongType()),
    T.StructField("stage", T.IntegerType()),
    T.StructField("match_pos", T.IntegerType()),
    T.StructField("match_end", T.IntegerType()),
])

# One row of the captured alert CSV.
CAPTURED_ALERT = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("detector", T.StringType()),
])

# One polled snapshot of the three running counters.
STATS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("poll_time", T.DoubleType()),
    T.StructField("events_processed", T.LongType()),
    T.StructField("events_dropped", T.LongType()),
    T.StructField("alerts_fired", T.LongType()),
    T.StructField("queue_backpressure_events", T.LongType()),
])

FRAME = T.StructType([
    T.StructField("frame_id", T.LongType(), False),
    T.StructField("rx_queue", T.IntegerType(), False),
    T.StructField("frame", T.BinaryType(), False),
])

# What makes an alert unique, and the order in which alerts arrive.
ALERT_KEY = ["detector", "rule_name", "packet_id", "match_pos"]
ARRIVAL = ["timestamp_ms", "packet_id", "stage", "match_end", "match_pos", "rule_name"]
