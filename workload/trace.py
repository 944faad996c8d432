"""Packet trace, stats series and raw frames derived from the ``events`` table.

Every event becomes at least one packet; some event types also expand into
bursts whose shapes are those of floods, scans, signature hits and
probe/exploit pairs. Everything is computed from the event's own columns, so
the trace is the same on every run and works on a stream as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wiresift.functions.clock import ntz_to_ms

SOURCE_BASE = 2886729728  # 172.16.0.0
TARGET = 3325256714  # 198.51.100.10
SERVICE_PORTS = (8080, 8443, 2222, 853)
SCAN_FROM, SCAN_STEP = 2000, 11

GREETING = b"HEAD /status HTTP/1.0"
EXPLOIT = b"POST /files?name=../../etc/passwd"
# By k mod 6. The last one matches nothing: patterns are case-sensitive.
CLICK_PAYLOADS = (
    EXPLOIT,
    b"q=9' UNION SELECT name",
    b"say <script>alert('hi')</script>",
    b"start cmd.exe /q",
    b"PUT /a/../../../b",
    b"union select name",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files.

    The braces make the path a glob, which may name a single file as well as a
    directory of part files.
    """
    schema = read_table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{{{name}}}.parquet")


def _binary(value: bytes) -> Column:
    return F.lit(bytearray(value))


def _choose(index: Column, values) -> Column:
    """values[index], written as a CASE so that it stays inside codegen."""
    out = F.lit(values[-1]) if not isinstance(values[-1], bytes) else _binary(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(index == i, _binary(v) if isinstance(v, bytes) else F.lit(v)).otherwise(out)
    return out


def packet_trace(events: DataFrame) -> DataFrame:
    """Expand ``events`` rows into packet events (see ``schema.EVENT``)."""
    base = events.select(
        "event_id",
        "event_type",
        "user_id",
        ntz_to_ms("ts").alias("t0"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    kind, eid, k = F.col("event_type"), F.col("event_id"), F.col("k")
    none = F.array().cast("array<int>")

    def burst(condition: Column, first: int, count: Column) -> Column:
        return F.when(condition, F.sequence(F.lit(first), first + count - 1)).otherwise(none)

    def fixed(condition: Column, *slots: int) -> Column:
        return F.when(condition, F.array(*[F.lit(s) for s in slots])).otherwise(none)

    buys = (kind == "purchase") & (eid % 5 == 3)
    slots = F.concat(
        F.array(F.lit(0)),
        burst((kind == "error") & (eid % 5 == 0), 100, 30 + k % 60),
        burst((kind == "signup") & (eid % 5 == 1), 300, 15 + k % 30),
        fixed((kind == "click") & (eid % 5 == 2), 500),
        fixed(buys, 600, 700),
        fixed(buys & (k % 3 == 0), 601, 701),
    )
    rows = base.select("*", F.explode(slots).alias("slot"))

    slot = F.col("slot")
    flood, scan = slot.between(100, 299), slot.between(300, 499)
    click, probe, exploit = slot == 500, slot.between(600, 699), slot >= 700
    packet_id = eid * 1000 + slot
    offset = (
        F.when(flood, 10 * (slot - 100))
        .when(scan, 10 * (slot - 300))
        .when(click, 1)
        .when(probe, slot - 599)
        .when(exploit, slot - 699 + (k % 8) * 1000)
        .otherwise(0)
    )
    dst_port = (
        F.when(slot == 0, _choose(eid % 4, SERVICE_PORTS))
        .when(scan, SCAN_FROM + SCAN_STEP * (slot - 300))
        .otherwise(80)
    )
    payload = (
        F.when(slot == 0, _binary(GREETING))
        .when(click, _choose(k % 6, CLICK_PAYLOADS))
        .when(exploit, _binary(EXPLOIT))
        .otherwise(_binary(b""))
    )
    return rows.select(
        packet_id.alias("packet_id"),
        (F.col("t0") + offset).alias("timestamp_ms"),
        (F.col("user_id") + SOURCE_BASE).alias("src_ip"),
        F.lit(TARGET).cast("long").alias("dst_ip"),
        (1024 + packet_id % 64511).cast("int").alias("src_port"),
        dst_port.cast("int").alias("dst_port"),
        F.lit("Tcp").alias("protocol"),
        F.when(flood | scan | probe, 1).otherwise(3).alias("flags"),
        payload.alias("payload_sample"),
    )


def stats_series(events: DataFrame, run_id: str = "r0") -> DataFrame:
    """Polled counters: one snapshot at the end of each day with events.

    Processed counts events so far, dropped those with k = 0, alerts_fired the
    error events; the first day's snapshot is polled again an hour later
    without growth. The running sums are over one row per day.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    day_ms = 86400000
    days = (
        events.select(
            F.expr(f"{day_ms}L").alias("width"), ntz_to_ms("ts").alias("ms"), k.alias("k"),
            (F.col("event_type") == "error").alias("alerting"))
        .groupBy((F.col("ms") - F.pmod("ms", "width") + F.col("width")).alias("poll_ms"))
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("k") == 0).alias("dropped"),
            F.count_if("alerting").alias("alerting"),
        )
    )
    upto = Window.partitionBy("run_id").orderBy("poll_ms").rowsBetween(Window.unboundedPreceding, 0)
    polls = days.withColumn("run_id", F.lit(run_id)).select(
        "run_id",
        "poll_ms",
        F.sum("n").over(upto).alias("events_processed"),
        F.sum("dropped").over(upto).alias("events_dropped"),
        F.sum("alerting").over(upto).alias("alerts_fired"),
        (F.row_number().over(Window.partitionBy("run_id").orderBy("poll_ms")) == 1).alias("first"),
    )
    times = F.when(F.col("first"), F.array(F.col("poll_ms"), F.col("poll_ms") + 3600000)).otherwise(
        F.array("poll_ms"))
    return polls.select("*", F.explode(times).alias("at_ms")).select(
        "run_id",
        (F.col("at_ms") / 1000).cast("double").alias("poll_time"),
        "events_processed",
        "events_dropped",
        "alerts_fired",
        F.col("events_dropped").alias("queue_backpressure_events"),
    )


def raw_frames(packets: DataFrame) -> DataFrame:
    """Wrap each packet in an Ethernet frame (see ``schema.FRAME``).

    ``packet_id`` modulo 11 picks the form: well-formed TCP, UDP and ICMP, IPv4
    with options, VLAN-tagged, IPv6, and frames cut short at each header.
    """
    form = F.col("packet_id") % 11

    def hexed(value: Column, digits: int) -> Column:
        return F.lpad(F.hex(value.cast("long")), digits, "0")

    ports = F.concat(hexed(F.col("src_port"), 4), hexed(F.col("dst_port"), 4))
    tcp = F.concat(ports, F.lit("00" * 9), hexed(F.col("flags"), 2), F.lit("00" * 6))
    udp = F.concat(ports, F.lit("00080000"))
    addresses = F.concat(hexed(F.col("src_ip"), 8), hexed(F.col("dst_ip"), 8))

    def ip(version_ihl: str, protocol: str, options: str = "") -> Column:
        return F.concat(F.lit(version_ihl + "00" * 8 + protocol + "0000"), addresses, F.lit(options))

    macs = F.lit("0200000000010200000000" + "02")
    v4, v6, vlan = F.lit("0800"), F.lit("86dd"), F.lit("81000001")
    body = F.hex("payload_sample")
    forms = [
        F.concat(macs, v4, ip("45", "06"), tcp, body),                # 0 TCP
        F.concat(macs, v4, ip("45", "11"), udp, body),                # 1 UDP
        F.concat(macs, v4, ip("45", "01")),                           # 2 ICMP, header only
        F.concat(macs, v4, ip("46", "06", "00000000"), tcp, body),    # 3 TCP, IP options
        F.concat(macs, F.lit("08")),                                  # 4 cut in Ethernet header
        F.concat(macs, v6, ip("60", "06"), tcp, body),                # 5 IPv6
        F.concat(macs, vlan, v4, ip("45", "06"), tcp, body),          # 6 VLAN tag
        F.concat(macs, v4, F.lit("45" + "00" * 18)),                  # 7 cut in IP header
        F.concat(macs, v4, ip("45", "06"), F.substring(tcp, 1, 38)),  # 8 TCP, one byte short
        F.concat(macs, v4, ip("45", "11"), F.substring(udp, 1, 14)),  # 9 UDP, one byte short
        F.concat(macs, v4, ip("46", "06"), tcp),                      # 10 TCP, options missing
    ]
    hex_frame = forms[-1]
    for i, f in reversed(list(enumerate(forms[:-1]))):
        hex_frame = F.when(form == i, f).otherwise(hex_frame)
    return packets.select(
        F.col("packet_id").alias("frame_id"),
        (F.col("packet_id") % 4).cast("int").alias("rx_queue"),
        F.unhex(hex_frame).alias("frame"),
    )
