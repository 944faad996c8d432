"""The library's operators as named queries over the given tables.

Each takes a session and a folder of parquet tables. Packets, alerts, counters
and frames are derived from the whole ``events`` table (see trace.py);
pages and conversations are used as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wiresift.functions import clock, net
from wiresift.functions.severity import severity_rank
from wiresift.operators import alerts as al
from wiresift.operators import frames, rates, reset, rule_set, rule_table, sequence, signature, sketches, telemetry, triage
from wiresift.plans.capture import captured_by_polls
from wiresift.plans.detection import all_alerts, store_suspects
from wiresift.plans.retention import append_alerts, read_retained, trim
from wiresift.rules import DEFAULT_SEQUENCE, DEFAULT_SIGNATURES, SequenceRule, SignatureRule, catalogue
from wiresift.schema import ALERT, CAPTURED_ALERT, STATS
from wiresift.scratch import scratch_dir
from wiresift.sources import tables
from wiresift.streaming import crossing, processors, run, sinks, sketches as stream_sketches, windows
from workload import trace

DAY_MS = 86400000
SEEN_BEFORE_MS = 1705363200000  # 2024-01-16: what an earlier capture already holds
PAGE_RULES = (
    SignatureRule("script-tag", b"<script>", "Low"),
    SignatureRule("root-link", b'href="/', "Low"),
)


# --- inputs ------------------------------------------------------------------

def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.packet_trace(trace.read_table(spark, sf_dir, "events"))


def packet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.packet_trace(trace.stream_table(spark, sf_dir, "events"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_alerts(packets(spark, sf_dir))


def all_alerts_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = packets(spark, sf_dir)
    return all_alerts(events, suspects=store_suspects(events, scratch_dir(spark, "suspects")))


def stored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert table written out, for queries that read it more than once."""
    path = scratch_dir(spark, "alerts")
    alerts(spark, sf_dir).write.parquet(path)
    return spark.read.schema(ALERT).parquet(path)


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.number_alerts(stored_alerts(spark, sf_dir))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polled counters as a written table, as a capture leaves them."""
    path = scratch_dir(spark, "stats")
    trace.stats_series(trace.read_table(spark, sf_dir, "events")).write.parquet(path)
    return spark.read.schema(STATS).parquet(path)


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.raw_frames(packets(spark, sf_dir))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- sources and sinks -------------------------------------------------------

def event_scan(spark, sf_dir):
    return packets(spark, sf_dir).withColumn("payload_sample", F.decode("payload_sample", "UTF-8"))


def alerts_csv_roundtrip(spark, sf_dir):
    path = scratch_dir(spark, "alerts-csv")
    captured = numbered(spark, sf_dir).select(*CAPTURED_ALERT.names)
    tables.write_csv(captured, path)
    return tables.read_alerts_csv(spark, path).select(
        *CAPTURED_ALERT.names, F.unix_millis("ts").alias("ts_ms"))


def stats_scan(spark, sf_dir):
    path = scratch_dir(spark, "stats-csv")
    tables.write_csv(stats(spark, sf_dir), path)
    return tables.read_stats_csv(spark, path).select(
        "run_id", "poll_time", "events_processed", "events_dropped", "alerts_fired",
        "queue_backpressure_events", F.unix_millis("ts").alias("ts_ms"))


def incremental_capture(spark, sf_dir):
    return captured_by_polls(numbered(spark, sf_dir), DAY_MS).select(
        "poll_ms", "id", "detector", "rule_name", "timestamp_ms", "src_ip")


def alerts_json(spark, sf_dir):
    return al.alert_json(numbered(spark, sf_dir))


def rule_catalogue(spark, sf_dir):
    return triage.rule_activity(catalogue(spark), alerts(spark, sf_dir))


def rule_catalogue_complete(spark, sf_dir):
    return triage.rule_activity(catalogue(spark, complete=True), alerts(spark, sf_dir)).select(
        "name", "detector", "n_alerts")


# --- scalar functions and predicates -----------------------------------------

def ip_to_string(spark, sf_dir):
    return packets(spark, sf_dir).select(
        "packet_id", net.ip_to_string("src_ip").alias("src"), net.ip_to_string("dst_ip").alias("dst"))


def is_syn(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_id", net.syn_only().alias("is_syn"))


def tcp_flags(spark, sf_dir):
    bits = {"syn": net.SYN, "ack": net.ACK, "fin": net.FIN, "rst": net.RST}
    return packets(spark, sf_dir).select(
        "packet_id", *[net.has_flag(b).alias(n) for n, b in bits.items()])


def flow_key(spark, sf_dir):
    flows = net.with_flow_key(packets(spark, sf_dir), shard_key="shard_key")
    return flows.select("packet_id", "flow_key", "shard_key")


def shard_load(spark, sf_dir):
    per_source = packets(spark, sf_dir).groupBy("src_ip").agg(F.count("*").alias("n"))
    return net.with_shard(per_source, 4).groupBy("shard").agg(F.sum("n").alias("n_events"))


def epoch_to_ts(spark, sf_dir):
    text = F.date_format(clock.ms_to_ts("timestamp_ms"), "yyyy-MM-dd HH:mm:ss.SSS")
    seconds = clock.seconds_to_ts(F.col("timestamp_ms") / 1000.0)
    return packets(spark, sf_dir).select(
        "packet_id", text.alias("ts_text"), F.unix_millis(seconds).alias("from_seconds_ms"))


def payload_marker(spark, sf_dir):
    return packets(spark, sf_dir).select(
        "packet_id", net.payload_contains(b"passwd").alias("has_marker"))


def severity_ranks(spark, sf_dir):
    return alerts(spark, sf_dir).select(
        "detector", "rule_name", "packet_id", "match_pos", "severity",
        severity_rank().alias("severity_rank"))


def port_above(spark, sf_dir):
    return packets(spark, sf_dir).where(net.port_above(1023)).select("packet_id", "dst_port")


def triage_filter(spark, sf_dir):
    return triage.triage_filter(alerts(spark, sf_dir), severity="High", detector="Signature")


def frame_admission(spark, sf_dir):
    return frames.frame_admission(raw_frames(spark, sf_dir))


def frame_counters(spark, sf_dir):
    return frames.frame_counters(raw_frames(spark, sf_dir))


# --- detectors ---------------------------------------------------------------

def signature_alerts(spark, sf_dir):
    return signature.signature_alerts(packets(spark, sf_dir))


def signature_match_count(spark, sf_dir):
    return signature.signature_counts(packets(spark, sf_dir), "packet_id").withColumn(
        "n_matches", F.col("n_matches").cast("long"))


def signature_pages(spark, sf_dir):
    pages = trace.read_table(spark, sf_dir, "pages").select(
        "page_id", F.encode("html", "UTF-8").alias("body"))
    return signature.signature_matches(pages, PAGE_RULES, "body").select(
        "page_id", "rule_name", "match_pos", "match_end")


def _phrase_rules(spark, sf_dir):
    """Rules from the benchmark's texts: each of their longer words, and each two words that follow each other."""
    words = trace.read_table(spark, sf_dir, "benchmark").select(F.split("text", " ").alias("w"))
    long_words = words.select(F.explode("w").alias("p")).where(F.length("p") >= 6).select("p", F.lit("Low").alias("severity"))
    pairs = words.select(F.explode(F.zip_with("w", F.slice("w", 2, F.size("w")), lambda a, b: F.concat(a, F.lit(" "), b))).alias("p"))
    rules = long_words.union(pairs.where(F.col("p").isNotNull()).select("p", F.lit("High").alias("severity")))
    return rules.distinct().select(F.col("p").alias("rule_name"), "severity", F.encode("p", "UTF-8").alias("pattern"))


def signature_rule_table(spark, sf_dir):
    pages = trace.read_table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("body"))
    return rule_table.rule_table_matches(pages, _phrase_rules(spark, sf_dir), "page_id", "body").select(
        "page_id", "rule_name", "severity", "match_pos", "match_end")


def syn_counts(spark, sf_dir):
    return rates.syn_counts(packets(spark, sf_dir))


def syn_counts_sliding(spark, sf_dir):
    return rates.syn_counts(packets(spark, sf_dir), slide_ms=1000)


def _written_packets(spark, sf_dir):
    path = scratch_dir(spark, "packets")
    packets(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def syn_counts_reset(spark, sf_dir):
    return reset.syn_counts_reset(_written_packets(spark, sf_dir))


def syn_flood_reset_alerts(spark, sf_dir):
    return reset.syn_floods_reset(_written_packets(spark, sf_dir))


def syn_flood_alerts(spark, sf_dir):
    return rates.syn_floods(packets(spark, sf_dir))


def port_distinct(spark, sf_dir):
    return rates.port_counts(packets(spark, sf_dir))


def port_scan_alerts(spark, sf_dir):
    return rates.port_scans(packets(spark, sf_dir))


def sequence_alerts(spark, sf_dir):
    return sequence.sequence_alerts(packets(spark, sf_dir))


def sequence_nstep(spark, sf_dir):
    return rule_set.rule_set_alerts(packets(spark, sf_dir), [DEFAULT_SEQUENCE])


SEQUENCE_RULES = (
    DEFAULT_SEQUENCE,
    SequenceRule("exploit-repeated", "High", (lambda: net.payload_contains(b"passwd"),) * 2, 8000),
    SequenceRule("probe-then-high-port", "Medium", (net.syn_only, lambda: net.port_above(8000)), 60000),
)


def sequence_rule_set(spark, sf_dir):
    return rule_set.rule_set_alerts(packets(spark, sf_dir), SEQUENCE_RULES)


def sequence_pairs_all(spark, sf_dir):
    return sequence.pair_counts(
        packets(spark, sf_dir), "src_ip", "timestamp_ms", "packet_id",
        *DEFAULT_SEQUENCE.conditions(), DEFAULT_SEQUENCE.within_ms)


def _role(name: str):
    return F.col("role") == name


def sequence_conversations(spark, sf_dir):
    turns = trace.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return sequence.two_step_matches(
        turns, "conv_id", "turn", "turn", _role("user"), _role("assistant"), within=2)


def sequence_three_step(spark, sf_dir):
    turns = trace.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    steps = [_role("user"), _role("assistant"), _role("user")]
    return rule_set.rule_set_matches(turns, "conv_id", "turn", "turn", [(steps, 4)]).drop("rule")


# --- sketches ----------------------------------------------------------------

def cms_estimate(spark, sf_dir):
    return sketches.syn_estimates(packets(spark, sf_dir))


def cms_flood_sources(spark, sf_dir):
    return sketches.syn_estimates(packets(spark, sf_dir)).where(F.col("n_estimate") >= 50).select(
        "src_ip", "window_start_ms", "n_estimate")


def cms_flood_alerts(spark, sf_dir):
    return sketches.cms_syn_floods(packets(spark, sf_dir))


def cms_merge(spark, sf_dir):
    shards = sketches.sharded_syn_sketches(packets(spark, sf_dir), shards=4)
    return sketches.cms_merge(shards, ["window_start_ms"])


def cms_builtin(spark, sf_dir):
    day = clock.window_start(DAY_MS).alias("day_ms")
    return sketches.builtin_syn_sketch(packets(spark, sf_dir), [day]).select(
        "day_ms", F.length("sketch").alias("n_bytes"), sketches.sketch_size().alias("n_syn"))


def hll_estimate(spark, sf_dir):
    rows = packets(spark, sf_dir).select(
        "src_ip", clock.window_start(5000).alias("window_start_ms"), "dst_port")
    keys = ["src_ip", "window_start_ms"]
    registers = sketches.hll_registers(rows, keys, "dst_port")
    return rounded(sketches.hll_estimate(registers, keys), "n_estimate")


def hll_estimate_dense(spark, sf_dir):
    registers = sketches.hll_registers(packets(spark, sf_dir), ["dst_port"], "src_port")
    literal = sketches.hll_estimate(registers, ["dst_port"])
    textbook = sketches.hll_estimate(registers, ["dst_port"], textbook=True)
    return rounded(
        literal.join(textbook.withColumnRenamed("n_estimate", "n_textbook"), "dst_port"),
        "n_estimate", "n_textbook")


def hll_merge(spark, sf_dir):
    rows = packets(spark, sf_dir).select(
        "src_ip", clock.window_start(5000).alias("window_start_ms"), "dst_port")
    parts = sketches.hll_registers(rows, ["src_ip", "window_start_ms"], "dst_port")
    merged = sketches.hll_merge(parts, ["src_ip"])
    return rounded(sketches.hll_estimate(merged, ["src_ip"]), "n_estimate")


def hll_scan_alerts(spark, sf_dir):
    return sketches.hll_port_scans(packets(spark, sf_dir))


def port_distinct_hll(spark, sf_dir):
    return sketches.builtin_port_sketches(packets(spark, sf_dir)).select(
        "src_ip", "window_start_ms", F.hll_sketch_estimate("sketch").alias("n_estimate"))


def hll_builtin_merge(spark, sf_dir):
    parts = sketches.builtin_port_sketches(packets(spark, sf_dir))
    return parts.groupBy("src_ip").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_estimate"))


# --- alert table -------------------------------------------------------------

def alert_ids(spark, sf_dir):
    return numbered(spark, sf_dir).select(
        "id", "detector", "rule_name", "timestamp_ms", "packet_id", "match_pos")


def latest_alerts(spark, sf_dir):
    return al.latest_alerts(alerts(spark, sf_dir))


def alert_retention(spark, sf_dir):
    return al.retain(alerts(spark, sf_dir))


def alert_retention_incremental(spark, sf_dir):
    """The newest thousand, kept while the alerts come in two halves."""
    every, root = stored_alerts(spark, sf_dir), scratch_dir(spark, "retained")
    for half in (every.where(F.col("timestamp_ms") < SEEN_BEFORE_MS), every.where(F.col("timestamp_ms") >= SEEN_BEFORE_MS)):
        append_alerts(half, root)
        trim(spark, root, 1000)
    return read_retained(spark, root)


def triage_page(spark, sf_dir):
    return triage.triage_page(alerts(spark, sf_dir), severity="Critical")


def dedup_alerts(spark, sf_dir):
    polled = alerts(spark, sf_dir).withColumn("poll", F.explode(F.array(F.lit(1), F.lit(2))))
    return al.dedup_alerts(polled.drop("poll"))


def unseen_alerts(spark, sf_dir):
    every = stored_alerts(spark, sf_dir)
    return al.unseen_alerts(every, every.where(F.col("timestamp_ms") < SEEN_BEFORE_MS))


def alert_timeline(spark, sf_dir):
    every = stored_alerts(spark, sf_dir)
    now = every.agg(F.max("timestamp_ms")).scalar()
    return rounded(triage.alert_timeline(every, now), "position")


def severity_distribution(spark, sf_dir):
    return triage.severity_distribution(alerts(spark, sf_dir))


def detector_distribution(spark, sf_dir):
    return triage.detector_distribution(alerts(spark, sf_dir))


def rule_breakdown(spark, sf_dir):
    return triage.rule_breakdown(alerts(spark, sf_dir))


# --- telemetry ---------------------------------------------------------------

def events_per_sec(spark, sf_dir):
    return rounded(telemetry.events_per_sec(stats(spark, sf_dir)), "events_per_sec")


def dashboard_rate(spark, sf_dir):
    return telemetry.dashboard_rate(stats(spark, sf_dir))


def throughput_summary(spark, sf_dir):
    return rounded(telemetry.throughput_summary(stats(spark, sf_dir)),
                   "mean_eps", "p50_eps", "p99_eps", "max_eps")


def throughput_describe(spark, sf_dir):
    return rounded(telemetry.throughput_describe(stats(spark, sf_dir)),
                   "mean", "std", "min", "p25", "p50", "p75", "max")


def stall_check(spark, sf_dir):
    return telemetry.stall_check(stats(spark, sf_dir))


def drop_growth(spark, sf_dir):
    return rounded(telemetry.drop_growth(stats(spark, sf_dir)), "drop_ratio")


def engine_stats(spark, sf_dir):
    return telemetry.engine_stats(packets(spark, sf_dir), alerts(spark, sf_dir))


# --- streams -----------------------------------------------------------------

def _drained(name, build):
    def query(spark, sf_dir):
        return run.drain(packet_stream(spark, sf_dir), build, name)

    return query


def stream_stats(spark, sf_dir):
    root = scratch_dir(spark, "stream-stats")
    run.run_with_counters(packet_stream(spark, sf_dir), signature.signature_alerts, root, f"{root}/checkpoint")
    return run.read_counters(spark, root).agg(
        *[F.sum(c).alias(c) for c in ("events_processed", "events_dropped", "alerts_fired")])


def _polled_twice(packet_rows: DataFrame) -> DataFrame:
    polled = signature.signature_alerts(packet_rows).withColumn(
        "poll", F.explode(F.array(F.lit(1), F.lit(2))))
    return run.capture_unseen(polled.drop("poll"))


def stream_alert_ids(spark, sf_dir):
    root = scratch_dir(spark, "stream-alert-ids")
    found = signature.signature_alerts(packet_stream(spark, sf_dir))
    sinks.each_batch(found, sinks.write_numbered(root), f"{root}/checkpoint")
    return sinks.read_numbered(spark, root, ALERT).select(
        "id", "detector", "rule_name", "timestamp_ms", "packet_id", "match_pos")


def stream_signature_rules(spark, sf_dir):
    root = scratch_dir(spark, "stream-signature-rules")
    rules = [(r.name, r.severity, bytearray(r.pattern)) for r in DEFAULT_SIGNATURES]
    spark.createDataFrame(rules, "rule_name string, severity string, pattern binary").write.parquet(f"{root}/table")
    sinks.each_batch(packet_stream(spark, sf_dir), sinks.write_rule_alerts(f"{root}/table", root), f"{root}/checkpoint")
    return spark.read.schema(ALERT).parquet(f"{root}/alerts").select(*ALERT.names)


def _messages(packet_rows: DataFrame) -> DataFrame:
    """Packets as lines of JSON, some cut off, some with a text for a number, some without a field."""
    line, no = F.to_json(F.struct(*[F.col(c) for c in packet_rows.columns])), F.col("packet_id")
    return packet_rows.select(
        F.when(no % 97 == 0, F.left(line, F.lit(20)))
        .when(no % 101 == 0, F.regexp_replace(line, '"flags":[0-9]+', '"flags":"many"'))
        .when(no % 103 == 0, F.regexp_replace(line, '"timestamp_ms":[0-9]+,', ""))
        .otherwise(line).alias("value"))


def stream_decode(spark, sf_dir):
    root = scratch_dir(spark, "stream-decode")
    _messages(packets(spark, sf_dir)).write.text(f"{root}/lines")
    sinks.run_decoding(spark.readStream.text(f"{root}/lines"), f"{root}/out", f"{root}/checkpoint")
    good = sinks.read_decoded(spark, f"{root}/out").agg(
        F.lit("decoded").alias("reason"), F.count("*").alias("n"), F.sum("packet_id").alias("packet_ids"), F.sum(F.length("payload_sample")).alias("payload_bytes"))
    dead = sinks.read_dead_letters(spark, f"{root}/out").groupBy("reason").agg(F.count("*").alias("n"))
    return good.unionByName(dead, allowMissingColumns=True)


QUERIES = {
    "all_alerts": alerts,
    "all_alerts_staged": all_alerts_staged,
    "event_scan": event_scan,
    "alerts_csv_roundtrip": alerts_csv_roundtrip,
    "stats_scan": stats_scan,
    "incremental_capture": incremental_capture,
    "alerts_json": alerts_json,
    "rule_catalogue": rule_catalogue,
    "rule_catalogue_complete": rule_catalogue_complete,
    "ip_to_string": ip_to_string,
    "is_syn": is_syn,
    "tcp_flags": tcp_flags,
    "flow_key": flow_key,
    "shard_load": shard_load,
    "epoch_to_ts": epoch_to_ts,
    "payload_marker": payload_marker,
    "severity_rank": severity_ranks,
    "port_above": port_above,
    "triage_filter": triage_filter,
    "frame_admission": frame_admission,
    "frame_counters": frame_counters,
    "signature_alerts": signature_alerts,
    "signature_match_count": signature_match_count,
    "signature_pages": signature_pages,
    "signature_rule_table": signature_rule_table,
    "syn_counts": syn_counts,
    "syn_counts_sliding": syn_counts_sliding,
    "syn_counts_reset": syn_counts_reset,
    "syn_flood_reset_alerts": syn_flood_reset_alerts,
    "syn_flood_alerts": syn_flood_alerts,
    "port_distinct": port_distinct,
    "port_scan_alerts": port_scan_alerts,
    "sequence_alerts": sequence_alerts,
    "sequence_nstep": sequence_nstep,
    "sequence_rule_set": sequence_rule_set,
    "sequence_pairs_all": sequence_pairs_all,
    "sequence_conversations": sequence_conversations,
    "sequence_three_step": sequence_three_step,
    "cms_estimate": cms_estimate,
    "cms_flood_sources": cms_flood_sources,
    "cms_flood_alerts": cms_flood_alerts,
    "cms_merge": cms_merge,
    "cms_builtin": cms_builtin,
    "hll_estimate": hll_estimate,
    "hll_estimate_dense": hll_estimate_dense,
    "hll_merge": hll_merge,
    "hll_scan_alerts": hll_scan_alerts,
    "port_distinct_hll": port_distinct_hll,
    "hll_builtin_merge": hll_builtin_merge,
    "alert_ids": alert_ids,
    "latest_alerts": latest_alerts,
    "alert_retention": alert_retention,
    "alert_retention_incremental": alert_retention_incremental,
    "triage_page": triage_page,
    "dedup_alerts": dedup_alerts,
    "unseen_alerts": unseen_alerts,
    "alert_timeline": alert_timeline,
    "severity_distribution": severity_distribution,
    "detector_distribution": detector_distribution,
    "rule_breakdown": rule_breakdown,
    "events_per_sec": events_per_sec,
    "dashboard_rate": dashboard_rate,
    "throughput_summary": throughput_summary,
    "throughput_describe": throughput_describe,
    "stall_check": stall_check,
    "drop_growth": drop_growth,
    "engine_stats": engine_stats,
    "stream_syn_counts": _drained("stream-syn-counts", windows.stream_syn_counts),
    "stream_syn_flood": _drained("stream-syn-flood", windows.stream_syn_floods),
    "stream_flood_alerts": _drained("stream-flood-alerts", processors.stream_flood_alerts),
    "stream_port_scan": _drained("stream-port-scan", windows.stream_port_scans),
    "stream_signature": _drained("stream-signature", signature.signature_alerts),
    "stream_sequence": _drained("stream-sequence", processors.stream_sequence_alerts),
    "stream_capture": _drained("stream-capture", _polled_twice),
    "stream_scan_alerts": _drained("stream-scan-alerts", processors.stream_port_scan_alerts),
    "stream_all_alerts": _drained("stream-all-alerts", processors.stream_all_alerts),
    "stream_stats": stream_stats,
    "stream_flood_at_crossing": _drained("stream-flood-crossing", crossing.stream_floods_at_crossing),
    "stream_cms_flood_sources": _drained("stream-cms", stream_sketches.stream_cms_flood_sources),
    "stream_alert_ids": stream_alert_ids,
    "stream_signature_rules": stream_signature_rules,
    "stream_decode": stream_decode,
}
