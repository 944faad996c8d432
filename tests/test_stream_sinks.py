from __future__ import annotations

import json

from pyspark.sql import functions as F

from tests.conftest import exploit, packet, rows, syn
from tests.test_streaming import ALERT_COLUMNS, landed, traffic  # noqa: F401
from wiresift.operators.rates import syn_counts, syn_floods
from wiresift.operators.signature import signature_alerts
from wiresift.operators.sketches import cms_lookup, cms_table
from wiresift.rules import DEFAULT_SIGNATURES
from wiresift.schema import ALERT, EVENT
from wiresift.scratch import scratch_dir
from wiresift.sources.tables import stream_events
from wiresift.streaming import crossing, run, sinks, sketches


def test_crossings_equal_batch(packets, landed):  # noqa: F811
    trace = traffic(3)
    got = run.drain(landed(trace), lambda p: crossing.stream_floods_at_crossing(p, threshold=12), "test-crossing")
    want = rows(syn_floods(packets(trace), threshold=12), *ALERT_COLUMNS)
    assert rows(got, *ALERT_COLUMNS) == want and len(want) > 5


def test_alert_comes_before_the_window_closes(spark, packets):
    """A window of ten minutes; the crossing at 11 ms is known once the watermark, ten seconds back, has passed it."""
    path, root = scratch_dir(spark, "test-landed"), scratch_dir(spark, "test-crossing")
    early = [syn(i, i + 1) for i in range(12)]
    packets(early[::2]).coalesce(1).write.mode("append").parquet(path)
    out = crossing.stream_floods_at_crossing(stream_events(spark, path, 1), threshold=10, width_ms=600_000)

    def alerted():
        run.run_available(out, f"{root}/out", f"{root}/checkpoint")
        return rows(spark.read.schema(ALERT).parquet(f"{root}/out"), "packet_id", "timestamp_ms")

    assert alerted() == []
    packets(early[1::2]).coalesce(1).write.mode("append").parquet(path)
    assert alerted() == []  # an earlier packet might still come
    packets([packet(99, 20_000)]).coalesce(1).write.mode("append").parquet(path)
    packets([syn(100, 30_000)]).coalesce(1).write.mode("append").parquet(path)
    assert alerted() == [(9, 10)]
    packets([syn(101 + i, 50_000 + i) for i in range(30)]).coalesce(1).write.mode("append").parquet(path)
    packets([syn(200, 700_000)]).coalesce(1).write.mode("append").parquet(path)
    assert alerted() == [(9, 10)]  # once a window


def test_sketch_with_shared_cells_equals_batch(packets, landed):  # noqa: F811
    trace = traffic(5, 600)
    counts = syn_counts(packets(trace))
    size = {"width": 3, "depth": 2}
    want = cms_lookup(counts, "src_ip", cms_table(counts, "src_ip", "n_syn", ["window_start_ms"], **size), ["window_start_ms"], **size)
    got = run.drain(landed(trace, files=3), lambda p: sketches.stream_cms_estimates(p, **size), "test-cms")
    columns = ("src_ip", "window_start_ms", "n_estimate")
    assert rows(got, *columns) == rows(want, *columns)
    exact = {(r["src_ip"], r["window_start_ms"]): r["n_syn"] for r in counts.collect()}
    assert any(n > exact[s, w] for s, w, n in rows(got, *columns))


def test_ids_go_on_over_batches_and_replays(spark, packets, landed):  # noqa: F811
    trace, root = traffic(6, 400), scratch_dir(spark, "test-ids")
    writer = sinks.write_numbered(root)
    sinks.each_batch(signature_alerts(landed(trace)), writer, f"{root}/checkpoint")
    found = rows(sinks.read_numbered(spark, root, ALERT), "id", "packet_id", "match_pos", "rule_name", "batch_id")
    assert [r[0] for r in found] == list(range(1, len(found) + 1)) and len({r[4] for r in found}) == 4
    assert sorted(r[1:4] for r in found) == rows(signature_alerts(packets(trace)), "packet_id", "match_pos", "rule_name")
    # the second batch once more, as after a failure
    again = spark.read.schema(ALERT).parquet(f"{root}/alerts/batch_id=1").cache()
    again.count()
    writer(again, 1)
    assert rows(sinks.read_numbered(spark, root, ALERT), "id", "packet_id", "match_pos", "rule_name", "batch_id") == found


def test_a_batch_without_alerts_keeps_the_marks(spark, packets):
    root = scratch_dir(spark, "test-ids")
    writer = sinks.write_numbered(root)
    for batch_id, trace in enumerate([[exploit(1, 1)], [syn(2, 2)], [exploit(3, 3)]]):
        writer(signature_alerts(packets(trace)), batch_id)
    assert [r[0] for r in rows(sinks.read_numbered(spark, root, ALERT), "id")] == list(range(1, 2 * len(rows(signature_alerts(packets([exploit(1, 1)])), "packet_id")) + 1))


def test_a_rule_added_between_batches_fires_from_then_on(spark, packets):
    path, root = scratch_dir(spark, "test-landed"), scratch_dir(spark, "test-rules")
    schema = "rule_name string, severity string, pattern binary"
    spark.createDataFrame([("beacon", "Low", bytearray(b"beacon"))], schema).write.parquet(f"{root}/table")
    writer = sinks.write_rule_alerts(f"{root}/table", root)

    def fired(packet_id):
        body = [packet(packet_id, packet_id, payload=b"a beacon and a trojan")]
        packets(body).coalesce(1).write.mode("append").parquet(path)
        sinks.each_batch(stream_events(spark, path, 1), writer, f"{root}/checkpoint")
        return rows(spark.read.schema(ALERT).parquet(f"{root}/alerts"), "packet_id", "rule_name")

    assert fired(1) == [(1, "beacon")]
    spark.createDataFrame([("trojan", "High", bytearray(b"trojan"))], schema).write.mode("append").parquet(f"{root}/table")
    assert fired(2) == [(1, "beacon"), (2, "beacon"), (2, "trojan")]
    writer(packets([packet(1, 1, payload=b"a beacon and a trojan")]), 0)  # run again, it has the rules of its time
    assert rows(spark.read.schema(ALERT).parquet(f"{root}/alerts"), "packet_id", "rule_name") == [(1, "beacon"), (2, "beacon"), (2, "trojan")]


def test_rules_as_a_table_equal_rules_in_the_plan(spark, packets):
    from wiresift.operators.rule_table import rule_table_alerts

    events = packets(traffic(8, 300))
    table = spark.createDataFrame([(r.name, r.severity, bytearray(r.pattern)) for r in DEFAULT_SIGNATURES], "rule_name string, severity string, pattern binary")
    assert rows(rule_table_alerts(events, table), *ALERT.names) == rows(signature_alerts(events), *ALERT.names)


def test_messages_and_dead_letters(spark, packets):
    good = [r[0] for r in packets([packet(i, i, payload=b"\x00\xff%d" % i) for i in range(20)]).select(F.to_json(F.struct(*EVENT.names))).collect()]
    missing = json.loads(good[0])
    del missing["src_ip"]
    odd = json.loads(good[1])
    odd["flags"] = "many"
    bad = ["", "{", "[1]", "null", good[2][:30], json.dumps(odd), json.dumps(missing), json.dumps({**missing, "src_ip": None}), "plain text"]
    more = json.dumps({**json.loads(good[3]), "extra": 1})
    root = scratch_dir(spark, "test-decode")
    spark.createDataFrame([(m,) for m in [*good, *bad, more]], "value string").repartition(3).write.text(f"{root}/lines")
    sinks.run_decoding(spark.readStream.text(f"{root}/lines"), f"{root}/out", f"{root}/checkpoint")
    found = rows(sinks.read_decoded(spark, f"{root}/out"), "packet_id", "payload_sample")
    assert found == sorted([(i, bytearray(b"\x00\xff%d" % i)) for i in range(20)] + [(3, bytearray(b"\x00\xff3"))])
    dead = rows(sinks.read_dead_letters(spark, f"{root}/out"), "reason", "message")
    assert sorted(m for _, m in dead) == sorted(bad)
    assert sum(r == "missing src_ip" for r, _ in dead) == 2 and sum(r == "unreadable" for r, _ in dead) >= 6
    table = sinks.decode_messages(spark.createDataFrame([(None,)], "value string"))
    assert [r["reason"] for r in table.collect()] == ["unreadable"]
