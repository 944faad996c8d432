from __future__ import annotations

import csv
import json
from pathlib import Path
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import packet, rows, syn
from wiresift.functions.net import payload_contains, port_above, syn_only
from wiresift.operators import alerts as al
from wiresift.operators import triage
from wiresift.plans.capture import captured_by_polls, poll_counts
from wiresift.plans.detection import all_alerts, store_suspects
from wiresift.rules import DEFAULT_SEQUENCE, SequenceRule, SignatureRule, catalogue
from wiresift.schema import ALERT, CAPTURED_ALERT
from wiresift.scratch import scratch_dir
from wiresift.sources.tables import read_alerts_csv, write_csv, write_json

ATTACK = b"GET /../../etc/passwd HTTP/1.1"

# The published capture's ten alerts, as (severity, detector, rule) counts.
CAPTURED = ([("Critical", "Anomaly", "syn-flood-anomaly")] * 4
            + [("High", "Signature", "path-traversal-passwd")] * 3
            + [("Medium", "Signature", "path-traversal-generic")] * 3)


@pytest.fixture
def table(spark):
    def make(entries):
        """(timestamp_ms, detector, rule, severity) entries, packet ids in order."""
        data = [(ms, rule, sev, "10.0.0.1", "192.168.1.1", "d", det, i, 1, 0, 0)
                for i, (ms, det, rule, sev) in enumerate(entries)]
        return spark.createDataFrame(data, ALERT).repartition(4)

    return make


def test_all_detectors_and_arrival_order(packets):
    """One packet can raise alerts of every kind; they arrive in a fixed order."""
    trace = [syn(i, 10 * i, dport=1000 + i) for i in range(49)]
    trace.append(syn(49, 490, dport=2000, payload=ATTACK))
    df = all_alerts(packets(trace))
    numbered = al.number_alerts(df)
    last = [r for r in numbered.orderBy(*al.ARRIVAL).collect() if r["packet_id"] == 49]
    assert [r["rule_name"] for r in last] == [
        "path-traversal-generic", "path-traversal-passwd", "syn-flood-anomaly",
        "probe-then-exploit-attempt"]
    assert rows(numbered, "detector", "id") == [
        ("Anomaly", 1), ("Anomaly", 2), ("Cep", 1), ("Signature", 1), ("Signature", 2)]
    assert rows(numbered.where("rule_name = 'port-scan-anomaly'"), "packet_id", "id") == [(24, 1)]


def test_own_rules(packets):
    trace = [packet(1, 0, payload=b"hello"), packet(2, 5, dport=9000)]
    got = all_alerts(
        packets(trace),
        signatures=[SignatureRule("greeting", b"hello", "Low")],
        sequences=[SequenceRule("low-then-high", "Low", [~port_above(1000), port_above(1000)], 10)])
    assert rows(got, "rule_name", "packet_id") == [("greeting", 1), ("low-then-high", 2)]


def test_stored_suspects_change_nothing(spark, packets):
    """Probes come in a flood, mostly in spans without any exploit, and from a busy source."""
    rng = random.Random(11)
    trace = []
    for i in range(6000):
        src = 7 if rng.random() < 0.4 else rng.randrange(50)
        ms = rng.randrange(400_000)
        kind = rng.random()
        if kind < 0.06:
            trace.append(packet(i, ms, src, payload=rng.choice([ATTACK, b"passwd", b"cmd.exe", b"UNION SELECT"])))
        elif kind < 0.08:
            trace.append(syn(i, ms, src, payload=b"passwd"))
        else:
            trace.append(syn(i, ms, src, dport=rng.randrange(100)))
    events = packets(trace)
    rules = dict(sequences=(DEFAULT_SEQUENCE, SequenceRule(
        "three", "Low", [syn_only, syn_only, lambda: payload_contains(b"cmd.exe")], 4000)))
    plain = all_alerts(events, syn_threshold=8, port_threshold=6, **rules)
    stored = store_suspects(events, scratch_dir(spark, "test-suspects"), **rules)
    staged = all_alerts(events, syn_threshold=8, port_threshold=6, suspects=stored, **rules)
    columns = ALERT.names
    assert rows(staged, *columns) == rows(plain, *columns)
    assert stored.count() < 600
    assert {r[0] for r in rows(plain, "detector")} == {"Signature", "Anomaly", "Cep"}


@pytest.mark.parametrize("slice_ms", [1, 60_000, 10**9])
def test_numbering(table, slice_ms):
    df = table([(1000 * (i % 90), "AB"[i % 2], "r", "Low") for i in range(300)])
    got = al.number_alerts(df, slice_ms).orderBy(*al.ARRIVAL).collect()
    for d in "AB":
        assert [r["id"] for r in got if r["detector"] == d] == list(range(1, 151))


def test_latest_and_retention(table):
    df = table([(i, "Cep", "r", "Low") for i in range(6000)])
    assert [r["timestamp_ms"] for r in al.latest_alerts(df, 3).collect()] == [5999, 5998, 5997]
    assert al.latest_alerts(df).count() == 200
    assert al.latest_alerts(df, 9999).count() == 6000
    assert al.latest_alerts(df, 5500).count() == 5500
    assert al.retain(df).agg(F.min("timestamp_ms")).first()[0] == 1000


def test_dedup_and_unseen(table):
    df = table([(i, "Cep", "r", "Low") for i in range(20)])
    assert al.dedup_alerts(df.union(df)).count() == 20
    assert rows(al.unseen_alerts(df, df.where("timestamp_ms < 15")), "timestamp_ms") == [
        (i,) for i in range(15, 20)]


def test_triage(table):
    sev = ["Critical", "High", "Medium", "Low"]
    df = table([(i, ["Signature", "Cep"][i % 2], "r", sev[i % 4]) for i in range(2400)])
    assert triage.triage_filter(df).count() == 2400
    assert triage.triage_filter(df, "High").count() == 600
    assert triage.triage_filter(df, "High", "Signature").count() == 0
    page = triage.triage_page(df, detector="Cep").collect()
    assert len(page) == 500 and page[0]["timestamp_ms"] == 2399
    assert [r["timestamp_ms"] for r in page] == sorted((r["timestamp_ms"] for r in page), reverse=True)


def test_breakdowns_of_the_published_capture(table):
    df = table([(i, d, rule, s) for i, (s, d, rule) in enumerate(CAPTURED)])
    assert [tuple(r) for r in triage.severity_distribution(df).collect()] == [
        ("Critical", 1, 4), ("High", 2, 3), ("Medium", 3, 3), ("Low", 4, 0)]
    assert [tuple(r) for r in triage.detector_distribution(df).collect()] == [("Signature", 6), ("Anomaly", 4)]
    assert [tuple(r) for r in triage.rule_breakdown(df).collect()] == [
        ("Anomaly", "syn-flood-anomaly", 4), ("Signature", "path-traversal-generic", 3),
        ("Signature", "path-traversal-passwd", 3)]


def test_timeline(table):
    df = table([(0, "Cep", "r", "Low"), (1, "Cep", "r", "High"), (600_001, "Cep", "r", "Critical")])
    got = triage.alert_timeline(df, 600_001)
    assert rows(got, "timestamp_ms", "position", "lane") == [(1, 0.0, 40), (600_001, 1.0, 14)]


def test_catalogue(spark, table):
    assert catalogue(spark).count() == 5
    assert catalogue(spark, complete=True).count() == 8
    df = table([(1, "Signature", "path-traversal-passwd", "High")] * 2)
    got = dict(rows(triage.rule_activity(catalogue(spark), df), "name", "n_alerts"))
    assert got["path-traversal-passwd"] == 2 and got["syn-flood-anomaly"] == 0


def test_csv_roundtrip_and_empty_sink(spark, table):
    numbered = al.number_alerts(table([(1704067200123 + i, "Cep", "r, \"x\"", "Low") for i in range(5)]))
    path = scratch_dir(spark, "test-csv")
    captured = numbered.select(*CAPTURED_ALERT.names)
    write_csv(captured, path)
    back = read_alerts_csv(spark, path)
    assert rows(back, *CAPTURED_ALERT.names) == rows(captured, *CAPTURED_ALERT.names)
    assert back.agg(F.min(F.unix_millis("ts"))).first()[0] == 1704067200123
    empty = scratch_dir(spark, "test-csv-empty")
    assert read_alerts_csv(spark, empty).count() == 0  # nothing written yet
    write_csv(captured, empty)
    write_csv(captured.limit(0), empty)
    assert read_alerts_csv(spark, empty).count() == 0  # and nothing left of the older table
    assert read_alerts_csv(spark, empty).columns == back.columns


def test_csv_of_other_writers(spark, tmp_path):
    """The dialect that spreadsheets and most languages' csv modules write."""
    details = ['plain', 'a "quoted", word', 'two\nlines', '', 'back\\slash', ',,']
    lines = [(i, 1704067200000 + i, "r", "Low", "10.0.0.1", "10.0.0.2", d, "Cep") for i, d in enumerate(details)]
    path = tmp_path / "alerts.csv"
    with path.open("w", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(CAPTURED_ALERT.names)
        writer.writerows(lines)
    got = {r["id"]: r for r in read_alerts_csv(spark, str(path)).collect()}
    assert [got[i]["detail"] or "" for i in range(len(details))] == details
    assert all(r["detector"] == "Cep" for r in got.values())
    ours = str(tmp_path / "ours")
    write_csv(spark.createDataFrame(lines, CAPTURED_ALERT).coalesce(1), ours)
    (part,) = Path(ours).glob("*.csv")
    with part.open(newline="") as rows_:
        assert [tuple(r) for r in csv.reader(rows_)][1:] == [tuple(map(str, line)) for line in lines]
    path.write_text(path.read_text() + "not a number,1,r,Low,a,b,c,Cep\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_alerts_csv(spark, str(path)).collect()


def test_json(spark, table):
    numbered = al.number_alerts(table([(7, "Cep", "quote\"d", "Low")]))
    got = json.loads(al.alert_json(numbered).first()["alert_json"])
    assert list(got) == CAPTURED_ALERT.names and got["rule_name"] == "quote\"d" and got["id"] == 1
    path = scratch_dir(spark, "test-json")
    write_json(numbered, path)
    assert spark.read.json(path).count() == 1


def test_capture_takes_every_alert_once(table):
    numbered = al.number_alerts(table([(100 * i, "AB"[i % 2], "r", "Low") for i in range(200)]))
    got = captured_by_polls(numbered, 3000)
    assert rows(got, "packet_id", "poll_ms") == [(i, (100 * i // 3000 + 1) * 3000) for i in range(200)]


def test_pages_that_are_asked_for_equal_polling(table):
    entries = [(100 * i + 1000 * (i // 40), "AB"[i % 2], "r", "Low") for i in range(200)]
    numbered = al.number_alerts(table(entries))
    every = sorted(map(tuple, numbered.select(*al.ARRIVAL, "id", "detector").collect()))
    interval, limit, seen, want = 3000, 12, set(), []
    for poll in range(interval, 30_001, interval):
        newest = [a for a in every if a[0] < poll][-limit:]
        for a in newest:
            if a not in seen:
                seen.add(a)
                want.append((poll, a[1]))
    got = captured_by_polls(numbered, interval, limit, slice_ms=500)
    assert rows(got, "poll_ms", "packet_id") == sorted(want)
    assert len(want) < len(entries)
    assert sum(n for _, n in rows(poll_counts(got), "poll_ms", "n_captured")) == len(want)
