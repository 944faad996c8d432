from __future__ import annotations

from tests.conftest import packet, rows, syn
from wiresift.operators.rates import port_counts, port_scans, syn_counts, syn_floods


def burst(n, start=0, src=1, first_id=0, step=10):
    return [syn(first_id + i, start + step * i, src) for i in range(n)]


def test_flood_threshold(packets):
    data = burst(49, src=1) + burst(50, src=2, first_id=100) + burst(80, src=3, first_id=200)
    got = rows(syn_floods(packets(data)), "src_ip", "packet_id", "timestamp_ms")
    assert got == [("0.0.0.2", 149, 490), ("0.0.0.3", 249, 490)]


def test_flood_alert_text_and_rule(packets):
    a = syn_floods(packets(burst(60))).first()
    assert a["detail"] == "source 0.0.0.1 sent an estimated 50+ SYNs within 5s window"
    assert (a["rule_name"], a["severity"], a["detector"], a["dst_ip"]) == (
        "syn-flood-anomaly", "Critical", "Anomaly", "0.0.0.99")


def test_noise_from_many_sources_changes_nothing(packets):
    noise = [syn(10_000 + i, 5 * i, src=1000 + i % 200) for i in range(400)]
    assert rows(syn_floods(packets(burst(80) + noise)), "src_ip") == [("0.0.0.1",)]


def test_burst_over_a_window_edge(packets):
    df = packets(burst(49, start=4510) + burst(49, start=5000, first_id=100))
    assert syn_floods(df).count() == 0
    assert syn_counts(df, slide_ms=1000).where("n_syn >= 50").count() >= 1


def test_answered_handshakes_are_no_flood(packets):
    assert syn_floods(packets([packet(i, i, flags=3) for i in range(100)])).count() == 0


def test_ties_are_broken_by_packet_id(packets):
    df = packets([syn(100 - i, 7) for i in range(60)])
    assert rows(syn_floods(df), "packet_id") == [(41 + 49,)]


def test_one_alert_per_window(packets):
    df = packets(burst(200) + burst(70, start=5000, first_id=1000))
    assert rows(syn_floods(df), "packet_id") == [(49,), (1049,)]


def ports(n, src=1, first_id=0, flags=3):
    return [packet(first_id + i, 10 * i, src, dport=1000 + 7 * i, flags=flags) for i in range(n)]


def test_scan_threshold(packets):
    same = [packet(500 + i, i, src=3, dport=80) for i in range(25)]
    df = packets(ports(24, 1) + ports(25, 2, 100) + same)
    a = port_scans(df).collect()
    assert [(x["src_ip"], x["packet_id"], x["severity"]) for x in a] == [("0.0.0.2", 124, "High")]
    assert a[0]["detail"] == (
        "source 0.0.0.2 touched an estimated 25 distinct destination ports within 5s window")


def test_scan_crossing_skips_repeated_ports(packets):
    repeated = [packet(1000 + i, 10 * i + 5, dport=1000 + 7 * i) for i in range(30)]
    assert rows(port_scans(packets(ports(30) + repeated)), "packet_id") == [(24,)]


def test_counts(packets):
    df = packets(ports(30) + burst(10, src=9, first_id=900) + burst(3, start=5000, src=9, first_id=990))
    assert rows(syn_counts(df), "src_ip", "window_start_ms", "n_syn") == [(9, 0, 10), (9, 5000, 3)]
    assert rows(port_counts(df), "src_ip", "window_start_ms", "n_ports") == [
        (1, 0, 30), (9, 0, 1), (9, 5000, 1)]


def test_hot_groups_are_cut_before_the_shuffle(packets):
    """A source may hold most rows of a window: each map task sends 50 of them at most."""
    plan = syn_floods(packets(burst(5)))._jdf.queryExecution().executedPlan().toString()
    partial = plan.index("row_number(), 50, Partial")
    assert plan.index("Exchange") < partial  # printed top down: the cut lies below the shuffle


def test_packets_are_dealt_out_before_they_are_sorted_or_gathered(packets):
    """Else a task holds all that its part of the table unfolds to."""
    events = packets(burst(60))
    for found in (syn_floods(events), port_scans(events)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        last = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line][-1]
        assert "packet_id" in last and "src_ip" not in last.split(")")[0]
        below = plan[plan.index(last) + len(last):]
        assert not any(step in below for step in ("Aggregate", "Sort", "WindowGroupLimit"))
