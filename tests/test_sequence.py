from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import exploit, packet, rows, syn
from wiresift.functions.net import payload_contains, syn_only
from wiresift.functions.steps import StepTracker
from wiresift.operators.sequence import pair_counts, sequence_alerts, step_matches, two_step_matches
from wiresift.rules import SequenceRule


def matched_pairs(trace, within):
    """Two-step matches of one key's (time, id, mask) rows, from what a match is and not by replaying rows.

    Write an opening for every first step and, before it if a row is both, a
    closing for every second step. A closing belongs to the nearest opening
    before it with only complete pairs in between, as brackets do; it counts if the two are near enough.
    """
    marks = [(t, i, x) for t, i, mask in sorted(trace) for x in [-1] * (mask >> 1 & 1) + [1] * (mask & 1)]
    depth = [0, *itertools.accumulate(x for _, _, x in marks)]
    return [
        (ident, marks[p][0])
        for e, (time, ident, x) in enumerate(marks) if x == -1
        for p in [next((p for p in range(e - 1, -1, -1) if marks[p][2] == 1 and depth[p + 1] == depth[e] and min(depth[p + 1 : e + 1]) == depth[e]), None)]
        if p is not None and time - marks[p][0] <= within
    ]


@pytest.mark.parametrize("trace, want", [
    ([syn(1, 0), exploit(2, 5000)], [2]),
    ([syn(1, 0), exploit(2, 5001)], []),
    ([syn(1, 0), syn(2, 1), exploit(3, 2), exploit(4, 3)], [3, 4]),
    ([syn(1, 0), exploit(2, 1), exploit(3, 2)], [2]),
    ([syn(1, 0, src=1), exploit(2, 1, src=2)], []),
    ([exploit(1, 0)], []),
    ([exploit(1, 0), syn(2, 1)], []),
    ([syn(1, 0, payload=b"passwd"), syn(2, 1, payload=b"passwd")], [2]),
    ([syn(1, 7), exploit(2, 7)], [2]),
    ([exploit(1, 7), syn(2, 7)], []),
    ([syn(1, 19_999), exploit(2, 20_000)], [2]),   # over a span edge
    ([syn(1, 15_000), exploit(2, 20_000)], [2]),
    ([syn(1, 14_999), exploit(2, 20_000)], []),
])
@pytest.mark.parametrize("steps_tracked", [False, True])
def test_cases(packets, trace, want, steps_tracked):
    df = packets(trace)
    if steps_tracked:
        got = step_matches(df, "src_ip", "timestamp_ms", "packet_id",
                           [syn_only(), payload_contains(b"passwd")], 5000)
    else:
        got = sequence_alerts(df)
    assert [i for (i,) in rows(got, "packet_id")] == want


def test_alert_text(packets):
    a = sequence_alerts(packets([syn(1, 0), exploit(2, 9)])).first()
    assert a["detail"] == ("CEP rule 'probe-then-exploit-attempt' completed: "
                           "2 steps matched within 5s")
    assert (a["severity"], a["detector"], a["timestamp_ms"]) == ("Critical", "Cep", 9)


def test_newest_probe_is_used_first(packets):
    df = two_step_matches(
        packets([syn(1, 0), syn(2, 10), exploit(3, 20), exploit(4, 30)]), "src_ip", "timestamp_ms",
        "packet_id", syn_only(), payload_contains(b"passwd"), 5000)
    assert rows(df, "packet_id", "started") == [(3, 10), (4, 0)]


def test_single_step_rules_never_fire(packets):
    rule = SequenceRule("one", "Low", [syn_only], 5000)
    assert sequence_alerts(packets([syn(1, 0), syn(2, 1)]), rule).count() == 0


def random_marks(seed, sources, n, n_steps, horizon, within):
    rng = random.Random(seed)
    out, ident = [], 0
    for src in range(sources):
        for _ in range(rng.randrange(n)):
            ident += 1
            mask = rng.randrange(1, 1 << n_steps) if rng.random() < 0.3 else 1 << rng.randrange(n_steps)
            out.append((src, rng.randrange(horizon), ident, mask))
    return out


@pytest.mark.parametrize("seed, span", [(1, None), (2, 10)])
def test_random_two_step_traces(spark, seed, span):
    within = 10
    marks = random_marks(seed, 60, 80, 2, 200, within)
    df = spark.createDataFrame(marks, "src long, at long, ident long, mask long").repartition(5)
    want = sorted(
        (src, *m) for src in {m[0] for m in marks} for m in matched_pairs([t[1:] for t in marks if t[0] == src], within))
    conditions = [F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(2)]
    for found in (step_matches, two_step_matches):
        steps = [conditions] if found is step_matches else conditions
        assert rows(found(df, "src", "at", "ident", *steps, within, span=span), "src", "ident", "started") == want
    assert len(want) > 50


# Traces of (time, fulfilled steps) for a rule of three steps within 10, and the (row, start) of each completion, by hand.
THREE_STEPS = [
    ("abc", [(0, "a"), (1, "b"), (2, "c")], [(2, 0)]),
    ("what does not fit in between is passed over", [(0, "a"), (1, "c"), (2, "b"), (3, "a"), (4, "c")], [(4, 0)]),
    ("a step cannot be skipped", [(0, "a"), (1, "c")], []),
    ("exactly at the limit", [(0, "a"), (5, "b"), (10, "c")], [(2, 0)]),
    ("past the limit", [(0, "a"), (5, "b"), (11, "c")], []),
    ("one b serves all that wait for it", [(0, "a"), (1, "a"), (2, "b"), (3, "c"), (4, "c")], [(3, 1), (4, 0)]),
    ("the newest that is ready completes", [(0, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "c")], [(4, 2)]),
    ("the older one is still there afterwards", [(0, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "c"), (5, "c")], [(4, 2), (5, 0)]),
    ("a row takes a sequence one step on, not two", [(0, "a"), (1, "bc"), (2, "c")], [(2, 0)]),
    ("the row that completes may begin another", [(0, "a"), (1, "b"), (2, "ac"), (3, "b"), (4, "c")], [(2, 0), (4, 2)]),
    ("sequences older than the one that completes stay put", [(0, "a"), (1, "a"), (2, "b"), (3, "bc"), (4, "c")], [(3, 1), (4, 0)]),
    ("the newer ones move on", [(0, "a"), (1, "b"), (2, "a"), (3, "bc"), (4, "c")], [(3, 0), (4, 2)]),
]


@pytest.mark.parametrize("span", [None, 10])
def test_three_steps_by_hand(spark, span):
    data = [(k, t, i, sum(1 << "abc".index(x) for x in steps)) for k, (_, trace, _) in enumerate(THREE_STEPS) for i, (t, steps) in enumerate(trace)]
    df = spark.createDataFrame(data, "src long, at long, ident long, mask long").repartition(3)
    conditions = [F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(3)]
    got = rows(step_matches(df, "src", "at", "ident", conditions, 10, span=span), "src", "ident", "started")
    assert got == sorted((k, *m) for k, (_, _, done) in enumerate(THREE_STEPS) for m in done)


@pytest.mark.parametrize("seed, n_steps, span", [(3, 3, 13), (4, 3, 10), (5, 4, 10)])
def test_spans_change_nothing_and_matches_have_their_steps(spark, seed, n_steps, span):
    within = 10
    marks = random_marks(seed, 60, 80, n_steps, 200, within)
    df = spark.createDataFrame(marks, "src long, at long, ident long, mask long").repartition(5)
    conditions = [F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(n_steps)]
    got = [rows(step_matches(df, "src", "at", "ident", conditions, within, span=s), "src", "ident", "started") for s in (span, 300)]
    assert got[0] == got[1] and len(got[0]) > 20
    for src, ident, started in got[0]:
        own = sorted(m[1:] for m in marks if m[0] == src)
        end = next(k for k, m in enumerate(own) if m[1] == ident)
        assert own[end][2] >> (n_steps - 1) & 1 and 0 <= own[end][0] - started <= within
        inner = [m[2] for m in own[:end] if m[0] >= started]
        assert any(all(mask >> s & 1 for s, mask in enumerate(c)) for c in itertools.combinations(inner, n_steps - 1))


def test_tracker_state_can_be_saved_at_any_row():
    for seed in range(20):
        trace = sorted(m[1:] for m in random_marks(seed, 1, 200, 3, 150, 10))
        whole, parts, got, want = StepTracker(3, 10), StepTracker(3, 10), [], []
        for time, _, mask in trace:
            want.append(whole.feed(time, mask))
            saved = parts.snapshot()
            parts = StepTracker(3, 10)
            parts.restore(saved)
            got.append(parts.feed(time, mask))
        assert got == want


def test_one_source_with_most_rows_is_spread_over_spans(spark, packets):
    """A hot source: exact results, and no span holds more than a sliver of it."""
    rng = random.Random(9)
    trace, ident = [], 0
    for second in range(400):
        for _ in range(25):
            ident += 1
            ms = second * 1000 + rng.randrange(1000)
            trace.append(exploit(ident, ms) if rng.random() < 0.4 else syn(ident, ms))
    df = packets(trace)
    want = sorted(i for i, _ in matched_pairs([(p[1], p[0], 1 if p[7] == 1 else 2) for p in trace], 5000))
    assert [i for (i,) in rows(sequence_alerts(df), "packet_id")] == want


def test_pair_counts_equal_the_interval_join(spark, packets):
    rng = random.Random(3)
    trace = []
    for i in range(600):
        src, ms = rng.randrange(5), rng.randrange(60_000)
        kind = rng.random()
        trace.append(syn(i, ms, src) if kind < 0.5 else exploit(i, ms, src) if kind < 0.9
                     else syn(i, ms, src, payload=b"passwd"))
    trace.append(packet(9999, 10, 1))
    firsts = [p for p in trace if p[7] == 1]
    seconds = [p for p in trace if b"passwd" in bytes(p[8])]
    want = sorted((e[0], n) for e in seconds if (n := sum(
        1 for p in firsts if p[2] == e[2] and p[0] != e[0] and 0 <= e[1] - p[1] <= 5000)))
    got = pair_counts(packets(trace), "src_ip", "timestamp_ms", "packet_id",
                      syn_only(), payload_contains(b"passwd"), 5000)
    assert rows(got, "packet_id", "n_pairs") == want


def test_spans_shorter_than_the_limit_are_refused(packets):
    with pytest.raises(ValueError):
        step_matches(packets([syn(1, 0)]), "src_ip", "timestamp_ms", "packet_id",
                     [syn_only(), payload_contains(b"passwd")], 5000, span=4999)


def test_firsts_of_spans_without_a_second_are_not_sorted(packets):
    """A flood of probes beside one exploit, and a source without a number: only spans with an exploit reach the windows."""
    trace = [syn(i, i * 10, src=i % 7) for i in range(5000)] + [exploit(6000, 25_005, src=3), syn(6001, 90_000, src=0), exploit(6002, 90_001, src=0)]
    nameless = packets(trace).repartition(3).withColumn("src_ip", F.when(F.col("timestamp_ms") < 90_000, F.col("src_ip")))
    done = sequence_alerts(nameless)
    assert [i for (i,) in rows(done, "packet_id")] == [6000, 6002]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    sorted_part = plan[plan.rindex("Window"):]
    assert "Join LeftSemi" in sorted_part and "src_ip" in sorted_part
