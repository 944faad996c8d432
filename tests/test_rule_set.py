import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import exploit, packet, rows, syn
from wiresift.functions.net import payload_contains, port_above, syn_only
from wiresift.functions.steps import StepTracker
from wiresift.operators.rule_set import rule_set_alerts, rule_set_matches
from wiresift.operators.sequence import sequence_alerts
from wiresift.rules import DEFAULT_SEQUENCE, SequenceRule
from wiresift.schema import ALERT


def loop(data, rules):
    """Each rule's tracker fed with each key's rows in order; data has (key, time, id, letters)."""
    out = []
    for r, (steps, within) in enumerate(rules):
        for key in {d[0] for d in data}:
            tracker = StepTracker(len(steps), within)
            for k, t, i, letters in sorted(d for d in data if d[0] == key):
                mask = sum(1 << n for n, s in enumerate(steps) if s in letters)
                if mask and (started := tracker.feed(t, mask)) is not None:
                    out.append((k, t, i, r, started))
    return sorted(out)


def found(spark, data, rules, span=None):
    frame = spark.createDataFrame(data, "k int, t long, i long, letters string").repartition(3)
    columns = [([F.col("letters").contains(s) for s in steps], within) for steps, within in rules]
    return rows(rule_set_matches(frame, "k", "t", "i", columns, span=span), "k", "t", "i", "rule", "started")


RULES = [("ab", 10), ("abc", 12), ("aab", 6), ("abcd", 20), ("a", 5)]


@pytest.mark.parametrize("seed,span", [(1, None), (2, 25), (3, 20)])
def test_equal_to_the_loop(spark, seed, span):
    rng = random.Random(seed)
    data, t = [], 0
    for i in range(500):
        t += rng.choice([0, 0, 1, 1, 2, 3, 9])
        data.append((rng.randrange(3), t, i, "".join(sorted(c for c in "abcd" if rng.random() < 0.35))))
    want = loop(data, RULES)
    assert found(spark, data, RULES, span) == want
    assert {r[3] for r in want} == {0, 1, 2, 3}


def test_a_flood_of_first_steps(spark):
    """Many open partials and few rows that complete: the trimmed state gives what the whole one does."""
    rng = random.Random(4)
    data = [(1, i // 40, i, "a" if rng.random() < 0.97 else rng.choice(["b", "c", "ab", "bc", "abc"])) for i in range(3000)]
    rules = [("abc", 30), ("ab", 3), ("acb", 50)]
    assert found(spark, data, rules) == loop(data, rules)


def test_alerts_of_several_rules_in_one_pass(packets):
    rng = random.Random(5)
    trace, ms = [], 0
    for i in range(400):
        ms += rng.randrange(0, 900)
        kind = rng.random()
        trace.append(syn(i, ms, i % 3) if kind < 0.4 else exploit(i, ms, i % 3) if kind < 0.7 else packet(i, ms, i % 3, dport=60000))
    rules = [
        DEFAULT_SEQUENCE,
        SequenceRule("three", "High", (syn_only, lambda: port_above(50000), lambda: payload_contains(b"passwd")), 8000),
        SequenceRule("exploit-twice", "Low", (lambda: payload_contains(b"passwd"), lambda: payload_contains(b"passwd")), 1000),
    ]
    events = packets(trace)
    want = sorted(row for rule in rules for row in rows(sequence_alerts(events, rule), *ALERT.names))
    assert rows(rule_set_alerts(events, rules), *ALERT.names) == want and len({w[1] for w in want}) == 3
    exchanges = rule_set_alerts(events, rules)._jdf.queryExecution().executedPlan().toString()
    assert exchanges.count("Exchange hashpartitioning") == 1 and "Python" not in exchanges and "Pandas" not in exchanges


def test_nothing(spark, packets):
    assert rule_set_alerts(packets([]), [DEFAULT_SEQUENCE]).count() == 0
    assert found(spark, [(1, 1, 1, "a")], [("a", 5)]) == []
    with pytest.raises(ValueError):
        found(spark, [(1, 1, 1, "a")], [("ab" * 32, 5)])
