import numpy as np
import pytest

from wiresift.operators.rule_table import anchors, candidates, rule_table_matches

ROWS = "packet_id long, payload_sample binary, note string"
RULES = "rule_name string, severity string, pattern binary"


def brute_force(rows, rules):
    out = []
    for i, body, note in rows:
        for name, severity, pattern in {(n, s, bytes(p or b"")) for n, s, p in rules}:
            for at in range(len(body or b"") - len(pattern) + 1):
                if pattern and body[at : at + len(pattern)] == pattern:
                    out.append((i, note, name, severity, at + 1, at + len(pattern)))
    return sorted(out)


def found(spark, rows, rules, **options):
    out = rule_table_matches(spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(rules, RULES), **options)
    return sorted(tuple(r) for r in out.select("packet_id", "note", "rule_name", "severity", "match_pos", "match_end").collect())


@pytest.mark.parametrize("width", [2, 4])
def test_brute_force(spark, width):
    rng = np.random.default_rng(3)
    rows = [(i, bytes(rng.integers(97, 100, int(rng.integers(0, 40))).tolist()), f"n{i}") for i in range(60)]
    rows += [(100, None, "null"), (101, b"", "empty"), (102, b"\x00\xff\x00\xff\x00", "bytes"), (103, b"a" * 3000, "long")]
    rules = [(f"r{n}", "High", bytes(rng.integers(97, 100, int(rng.integers(1, 9))).tolist())) for n in range(40)]
    rules += [("overlap", "Low", b"aaaa"), ("one", "Low", b"a"), ("bytes", "Low", b"\xff\x00"), ("empty", "Low", b""), ("null", "Low", None), ("never", "Low", b"zzzzz"), ("never", "Low", b"z")]
    rules += [("overlap", "Low", b"aaaa"), ("same pattern", "Low", b"aaaa"), ("longer than any", "Low", b"a" * 4000)]
    assert found(spark, rows, rules, width=width) == brute_force(rows, rules)


def test_no_rules_and_no_rows(spark):
    assert found(spark, [(1, b"abc", "x")], []) == []
    assert found(spark, [], [("r", "Low", b"abc")]) == []


def test_rules_that_never_match_cost_no_candidates(spark):
    rows = spark.createDataFrame([(i, b"GET /item/%d of the shop" % i, "x") for i in range(200)], ROWS)
    few = [("shop", "Low", b"the shop"), ("item", "Low", b"/item/7")]
    many = few + [(f"never {i}", "Low", b"the %06d" % (i * 7919)) for i in range(2000)]
    counts = []
    for rules in (few, many):
        filed = anchors(rows, spark.createDataFrame(rules, RULES))
        counts.append((filed.count(), candidates(rows, filed, [4], "packet_id", "payload_sample").count()))
    assert counts[0] == counts[1]


def test_the_rarest_gram_is_the_anchor(spark):
    rows = spark.createDataFrame([(i, b"common words" + (b" rare" if i == 3 else b""), "x") for i in range(50)], ROWS)
    rule = spark.createDataFrame([("r", "Low", b"common words rare")], RULES)
    assert candidates(rows, anchors(rows, rule), [4], "packet_id", "payload_sample").count() == 1


def test_grams_are_hashed_one_by_one_and_meet_a_stored_table(spark):
    """No array of a payload's grams is built, and grams of payloads are not shuffled to meet few rules."""
    rows = spark.createDataFrame([(i, b"GET /item/%d of the shop" % i, "x") for i in range(200)], ROWS)
    filed = anchors(rows, spark.createDataFrame([("shop", "Low", b"the shop")], RULES))
    plan = candidates(rows, filed, [4], "packet_id", "payload_sample")._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
