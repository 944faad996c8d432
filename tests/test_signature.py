from __future__ import annotations

import random

from tests.conftest import packet, rows
from wiresift.operators.signature import BLOCK, signature_alerts, signature_counts, signature_matches
from wiresift.rules import SignatureRule


def occurrences(body: bytes, pattern: bytes):
    return [i + 1 for i in range(len(body) - len(pattern) + 1) if body[i:i + len(pattern)] == pattern]


def test_path_traversal_fires_both_rules_in_match_end_order(packets):
    df = signature_alerts(packets([packet(1, 7, payload=b"GET /../../etc/passwd HTTP/1.1")]))
    got = sorted((r["match_end"], r["rule_name"], r["severity"], r["timestamp_ms"]) for r in df.collect())
    assert got == [(11, "path-traversal-generic", "Medium", 7), (21, "path-traversal-passwd", "High", 7)]
    assert df.first()["detail"].startswith("signature match for rule 'path-traversal-")


def test_benign_empty_and_short_payloads_are_silent(packets):
    bodies = [b"GET /index.html HTTP/1.1", b"", b"x", b"union select", b"..", b"../.."]
    assert signature_alerts(packets([packet(i, 0, payload=b) for i, b in enumerate(bodies)])).count() == 0


def test_every_default_rule(packets):
    body = b"/etc/passwd UNION SELECT <script>alert( cmd.exe ../../"
    got = rows(signature_alerts(packets([packet(1, 0, payload=body)])), "rule_name", "severity")
    assert got == [("path-traversal-generic", "Medium"), ("path-traversal-passwd", "High"),
                   ("sql-injection-union", "High"), ("windows-cmd-exec", "Critical"),
                   ("xss-script-tag", "Medium")]


def test_overlapping_occurrences(packets):
    df = packets([packet(1, 0, payload=b"../../../")])
    assert rows(signature_alerts(df), "match_pos", "match_end") == [(1, 6), (4, 9)]
    assert rows(signature_counts(df, "packet_id"), "packet_id", "rule_name", "n_matches") == [
        (1, "path-traversal-generic", 2)]


def test_positions_and_counts_against_a_scan(packets):
    """Long binary payloads, matches across block edges, a pattern that overlaps itself."""
    rng = random.Random(5)
    rules = [SignatureRule("aa", b"aa", "Low"), SignatureRule("aba", b"aba", "Low"),
             SignatureRule("bin", b"\xff\x00", "Low"), SignatureRule("dots", b"a.b", "Low")]
    bodies = [bytes(rng.choice(b"ab.\xff\x00") for _ in range(n))
              for n in (1, 2, 3, BLOCK - 1, BLOCK, BLOCK + 1, 2 * BLOCK + 3, 500)]
    bodies.append(b"x" * (BLOCK - 1) + b"aa" + b"x" * BLOCK)
    df = packets([packet(i, 0, payload=b) for i, b in enumerate(bodies)])
    want = sorted((i, r.name, p, p + len(r.pattern) - 1)
                  for i, b in enumerate(bodies) for r in rules for p in occurrences(b, r.pattern))
    assert rows(signature_matches(df, rules), "packet_id", "rule_name", "match_pos", "match_end") == want
    counts = sorted((i, r.name, len(occurrences(b, r.pattern)))
                    for i, b in enumerate(bodies) for r in rules if occurrences(b, r.pattern))
    assert rows(signature_counts(df, "packet_id", rules), "packet_id", "rule_name", "n_matches") == counts


def test_matching_needs_no_shuffle(packets):
    plan = signature_alerts(packets([packet(1, 0)]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_no_rules_give_no_alerts(packets):
    df = packets([packet(1, 0, payload=b"GET /etc/passwd")])
    assert signature_alerts(df, []).count() == 0
    assert signature_alerts(df, []).columns == signature_alerts(df).columns
