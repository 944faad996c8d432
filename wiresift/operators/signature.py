"""Byte-signature matching: many patterns, overlapping, one row per occurrence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wiresift.operators.alerts import to_alert
from wiresift.rules import DEFAULT_SIGNATURES, SignatureRule

# Bytes per block when locating occurrences.
BLOCK = 64
RULES = "array<struct<rule_id:int,rule_name:string,severity:string,pattern:binary>>"


def contains_any(payload: Column, rules: Sequence[SignatureRule]) -> Column:
    """Whether a payload contains at least one of the patterns."""
    return reduce(lambda a, b: a | b, [payload.contains(F.lit(bytearray(r.pattern))) for r in rules], F.lit(False))


def _rule_array(rules: Sequence[SignatureRule]) -> Column:
    """The rule set as an array literal, folded into the plan as a constant."""
    return F.array(*[
        F.struct(
            F.lit(i + 1).alias("rule_id"),
            F.lit(r.name).alias("rule_name"),
            F.lit(r.severity).alias("severity"),
            F.lit(bytearray(r.pattern)).alias("pattern"),
        )
        for i, r in enumerate(rules)
    ]).cast(RULES)


def signature_hits(
    rows: DataFrame, rules: Sequence[SignatureRule] = DEFAULT_SIGNATURES, payload: str = "payload_sample"
) -> DataFrame:
    """Rows paired with each rule whose pattern they contain, as column ``rule``.

    A narrow operation: no join, no shuffle. Rows without any match leave at a
    plain filter over binary ``contains``, before anything is exploded.
    """
    body = F.col(payload)
    found = rows.where((F.length(body) > 0) & contains_any(body, rules))
    matching = F.filter(_rule_array(rules), lambda r: body.contains(r["pattern"]))
    return found.select("*", F.explode(matching).alias("rule"))


def signature_matches(
    rows: DataFrame, rules: Sequence[SignatureRule] = DEFAULT_SIGNATURES, payload: str = "payload_sample"
) -> DataFrame:
    """One row per occurrence, with 1-based byte positions match_pos..match_end.

    Payloads are looked at in blocks: binary ``contains`` picks the blocks in
    which an occurrence starts, and only those are compared byte by byte.
    """
    body, pattern = F.col(payload), F.col("rule.pattern")
    size, width = F.length(body), F.length(pattern)

    def starts_in(block: Column) -> Column:
        first = block * BLOCK + 1
        last = F.least(first + BLOCK - 1, size - width + 1)
        return F.filter(F.sequence(first, last), lambda i: F.substring(body, i, width) == pattern)

    blocks = F.filter(
        F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")),
        lambda b: F.substring(body, b * BLOCK + 1, width + BLOCK - 1).contains(pattern))
    hits = F.flatten(F.transform(blocks, starts_in))
    return (
        signature_hits(rows, rules, payload)
        .select("*", F.explode(hits).alias("match_pos"))
        .withColumn("match_end", F.col("match_pos") + F.length(pattern) - 1)
        .withColumns({c: F.col(f"rule.{c}") for c in ("rule_id", "rule_name", "severity")})
        .drop("rule")
    )


def signature_counts(
    rows: DataFrame,
    key: str,
    rules: Sequence[SignatureRule] = DEFAULT_SIGNATURES,
    payload: str = "payload_sample",
) -> DataFrame:
    """Occurrences per row and rule, counted in one regex pass per matching rule.

    The lookahead consumes nothing, so overlapping occurrences all count. The
    bytes are read as ISO-8859-1, which maps each byte to one character.
    """
    text = F.decode(payload, "ISO-8859-1")
    needle = F.concat(
        F.lit("(?s)(?=\\Q"), F.decode(F.col("rule.pattern"), "ISO-8859-1"), F.lit("\\E)"))
    return signature_hits(rows.select(key, payload), rules, payload).select(
        key, F.col("rule.rule_name").alias("rule_name"), F.regexp_count(text, needle).alias("n_matches"))


def signature_alerts(
    events: DataFrame, rules: Sequence[SignatureRule] = DEFAULT_SIGNATURES
) -> DataFrame:
    """One alert per occurrence of a rule's pattern in a payload sample."""
    columns = ["packet_id", "timestamp_ms", "src_ip", "dst_ip", "payload_sample"]
    detail = F.concat(
        F.lit("signature match for rule '"), F.col("rule_name"), F.lit("' in payload sample"))
    return to_alert(
        signature_matches(events.select(*columns), rules),
        rule=F.col("rule_name"),
        severity=F.col("severity"),
        detail=detail,
        detector="Signature",
        stage=1,
        match_pos=F.col("match_pos"),
        match_end=F.col("match_end"),
    )
