"""Byte signatures from a table of rules: any number of patterns, without a pass per rule.

Every pattern is filed under one of its grams (stretches of ``GRAM`` bytes; the whole
pattern if it is shorter): the one that the payloads hold least often. Payloads are cut to their
grams, those are joined with the filed ones, and what meets is compared byte by
byte at the place that the gram's place in the pattern implies. A rule whose rarest gram
does not occur costs nothing beyond its row, and a payload is read as often for ten
thousand rules as for ten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiresift.operators.alerts import to_alert
from wiresift.scratch import scratch_dir

GRAM = 4
RULE_COLUMNS = ("rule_name", "severity", "pattern")


def _grams(body: Column, width: int) -> Column:
    """All stretches of ``width`` bytes as (pos, gram): the position from 1 and a hash."""
    starts = F.when(F.length(body) >= width, F.sequence(F.lit(1), F.length(body) - width + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(width), F.substring(body, i, F.lit(width))).alias("gram")))


def pattern_grams(rules: DataFrame, width: int = GRAM) -> DataFrame:
    """The grams of all patterns: (rule columns, offset from 0, gram). A pattern shorter than ``width`` is one gram, an empty or null one none."""
    body = F.col("pattern")
    own = [F.when(F.length(body) == n, F.transform(_grams(body, n), lambda g: g)) for n in range(1, width)]
    grams = F.coalesce(*own, _grams(body, width))
    return rules.where(F.length(body) > 0).select(*RULE_COLUMNS, F.inline(grams)).withColumn("offset", F.col("pos") - 1).drop("pos")


def payload_grams(rows: DataFrame, key: str, payload: str, widths: list[int]) -> DataFrame:
    """(key, pos, gram) for the given widths of all payloads.

    Positions are exploded first and hashed one by one, so that a gram is a few steps of compiled
    code and never part of an array of a payload's grams.
    """
    body, every = F.col("_body"), F.array(*[F.lit(n) for n in widths])
    sized = rows.select(F.col(key).alias("_key"), F.col(payload).alias("_body"))
    if len(widths) > 1:
        sized = sized.withColumn("_width", F.explode(every))
    width = F.col("_width") if len(widths) > 1 else F.lit(widths[0])
    starts = sized.where(F.length(body) >= width).withColumn("pos", F.explode(F.sequence(F.lit(1), F.length(body) - width + 1)))
    return starts.select("_key", "pos", F.xxhash64(width, F.substring(body, F.col("pos"), width)).alias("gram"))


def anchors(rows: DataFrame, rules: DataFrame, key: str = "packet_id", payload: str = "payload_sample", width: int = GRAM) -> DataFrame:
    """Rules with the gram that they are filed under and its offset; rules that cannot match are left out.

    Grams are counted over all payloads, those that no pattern has before they are counted left out.
    What the payloads meet is stored, so that Spark knows how small it is: grams of payloads are then not shuffled to meet few rules.
    """
    grams = pattern_grams(rules, width)
    widths = _widths(rules, width)
    if not widths:
        return grams.limit(0)
    wanted = _stored(grams.select("gram").distinct(), "wanted-grams")
    counts = payload_grams(rows, key, payload, widths).select("gram").join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    counted = grams.join(counts, "gram", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    rarest = counted.groupBy(*RULE_COLUMNS).agg(F.min(F.struct("_n", "offset", "gram")).alias("a"))
    return _stored(rarest.where("a._n > 0").select(*RULE_COLUMNS, "a.offset", "a.gram"), "filed-rules")


def _stored(table: DataFrame, purpose: str) -> DataFrame:
    path = scratch_dir(table.sparkSession, purpose)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _widths(rules: DataFrame, width: int) -> list[int]:
    """The gram widths that occur among the rules: ``width`` of them at most."""
    each = F.least(F.length("pattern"), F.lit(width)).alias("w")
    return sorted(r["w"] for r in rules.where(F.length("pattern") > 0).select(each).distinct().collect())


def candidates(rows: DataFrame, filed: DataFrame, widths: list[int], key: str, payload: str) -> DataFrame:
    """(_key, rule columns, match_pos): where a filed gram stands so that its pattern might."""
    met = payload_grams(rows, key, payload, widths).join(filed, "gram")
    return met.withColumn("match_pos", F.col("pos") - F.col("offset")).where("match_pos > 0").select("_key", *RULE_COLUMNS, "match_pos")


def rule_table_matches(rows: DataFrame, rules: DataFrame, key: str = "packet_id", payload: str = "payload_sample", width: int = GRAM) -> DataFrame:
    """One row per occurrence of a rule's pattern: the row's columns, rule_name, severity, match_pos and match_end (bytes from 1).

    ``rules`` has rule_name, severity and pattern (binary); equal rows are one rule. ``key`` names
    a row of ``rows``. Occurrences may overlap. Null payloads, and empty or null patterns, match nothing.

    Only (key, position, gram) travel to meet the rules; payloads are joined back by key
    to what met, and compared.
    """
    rules = rules.select(*RULE_COLUMNS).distinct()
    filed = anchors(rows, rules, key, payload, width)
    widths = _widths(rules, width)
    if not widths:
        widths = [width]
    met = candidates(rows, filed, widths, key, payload)
    size = F.length("pattern")
    # merged: a table of payloads is larger than the size of its files tells
    found = rows.join(met.hint("merge"), F.col(key) == F.col("_key")).where(F.substring(F.col(payload), F.col("match_pos"), size) == F.col("pattern"))
    return found.withColumn("match_end", F.col("match_pos") + size - 1).drop("_key", "pattern")


def rule_table_alerts(events: DataFrame, rules: DataFrame) -> DataFrame:
    """One alert per occurrence of a rule's pattern in a payload sample. ``events`` is read more than once."""
    columns = ["packet_id", "timestamp_ms", "src_ip", "dst_ip", "payload_sample"]
    detail = F.concat(F.lit("signature match for rule '"), F.col("rule_name"), F.lit("' in payload sample"))
    return to_alert(
        rule_table_matches(events.select(*columns), rules), rule=F.col("rule_name"), severity=F.col("severity"), detail=detail,
        detector="Signature", stage=1, match_pos=F.col("match_pos"), match_end=F.col("match_end"))
