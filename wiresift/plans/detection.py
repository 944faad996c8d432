"""All detectors over one packet table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from wiresift.operators.rates import port_scans, syn_floods
from wiresift.operators.rule_set import rule_set_alerts
from wiresift.operators.sequence import sequence_alerts
from wiresift.operators.signature import contains_any, signature_alerts
from wiresift.rules import (
    DEFAULT_SEQUENCE,
    DEFAULT_SIGNATURES,
    PORT_SCAN_THRESHOLD,
    SYN_FLOOD_THRESHOLD,
    WINDOW_MS,
    SequenceRule,
    SignatureRule,
)
from wiresift.schema import EVENT


def suspects(
    events: DataFrame,
    signatures: Sequence[SignatureRule] = DEFAULT_SIGNATURES,
    sequences: Sequence[SequenceRule] = (DEFAULT_SEQUENCE,),
) -> DataFrame:
    """Packets that contain a signature or can complete a two-step sequence."""
    tests = [contains_any(F.col("payload_sample"), signatures)] if signatures else []
    tests += [rule.conditions()[1] for rule in sequences if len(rule.steps) == 2]
    return events.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


def store_suspects(events: DataFrame, path: str, **rules) -> DataFrame:
    """Write the suspects to a table and read it back.

    This is the one pass over all payloads; see ``all_alerts``.
    """
    suspects(events, **rules).select(*EVENT.names).write.mode("overwrite").parquet(path)
    return events.sparkSession.read.schema(EVENT).parquet(path)


def all_alerts(
    events: DataFrame,
    signatures: Sequence[SignatureRule] = DEFAULT_SIGNATURES,
    sequences: Sequence[SequenceRule] = (DEFAULT_SEQUENCE,),
    syn_threshold: int = SYN_FLOOD_THRESHOLD,
    port_threshold: int = PORT_SCAN_THRESHOLD,
    width_ms: int = WINDOW_MS,
    suspects: DataFrame | None = None,
) -> DataFrame:
    """Signature, flood, scan and sequence alerts as one bag.

    Each branch reads only the columns it needs. ``stage`` and the match
    position give the order in which a packet's alerts arrive. Sequences of three and
    more steps are found together in one pass.

    On large tables, store the suspects first (``store_suspects``, with the
    same rules) and pass them in. Payloads, the bulk of the table, are then
    read once instead of twice, and probes are kept only where a suspect may
    complete them: a flood of probes ends at the scan instead of in a shuffle.
    """
    matching = events if suspects is None else suspects
    longer = [rule for rule in sequences if len(rule.steps) > 2]
    branches = [
        *([signature_alerts(matching, signatures)] if signatures else []),
        syn_floods(events, syn_threshold, width_ms),
        port_scans(events, port_threshold, width_ms),
        *[sequence_alerts(events, rule, seconds=suspects) for rule in sequences if len(rule.steps) == 2],
        *([rule_set_alerts(events, longer)] if longer else []),
    ]
    return reduce(DataFrame.unionByName, branches)
