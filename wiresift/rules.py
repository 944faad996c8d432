"""Rule sets, thresholds and the rule catalogue."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wiresift.functions.net import payload_contains, syn_only


@dataclass(frozen=True)
class SignatureRule:
    """A byte pattern to look for in payloads."""

    name: str
    pattern: bytes
    severity: str

    def __post_init__(self):
        if not self.pattern:
            raise ValueError("a signature needs a pattern")


@dataclass(frozen=True)
class SequenceRule:
    """Steps that one source must pass in order within ``within_ms``.

    A step is a boolean Column over the event columns, or a function that
    returns one (so that rules can be declared before a session exists).
    """

    name: str
    severity: str
    steps: Sequence[Column | Callable[[], Column]]
    within_ms: int

    def conditions(self) -> list[Column]:
        return [s if isinstance(s, Column) else s() for s in self.steps]


# The default signature rules.
DEFAULT_SIGNATURES = (
    SignatureRule("path-traversal-passwd", b"/etc/passwd", "High"),
    SignatureRule("sql-injection-union", b"UNION SELECT", "High"),
    SignatureRule("xss-script-tag", b"<script>alert(", "Medium"),
    SignatureRule("windows-cmd-exec", b"cmd.exe", "Critical"),
    SignatureRule("path-traversal-generic", b"../../", "Medium"),
)

# Thresholds and window of the rate rules, sketch sizes.
WINDOW_MS = 5000
SYN_FLOOD_RULE = "syn-flood-anomaly"
SYN_FLOOD_SEVERITY = "Critical"
SYN_FLOOD_THRESHOLD = 50
PORT_SCAN_RULE = "port-scan-anomaly"
PORT_SCAN_SEVERITY = "High"
PORT_SCAN_THRESHOLD = 25
CMS_WIDTH = 2048
CMS_DEPTH = 4
HLL_BITS = 10

# The default sequence rule.
DEFAULT_SEQUENCE = SequenceRule(
    name="probe-then-exploit-attempt",
    severity="Critical",
    steps=(syn_only, lambda: payload_contains(b"passwd")),
    within_ms=5000,
)

# The published rule catalogue (name, detector, description).
CATALOGUE = (
    ("path-traversal-passwd", "signature",
     "Aho-Corasick match on '/etc/passwd' in payload sample"),
    ("sql-injection-union", "signature",
     "Aho-Corasick match on 'UNION SELECT' in payload sample"),
    ("syn-flood-anomaly", "anomaly",
     "Count-Min Sketch estimated SYN count per source exceeds threshold within window"),
    ("port-scan-anomaly", "anomaly",
     "HyperLogLog estimated distinct destination ports per source exceeds threshold within window"),
    ("probe-then-exploit-attempt", "cep",
     "NFA sequence: SYN probe followed by known-bad payload from same source within 5s window"),
)

# The three signature rules that are active but not in the published catalogue.
UNLISTED = (
    ("xss-script-tag", "signature", "Byte match on '<script>alert(' in payload sample"),
    ("windows-cmd-exec", "signature", "Byte match on 'cmd.exe' in payload sample"),
    ("path-traversal-generic", "signature", "Byte match on '../../' in payload sample"),
)


def catalogue(spark: SparkSession, complete: bool = False) -> DataFrame:
    """The five published rules, or all eight active ones."""
    rows = CATALOGUE + UNLISTED if complete else CATALOGUE
    entries = [
        F.struct(F.lit(n).alias("name"), F.lit(d).alias("detector"), F.lit(t).alias("description"))
        for n, d, t in rows
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))
