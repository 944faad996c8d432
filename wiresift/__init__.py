"""Detection, triage and telemetry operators for network event tables and streams."""

from wiresift.operators.alerts import to_alert
from wiresift.operators.rates import port_counts, port_scans, syn_counts, syn_floods
from wiresift.operators.sequence import sequence_alerts
from wiresift.operators.signature import signature_alerts
from wiresift.plans.detection import all_alerts
from wiresift.rules import SequenceRule, SignatureRule

__all__ = [
    "SequenceRule",
    "SignatureRule",
    "all_alerts",
    "port_counts",
    "port_scans",
    "sequence_alerts",
    "signature_alerts",
    "syn_counts",
    "syn_floods",
    "to_alert",
]
