"""Severity order and lookups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Severities in display order, and their timeline lanes (pixels).
SEVERITIES = ("Critical", "High", "Medium", "Low")
LANES = {"Critical": 14, "High": 40, "Medium": 66, "Low": 92}


def _lookup(values: dict, severity: Column | str, default) -> Column:
    c = F.col(severity) if isinstance(severity, str) else severity
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(c == name, value).otherwise(out)
    return out


def severity_rank(severity: Column | str = "severity") -> Column:
    """1 for Critical down to 4 for Low; null for anything else."""
    ranks = {name: i + 1 for i, name in enumerate(SEVERITIES)}
    return _lookup(ranks, severity, None).cast("int")


def severity_lane(severity: Column | str = "severity") -> Column:
    """Lane of the alert timeline; unknown severities use Low's."""
    return _lookup(LANES, severity, LANES["Low"])
