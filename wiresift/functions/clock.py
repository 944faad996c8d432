"""Column functions over time: epoch conversions, tumbling windows, durations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ms_to_ts(ms: Column | str) -> Column:
    return F.timestamp_millis(ms)


def seconds_to_ts(seconds: Column | str) -> Column:
    """Float epoch seconds to a timestamp, rounded to microseconds."""
    c = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.timestamp_micros(F.round(c * 1000000).cast("long"))


def ntz_to_ms(ts: str) -> Column:
    """Epoch milliseconds of a zone-less timestamp read as UTC."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def floor_div(value: Column | str, width: int) -> Column:
    """Integer division rounding down, without leaving 64-bit integers."""
    c = F.col(value) if isinstance(value, str) else value
    w = F.lit(width).cast("long")
    return F.call_function("div", c - F.pmod(c, w), w)


def window_start(width_ms: int, ms: Column | str = "timestamp_ms") -> Column:
    """Start of the epoch-aligned, half-open window that holds ``ms``."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return c - F.pmod(c, F.lit(width_ms).cast("long"))


def duration_text(ms: int) -> str:
    """5000 as '5s', 1500 as '1.5s', 250 as '250ms', 1234567 as '1234.567s'."""
    if ms < 1000:
        return f"{ms}ms"
    seconds, rest = divmod(ms, 1000)
    return f"{seconds}.{rest:03d}".rstrip("0") + "s" if rest else f"{seconds}s"
