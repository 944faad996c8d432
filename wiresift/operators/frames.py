"""Admission of raw Ethernet frames by their headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Header sizes, EtherType of IPv4 and protocol numbers.
ETHERNET, IP_MIN, TCP_MIN, UDP_MIN = 14, 20, 20, 8
IPV4 = b"\x08\x00"
TCP, UDP = b"\x06", b"\x11"


def admitted(frame: Column | str = "frame") -> Column:
    """Whether a frame is IPv4 and long enough for the headers it announces.

    TCP and UDP headers are looked for where the header length field says;
    other protocols pass once the fixed IP header fits. VLAN-tagged frames have
    another EtherType and do not pass.
    """
    f = F.col(frame) if isinstance(frame, str) else frame
    size = F.length(f)

    def at(offset: int, n: int) -> Column:
        return F.substring(f, offset + 1, n)

    words = F.conv(F.hex(at(ETHERNET, 1)), 16, 10).cast("int").bitwiseAND(F.lit(15))
    payload_at = ETHERNET + words * 4
    protocol = at(ETHERNET + 9, 1)
    transport = (
        F.when(protocol == F.lit(bytearray(TCP)), size >= payload_at + TCP_MIN)
        .when(protocol == F.lit(bytearray(UDP)), size >= payload_at + UDP_MIN)
        .otherwise(True)
    )
    ip = (size >= ETHERNET + IP_MIN) & (at(12, 2) == F.lit(bytearray(IPV4)))
    return F.when(ip, transport).otherwise(False)


def frame_admission(frames: DataFrame) -> DataFrame:
    return frames.select("frame_id", "rx_queue", admitted().alias("admitted"))


def frame_counters(frames: DataFrame) -> DataFrame:
    """Totals of rejected and admitted frames."""
    ok = admitted()
    return frames.agg(F.count_if(~ok).alias("n_rejected"), F.count_if(ok).alias("n_admitted"))
