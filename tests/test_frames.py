from __future__ import annotations

import pytest

from wiresift.operators.frames import admitted, frame_counters
from wiresift.schema import FRAME

MACS = b"\x02" * 12


def ip(protocol, ihl=5):
    return bytes([0x40 | ihl]) + b"\x00" * 8 + bytes([protocol]) + b"\x00" * (ihl * 4 - 10)


CASES = [
    (b"", False),
    (MACS + b"\x08", False),
    (MACS + b"\x08\x00", False),
    (MACS + b"\x08\x00" + ip(6)[:19] , False),
    (MACS + b"\x08\x00" + ip(6) + b"\x00" * 20, True),
    (MACS + b"\x08\x00" + ip(6) + b"\x00" * 19, False),
    (MACS + b"\x08\x00" + ip(17) + b"\x00" * 8, True),
    (MACS + b"\x08\x00" + ip(17) + b"\x00" * 7, False),
    (MACS + b"\x08\x00" + ip(1), True),
    (MACS + b"\x08\x00" + ip(47), True),
    (MACS + b"\x08\x00" + ip(6, 6) + b"\x00" * 20, True),
    (MACS + b"\x08\x00" + ip(6, 6) + b"\x00" * 19, False),
    (MACS + b"\x08\x00" + ip(17, 15) + b"\x00" * 8, True),
    # A header length below the minimum is not checked: the TCP header is looked for at 14 + 0.
    (MACS + b"\x08\x00" + b"\x40" + ip(6)[1:], True),
    (MACS + b"\x86\xdd" + b"\x60" + b"\x00" * 60, False),
    (MACS + b"\x81\x00\x00\x01\x08\x00" + ip(6) + b"\x00" * 20, False),
]


@pytest.fixture
def frames(spark):
    return spark.createDataFrame([(i, 0, bytearray(f)) for i, (f, _) in enumerate(CASES)], FRAME)


def test_admission(frames):
    got = [r[0] for r in frames.orderBy("frame_id").select(admitted()).collect()]
    assert got == [ok for _, ok in CASES]


def test_counters(frames):
    ok = sum(1 for _, good in CASES if good)
    assert tuple(frame_counters(frames).first()) == (len(CASES) - ok, ok)
