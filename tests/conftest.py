from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tools.session import local_session  # noqa: E402
from wiresift.schema import EVENT  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    yield session
    session.stop()


def packet(packet_id, ms, src=1, dst=99, sport=1111, dport=80, proto="Tcp", flags=3, payload=b""):
    return (packet_id, ms, src, dst, sport, dport, proto, flags, bytearray(payload))


def syn(packet_id, ms, src=1, dst=99, dport=80, payload=b""):
    return packet(packet_id, ms, src, dst, dport=dport, flags=1, payload=payload)


def exploit(packet_id, ms, src=1, dst=99):
    return packet(packet_id, ms, src, dst, payload=b"GET /../../etc/passwd HTTP/1.1")


@pytest.fixture
def packets(spark):
    return lambda rows: spark.createDataFrame(rows, EVENT)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
