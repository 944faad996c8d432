from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import packet, rows
from wiresift.functions import clock, net
from wiresift.functions.severity import severity_lane, severity_rank

MASK = 2**64 - 1


def fold(octets):
    h = 1469598103934665603
    for o in octets:
        h = ((h ^ o) * 1099511628211) & MASK
    return h


CASES = [(0, 0, 0, 0), (4294967295, 4294967295, 65535, 65535), (167772160, 3232235777, 1024, 443),
         (1, 2147483648, 53, 7), (3735928559, 305419896, 4660, 22136)]


@pytest.fixture
def flows(packets):
    return packets([packet(i, 0, s, d, sp, dp) for i, (s, d, sp, dp) in enumerate(CASES)])


def test_ip_to_string(packets):
    df = packets([packet(1, 0, 4294967295, 0), packet(2, 0, 167772161, 3232235777)])
    got = rows(df, "packet_id", net.ip_to_string("src_ip"), net.ip_to_string("dst_ip"))
    assert got == [(1, "255.255.255.255", "0.0.0.0"), (2, "10.0.0.1", "192.168.1.1")]


def test_flow_and_shard_keys_equal_big_integer_arithmetic(flows):
    want = []
    for i, (s, d, sp, dp) in enumerate(CASES):
        src, rest = s.to_bytes(4, "big"), d.to_bytes(4, "big") + sp.to_bytes(2, "big") + dp.to_bytes(2, "big")
        want.append((i, f"{fold(src + rest):016x}", f"{fold(src):016x}"))
    got = net.with_flow_key(flows, shard_key="shard_key")
    assert rows(got, "packet_id", "flow_key", "shard_key") == want
    assert rows(net.with_shard_key(flows), "packet_id", "shard_key") == [(i, k) for i, _, k in want]


@pytest.mark.parametrize("shards", [1, 3, 4, 7, 64])
def test_shard_is_the_source_hash_modulo(flows, shards):
    want = [(i, fold(c[0].to_bytes(4, "big")) % shards) for i, c in enumerate(CASES)]
    assert rows(net.with_shard(flows, shards), "packet_id", "shard") == want


def test_flags_and_syn_only(packets):
    df = packets([packet(f, 0, flags=f) for f in range(16)])
    for r in df.select("packet_id", net.syn_only().alias("s"), *[
            net.has_flag(b).alias(str(b)) for b in (1, 2, 4, 8)]).collect():
        f = r["packet_id"]
        assert r["s"] == (f & 1 != 0 and f & 2 == 0)
        assert [r[str(b)] for b in (1, 2, 4, 8)] == [f & b != 0 for b in (1, 2, 4, 8)]


def test_payload_contains_and_port_above(packets):
    df = packets([
        packet(1, 0, payload=b"cat /etc/passwd"), packet(2, 0, payload=b"PASSWD"),
        packet(3, 0, payload=b""), packet(4, 0, payload=b"\xff\xfepasswd\x00", dport=1024)])
    assert rows(df.where(net.payload_contains(b"passwd")), "packet_id") == [(1,), (4,)]
    assert rows(df.where(net.port_above(1023)), "packet_id") == [(4,)]


def test_clock(spark):
    df = spark.createDataFrame([(4999,), (5000,), (-1,)], "ms long")
    assert rows(df, "ms", clock.window_start(5000, "ms"), clock.floor_div("ms", 5000)) == [
        (-1, -5000, -1), (4999, 0, 0), (5000, 5000, 1)]
    assert [clock.duration_text(ms) for ms in (5000, 1500, 250, 1_234_567, 1_000_000_000, 1005)] == [
        "5s", "1.5s", "250ms", "1234.567s", "1000000s", "1.005s"]
    got = spark.range(1).select(F.unix_micros(clock.seconds_to_ts(F.lit(1785439205.219682)))).first()[0]
    assert got == 1785439205219682


def test_severity(spark):
    df = spark.createDataFrame([("Critical",), ("High",), ("Medium",), ("Low",), ("odd",)], "severity string")
    got = {r[0]: (r[1], r[2]) for r in df.select("severity", severity_rank(), severity_lane()).collect()}
    assert got == {"Critical": (1, 14), "High": (2, 40), "Medium": (3, 66), "Low": (4, 92), "odd": (None, 92)}
