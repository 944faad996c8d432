from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import packet, rows, syn
from wiresift.operators import sketches as sk
from wiresift.operators.rates import port_scans, syn_floods
from wiresift.rules import CMS_WIDTH


def cells_of(key):
    return [(r, ((key * a + b) % (2**31 - 1)) % CMS_WIDTH) for r, (a, b) in enumerate(sk.CMS_HASHES)]


def colliding_with(target, row, n):
    """Sources that share the target's cell in one row."""
    want = cells_of(target)[row]
    return [k for k in range(1, 40_000) if k != target and cells_of(k)[row] == want][:n]


def test_estimates_never_fall_below_counts(packets):
    rng = random.Random(4)
    trace = [syn(i, rng.randrange(10_000), src=int(rng.paretovariate(0.6)) % 4_000_000_000)
             for i in range(4000)]
    got = sk.syn_estimates(packets(trace)).collect()
    assert all(r["n_estimate"] >= r["n_syn"] for r in got)
    assert sum(r["n_syn"] for r in got) == 4000


def test_cells_at_the_ends_of_the_key_range(spark):
    keys = [0, 1, 2**31, 2**32 - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", F.inline(sk.cms_cells("k")))
    assert rows(df, "k", "cms_row", "cell") == sorted((k, r, c) for k in keys for r, c in cells_of(k))


def test_merged_shards_equal_one_sketch(packets):
    trace = [syn(i, 7 * i, src=i * 7919 % 1000) for i in range(2000)]
    whole = sk.syn_sketch(packets(trace))
    parts = sk.sharded_syn_sketches(packets(trace), 4)
    assert parts.select("shard").distinct().count() == 4
    merged = sk.cms_merge(parts, ["window_start_ms"])
    columns = ("window_start_ms", "cms_row", "cell", "n_cell")
    assert rows(merged, *columns) == rows(whole, *columns)


def running_estimates(trace, threshold):
    """Floods by the sketch, packet by packet: (packet_id, estimate)."""
    tables, alerted, out = {}, set(), []
    for p in sorted(trace, key=lambda p: (p[1], p[0])):
        if p[7] != 1:
            continue
        window = p[1] // 5000
        table = tables.setdefault(window, {})
        for c in cells_of(p[2]):
            table[c] = table.get(c, 0) + 1
        estimate = min(table[c] for c in cells_of(p[2]))
        if estimate >= threshold and (window, p[2]) not in alerted:
            alerted.add((window, p[2]))
            out.append((p[0], estimate))
    return sorted(out)


@pytest.mark.parametrize("slice_ms", [100, 5000])
def test_running_estimate_alerts_packet_by_packet(packets, slice_ms):
    """Few cells and many sources: estimates are shared and jump past the threshold."""
    rng = random.Random(6)
    target = 777
    others = [k for row in range(4) for k in colliding_with(target, row, 2)]
    trace = [syn(i, rng.randrange(15_000), src=rng.choice([target, *others, 5, 6])) for i in range(900)]
    got = sk.cms_syn_floods(packets(trace), threshold=20, slice_ms=slice_ms)
    found = sorted((r["packet_id"], int(r["detail"].split(" an estimated ")[1].split("+")[0]))
                   for r in got.collect())
    assert found == running_estimates(trace, 20)
    assert any(e > 20 for _, e in found)


def test_without_collisions_the_sketch_equals_the_exact_rule(packets):
    trace = [syn(i, 10 * i, src=5) for i in range(80)]
    assert rows(sk.cms_syn_floods(packets(trace)), "packet_id", "detail") == rows(
        syn_floods(packets(trace)), "packet_id", "detail")


def test_builtin_sketch_has_the_same_size(packets):
    df = sk.builtin_syn_sketch(packets([syn(i, i, src=i) for i in range(500)]), [F.lit(1).alias("k")])
    assert rows(df, F.length("sketch"), sk.sketch_size()) == [(65588, 500)]


def estimate(spark, n, **kind):
    items = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("item"))
    return sk.hll_estimate(sk.hll_registers(items, ["g"], "item"), ["g"], **kind).first()["n_estimate"]


def test_cardinalities(spark):
    assert abs(estimate(spark, 1) - 1) < 0.01
    assert abs(estimate(spark, 50) - 50) < 5
    assert 18_000 < estimate(spark, 20_000) < 22_000
    for n in (1, 50, 300, 1000, 20_000):
        assert 0.8 * n < estimate(spark, n, textbook=True) < 1.2 * n


def test_estimate_is_the_formula(spark):
    for n in (90, 400, 3000):
        registers = spark.range(n).select(sk.hll_position("id").alias("p")).groupBy("p.bucket").agg(
            F.max("p.rank").alias("rank")).collect()
        m, empty = 1024, 1024 - len(registers)
        raw = 0.7213 / (1 + 1.079 / m) * m * m / (empty + sum(2.0 ** -r["rank"] for r in registers))
        want = m * math.log(m / empty) if empty / m > 0.9 else raw
        assert math.isclose(estimate(spark, n), want, rel_tol=1e-12)


def test_repeats_change_nothing_and_merging_is_the_union(spark):
    a = spark.range(0, 600).select(F.lit("a").alias("part"), F.lit(1).alias("g"), "id")
    b = spark.range(400, 900).select(F.lit("b").alias("part"), F.lit(1).alias("g"), "id")
    parts = sk.hll_registers(a.union(b).union(a), ["part", "g"], "id")
    merged = sk.hll_merge(parts, ["g"])
    whole = sk.hll_registers(spark.range(900).select(F.lit(1).alias("g"), "id"), ["g"], "id")
    assert rows(merged, "bucket", "rank") == rows(whole, "bucket", "rank")


def test_positions_cover_all_registers(spark):
    p = spark.range(40_000).select(sk.hll_position("id").alias("p")).select("p.*")
    r = p.agg(F.min("bucket"), F.max("bucket"), F.countDistinct("bucket"), F.min("rank"), F.max("rank")).first()
    assert r[:4] == (0, 1023, 1024, 1) and 10 < r[4] <= 55


@pytest.mark.parametrize("threshold", [25, 90, 130, 200, 700])
def test_scan_alerts_at_any_threshold_follow_the_sketch_packet_by_packet(spark, packets, threshold):
    ports = [(7919 * i) % 60_000 for i in range(1500)]
    placed = dict(spark.createDataFrame([(p,) for p in set(ports)], "p int").select("p", sk.hll_position("p").alias("at")).collect())
    ranks, want, m = {}, None, 1024
    for i, p in enumerate(ports):
        bucket, rank = placed[p]
        ranks[bucket] = max(rank, ranks.get(bucket, 0))
        empty = m - len(ranks)
        raw = 0.7213 / (1 + 1.079 / m) * m * m / (empty + sum(2.0**-r for r in ranks.values()))
        if (m * math.log(m / empty) if empty / m > 0.9 else raw) >= threshold:
            want = i
            break
    df = packets([packet(i, i, dport=p) for i, p in enumerate(ports)])
    assert rows(sk.hll_port_scans(df, threshold=threshold), "packet_id") == [(want,)]


@pytest.mark.parametrize("width, depth", [(2048, 4), (16, 2), (5, 6), (64, 1)])
def test_flood_alerts_of_any_size_follow_the_sketch_packet_by_packet(spark, packets, width, depth):
    rng = random.Random(width)
    trace = [syn(i, rng.randrange(5000), src=rng.choice([1, 2, 2, 2, 3, 4, 5, 6, 7, 8, 9])) for i in range(700)]
    sources = sorted({p[2] for p in trace})
    cells = {r["s"]: [tuple(c) for c in r["c"]] for r in spark.createDataFrame([(s,) for s in sources], "s long").select("s", sk.cms_cells("s", width, depth).alias("c")).collect()}
    counts, alerted, want = {}, set(), []
    for p in sorted(trace, key=lambda p: (p[1], p[0])):
        for cell in cells[p[2]]:
            counts[cell] = counts.get(cell, 0) + 1
        if p[2] not in alerted and min(counts[c] for c in cells[p[2]]) >= 50:
            alerted.add(p[2])
            want.append(p[0])
    got = sk.cms_syn_floods(packets(trace), threshold=50, width=width, depth=depth)
    assert [i for (i,) in rows(got, "packet_id")] == sorted(want)


def test_scan_alerts_on_estimates_follow_the_running_sketch(spark, packets):
    ports = [1000 + 7 * i for i in range(60)]
    bucket = dict(spark.createDataFrame([(p,) for p in ports], "p int").select(
        "p", sk.hll_position("p")["bucket"]).collect())
    seen, want = set(), None
    for i, p in enumerate(ports):
        seen.add(bucket[p])
        if want is None and len(seen) == 25:
            want = i
    df = packets([packet(i, 10 * i, dport=p) for i, p in enumerate(ports)])
    assert rows(sk.hll_port_scans(df), "packet_id") == [(want,)]
    assert rows(port_scans(df), "packet_id") == [(24,)]
    assert sk.hll_port_scans(df).first()["detail"].split("estimated ")[1].startswith("25 distinct")


def test_builtin_port_sketches(packets):
    df = packets([packet(i, i, dport=i % 40) for i in range(400)])
    got = sk.builtin_port_sketches(df).select(F.hll_sketch_estimate("sketch").alias("n")).first()["n"]
    assert 38 <= got <= 42
