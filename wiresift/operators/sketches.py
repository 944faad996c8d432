"""Mergeable sketches as tables: Count-Min counts and HyperLogLog registers.

A sketch is a relation (one row per cell or register in use), so building is a
grouped aggregate with map-side partials, merging is another one, and a lookup
is a join. Windows play the part of clearing: each has its own cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wiresift.functions.clock import floor_div, window_start
from wiresift.functions.net import syn_only, with_shard
from wiresift.operators.alerts import to_alert
from wiresift.operators.ordered import kth_row, running_total
from wiresift.operators.rates import first_sightings, flood_detail, scan_detail, syn_counts
from wiresift.rules import (
    CMS_DEPTH,
    CMS_WIDTH,
    HLL_BITS,
    PORT_SCAN_RULE,
    PORT_SCAN_SEVERITY,
    PORT_SCAN_THRESHOLD,
    SYN_FLOOD_RULE,
    SYN_FLOOD_SEVERITY,
    SYN_FLOOD_THRESHOLD,
    WINDOW_MS,
)

MODULUS = 2147483647  # 2^31 - 1
# Multiplier and offset of each row's hash; below 2^30, so that products with
# 32-bit keys stay in a signed long.
CMS_HASHES = ((373587883, 911), (679295311, 36007), (899809363, 500009), (982451653, 7919))
CELL_MAX = 4294967295  # cells saturate at 32 bits
CELL_SLICE_MS = 100
HLL_SPARSE = 0.9  # share of empty registers above which linear counting is used


# --- Count-Min ---------------------------------------------------------------

def cms_hash(row: int) -> tuple[int, int]:
    """Multiplier and offset of a hash row; those past the named ones follow a rule."""
    if row < len(CMS_HASHES):
        return CMS_HASHES[row]
    return (536870912 + 15485863 * row) % 1073741789, 104729 * row


def cms_cells(key: str, width: int = CMS_WIDTH, depth: int = CMS_DEPTH) -> Column:
    """Array of (cms_row, cell), one per hash row."""
    k = F.col(key).cast("long")
    return F.array(*[
        F.struct(F.lit(r).alias("cms_row"),
                 F.pmod(F.pmod(k * a + b, F.lit(MODULUS)), F.lit(width)).cast("int").alias("cell"))
        for r, (a, b) in enumerate(map(cms_hash, range(depth)))
    ])


def cms_table(counts: DataFrame, key: str, n: str, keys: Sequence[str], **size) -> DataFrame:
    """Sketch cells per group from per-key counts: (*keys, cms_row, cell, n_cell)."""
    return (
        counts.select(*keys, n, F.inline(cms_cells(key, **size)))
        .groupBy(*keys, "cms_row", "cell")
        .agg(F.least(F.sum(n), F.lit(CELL_MAX)).alias("n_cell"))
    )


def cms_merge(tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up the cells of several sketches of the same size."""
    return tables.groupBy(*keys, "cms_row", "cell").agg(
        F.least(F.sum("n_cell"), F.lit(CELL_MAX)).alias("n_cell"))


def cms_lookup(points: DataFrame, key: str, table: DataFrame, keys: Sequence[str], **size) -> DataFrame:
    """Estimate per (*keys, key): the least of its cells. Never too low."""
    cells = points.select(*keys, key, F.inline(cms_cells(key, **size)))
    return (
        cells.join(table, [*keys, "cms_row", "cell"])
        .groupBy(*keys, key)
        .agg(F.min("n_cell").alias("n_estimate"))
    )


def syn_sketch(events: DataFrame, width_ms: int = WINDOW_MS) -> DataFrame:
    """SYN counts of all sources, one sketch per window."""
    return cms_table(syn_counts(events, width_ms), "src_ip", "n_syn", ["window_start_ms"])


def syn_estimates(events: DataFrame, width_ms: int = WINDOW_MS) -> DataFrame:
    """Exact and estimated SYN count per source and window."""
    counts = syn_counts(events, width_ms)
    table = cms_table(counts, "src_ip", "n_syn", ["window_start_ms"])
    estimates = cms_lookup(counts, "src_ip", table, ["window_start_ms"])
    return counts.join(estimates, ["src_ip", "window_start_ms"])


def sharded_syn_sketches(events: DataFrame, shards: int, width_ms: int = WINDOW_MS) -> DataFrame:
    """One sketch per shard and window, as separate workers would hold them."""
    counts = with_shard(syn_counts(events, width_ms), shards)
    return cms_table(counts, "src_ip", "n_syn", ["shard", "window_start_ms"])


def cms_syn_floods(
    events: DataFrame,
    threshold: int = SYN_FLOOD_THRESHOLD,
    width_ms: int = WINDOW_MS,
    slice_ms: int = CELL_SLICE_MS,
    width: int = CMS_WIDTH,
    depth: int = CMS_DEPTH,
) -> DataFrame:
    """One alert per source and window, when its running estimate reaches the threshold.

    The estimate after a SYN is the least running count among its source's
    cells, which other sources share, so it may jump past the threshold. Only
    sources whose estimate ends at or past the threshold can reach it: cells
    are totalled per window first, and running counts, per time slice of a
    cell, are taken in the cells of those sources alone.
    """
    key, size = ["window_start_ms"], {"width": width, "depth": depth}
    counts = syn_counts(events, width_ms)
    table = cms_table(counts, "src_ip", "n_syn", key, **size)
    over = cms_lookup(counts, "src_ip", table, key, **size).where(F.col("n_estimate") >= threshold).select("src_ip", *key)
    wanted = over.select(*key, F.inline(cms_cells("src_ip", **size))).distinct()
    syns = events.where(syn_only()).select(
        "packet_id", "timestamp_ms", "src_ip", "dst_ip",
        window_start(width_ms).alias("window_start_ms"))
    cells = syns.select("*", F.inline(cms_cells("src_ip", **size))).join(wanted, [*key, "cms_row", "cell"], "left_semi")
    filled = running_total(
        cells,
        keys=["window_start_ms", "cms_row", "cell"],
        order=["timestamp_ms", "packet_id"],
        piece=floor_div("timestamp_ms", slice_ms),
        value=F.lit(1),
        name="n_cell",
    )
    packet = ["src_ip", "window_start_ms", "timestamp_ms", "packet_id", "dst_ip"]
    reached = (
        filled.where(F.col("n_cell") >= threshold).join(over, ["src_ip", *key], "left_semi")
        .groupBy(*packet)
        .agg(F.count("*").alias("n_rows"), F.min("n_cell").alias("n_estimate"))
        .where(F.col("n_rows") == depth)
    )
    crossing = kth_row(reached, ["src_ip", "window_start_ms"], ["timestamp_ms", "packet_id"], 1)
    return to_alert(
        crossing, SYN_FLOOD_RULE, SYN_FLOOD_SEVERITY,
        flood_detail(F.col("n_estimate"), width_ms), "Anomaly", stage=2)


def builtin_syn_sketch(events: DataFrame, keys: Sequence[Column], seed: int = 42) -> DataFrame:
    """Spark's own Count-Min sketch of SYN sources, of the same size, as bytes.

    Bytes 5 to 12 of the serialised sketch hold the number of items in it.
    """
    sketch = F.count_min_sketch(
        "src_ip", F.lit(2.0 / CMS_WIDTH), F.lit(1 - 2.0 ** -CMS_DEPTH), F.lit(seed))
    return events.where(syn_only()).groupBy(*keys).agg(sketch.alias("sketch"))


def sketch_size(sketch: str = "sketch") -> Column:
    return F.conv(F.hex(F.substring(sketch, 5, 8)), 16, 10).cast("long")


# --- HyperLogLog -------------------------------------------------------------

def hll_position(item: Column | str, bits: int = HLL_BITS) -> Column:
    """(bucket, rank) of an item: the first bits of its md5, then the run of zeros.

    The 64 leading bits are split into ``bits`` for the bucket and the rest for
    the rank, which is the place of the first one among them.
    """
    if not 4 <= bits <= 12:
        raise ValueError("bits must be between 4 and 12")
    c = F.col(item) if isinstance(item, str) else item
    digest = F.md5(c.cast("string").cast("binary"))
    head = F.conv(F.substring(digest, 1, 3), 16, 10).cast("long")
    tail = F.conv(F.substring(digest, 4, 13), 16, 10).cast("long")
    spare, rest_bits = 12 - bits, 64 - bits
    rest = F.shiftleft(head.bitwiseAND(F.lit((1 << spare) - 1).cast("long")), 52).bitwiseOR(tail)
    rank = F.when(rest == 0, rest_bits + 1).otherwise(rest_bits - F.length(F.bin(rest)) + 1)
    return F.struct(F.shiftright(head, spare).cast("int").alias("bucket"), rank.cast("int").alias("rank"))


def hll_registers(rows: DataFrame, keys: Sequence[str], item: str, bits: int = HLL_BITS) -> DataFrame:
    """(*keys, bucket, rank): the registers in use of one sketch per group."""
    return (
        rows.select(*keys, hll_position(item, bits).alias("p"))
        .groupBy(*keys, F.col("p.bucket").alias("bucket"))
        .agg(F.max("p.rank").alias("rank"))
    )


def hll_merge(registers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge sketches: the greatest rank of each register."""
    return registers.groupBy(*keys, "bucket").agg(F.max("rank").alias("rank"))


def hll_estimate(
    registers: DataFrame, keys: Sequence[str], bits: int = HLL_BITS, textbook: bool = False
) -> DataFrame:
    """Distinct-count estimate per group, without large-range correction.

    Linear counting while more than nine tenths of the registers are empty, the
    raw harmonic-mean estimate otherwise. That cut suits hashes that leave many
    registers empty; md5 mixes well, and between a tenth of the registers in
    use and about 2.5 values per register the raw estimate is then too high.
    ``textbook`` applies linear counting up to that point instead.
    """
    return (
        registers.groupBy(*keys)
        .agg(F.count("*").alias("n_used"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("inverse_sum"))
        .select(*keys, hll_formula(bits, textbook).alias("n_estimate"))
    )


def hll_formula(bits: int, textbook: bool = False) -> Column:
    """The estimate from ``n_used`` registers and the sum of 2 to the minus rank over them."""
    m = float(1 << bits)
    alpha = 0.7213 / (1.0 + 1.079 / m)  # fixed values of the estimator
    empty = F.lit(m) - F.col("n_used")
    raw = F.lit(alpha * m * m) / (empty + F.col("inverse_sum"))
    sparse = (empty > 0) & (raw <= 2.5 * m) if textbook else empty / m > HLL_SPARSE
    return F.when(sparse, F.lit(m) * F.log(F.lit(m) / empty)).otherwise(raw)


def hll_port_scans(
    events: DataFrame, threshold: float = PORT_SCAN_THRESHOLD, width_ms: int = WINDOW_MS, bits: int = HLL_BITS
) -> DataFrame:
    """Port-scan alerts on the running estimate instead of the exact distinct count.

    The estimate changes only where a packet raises a register. The first
    packets per register and rank give these steps, at most a few dozen a
    register; their running sums give the estimate after each, and the first
    at or past the threshold alerts.
    """
    m = float(1 << bits)
    group, arrival = ["src_ip", "window_start_ms"], ["timestamp_ms", "packet_id"]
    place = hll_position("dst_port", bits)
    placed = events.select("src_ip", *arrival, "dst_ip", (place["bucket"] * 64 + place["rank"]).alias("placed"))
    seen = first_sightings(placed, "placed", width_ms).withColumn("bucket", F.floor(F.col("placed") / 64)).withColumn("rank", F.col("placed") % 64)
    before = F.max("rank").over(Window.partitionBy(*group, "bucket").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1))
    steps = seen.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("rank") > F.col("_before")))
    upto = Window.partitionBy(*group).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, 0)
    half = lambda c: F.pow(F.lit(2.0), -F.col(c))
    running = steps.withColumn("n_used", F.sum(F.col("_before").isNull().cast("int")).over(upto)).withColumn(
        "inverse_sum", F.sum(half("rank") - F.coalesce(half("_before"), F.lit(0.0))).over(upto))
    reached = running.withColumn("n_estimate", hll_formula(bits)).where(F.col("n_estimate") >= threshold - 1e-9)
    crossing = kth_row(reached, group, arrival, 1)
    return to_alert(
        crossing, PORT_SCAN_RULE, PORT_SCAN_SEVERITY,
        scan_detail(F.round("n_estimate").cast("long"), width_ms), "Anomaly", stage=3)


def builtin_port_sketches(events: DataFrame, width_ms: int = WINDOW_MS, bits: int = HLL_BITS) -> DataFrame:
    """Spark's own HyperLogLog sketch of destination ports per source and window."""
    return events.groupBy("src_ip", window_start(width_ms).alias("window_start_ms")).agg(
        F.hll_sketch_agg("dst_port", bits).alias("sketch"))
