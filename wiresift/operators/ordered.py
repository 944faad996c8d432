"""Ordered per-group computations that stay spread out when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# Spark cuts each map task's share of a group to k rows before the shuffle
# (WindowGroupLimit) only for k up to this setting.
GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
SALTS = 64


def spread(df: DataFrame, by: str) -> DataFrame:
    """The rows dealt out evenly, in shares that Spark sizes by their bytes.

    A task that reads a table takes as many rows as its split unfolds to. What it would sort or gather of them
    before a shuffle grows with the table; of a share it does not.
    """
    return df.repartition(by)


def kth_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The k-th row of each group in ``order``; groups with fewer rows give none.

    No task ever receives a whole group: up to the session's ``GROUP_LIMIT``
    Spark keeps k rows per group and map task before shuffling, and beyond it a
    first pass over salted groups keeps k rows of each salt.
    """
    if k > int(df.sparkSession.conf.get(GROUP_LIMIT)):
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
            .withColumn("_n", F.row_number().over(
                Window.partitionBy(*keys, "_salt").orderBy(*order)))
            .where(F.col("_n") <= k)
            .drop("_salt", "_n")
        )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", rank).where(F.col("_n") == k).drop("_n")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    piece: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Running sum of ``value`` per group, added as column ``name``.

    ``piece`` cuts each group into consecutive stretches (it must not decrease
    along ``order``, e.g. a time slice). Totals per piece are summed first with
    map-side aggregation, their running sum gives what precedes each piece, and
    the window over rows then runs per piece instead of per group.
    """
    rows = df.withColumn("_piece", piece).withColumn("_value", value.cast("long"))
    cut = [*keys, "_piece"]
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*cut).agg(F.sum("_value").alias("_total"))
        .select(*cut, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    )
    local = Window.partitionBy(*cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_local", F.sum("_value").over(local))
        .join(carry, cut)
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_piece", "_value", "_before", "_local")
    )


def previous_row(
    df: DataFrame, keys: Sequence[str], order: str, piece: Column, columns: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    """Add the columns of the preceding row of the group, cut into pieces likewise.

    The first row of a piece takes its predecessor from the last row of the
    nearest earlier piece.
    """
    rows = df.withColumn("_piece", piece).withColumn("_row", F.struct(*columns))
    cut = [*keys, "_piece"]
    edges = (
        rows.groupBy(*cut).agg(F.max_by("_row", order).alias("_last"))
        .select(*cut, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_piece")).alias("_edge"))
    )
    near = F.lag("_row").over(Window.partitionBy(*cut).orderBy(order))
    both = rows.withColumn("_near", near).join(edges, cut)
    previous = F.coalesce(F.col("_near"), F.col("_edge"))
    return both.select(*df.columns, *[previous[c].alias(prefix + c) for c in columns])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], bin_width: float
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per name.

    Equal values are counted first; the running count over values (cut into
    bins of ``bin_width``) then tells which value holds each rank, so no task
    gathers a group's values. Nulls are ignored.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = running_total(
        counted, keys, [value], F.floor(F.col(value) / bin_width), F.col("_n"), "_upto")
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    ranked = upto.join(sizes, list(keys))
    aggs, out = [], []
    for name, p in probabilities.items():
        position = (F.col("_size") - 1) * F.lit(p)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            aggs.append(F.min(F.when(F.col("_upto") > rank, F.col(value))).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return ranked.groupBy(*keys, "_size").agg(*aggs).select(*keys, *out)
