"""Sharding by a keyed permutation of row numbers.

Rows are numbered 0 .. N-1 by their content, a Feistel network over the smallest
even number of bits that holds N permutes the numbers, and a number that leaves
the range is sent through the network again until it is back (cycle walking).
The permuted number p lies in shard ``p mod shards`` at slot ``p div shards``.
Both can be computed from a row's number alone, and the number from both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from wiresift.llm.common import documents, expand, stored

SHARDS = 40
SEED = 20_240_117
ROUNDS = 8
BLOCK_ROWS = 1 << 16
FRAME_BYTES = 16


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Permutation:
    """A bijection of 0 .. total-1, fixed by the seed."""

    total: int
    seed: int = SEED
    rounds: int = ROUNDS

    @property
    def half(self) -> int:
        return max(1, (max(self.total - 1, 1).bit_length() + 1) // 2)

    def _key(self, turn: int) -> np.uint64:
        return _mixed(np.array([(self.seed * 0x9E3779B97F4A7C15 + turn + 1) % 2**64], dtype=np.uint64))[0]

    def _network(self, x: np.ndarray, turns) -> np.ndarray:
        mask, half = np.uint64((1 << self.half) - 1), np.uint64(self.half)
        left, right = x >> half, x & mask
        for turn in turns:
            left, right = right, left ^ (_mixed(right + self._key(turn)) & mask)
        return (right << half) | left  # halves swapped, so that running the turns backwards undoes it

    def _walk(self, numbers, turns) -> np.ndarray:
        x = np.asarray(numbers, dtype=np.uint64)
        with np.errstate(over="ignore"):
            out = self._network(x, turns)
            astray = np.flatnonzero(out >= self.total)
            while astray.size:
                out[astray] = self._network(out[astray], turns)
                astray = astray[out[astray] >= self.total]
        return out.astype(np.int64)

    def forward(self, numbers) -> np.ndarray:
        return self._walk(numbers, range(self.rounds))

    def backward(self, places) -> np.ndarray:
        return self._walk(places, range(self.rounds - 1, -1, -1))


def number_rows(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int]:
    """Rows with ``row_number`` from 0, gapless, and their count.

    The order is by a hash of the whole row, so it depends on the content alone
    and not on files or partitions. Equal rows are interchangeable: they are
    counted before the shuffle and opened again afterwards, so a row repeated
    any number of times is never gathered in one task. Numbers are dealt in
    blocks of about ``block_rows``, each starting where the one before ends.
    """
    names = rows.columns
    counted = stored(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies")), "row-counts")
    total = counted.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_rows))
    counted = counted.withColumn("_hash", F.xxhash64(*names)).withColumn("_in", F.pmod(F.col("_hash"), F.lit(blocks)))
    before = Window.orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counted.groupBy("_in").agg(F.sum("_copies").alias("_rows"))
        .select("_in", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    earlier = Window.partitionBy("_in").orderBy("_hash", *names).rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        counted.withColumn("_earlier", F.coalesce(F.sum("_copies").over(earlier), F.lit(0)))
        .join(starts, "_in")
        .withColumn("_first", F.col("_start") + F.col("_earlier"))
        .select(*names, "_copies", "_first")
    )
    opened = expand(numbered, "_copies", "_copy")
    return opened.select(*names, (F.col("_first") + F.col("_copy")).alias("row_number")), total


def shard_rows(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every row with its ``row_number``, ``shard`` and ``slot``; any columns that can be grouped by.

    Shards differ by one row at most and slots are gapless from 0. The same rows
    give the same result however they are stored. An empty table gives no rows;
    nulls are values like any other; repeated rows get a place each. Names
    beginning with an underscore are kept for the operator's own columns.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    numbered, total = number_rows(rows)
    order = Permutation(total, seed)

    @F.pandas_udf("long")
    def permuted(numbers: pd.Series) -> pd.Series:
        return pd.Series(order.forward(numbers.to_numpy()))

    return (
        numbered.withColumn("_place", permuted("row_number"))
        .withColumn("shard", F.pmod(F.col("_place"), F.lit(shards)).cast("int"))
        .withColumn("slot", F.floor(F.col("_place") / F.lit(shards)).cast("long"))
        .drop("_place")
    )


def row_at(shard, slot, total: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """The row numbers found at these slots: the inverse of ``shard_rows``."""
    places = np.asarray(slot, dtype=np.int64) * shards + np.asarray(shard, dtype=np.int64)
    return Permutation(total, seed).backward(places)


def op6_feistel_shards(spark, sf_dir) -> DataFrame:
    """Documents dealt to 40 shards whose row counts differ by one at most; a null text has no bytes."""
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text).cast("long") + FRAME_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shard_rows(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
