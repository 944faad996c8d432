"""Mixing sources to target weights by fitting a budget of words exactly.

A source's target is met in whole passes over it and a remaining budget. For
that budget its documents are counted by length, every length gives its share
rounded down, and a bounded-knapsack dynamic programme over the lengths that are
left fits what rounding leaves open. Which documents of a length go in is
decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from wiresift.llm.common import documents, expand, free_names, stored, text_key

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_REPEATS = 2
SEED = 77_003
DP_WORDS = 1 << 16
BUCKET_ROWS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column | str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to the budget as they can.

    Shares rounded down first; longest first down to the last ``dp_words``; then
    the programme over sums up to what is left. It stops once the budget is
    met exactly, else takes the largest sum below it, or the smallest one above
    where that is nearer.
    """
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    taken = np.zeros(len(lengths), dtype=np.int64)
    words = int((lengths * counts).sum())
    if budget <= 0 or words == 0:
        return taken
    if budget >= words:
        return counts.copy()
    taken = np.array([int(c) * int(budget) // words for c in counts], dtype=np.int64)
    left = int(budget) - int((taken * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if lengths[i] and left - dp_words >= lengths[i]:
            more = min(int(counts[i] - taken[i]), (left - dp_words) // int(lengths[i]))
            taken[i] += more
            left -= more * int(lengths[i])
    spare = counts - taken
    size = 2 * left  # a sum further above is no nearer than taking nothing
    reached = np.zeros(size + 1, dtype=bool)
    reached[0] = True
    item_of = np.full(size + 1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for i in np.argsort(lengths, kind="stable"):
        length, n = int(lengths[i]), int(spare[i])
        if length == 0 or length > size:
            continue
        n, piece = min(n, size // length), 1
        while n > 0 and not reached[left]:
            piece_n = min(piece, n)
            weight = piece_n * length
            new = reached[: size + 1 - weight] & ~reached[weight:]
            item_of[weight:][new] = len(items)
            reached[weight:] |= new
            items.append((int(i), piece_n))
            n, piece = n - piece_n, piece * 2
        if reached[left]:
            break
    below = int(np.flatnonzero(reached[: left + 1])[-1])
    above = np.flatnonzero(reached[left:])
    best = left + int(above[0]) if above.size and above[0] < left - below else below
    while best > 0:
        i, n = items[item_of[best]]
        taken[i] += n
        best -= n * int(lengths[i])
    return taken


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST_REPEATS, weights=WEIGHTS) -> DataFrame:
    """Targets of sources: (source, source_size) -> also (source_no, target).

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` times all words. A target stops at ``most`` times its source's
    size and the excess goes to the others by weight: the common level is the
    first, going up by size per weight, that its own source does not exceed.
    The table has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    no = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_no"), F.lit(len(weights))) + 1).cast("int"))
    by_room = Window.orderBy("_full_at", "source_no")
    whole = Window.partitionBy()
    table = (
        sizes.withColumn("source_no", no)
        .withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * float(most))
        .withColumn("_full_at", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(whole) * float(share))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_budget") - F.col("_full")) / F.col("_open"))
    )
    first = F.min(F.when(F.col("_level") <= F.col("_full_at"), F.struct("_full_at", "source_no", "_level"))).over(whole)
    table = table.withColumn("_common", first.getField("_level"))
    target = F.coalesce(F.least(F.col("_cap"), F.col("_common") * F.col("_weight")), F.col("_cap"))
    return table.select("source", "source_size", "source_no", target.alias("target"))


def _quotas(histogram: pd.DataFrame) -> pd.DataFrame:
    size, target = int(histogram["source_size"].iloc[0]), float(histogram["target"].iloc[0])
    passes = min(MOST_REPEATS, int(target // size)) if size else 0
    histogram["passes"] = passes
    histogram["quota"] = fit_budget(histogram["words"].to_numpy(), histogram["items"].to_numpy(), round(target) - passes * size)
    return histogram[["source_no", "words", "items", "passes", "quota"]]


def mix(rows: DataFrame, share: float = SHARE, most: float = MOST_REPEATS, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """How often each document goes into the mix.

    ``rows`` has doc_id, text_key, source and size (words). One row comes back
    for each different one, with ``rows`` (how often it was there), source_size,
    target and ``copies`` (0 to ``most``) of each of them. Where some of a row's repetitions are taken once
    more than the others, there are two such rows. Null sources form one
    source, the last. A document without words meets no target and gets 0
    copies. An empty table gives no rows.

    Buckets of the seeded hash keep a length that most documents share from
    meeting in one task: whole buckets are counted, only ranks within one are
    sorted.
    """
    keys = ["doc_id", "text_key", "source", "size"]
    items = stored(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), "mix-items"
    )
    sources = stored(source_targets(items.groupBy("source").agg(F.sum(F.col("rows") * F.col("size")).alias("source_size")), share, most, weights), "mix-sources")
    known = items.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    quotas = stored(
        known.groupBy("source_no", F.col("size").alias("words"), "source_size", "target").agg(F.sum("rows").alias("items"))
        .groupBy("source_no").applyInPandas(_quotas, "source_no int, words long, items long, passes int, quota long"),
        "mix-quotas",
    )
    seeded = F.xxhash64(F.lit(seed), "doc_id", "text_key")
    ranked = (
        known.join(quotas.withColumnRenamed("words", "size"), ["source_no", "size"])
        .withColumn("_hash", seeded)
        .withColumn("_buckets", F.ceil(F.col("items") / F.lit(BUCKET_ROWS)))
        .withColumn("_bucket", F.floor(F.shiftrightunsigned("_hash", 33) * F.col("_buckets") / F.lit(float(1 << 31))).cast("long"))
    )
    group = ["source_no", "size", "_bucket"]
    before = Window.partitionBy("source_no", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranked.groupBy(*group).agg(F.sum("rows").alias("_n"))
        .select(*group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    ahead = F.coalesce(F.sum("rows").over(Window.partitionBy(*group).orderBy("_hash", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = F.greatest(F.lit(0).cast("long"), F.least(F.col("rows"), F.col("quota") - F.col("_start") - F.col("_ahead")))
    some = lambda n, copies: F.struct(n.alias("rows"), copies.cast("int").alias("copies"))
    parts = F.when(F.col("size") > 0, F.array(some(F.col("_more"), F.col("passes") + 1), some(F.col("rows") - F.col("_more"), F.col("passes")))).otherwise(
        F.array(some(F.col("rows"), F.lit(0))))
    return (
        ranked.withColumn("_ahead", ahead)
        .join(starts, group)
        .withColumn("_more", chosen)
        .select(*keys, "source_size", "target", F.explode(F.filter(parts, lambda p: p["rows"] > 0)).alias("_p"))
        .select(*keys, "_p.rows", "source_size", "target", "_p.copies")
    )


def measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key().alias("text_key"), "source", word_count().alias("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns it came with, whatever their names.

    Rows repeated whole are brought together first, as what is taken of them is a number.
    """
    key, doc, source, own_doc, own_source, taken, row, copy = free_names(docs, "key", "doc", "source_", "own_doc", "own_source", "taken", "row", "copy")
    hashed = [F.map_entries(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in docs.schema.fields]
    keyed = docs.withColumn(key, F.xxhash64(*hashed))
    choice = mix(keyed.select("doc_id", F.col(key).alias("text_key"), "source", word_count().alias("size")), **options)
    choice = choice.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("source").alias(source)).agg(F.sum(F.col("rows") * F.col("copies")).alias(taken))
    whole = keyed.groupBy(F.col("doc_id").alias(own_doc), key, F.col("source").alias(own_source)).agg(F.first(F.struct(*docs.columns)).alias(row))
    same = (whole[key] == choice[key]) & F.col(own_doc).eqNullSafe(F.col(doc)) & F.col(own_source).eqNullSafe(F.col(source))
    both = whole.join(choice.where(F.col(taken) > 0), same).select(row, taken)
    return expand(both, taken, copy).select(f"{row}.*")


def op2_subset_sum_mix(spark, sf_dir) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it."""
    choice = mix(measured(documents(spark, sf_dir)))
    return expand(choice, "rows", "_row").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source",
    )
