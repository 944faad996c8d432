"""A Merkle manifest of a data set: per language a tree over its rows, and a tree over those.

A node is (tree, idx, digest). At every level the nodes equijoin themselves on the
computed index of their siblings: idx XOR 1 where two make a run, the run's other
slots otherwise. The rows in slot 0 emit the parents. A tree whose level has one
node is done. Levels are written tables, each half as large as the one
below, so the plan never holds more than one join and a lost executor costs a level
at most.

Proofs go down the same levels: a node's proof is its siblings followed by its
parent's proof, joined on the parent's index. All leaves together so cost as
many joined rows as there are nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wiresift.llm.common import documents, stored

FANOUT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_EVERY = 7
STORED_EVERY = 4  # levels whose proofs are joined in one plan


def digest_of(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_digest(columns: dict[str, Column]) -> Column:
    """The digest of a row's fields, each as its byte count, a colon and the value, or ``-`` where null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in columns.values()]
    return digest_of(F.concat(*parts))


def numbered(rows: DataFrame, group: str, order: list[Column], purpose: str) -> DataFrame:
    """Rows stored with ``idx``, their number from 0 within ``group`` (null is a group too) by ``order``.

    Rows are sorted over all partitions; a partition holds a stretch of each of its
    groups, and stretches are numbered on from the totals before them. No
    group meets in one task.
    """
    key = F.col(group).asc_nulls_first()
    ordered = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    ordered = stored(ordered, purpose)
    part = F.shiftright("_at", 33)
    stretches = ordered.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stretches.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    known = ordered.withColumn("_p", part).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_p") == F.col("_part")))
    return known.withColumn("idx", F.col("_start") + F.col("_at") - F.col("_first")).drop("_at", "_p", "_group", "_part", "_first", "_start")


def shifted(idx: Column, shift: int, fanout: int) -> Column:
    """The index of the sibling ``shift`` slots on, counted round the run."""
    if fanout == 2:
        return idx.bitwiseXOR(F.lit(1).cast("long"))
    slot = F.pmod(idx, F.lit(fanout))
    return idx - slot + F.pmod(slot + shift, F.lit(fanout))


def with_siblings(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Nodes (tree, idx, n, digest) with ``siblings``: an array of ``fanout`` with the run's digests by slot, null where there is none and at the own one."""
    out = nodes
    for shift in range(1, fanout):
        other = nodes.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), F.col("digest").alias(f"_d{shift}"))
        out = out.join(other, (F.col("tree") == F.col("_tree")) & (shifted(F.col("idx"), shift, fanout) == F.col("_idx")), "left").drop("_tree", "_idx")
    slot = F.pmod(F.col("idx"), F.lit(fanout)).cast("int")
    by_shift = F.array(F.lit(None).cast("string"), *[F.col(f"_d{s}") for s in range(1, fanout)])
    by_slot = F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), lambda s: F.get(by_shift, F.pmod(s - slot, F.lit(fanout))))
    return out.select("tree", "idx", "n", "digest", by_slot.alias("siblings"))


def parent_digest(digest: Column, siblings: Column, slot: Column) -> Column:
    """The digest of a run, left to right, the node's own put in at its slot."""
    whole = F.transform(siblings, lambda d, s: F.when(s == slot, digest).otherwise(d))
    return digest_of(F.array_join(whole, ""))


def build(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The stored levels of all trees, lowest first: (tree, idx, n, digest, siblings).

    ``leaves`` is (tree, idx, n, digest) with idx gapless from 0 in each tree, and n the tree's
    number of leaves; in the levels n is the tree's number of nodes there. The only
    node of a level, n = 1, is the tree's root, whose siblings are all null.
    """
    widest = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes = [], leaves
    while True:
        level = stored(with_siblings(nodes, fanout), f"merkle-level-{len(levels)}")
        levels.append(level)
        if widest <= 1:
            return levels
        widest = -(-widest // fanout)
        slot_zero = level.where((F.col("n") > 1) & (F.pmod("idx", F.lit(fanout)) == 0))
        above = [F.floor(F.col("idx") / fanout).cast("long").alias("idx"), F.ceil(F.col("n") / fanout).cast("long").alias("n")]
        nodes = slot_zero.select("tree", *above, parent_digest(F.col("digest"), F.col("siblings"), F.lit(0)).alias("digest"))


def proofs(levels: list[DataFrame], fanout: int = FANOUT, above: DataFrame | None = None) -> DataFrame:
    """Every leaf (tree, idx, digest) with its tree's ``top`` digest and ``proof``: an array of (slot, siblings), lowest level first.

    ``above`` gives, by tree, (root, path) of the tree over the trees; path follows the proof. Without it the tops are the roots.
    Further columns of the lowest level stay.
    """
    step = "array<struct<slot:int,siblings:array<string>>>"
    down, known = None, ("tree", "idx", "n", "digest", "siblings")
    for number, level in reversed(list(enumerate(levels))):
        more = [c for c in level.columns if c not in known]
        top = level.where("n = 1").select("tree", "idx", "digest", *more, F.col("digest").alias("top"), F.expr(f"cast(array() as {step})").alias("proof"))
        if above is None:
            top = top.withColumn("root", F.col("top"))
        else:
            top = top.join(above, "tree").withColumn("proof", F.col("path")).drop("path")
        top = top.select("tree", "idx", "digest", *more, "top", "root", "proof")
        if down is None:
            here = top
        else:
            own = F.struct(F.pmod("idx", F.lit(fanout)).cast("int").alias("slot"), F.col("siblings").alias("siblings"))
            parents = down.select(F.col("tree").alias("_tree"), F.col("idx").alias("_idx"), "top", "root", F.col("proof").alias("_proof"))
            child = level.where("n > 1").join(parents, (F.col("tree") == F.col("_tree")) & (F.floor(F.col("idx") / fanout).cast("long") == F.col("_idx")))
            here = top.unionByName(child.select("tree", "idx", "digest", *more, "top", "root", F.concat(F.array(own), F.col("_proof")).alias("proof")))
        # a table every few levels keeps the plan short; the last one is left to the caller
        down = stored(here, f"merkle-proofs-{number}", "lz4") if number and number % STORED_EVERY == 0 else here
    return down


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest and its proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, step: parent_digest(digest, step["siblings"], step["slot"]))


def proof_digest(proof: Column) -> Column:
    """One digest of all siblings of a proof, lowest level first, left to right."""
    return digest_of(F.array_join(F.flatten(F.transform(proof, lambda step: step["siblings"])), ""))


def manifest(rows: DataFrame, group: str = "lang", fields: tuple[str, ...] = FIELDS, order: str = "doc_id", fanout: int = FANOUT, carry: dict[str, Column] | None = None) -> DataFrame:
    """Every row's ``order`` column, group, leaf, subroot, root and proof.

    Leaves of a group ascend by ``order``, null last; rows that share it follow their
    digests. Groups ascend by name, null first. ``carry`` names further expressions over the
    rows to hand through. Columns not in ``fields`` play no part; repeated rows are leaves
    of their own; an empty table gives no rows. The result reads stored tables only.
    """
    carry = carry or {}
    leaf = leaf_digest({name: F.col(name) for name in fields})
    own = rows.select(F.col(group).alias("_lang"), F.col(order).alias("_order"), leaf.alias("digest"), *[c.alias(f"_c_{n}") for n, c in carry.items()])
    leaves = stored(numbered(own, "_lang", [F.col("_order").asc_nulls_last(), F.col("digest").asc()], "merkle-rows"), "merkle-leaves")
    # the groups' numbers, dealt like those of rows
    names = numbered(leaves.groupBy("_lang").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_all", F.lit(0)), "_all", [F.col("_lang").asc_nulls_first()], "merkle-groups")
    names = stored(names.select("_lang", F.col("idx").alias("tree"), F.col("_rows").alias("n")), "merkle-trees")
    named = names.withColumnRenamed("_lang", "_name")
    whole = stored(leaves.join(named, F.col("_lang").eqNullSafe(F.col("_name"))).drop("_name"), "merkle-numbered")
    levels = build(whole.select("tree", "idx", "n", "digest"), fanout)
    tops = levels[0].where("n = 1")
    for level in levels[1:]:
        tops = tops.union(level.where("n = 1"))
    trees = names.count()
    over = build(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("n"), "digest"), fanout)
    above = stored(proofs(over, fanout).select(F.col("idx").alias("tree"), "root", F.col("proof").alias("path")), "merkle-above")
    # the rows' own columns come in before the long proofs do
    leaves = levels[0].join(whole.drop("digest", "n"), ["tree", "idx"])
    return proofs([leaves, *levels[1:]], fanout, above).select(
        F.col("_order").alias(order), F.col("_lang").alias(group), "tree", "idx", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", "proof",
        *[F.col(f"_c_{n}").alias(n) for n in carry],
    )


def tampered(columns: tuple[str, ...] = FIELDS) -> Column:
    """The leaf digest after one more character is claimed, in the rows whose id's crc32 7 divides."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0
    claimed = {name: F.col(name) for name in columns}
    claimed["n_chars"] = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return leaf_digest(claimed)


def verified(rows: DataFrame) -> DataFrame:
    """The manifest of ``documents`` rows, each checked against the root with a leaf that may have been tampered with."""
    found = manifest(rows, carry={"claimed": tampered()}).withColumn("folded_root", fold(F.col("claimed"), F.col("proof")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir) -> DataFrame:
    """Every document's leaf, subroot, root, a digest of its proof, and whether its (tampered) leaf leads to the root."""
    return verified(documents(spark, sf_dir)).select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified", "lang", F.col("idx").alias("leaf_idx"),
    )
