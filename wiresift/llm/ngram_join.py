"""Joining texts by the Jaccard similarity of their word n-grams, with a forest of MinHash prefix tries.

Every distinct n-gram set gets a signature of ``TREES`` x ``DEPTH`` minima. A tree
of the forest is the sorted list of its slice of the signatures; sets that agree
on a prefix stand together in it. The length of the prefix is fixed in advance: the
longest with which pairs at the threshold meet in some tree with the target
probability, whatever the data. What
meets is compared on the whole signature, and what is near enough there is
grouped by connected components. In each group all pairs are verified exactly on
their n-grams, in blocks, and only counts and a spanning forest of the links are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from wiresift.llm.common import blocks, documents, free_names, stored, text_key
from wiresift.llm.components import components

WORDS = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
RECALL = 0.998
MARGIN = 0.15  # four standard deviations of the estimate at the threshold
BUCKET_ROWS = 1024
GROUP_ROWS = 512
GROUP_NGRAMS = 1 << 20
COLUMNS = 4096
BLOCK_BYTES = 1 << 19
SEED = 31_337

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x100000001B3)
_TURN = np.uint64(0x9E3779B97F4A7C15)


def shortened_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which two sets at the threshold share one in some tree with probability ``recall``."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


# --- n-grams and signatures ----------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its word n-grams; of all its words if they are fewer.

    Words are lower-cased runs without ASCII white space.
    """
    data = [(t or "").lower().encode() for t in texts]
    sizes = np.array([len(d) + 1 for d in data], dtype=np.int64)
    bytes_ = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    inside = ~_SPACE[bytes_]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not starts.size:
        return [np.empty(0, dtype=np.uint64) for _ in texts]
    lengths = ends - starts
    out, at = [], 0
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _BASE, dtype=np.uint64))
        letters = np.flatnonzero(inside)
        within = letters - np.repeat(starts, lengths)
        words = _mixed(np.add.reduceat((bytes_[letters].astype(np.uint64) + np.uint64(1)) * powers[within], np.concatenate([[0], np.cumsum(lengths)[:-1]])))
        per_text = np.bincount(np.searchsorted(np.cumsum(sizes), starts, side="right"), minlength=len(texts))
        for count in per_text.tolist():
            own = words[at : at + count]
            at += count
            size = min(n, count)
            grams = np.zeros(max(0, count - size + 1) if count else 0, dtype=np.uint64)
            for k in range(size):
                grams = grams * _TURN + own[k : k + len(grams)]
            out.append(np.unique(_mixed(grams + np.uint64(size))))
    return out


def hashers(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32), rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(grams: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minima of all hash functions, 16 bits of each, mixed so that equal bits mean little for unequal minima."""
    low = np.full(len(flips), np.iinfo(np.uint32).max, dtype=np.uint32)
    half = (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(half), COLUMNS):
        low = np.minimum(low, ((half[None, at : at + COLUMNS] ^ flips[:, None]) * factors[:, None]).min(axis=1))
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def signatures(rows: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, text_key, node, size, signature) of all rows (doc_id, text). ``node`` is a digest of the n-gram set,
    or of the text key where there is no word, so that such texts are alike only if identical."""
    flips, factors = hashers()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in blocks(batches, 2, BLOCK_BYTES):
            out = []
            for (doc_id, key, _), grams in zip(some, ngram_sets([t for _, _, t in some], n), strict=True):
                node = xxhash.xxh3_128_digest(grams.tobytes() if grams.size else b"no words %d" % key)
                out.append((doc_id, key, node, len(grams), signature(grams, flips, factors).tobytes()))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "size", "signature"])

    keyed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return stored(keyed.mapInArrow(sign, "doc_id long, text_key long, node binary, size int, signature binary"), "ngram-signatures")


# --- blocks of groups ------------------------------------------------------------------

def pair_blocks(rows: DataFrame, keys: list[str], parts: Column, by: str) -> DataFrame:
    """Every group of rows as all pairs of its parts: (left, right) with ``own`` the part of the row.

    Each pair of rows of a group meets in exactly one pair of parts, or in one with both in the same part.
    """
    own = F.pmod(F.xxhash64(by), F.col("_parts")).cast("int")
    return (
        rows.withColumn("_parts", parts.cast("int")).withColumn("own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("left", F.least("own", "_other")).withColumn("right", F.greatest("own", "_other"))
        .drop("_parts", "_other")
        .repartition(*keys, "left", "right").sortWithinPartitions(*keys, "left", "right", "own", by)
    )


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The consecutive rows with equal keys, one table a group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        values = list(zip(*columns, strict=True))
        start = 0
        for i, value in enumerate(values):
            if value != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, value
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def spanning(pairs: Iterator[tuple[int, np.ndarray]], size: int) -> Iterator[tuple[int, int]]:
    """Of the pairs (i, its partners) those that join what was not joined before."""
    above = list(range(size))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for i, partners in pairs:
        for j in partners.tolist():
            a, b = top(i), top(j)
            if a != b:
                above[max(a, b)] = min(a, b)
                yield i, j


# --- the forest ------------------------------------------------------------------------

def near_edges(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) between nodes that share a prefix and whose signatures agree nearly to the threshold.

    ``sets`` has node and signature, one row a node. Of a bucket a spanning forest is kept, longest prefixes first.
    """
    depth, keys = shortened_depth(threshold, recall=recall), ["tree", "prefix", "left", "right"]
    placed = sets.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).withColumn(
        "prefix", F.substring("signature", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * depth))
    )
    shared = placed.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = placed.join(shared, ["tree", "prefix"])
    rows = pair_blocks(met, ["tree", "prefix"], F.ceil(F.col("_n") / bucket_rows), "node").select(*keys, "own", "node", "signature")
    least = threshold - MARGIN

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, keys):
            if group.num_rows < 2:
                continue
            nodes = group.column("node").to_pylist()
            tree, left, right = (group.column(k)[0].as_py() for k in ("tree", "left", "right"))
            values = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16).reshape(len(nodes), -1)
            own = group.column("own").to_numpy()
            label = values[:, tree * DEPTH : (tree + 1) * DEPTH]
            order = np.lexsort(label.T[::-1])  # the trie's leaves in order: longest common prefixes are neighbours
            values, own, nodes = values[order], own[order], [nodes[i] for i in order]

            def pairs() -> Iterator[tuple[int, np.ndarray]]:
                for i in range(len(nodes) - 1):
                    close = (values[i + 1 :] == values[i]).mean(axis=1) >= least
                    if left != right:
                        close &= own[i + 1 :] != own[i]
                    yield i, np.flatnonzero(close) + i + 1

            found = list(spanning(pairs(), len(nodes)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.binary()), pa.array([nodes[j] for _, j in found], pa.binary())], ["a", "b"])

    return rows.mapInArrow(compare, "a binary, b binary")


# --- exact verification ------------------------------------------------------------------

def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each of the left sets shares with each of the right ones."""
    n = len(left)
    lengths = [len(s) for s in (*left, *right)]
    row = np.repeat(np.arange(len(lengths)), lengths)
    column = np.unique(np.concatenate([*left, *right]), return_inverse=True)[1]
    often = np.bincount(column) > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    out = np.zeros((n, len(right)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        block = np.zeros((len(lengths), min(COLUMNS, int(often.sum()) - first)), dtype=np.float32)
        block[row[a:b], column[a:b] - first] = 1
        out += block[:n] @ block[n:].T
    return out


def verified(members: DataFrame, threshold: float = THRESHOLD, group_rows: int = GROUP_ROWS, group_ngrams: int = GROUP_NGRAMS) -> DataFrame:
    """Rows (node, partner, links, texts): for each node how many rows and texts are linked to it, partner null; and a
    spanning forest of the links with partner set.

    ``members`` has group, node, copies, size and grams (packed). All pairs of a group are compared.
    """
    keys = ["group", "left", "right"]
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_grams"))
    parts = F.greatest(F.ceil(F.col("_n") / group_rows), F.ceil(F.col("_grams") / group_ngrams))
    rows = pair_blocks(members.join(sizes, "group"), ["group"], F.least(parts, F.col("_n")), "node").select(*keys, "own", "node", "copies", "grams")
    # two sets at the threshold share this much of their summed sizes
    share = threshold / (1 + threshold)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, keys):
            if group.num_rows < 2:
                continue
            nodes = group.column("node").to_pylist()
            sets = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
            copies, own = group.column("copies").to_numpy(), group.column("own").to_numpy()
            left, right = group.column("left")[0].as_py(), group.column("right")[0].as_py()
            a = np.flatnonzero(own == left)
            b = a if left == right else np.flatnonzero(own == right)
            if not a.size or not b.size:
                continue
            n = np.array([len(s) for s in sets])
            linked = overlaps([sets[i] for i in a], [sets[i] for i in b]) >= share * (n[a][:, None] + n[b][None, :]) - 1e-6
            if left == right:
                np.fill_diagonal(linked, False)
            out = [(nodes[i], None, int(x), int(t)) for i, x, t in zip(a, (linked * copies[b][None, :]).sum(axis=1), linked.sum(axis=1), strict=True) if t]
            if left != right:
                out += [(nodes[i], None, int(x), int(t)) for i, x, t in zip(b, (linked * copies[a][:, None]).sum(axis=0), linked.sum(axis=0), strict=True) if t]
            out += [(nodes[i], nodes[j], 0, 0) for i, j in spanning(((int(a[k]), b[np.flatnonzero(linked[k])]) for k in range(len(a))), len(nodes))]
            if out:
                types = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["node", "partner", "links", "texts"])

    return rows.mapInArrow(verify, "node binary, partner binary, links long, texts long")


def packed_grams(n: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in blocks(batches, 4, BLOCK_BYTES):
            grams = ngram_sets([r[4] for r in some], n)
            columns = [pa.array([r[k] for r in some], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([g.tobytes() for g in grams], pa.binary())], ["group", "node", "copies", "size", "grams"])

    return pack


def similar_texts(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL) -> DataFrame:
    """One row a document: doc_id, text_key, ``class_id`` (the smallest doc_id of all that links connect it
    to), ``class_size``, ``links`` (how many other documents have similarity ``threshold`` or more, copies included),
    ``text_links`` (how many other n-gram sets) and ``stays`` (whether it is the class's first by id and text key).

    Copies are one node, so no pairs of them are formed. A text with fewer than
    ``n`` words has one n-gram of all of them; one without words, null too, is
    linked to identical ones only. A null doc_id counts as larger than all; rows repeated whole
    are copies of which all or none stay. Other columns play no part.
    """
    signed = signatures(docs, n)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    nodes = stored(
        signed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first"), F.first("signature").alias("signature"), F.first("size").alias("size")),
        "ngram-nodes",
    )
    groups = components(near_edges(nodes.where("size > 0").select("node", "signature"), threshold, recall))
    members = groups.join(nodes.select("node", "copies", "size", "first"), "node").select(
        F.col("root").alias("group"), "node", "copies", "size", F.col("first.doc_id").alias("_doc"), F.col("first.text_key").alias("_key")
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (text_key() == F.col("_key"))
    texts = docs.select("doc_id", "text").join(members, same).select("group", "node", "copies", "size", "text")
    grams = stored(texts.mapInArrow(packed_grams(n), "group binary, node binary, copies long, size int, grams binary").dropDuplicates(["node"]), "ngram-members")
    checked = stored(verified(grams, threshold), "ngram-links")
    classes = components(checked.where("partner IS NOT NULL").select(F.col("node").alias("a"), F.col("partner").alias("b")))
    links = checked.where("partner IS NULL").groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    known = (
        nodes.select("node", "copies", "first").join(classes, "node", "left").join(links, "node", "left")
        .select("node", "copies", "first", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("texts", F.lit(0)).alias("text_links"))
    )
    whole = known.groupBy("root").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size"))
    described = stored(known.join(whole, "root").drop("root", "first"), "ngram-classes")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    return signed.select("doc_id", "text_key", "node").join(described, "node").select(
        "doc_id", "text_key", F.col("head.doc_id").alias("class_id"), "class_size",
        (F.col("links") + F.col("copies") - 1).alias("links"), "text_links", (own == F.col("head")).alias("stays"),
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with the columns they came with, whatever their names: the first of each class, once."""
    doc, key = free_names(docs, "doc", "key")
    first = similar_texts(docs, **options).where("stays").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (text_key() == F.col(key))
    return docs.join(first, same).dropDuplicates([doc, key]).select(*[docs[c] for c in docs.columns])


def op7_minhash_forest_join(spark, sf_dir) -> DataFrame:
    """Every document with its class of near copies and its number of links."""
    return similar_texts(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "links", "text_links")
