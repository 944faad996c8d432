"""What each of several filters removes, in every order of applying them.

Four filters look at a document alone. The fifth asks whether a smaller id has the same
text, and is answered by radix tries: texts are dealt out by ranges whose bounds are
prefixes, as long as it takes to tell neighbouring sampled texts apart; a task inserts its whole
texts into a compressed trie whose terminals hold the smallest id, then walks it and
flags the rows at each terminal.

A task that reads documents first inserts each block of them into a trie of its own. Rows that have a
smaller id there are settled; of a text only the rows with the block's smallest id travel
on. A text that a third of all rows share arrives as a few rows a block.

What a document fails is a mask of five bits. Masks are counted by part, and a part's 32
counts answer all orders: a step removes the masks with its bit and none of
the earlier ones.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wiresift.llm.common import blocks, documents, stored, table

FILTERS = "ABCDE"
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10  # words; percent of words; percent of code points
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))  # the bytes that begin no code point
BLOCK_BYTES = 16 << 20  # of texts in the trie of a reading task
RANGE_BYTES = (8 << 20, 128 << 20)  # of texts in a range, at least and at most, about
MOST_RANGES = 4096  # beyond it ranges grow, and then are dealt out further by hash
SAMPLES_A_RANGE = 16
FIRST_BYTES, LONGER = 64, 8  # of a sampled text, and how many times as many where these do not tell it apart

ROWS = "doc_id long, part string, fails int, rows long, text binary, bucket int"
MARKED = "doc_id long, part string, fails int, rows long"


# --- the trie ------------------------------------------------------------------------

class Node:
    """An edge's bytes, the nodes below by their first byte, and at the end of a text its rows and smallest id."""

    __slots__ = ("edge", "below", "least", "rows")

    def __init__(self, edge: bytes):
        self.edge, self.below, self.least, self.rows = edge, None, None, None


def shared(a: bytes, b: bytes) -> int:
    """How many bytes two strings begin with alike: halving, so that comparing is left to whole slices."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Trie:
    """A radix trie of whole texts: every edge holds all bytes up to the next fork or end."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, text: bytes) -> Node:
        """The text's terminal."""
        node, at, n = self.root, 0, len(text)
        while at < n:
            below = node.below
            if below is None:
                below = node.below = {}
            child = below.get(text[at])
            if child is None:
                child = below[text[at]] = Node(text[at:])
                return child
            edge = child.edge
            if not text.startswith(edge, at):
                alike = shared(edge, text[at : at + len(edge)])
                fork = Node(edge[:alike])
                child.edge = edge[alike:]
                fork.below = {child.edge[0]: child}
                below[text[at]] = child = fork
            node, at = child, at + len(child.edge)
        return node

    def add(self, text: bytes, doc_id: int | None, row) -> None:
        end = self.insert(text)
        if end.rows is None:
            end.rows = []
        end.rows.append((doc_id, row))
        if doc_id is not None and (end.least is None or doc_id < end.least):
            end.least = doc_id

    def ends(self, texts: bool = True) -> Iterator[tuple[bytes, int | None, list]]:
        """All terminals in the texts' order: (text, smallest id, rows). Without ``texts`` these are left empty."""
        open_ = [(self.root, b"")]
        while open_:
            node, before = open_.pop()
            text = before + node.edge if texts else b""
            if node.rows is not None:
                yield text, node.least, node.rows
            if node.below:
                open_ += [(node.below[b], text) for b in sorted(node.below, reverse=True)]


# --- masks -----------------------------------------------------------------------------

def fails_alone(text: bytes) -> int:
    """The mask of what a text fails by itself."""
    words = text.split()  # of bytes: at the white space of ASCII
    n, points = len(words), len(text.translate(None, CONTINUED))
    return int(
        (n < LEAST_WORDS and BIT["A"])
        | (100 * len(set(words)) < LEAST_DISTINCT * n and BIT["B"])
        | (100 * (len(text) - len(text.translate(None, CAPITALS))) > MOST_CAPITALS * points and BIT["C"])
        | (SYMBOLS.search(text) is not None and BIT["D"])
    )


def counted(rows: list[tuple]) -> dict[tuple, int]:
    out: dict[tuple, int] = {}
    for key, n in rows:
        out[key] = out.get(key, 0) + n
    return out


def ranges_of(docs: DataFrame) -> tuple[list[bytes], int]:
    """Bounds that deal texts out evenly, and the number of hash buckets that each range has.

    All texts' bytes are summed. The bounds come from a sample by hash, about
    ``SAMPLES_A_RANGE`` a range; they decide where a text is worked on and nothing else.
    Of a sampled text no more bytes are fetched than tell it from its neighbours.
    """
    size = F.octet_length("text").cast("long") + 64
    total, rows = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    least, most = RANGE_BYTES
    count = min(max(1, math.ceil(total / least)), MOST_RANGES)
    buckets = max(1, math.ceil(total / count / most))
    if count == 1:
        return [], buckets
    share = min(1.0, count * SAMPLES_A_RANGE / rows)
    chosen = docs.where(F.pmod(F.xxhash64(F.lit(1), "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = stored(chosen.select("text", size.alias("size")).distinct().withColumn("no", F.monotonically_increasing_id()), "audit-sample")
    known, sizes, length, open_ = {}, {}, FIRST_BYTES, None
    while open_ is None or open_:
        asked = sample if open_ is None else sample.join(sample.sparkSession.createDataFrame([(n,) for n in sorted(open_)], "no long"), "no")
        for row in asked.select("no", "size", F.substring("text", 1, length).alias("start")).collect():
            known[row["no"]], sizes[row["no"]] = bytes(row["start"]), row["size"]
        ordered = sorted(known, key=lambda n: (known[n], n))
        alike = [(a, b) for a, b in zip(ordered, ordered[1:], strict=False) if known[a] == known[b] and len(known[a]) == length]
        open_, length = {n for pair in alike for n in pair}, length * LONGER
    return bounds(sorted((known[n], sizes[n]) for n in known), count), buckets


def bounds(sample: list[tuple[bytes, int]], count: int) -> list[bytes]:
    """The prefixes at which ``count`` ranges of about equal size part; each is just long enough to be above the sampled text before it."""
    total, upto, out = sum(size for _, size in sample), 0, []
    for (before, size), (text, _) in zip(sample, sample[1:], strict=False):
        upto += size
        if upto * count >= total * (len(out) + 1):
            prefix = text[: shared(before, text) + 1]
            if not out or prefix > out[-1]:
                out.append(prefix)
    return out[: count - 1]


def read_rows(docs: DataFrame, cuts: list[bytes], buckets: int) -> DataFrame:
    """What reading tasks find: settled rows without a text, and per text of a block those whose smallest id may not be the table's."""
    whole = (len(cuts) + 1) * buckets

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, 1, BLOCK_BYTES):
            trie, out = Trie(), []
            for doc_id, text, part in rows:
                trie.add(text or b"", doc_id, part)
            for text, least, held in trie.ends():
                fails, found = fails_alone(text), counted([(row, 1) for row in held])
                bucket = bisect_right(cuts, text) * buckets
                if buckets > 1:
                    bucket += crc32(text) % buckets
                for (doc_id, part), n in found.items():
                    if doc_id is None or doc_id == least:
                        out.append((doc_id, part, fails, n, text, bucket))
                    else:
                        out.append((doc_id, part, fails | BIT["E"], n, None, abs(doc_id) % whole))
            yield _batch(out, ROWS)

    return docs.select(F.col("doc_id").cast("long"), "text", F.coalesce("lang", F.lit("")).alias("part")).mapInArrow(read, ROWS)


def marked_rows(rows: DataFrame) -> DataFrame:
    """Rows dealt out by bucket and marked by the tries of their tasks, without texts."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[int, Trie] = {}
        for batch in batches:
            out = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                doc_id, part, fails, n, text, bucket = row
                if text is None:
                    out.append((doc_id, part, fails, n))
                else:
                    tries.setdefault(bucket, Trie()).add(text, doc_id, (part, fails, n))
            yield _batch(out, MARKED)
        for bucket in list(tries):
            out = []
            for _, least, held in tries.pop(bucket).ends(texts=False):
                out += [(doc_id, part, fails | (doc_id is not None and doc_id > least and BIT["E"]), n) for doc_id, (part, fails, n) in held]
            yield _batch(out, MARKED)

    return rows.mapInArrow(mark, MARKED)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*[(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))], strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))


def failed(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails, rows): how many rows of an id and part fail what; ``fails`` has a bit for each of A to E.

    A null text counts as empty and a null lang as the empty part. A row fails E if a smaller
    doc_id anywhere has its text; a null doc_id is smaller than none and never fails it. Rows
    repeated whole count each. Columns but doc_id, text and lang play no part.
    """
    own = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"), "lang")
    cuts, buckets = ranges_of(own)
    rows = read_rows(own, cuts, buckets)
    return marked_rows(rows.repartitionById((len(cuts) + 1) * buckets, F.col("bucket")))


# --- orders ------------------------------------------------------------------------------

def masks_by_part(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, masks): per part its at most 32 masks with the rows, good and toxic rows that have it.

    A document is good, or toxic, if any label row of its id says so.
    """
    said = labels.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # rows without an id have no labels; the spread keeps them out of one task
    spread = F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(0)
    known = rows.withColumn("_spread", spread).join(said.withColumn("_none", F.lit(0)), (F.col("doc_id") == F.col("_doc")) & (F.col("_spread") == F.col("_none")), "left")
    count = lambda which: F.sum(F.when(which, F.col("rows")).otherwise(0))
    cells = known.groupBy("part", "fails").agg(F.sum("rows").alias("rows"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct("fails", "rows", "good", "toxic")).alias("masks"))


def _steps(filters: str) -> Column:
    """All steps of all orders, as an array literal of (filter_order, step, before, own): the earlier filters' bits and the filter's."""
    rows = []
    for order in permutations(filters):
        before = 0
        for step, name in enumerate(order, 1):
            rows.append(f"struct('{''.join(order)}', {step}, {before}, {BIT[name]})")
            before |= BIT[name]
    return F.expr(f"array({', '.join(rows)})").cast("array<struct<filter_order:string,step:int,before:int,own:int>>")


def audit(rows: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For each part, order of the filters and step: what is kept after it, what it removes, and of what kind.

    ``rows`` is from ``failed``. ``redundant`` fail the step's filter but went earlier, ``unique_fails`` fail
    no other filter, ``shapley`` sums what the filter removes over all orders: of the n! orders, the first of
    a mask's k filters is the given one in n!/k.
    """
    orders = math.factorial(len(filters))
    every = sum(BIT[f] for f in filters)
    one = masks_by_part(rows, labels).select("part", "masks", F.explode(_steps(filters)).alias("s")).select("part", "masks", "s.*")
    has = lambda m, bits: m["fails"].bitwiseAND(bits) != 0
    own, before = F.col("own"), F.col("before")
    first = lambda m: has(m, own) & ~has(m, before)

    def total(which, what: str = "rows", weigh=None) -> Column:
        value = lambda m: m[what] if weigh is None else m[what] * weigh(m)
        return F.aggregate("masks", F.lit(0).cast("long"), lambda sum_, m: sum_ + F.when(which(m), value(m)).otherwise(0).cast("long"))

    return one.select(
        "part", "filter_order", "step",
        total(lambda m: ~has(m, before.bitwiseOR(own))).alias("kept"),
        total(first).alias("removed"),
        total(lambda m: has(m, own) & has(m, before)).alias("redundant"),
        total(lambda m: m["fails"].bitwiseAND(F.lit(every)) == own).alias("unique_fails"),
        total(first, "good").alias("good_lost"),
        total(first, "toxic").alias("toxic_lost"),
        total(lambda m: has(m, own), weigh=lambda m: F.floor(F.lit(orders) / F.bit_count(m["fails"].bitwiseAND(F.lit(every))))).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir) -> DataFrame:
    """All orders of the five filters over all documents, by language."""
    return audit(failed(documents(spark, sf_dir)), table(spark, sf_dir, "labels"))
