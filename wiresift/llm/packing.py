"""Packing documents into fixed-length sequences, best two fit.

Documents become token ids and an end id; a longer one is cut. A bin opens with
the longest piece left and is filled greedily with the longest that fits. Then
its smallest piece is exchanged for two unpacked ones if these fill its place
and the gap more tightly.

Pieces of one length are interchangeable, so the rule runs on the counts of
lengths: a bin's choice stays the same until one of the lengths it looks at runs out,
and is repeated that often at once. The plan therefore has a size that depends on
the sequence length and not on the corpus, and it is what the rule gives piece
by piece. Pieces find their place by their rank among those of their length.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wiresift.llm.common import documents, stored

LIMIT = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
OUT_BYTES = 8 << 20
LONG_SPACE = 100_000

PIECES = "part int, doc_id long, piece int, start long, length long, nth long, ids binary"


# --- token ids -----------------------------------------------------------------

def tokenizer_paths(vocabulary: str = VOCABULARY) -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(f"{vocabulary}.json"), public_tokenizers.path(f"{vocabulary}.tiktoken")


def long_space(text: str, least: int = LONG_SPACE) -> bool:
    """Whether ``least`` characters of white space follow each other."""
    return len(text) >= least and any(m.end() - m.start() >= least for m in re.finditer(r"\s+", text))


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str):
    """A function from text to token ids, those of the tokenizer file at ``json_path``.

    The rank file holds the same vocabulary and its reader gives the same ids
    several times faster; a text with a special token's string goes to the
    tokenizer itself, as only that knows special tokens. So does a text with a
    white-space run of ``LONG_SPACE`` characters or more, and any other that the
    fast reader gives up: its expressions run out of stack somewhere between
    800,000 and a million characters of white space.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(json_path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if not any(s in text for s in special) and not long_space(text):
            try:
                return fast.encode_ordinary(text)
            except BaseException as error:
                if type(error).__name__ != "PanicException":  # no Exception, and of no module that can be imported
                    raise
        return tokenizer.encode(text, add_special_tokens=False).ids

    return encode


def cut(total: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, and first the shorter rest."""
    rest = total % limit
    edges = ([0] if rest else []) + list(range(rest, total + 1, limit))
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def tokenised_pieces(docs: DataFrame, limit: int = LIMIT, end_id: int = END_ID, paths: tuple[str, str] | None = None) -> DataFrame:
    """Pieces of all documents with their ids (little-endian 32-bit), stored.

    ``part`` is the task that wrote a piece and ``nth`` its number, from 0, among
    the task's pieces of that length; both are read back from the stored table,
    so they stay as they are. A null text counts as empty; every document ends
    with ``end_id``, so an empty one has one piece of one id.
    """
    paths = paths or tokenizer_paths()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(*paths), TaskContext.get().partitionId(), np.zeros(limit + 1, dtype=np.int64)
        names = ("doc_id", "piece", "start", "length", "nth", "ids")
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), *columns], ["part", *names])

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                doc_id, text = doc_id.as_py(), text.as_py()
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                for piece, (start, length) in enumerate(cut(len(ids), limit)):
                    rows.append((doc_id, piece, start, length, int(seen[length]), ids[start : start + length].tobytes()))
                    seen[length] += 1
                    held += 4 * length + 64
                    if held > OUT_BYTES:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES), "packing-pieces")


# --- the plan --------------------------------------------------------------------

def _reachable(counts: np.ndarray) -> np.ndarray:
    """At x the largest length up to x of which something is left, else 0."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def _two_for(room: int, counts: np.ndarray) -> tuple[int, int]:
    """The two lengths left, the longer first, that fill ``room`` best; (0, 0) if none fit."""
    up_to = _reachable(counts)
    first = np.flatnonzero(counts[: room + 1] > 0)
    if not first.size:
        return 0, 0
    most = np.minimum(room - first, first)
    most = np.where((most == first) & (counts[first] < 2), first - 1, most)
    second = up_to[np.maximum(most, 0)]
    both = np.where(second > 0, first + second, 0)
    best = len(both) - 1 - int(np.argmax(both[::-1]))
    return (int(first[best]), int(second[best])) if both[best] else (0, 0)


def chosen(counts: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """The lengths that go into the next bin, and the one, if any, that was filled in and exchanged.

    A bin's only piece is not exchanged: it opened the bin as the longest one left, and
    two others in its place would leave it to open the next.
    """
    counts = counts.copy()
    lengths, gap = [], limit
    while (length := int(_reachable(counts)[gap])) > 0:
        lengths.append(length)
        counts[length] -= 1
        gap -= length
    if gap and len(lengths) > 1:
        smallest = lengths[-1]
        a, b = _two_for(gap + smallest, counts)
        if a + b > smallest:
            return [*lengths[:-1], a, b], [smallest]
    return lengths, []


def one_bin(counts: np.ndarray, limit: int) -> list[int]:
    return chosen(counts, limit)[0]


def plan_bins(counts: np.ndarray, limit: int = LIMIT) -> list[tuple[int, list[int]]]:
    """All bins as (how often, lengths in order); ``counts`` at x is the number of pieces of length x.

    A bin is repeated as long as every length that its choice looked at, an exchanged one
    included, is left in the number that it looked for.
    """
    counts, plan = np.asarray(counts, dtype=np.int64).copy(), []
    while counts[1:].any():
        lengths, exchanged = chosen(counts, limit)
        used = np.bincount(lengths, minlength=len(counts))
        seen = np.bincount(lengths + exchanged, minlength=len(counts))
        at = used > 0
        times = max(1, int(((counts - seen)[at] // used[at]).min()) + 1)
        counts -= used * times
        plan.append((times, lengths))
    return plan


def place(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``part``, ``nth`` and ``length`` say which they are, other columns stay.

    The counts that reach the driver are one per length, at most ``limit``, and
    so is the broadcast plan: a row for each length in each kind of bin.
    """
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(by_part.select("part", "length", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")), "packing-counts")
    counts = np.zeros(limit + 1, dtype=np.int64)
    for row in starts.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    rows, used, sequences = [], np.zeros(limit + 1, dtype=np.int64), 0
    for times, lengths in plan_bins(counts, limit):
        offsets: dict[int, list[int]] = {}
        at = 0
        for length in lengths:
            offsets.setdefault(length, []).append(at)
            at += length
        for length, places in offsets.items():
            upto = int(used[length]) + times * len(places)
            rows.append((length, int(used[length]), upto, sequences, places))
            used[length] = upto
        sequences += times
    plan = spark.createDataFrame(rows, "length long, _from long, _upto long, _first long, _places array<long>")
    nth = F.col("_rank") - F.col("_from")
    each = F.size("_places")
    return (
        pieces.join(starts.drop("_n"), ["part", "length"])
        .withColumn("_rank", F.col("_start") + F.col("nth"))
        .join(F.broadcast(plan), "length")
        .where((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_upto")))
        .withColumn("sequence_id", (F.col("_first") + F.floor(nth / each)).cast("long"))
        .withColumn("offset", F.element_at("_places", (F.pmod(nth, each) + 1).cast("int")))
        .drop("_start", "_rank", "_from", "_upto", "_first", "_places")
    )


def pack(docs: DataFrame, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """Every piece with its ids, sequence and offset.

    Repeated rows are packed as often as they are there, a null doc_id stays
    null, other columns play no part, and an empty table gives no rows.
    """
    return place(tokenised_pieces(docs, limit, end_id), limit).drop("part", "nth")


def packing_digest(docs: DataFrame) -> DataFrame:
    """The packing with a checksum in place of the ids, which are read once and not shuffled."""
    pieces = tokenised_pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_best_two_fit(spark, sf_dir) -> DataFrame:
    """All documents packed into sequences of 1024 token ids."""
    return packing_digest(documents(spark, sf_dir))
