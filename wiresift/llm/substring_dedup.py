"""Removing passages that repeat across and within documents, by content-defined chunks.

A gear hash rolls over a text's bytes; where its low bits are zero a chunk ends.
They see the last few bytes only, so text of few different words may have none:
``GAP_BYTES`` or more after the last such place a chunk also ends where the high
bits are zero, which see the last 32 bytes. As nothing further back counts, an
insertion moves no boundary but those next to it, and a passage falls into the
same chunks wherever it stands. What is left is text that repeats itself every
few bytes: it may have no boundary at all and is cut every ``MOST_BYTES``, and
those cuts an insertion shifts.
Chunks are told apart by a 128-bit digest. The document with the smallest id
that has a chunk keeps it, where it stands first; everywhere else it is a repeat.
Neighbouring repeats make a span, and spans of ``LEAST_WORDS`` words or more are
cut out, or of ``LEAST_CHARACTERS`` characters, as not all scripts part words.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from wiresift.llm.common import blocks, documents, free_names, stored, text_key

BOUNDARY_BITS = 5
GAP_BYTES = 64
LEAST_BYTES = 12
MOST_BYTES = 256
LEAST_WORDS = 20
LEAST_CHARACTERS = 200
LONGEST_WORD = 64  # in bytes; a span is drawn in to whole words no further than that
SEED = 99_173
BLOCK_BYTES = 1 << 19
LAST = (1 << 63) - 1  # stands for a null id, so such rows come last

GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

CHUNKS = "doc_id long, text_key long, start int, length int, words int, again boolean, high long, low long"


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 32 bytes' gear values, each shifted once for every byte since."""
    h = GEAR[data]
    for reach in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[reach:] = h[:-reach] << np.uint32(reach)
        h = h + shifted
    return h


def chunk_ends(data: np.ndarray, bits: int = BOUNDARY_BITS, least: int = LEAST_BYTES, most: int = MOST_BYTES) -> list[int]:
    """Where a text's chunks end. Chunks have ``least`` to ``most`` bytes, the last one perhaps fewer, and never split a character."""
    size = len(data)
    if not size:
        return []
    whole = np.ones(size, dtype=bool)
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    h, at = gear_hashes(data), np.arange(size)
    low, high = (h & np.uint32((1 << bits) - 1)) == 0, (h >> np.uint32(32 - bits)) == 0
    gap = at - np.maximum.accumulate(np.where(low, at, -1))
    marks = np.flatnonzero((low | (high & (gap >= GAP_BYTES))) & whole) + 1
    ends, last = [], 0

    def fill(upto: int) -> int:
        at = last
        while upto - at > most:
            at += most
            while not whole[at - 1]:
                at -= 1
            ends.append(at)
        return at

    for mark in marks.tolist():
        if mark - last >= least:
            last = fill(mark)
            ends.append(mark)
            last = mark
    if last < size:
        fill(size)
        ends.append(size)
    return ends


def chunks_of(text: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, length, words, two halves of the digest) of a text's chunks; starts and lengths in bytes."""
    raw = text.encode()
    data = np.frombuffer(raw, dtype=np.uint8)
    spaces = np.concatenate([[0], np.cumsum(SPACE[data])])
    start = 0
    for end in chunk_ends(data):
        high, low = struct.unpack(">qq", xxhash.xxh3_128_digest(raw[start:end]))
        yield start, end - start, int(spaces[end] - spaces[start]), high, low
        start = end


def chunked(docs: DataFrame) -> DataFrame:
    """The chunks of all texts; ``again`` says that the same chunk stands earlier in the text."""

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, 2, BLOCK_BYTES):
            out = []
            for doc_id, key, text in rows:
                seen = set()
                for start, length, words, high, low in chunks_of(text or ""):
                    out.append((doc_id, key, start, length, words, (high, low) in seen, high, low))
                    seen.add((high, low))
            if out:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "start", "length", "words", "again", "high", "low"])

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), text_key().alias("text_key"), "text")
    return keyed.mapInArrow(chunk, CHUNKS)


def several_texts(docs: DataFrame) -> DataFrame:
    """Documents whose id, a null one too, other texts have as well."""
    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), text_key().alias("_key"))
    several = texts.groupBy("_id").agg(F.min("_key").alias("_first"), F.max("_key").alias("_last")).where("_first < _last")
    several = stored(several.select("_id"), "ids-of-several-texts")
    return docs.join(several, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("_id"), "left_semi")


def repeats(docs: DataFrame) -> DataFrame:
    """Chunks that stand earlier too, and the smallest id of a document that has them.

    Earlier is in a document with a smaller id, earlier in the same text, or in a
    text of the same id with a smaller key; texts that share an id are few or
    none, so they are compared apart from the rest.

    Counting combines before it shuffles, so a passage in a third of all
    documents is one row a task; the chunks that repeat are written out, so that
    the join back may split it.
    """
    pieces = chunked(docs)
    ids = pieces.groupBy("high", "low").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.max("again").alias("twice"))
    shared = stored(ids.where("first_doc < last_doc or twice").drop("last_doc", "twice"), "shared-chunks")
    found = pieces.join(shared, ["high", "low"]).where("doc_id > first_doc or again").drop("again", "high", "low")

    of_one_id = chunked(several_texts(docs)).drop("again")
    keys = of_one_id.groupBy("doc_id", "high", "low").agg(F.min("text_key").alias("first_key"), F.max("text_key").alias("last_key"))
    keys = stored(keys.where("first_key < last_key").drop("last_key"), "shared-chunks-of-one-id")
    same_id = of_one_id.join(keys, ["doc_id", "high", "low"]).where("text_key > first_key").drop("first_key", "high", "low")
    return found.unionByName(same_id.withColumn("first_doc", F.col("doc_id")))


def spans(found: list[tuple[int, int, int, int]], raw: bytes, least_words: int = LEAST_WORDS) -> list[tuple[int, int, list[int]]]:
    """(start, end, first documents) of neighbouring repeats with enough words or characters, drawn in to whole words.

    ``found`` has (start, length, words, first document) of a document's repeats.
    """
    runs: list[list] = []
    at = -1
    for start, length, words, first in sorted(set(found)):
        if start == at:  # the same chunk, found in another document and in one of the same id
            runs[-1][3].add(first)
            continue
        at = start
        if runs and runs[-1][1] >= start:
            runs[-1][1] = max(runs[-1][1], start + length)
            runs[-1][2] += words
            runs[-1][3].add(first)
        else:
            runs.append([start, start + length, words, {first}])
    out = []
    for start, end, words, first in runs:
        if words < least_words and sum((b & 0xC0) != 0x80 for b in raw[start:end]) < LEAST_CHARACTERS:
            continue
        ahead = (k for k in range(start, min(start + LONGEST_WORD, end) + 1) if not k or SPACE[raw[k - 1]])
        back = (k for k in range(end, max(end - LONGEST_WORD, start) - 1, -1) if k == len(raw) or SPACE[raw[k]])
        start, end = next(ahead, start), next(back, end)
        if start < end:
            out.append((start, end, sorted(first)))
    return out


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Documents without the passages that stand earlier: in a document with a smaller id, or further up.

    Columns as before, the text cut, and ``removed``: (start, length, first_docs)
    of each span in bytes of the old text, ids of the other documents that keep
    it (none if only this id has it). A text between two spaces is cut out with
    none of its surroundings. Null texts stay null. Rows without an id come last;
    among them, and among rows that share an id, the order is that of the text
    keys, and rows repeated whole stay alike. A column named ``removed`` is replaced.
    """
    names = [c for c in docs.columns if c != "removed"]
    doc, key, spans_of = free_names(docs, "doc", "key", "found")
    found = (
        repeats(docs).groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("start", "length", "words", "first_doc")).alias(spans_of))
        .select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), spans_of)
    )
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col(doc)) & (text_key() == F.col(key))
    joined = docs.select(*names).join(found, same, "left").select(*names, spans_of)
    id_at, text_at = names.index("doc_id"), names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for doc_id, text, repeated in zip(batch.column(id_at), batch.column(text_at), batch.column(len(names)), strict=True):
                text, repeated = text.as_py(), repeated.as_py()
                if not repeated or text is None:
                    texts.append(text)
                    removed.append([])
                    continue
                raw = text.encode()
                gone = spans([(r["start"], r["length"], r["words"], r["first_doc"]) for r in repeated], raw, least_words)
                own = LAST if (doc_id := doc_id.as_py()) is None else int(doc_id)
                edges = [0, *(x for start, end, _ in gone for x in (start, end)), len(raw)]
                texts.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode())
                removed.append([{"start": start, "length": end - start, "first_docs": [d for d in first if d != own]} for start, end, first in gone])
            columns = [*batch.columns[: len(names)]]
            columns[text_at] = pa.array(texts, columns[text_at].type)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("first_docs", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, kind)], [*names, "removed"])

    out = T.StructType([*docs.select(*names).schema.fields, *T.StructType.fromDDL("removed array<struct<start:int,length:int,first_docs:array<bigint>>>").fields])
    return joined.mapInArrow(cut, out)


def op3_gear_chunk_dedup(spark, sf_dir) -> DataFrame:
    """Every document with its text after repeats are cut out, and what was cut."""
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    first = F.array_sort(F.array_distinct(F.flatten(F.transform("removed", lambda r: r["first_docs"]))))
    lengths = F.aggregate("removed", F.lit(0).cast("long"), lambda total, r: total + r["length"])
    return out.select("doc_id", "text", F.size("removed").alias("spans"), lengths.alias("removed_bytes"), first.alias("first_docs"))
