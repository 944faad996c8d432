"""Byte-level BPE encoding and decoding with a vocabulary of ranks.

A text is cut by the vocabulary's pattern and each match is encoded on its own. The
bytes of a match are the leaves of a segment tree: a leaf holds the rank of the pair
that starts at this byte with the next live one, a node the smallest rank below it,
so the root tells the next merge and the way down the leftmost place of it. A merge
takes its right neighbour out and gives new ranks to the place itself and to the live
neighbour before it: three point updates along one path each. A match of n bytes costs
O(n log n), however long it is.

Short matches are worked on together: the trees of all new ones with as many leaves
lie in one array, and a step makes one merge in each. Matches that were encoded
before are looked up. Tasks work on their rows alone; nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wiresift.llm.common import blocks, documents

VOCABULARY = "byte_bpe_50k"
NONE = 1 << 62  # the rank of a pair that makes no token
TOGETHER = 64  # trees of up to so many leaves are worked on together
KNOWN = 300_000  # different matches that a worker remembers, some 200 bytes each; beyond it, it forgets all
LONG_TEXT, MATCHES = 1 << 20, 1 << 16  # a text of more characters is worked on so many matches at a time
TEXT_BYTES = 1 << 20  # of texts encoded at once

ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, ids array<int>, bytes binary"


class PairTree:
    """The ranks of the pairs of one byte string, as a segment tree of minima."""

    def __init__(self, piece: bytes, ranks: dict[bytes, int]):
        self.piece, self.ranks, n = piece, ranks, len(piece)
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.after = list(range(1, n + 1))  # the next live position; n is the end
        self.before = list(range(-1, n - 1))
        first = [ranks.get(piece[i : i + 2], NONE) for i in range(n - 1)]
        tree = [NONE] * self.leaves + first + [NONE] * (self.leaves - n + 1)
        for node in range(self.leaves - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left <= right else right
        self.tree = tree

    def update(self, position: int, rank: int) -> None:
        tree, node = self.tree, self.leaves + position
        tree[node] = rank
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            least = left if left <= right else right
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    def leftmost(self) -> int:
        """The first position with the smallest rank; -1 if no pair is left."""
        tree, leaves = self.tree, self.leaves
        least, node = tree[1], 1
        if least == NONE:
            return -1
        while node < leaves:
            node *= 2
            if tree[node] != least:
                node += 1
        return node - leaves

    def rank_at(self, position: int) -> int:
        """The rank of the pair that the token at a live position makes with the next one."""
        middle = self.after[position]
        n = len(self.piece)
        return self.ranks.get(self.piece[position : self.after[middle]], NONE) if middle < n else NONE

    def merge(self, position: int) -> None:
        gone = self.after[position]
        following = self.after[gone]
        self.after[position] = following
        if following < len(self.piece):
            self.before[following] = position
        self.update(gone, NONE)
        self.update(position, self.rank_at(position))
        if (earlier := self.before[position]) >= 0:
            self.update(earlier, self.rank_at(earlier))

    def tokens(self) -> list[int]:
        """All merges done, the ranks of what is left."""
        while (position := self.leftmost()) >= 0:
            self.merge(position)
        ids, at, n = [], 0, len(self.piece)
        while at < n:
            ids.append(self.ranks[self.piece[at : self.after[at]]])
            at = self.after[at]
        return ids


class PairTrees:
    """The same for many short byte strings, whose trees have equally many leaves, as arrays."""

    def __init__(self, pieces: list[bytes], leaves: int, pairs: tuple[np.ndarray, np.ndarray], byte_ids: np.ndarray):
        self.leaves, self.pairs = leaves, pairs
        self.length = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        padded = np.frombuffer(b"".join(p.ljust(leaves + 1, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, leaves + 1)
        self.token = byte_ids[padded]  # one column more than positions, for the end of the longest
        at = np.arange(leaves + 1)
        self.live = at < self.length[:, None]
        self.after = np.tile(at + 1, (len(pieces), 1))
        self.before = np.tile(at - 1, (len(pieces), 1))
        tree = np.full((len(pieces), 2 * leaves), NONE, dtype=np.int64)
        rows, places = np.nonzero(self.live[:, 1:])
        tree[rows, leaves + places] = self.ranks_of(self.token[rows, places], self.token[rows, places + 1])
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        self.tree = tree

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ranks = self.pairs
        wanted = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, ranks[at], NONE)

    def update(self, rows: np.ndarray, places: np.ndarray, ranks) -> None:
        tree, node = self.tree, self.leaves + places
        tree[rows, node] = ranks
        for _ in range(self.leaves.bit_length() - 1):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def leftmost(self, rows: np.ndarray) -> np.ndarray:
        tree, least, node = self.tree, self.tree[rows, 1], np.ones(len(rows), dtype=np.int64)
        for _ in range(self.leaves.bit_length() - 1):
            node = 2 * node
            node += tree[rows, node] != least
        return node - self.leaves

    def rank_at(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        following = self.after[rows, places]
        ranks = self.ranks_of(self.token[rows, places], self.token[rows, following])
        return np.where(following < self.length[rows], ranks, NONE)

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """All merges done: how many ids each string has, and the ids of all in order."""
        while (rows := np.flatnonzero(self.tree[:, 1] < NONE)).size:
            places = self.leftmost(rows)
            self.token[rows, places] = self.tree[rows, 1]
            gone = self.after[rows, places]
            following = self.after[rows, gone]
            self.after[rows, places] = following
            inside = following < self.length[rows]
            self.before[rows[inside], following[inside]] = places[inside]
            self.live[rows, gone] = False
            self.update(rows, gone, NONE)
            self.update(rows, places, self.rank_at(rows, places))
            earlier = self.before[rows, places]
            has = earlier >= 0
            self.update(rows[has], earlier[has], self.rank_at(rows[has], earlier[has]))
        return self.live.sum(axis=1), self.token[self.live]


def ranges(points: set[int]) -> str:
    """Code points as the inside of a character class."""
    out, ordered = [], sorted(points)
    for i, point in enumerate(ordered):
        if not i or ordered[i - 1] != point - 1:
            out.append([point, point])
        out[-1][1] = point
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in out)


class Matcher:
    """The pattern with the letters, numbers and spaces that the rank files' reader takes for such.

    Its Unicode tables may be of another version than those of the module that matches
    here. Texts with a code point on which these differ get a pattern whose classes are mended by them.
    """

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
        single = {bytes([b]): b for b in range(256)}
        mended, differ = pattern, set()
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            reader = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
            theirs = bytes(reader.encode_ordinary(every)).decode()
            ours = "".join(regex.findall(name, every))
            more, less = set(map(ord, set(theirs).difference(ours))), set(map(ord, set(ours).difference(theirs)))
            differ |= more | less
            own = name
            if less:
                own = f"[{own}--[{ranges(less)}]]"
            if more:
                own = f"[{own}{ranges(more)}]"
            mended = mended.replace(name, own)
            if name == r"\s" and own != name:
                mended = mended.replace(r"\S", f"[^{own}]")
        self.plain, self.mended = regex.compile(pattern), regex.compile(mended, regex.V1)
        self.odd = regex.compile(f"[{ranges(differ)}]") if differ else None

    def of(self, text: str):
        return self.mended if self.odd and not text.isascii() and self.odd.search(text) else self.plain


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(total)]


class Growing:
    """An array that values are appended to; ``room`` holds ``length`` of them."""

    def __init__(self, kind):
        self.room, self.length = np.zeros(1024, dtype=kind), 0

    def append(self, values: np.ndarray) -> None:
        upto = self.length + len(values)
        if upto > len(self.room):
            self.room = np.concatenate([self.room[: self.length], np.zeros(max(upto, 2 * len(self.room)) - self.length, dtype=self.room.dtype)])
        self.room[self.length : upto] = values
        self.length = upto


class Codec:
    """Encodes texts to ids and ids to bytes by the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.matcher = ranks, Matcher(pattern)
        halves = [
            (ranks[token[:k]] << 32 | ranks[token[k:]], rank)
            for token, rank in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks
        ]
        keys, merged = np.array(sorted(halves) or [(-1, NONE)], dtype=np.int64).T
        self.pairs = (np.ascontiguousarray(keys), np.ascontiguousarray(merged))
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        in_order = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            in_order[rank] = token
        self.lengths = np.fromiter(map(len, in_order), dtype=np.int64, count=len(in_order))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(in_order), dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.id_counts, self.id_starts = Growing(np.int32), Growing(np.int64), Growing(np.int64)

    def learn(self, matches: set[str]) -> None:
        """Encodes matches and numbers them on."""
        by_leaves: dict[int, list[tuple[str, bytes]]] = {}
        for match in matches:
            piece = match.encode()
            by_leaves.setdefault(0 if piece in self.ranks else max(2, 1 << (len(piece) - 1).bit_length()), []).append((match, piece))
        for leaves, group in by_leaves.items():
            if leaves == 0:
                counts, ids = np.ones(len(group), dtype=np.int64), np.array([self.ranks[p] for _, p in group])
            elif leaves <= TOGETHER:
                counts, ids = PairTrees([p for _, p in group], leaves, self.pairs, self.byte_ids).tokens()
            else:
                each = [PairTree(p, self.ranks).tokens() for _, p in group]
                counts, ids = np.array(list(map(len, each))), np.array(list(chain.from_iterable(each)))
            first = len(self.known)
            self.known.update((match, first + i) for i, (match, _) in enumerate(group))
            self.id_starts.append(self.ids.length + np.cumsum(counts) - counts)
            self.id_counts.append(counts)
            self.ids.append(ids)

    def of_matches(self, matches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each match of a list: how many, and all in order."""
        if len(self.known) > KNOWN:
            self.forget()
        if new := set(matches).difference(self.known):
            self.learn(new)
        numbers = np.fromiter(map(self.known.__getitem__, matches), dtype=np.int64, count=len(matches))
        counts = self.id_counts.room[numbers]
        return counts, gathered(self.ids.room, self.id_starts.room[numbers], counts)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. A long text's matches are worked on a block at a time."""
        if len(texts) == 1 and len(texts[0]) > LONG_TEXT:
            matches, parts = (m.group() for m in self.matcher.of(texts[0]).finditer(texts[0])), []
            while block := list(islice(matches, MATCHES)):
                parts.append(self.of_matches(block)[1])
            return [np.concatenate(parts)]
        found = [self.matcher.of(text).findall(text) for text in texts]
        matches = list(chain.from_iterable(found))
        if not matches:
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        counts, ids = self.of_matches(matches)
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(list(map(len, found)))]
        return np.split(ids, ends[:-1])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        if ids.size and (ids.min() < 0 or ids.max() >= len(self.lengths) or not self.lengths[ids].all()):
            raise ValueError("an id that the vocabulary lacks")
        return gathered(self.flat, self.starts[ids], self.lengths[ids]).tobytes()


def vocabulary_path(vocabulary: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{vocabulary}.tiktoken")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process, so that its cache serves all of the worker's tasks."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0), pa.int32()))


def pattern_of_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_bytes: bool = False) -> DataFrame:
    """(doc_id, ids) of every row; ``with_bytes`` adds the bytes that the ids decode to, from the same pass.

    A null text counts as empty and gives no ids, a null doc_id stays null, repeated rows stay, other columns play no part.
    """
    path, pattern = path or vocabulary_path(), pattern or pattern_of_vocabulary()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for rows in blocks(batches, 1, TEXT_BYTES):
            ids = own.encode_all([text or "" for _, text in rows])
            columns = [pa.array([doc_id for doc_id, _ in rows], pa.int64()), _lists(ids)]
            if with_bytes:
                columns.append(pa.array([own.decode(each) for each in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "bytes"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encoded, DECODED if with_bytes else ENCODED)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, bytes) of rows (doc_id, ids). An id that the vocabulary lacks ends the job."""
    path, pattern = path or vocabulary_path(), pattern_of_vocabulary()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = batch.column(1)
            whole = [own.decode(each.values.to_numpy()) if each.is_valid else None for each in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(whole, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, DECODED)


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def op12_byte_bpe(spark, sf_dir) -> DataFrame:
    """Every document's number of ids, a digest of the ids and one of the bytes that they decode to."""
    both = encode(documents(spark, sf_dir), with_bytes=True)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
