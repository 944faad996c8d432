import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from wiresift.llm.byte_bpe import PairTree, codec, decode, encode, op12_byte_bpe, vocabulary_path

SCHEMA = "doc_id long, text string, ids string, bytes int, n_tokens int"


@pytest.fixture(scope="module")
def own():
    return codec(vocabulary_path(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reader(own):
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


TEXTS = ["", " ", "a", "Hello world's  best\n\n\ttabs ", "don't we'll I'VE", "naïve Straße 北京大学 😀😀", "x" * 5000, "ab" * 3001, " " * 5000 + "end", "\n" * 70,
         "<|endoftext|>", "½ Ⅷ ① ٣", "á​ b c\x1c\x1dd\x85", "࢏꟎\U0003134a\U000323af x", "word " * 300_000, "é" * 4000, "'" * 90, "\x00\x01"]


def test_texts(own, reader):
    assert [list(i) for i in own.encode_all(TEXTS)] == [reader.encode_ordinary(t) for t in TEXTS]
    assert all(own.decode(own.encode(t)) == t.encode() for t in TEXTS)


def merged_one_by_one(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@given(st.lists(st.binary(min_size=1, max_size=70), min_size=1, max_size=20))
@settings(max_examples=100, deadline=None)
def test_both_trees_make_the_merges_one_by_one(own, pieces):
    from wiresift.llm.byte_bpe import PairTrees

    for piece in pieces:
        assert PairTree(piece, own.ranks).tokens() == merged_one_by_one(piece, own.ranks)
    counts, ids = PairTrees(pieces, 128, own.pairs, own.byte_ids).tokens()
    assert [list(i) for i in np.split(ids, np.cumsum(counts)[:-1])] == [merged_one_by_one(p, own.ranks) for p in pieces]


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_text(own, reader, text):
    assert list(own.encode(text)) == reader.encode_ordinary(text) and own.decode(own.encode(text)) == text.encode()


def test_every_code_point_is_of_the_reader_s_class(own, reader):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1{chr(c)}  {chr(c)}!" for c in points[i : i + 5000]) for i in range(0, len(points), 5000)]
    for text in texts:
        assert list(own.encode(text)) == reader.encode_ordinary(text)


def test_a_small_memory_gives_the_same(own, reader, monkeypatch):
    monkeypatch.setattr("wiresift.llm.byte_bpe.KNOWN", 5)
    monkeypatch.setattr("wiresift.llm.byte_bpe.LONG_TEXT", 100)
    monkeypatch.setattr("wiresift.llm.byte_bpe.MATCHES", 7)
    for text in TEXTS[:12]:
        assert list(own.encode(text)) == reader.encode_ordinary(text)


def test_rows(spark, reader):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "same"), (3, "same"), (99, None)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    out = decode(encode(docs)).collect()
    assert sorted(str((r["doc_id"], r["ids"], bytes(r["bytes"]))) for r in out) == sorted(str((i, reader.encode_ordinary(t or ""), (t or "").encode())) for i, t in rows)
    assert sorted(map(str, encode(docs, with_bytes=True).collect())) == sorted(map(str, out))
    assert decode(encode(docs.limit(0))).count() == 0


def test_an_unknown_id_ends_the_job(own):
    with pytest.raises(ValueError):
        own.decode([60_000])
    with pytest.raises(ValueError):
        own.decode([-1])


def test_registered_query(spark, reader):
    path = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect():
        ids = reader.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    out = op12_byte_bpe(spark, path).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out} == want and len(out) == len(want)
