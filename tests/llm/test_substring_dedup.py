import numpy as np
import pytest

from wiresift.llm.substring_dedup import chunk_ends, chunks_of, gear_hashes, GEAR, op3_gear_chunk_dedup, remove_repeats

SCHEMA = "doc_id long, text string, removed string, start int"


def prose(rng, words):
    return " ".join("".join(rng.choice(list("abcdeéß"), rng.integers(2, 9))) for _ in range(words))


def test_gear_hash_rolls():
    data = np.random.default_rng(1).integers(0, 256, 100).astype(np.uint8)
    h, expected = 0, []
    for b in data.tolist():
        h = ((h << 1) + int(GEAR[b])) % 2**32
        expected.append(h)
    assert gear_hashes(data).tolist() == expected


@pytest.mark.parametrize("text", ["", "a", "é" * 900, "word " * 400, prose(np.random.default_rng(2), 3000)])
def test_chunks_cover_the_text(text):
    raw, at = text.encode(), 0
    for start, length, _, _, _ in chunks_of(text):
        assert start == at and 0 < length <= 256
        raw[start : start + length].decode()
        at += length
    assert at == len(raw)


def test_insertion_moves_only_near_boundaries():
    text = prose(np.random.default_rng(3), 2000).encode()
    before = chunk_ends(np.frombuffer(text, np.uint8))
    after = chunk_ends(np.frombuffer(text[:3000] + b"inserted" + text[3000:], np.uint8))
    moved = {e - 8 for e in after if e > 3400}
    assert moved == {e for e in before if e > 3392}


def test_insertion_into_text_of_two_words():
    text = " ".join(np.random.default_rng(0).choice(["green", "walk"], 600)).encode()
    before = chunk_ends(np.frombuffer(text, np.uint8))
    after = chunk_ends(np.frombuffer(text[:500] + b"inserted" + text[500:], np.uint8))
    assert {e - 8 for e in after if e > 1500} == {e for e in before if e > 1492}


def test_passages_are_cut_from_later_documents(spark):
    rng = np.random.default_rng(4)
    passage, short = prose(rng, 60), prose(rng, 8)
    texts = [prose(rng, int(n)) for n in rng.integers(1, 300, 40)]
    rows = []
    for i, t in enumerate(texts):
        words = t.split(" ")
        if i % 4 == 1:
            words.insert(len(words) // 2, passage)
        if i % 5 == 2:
            words.insert(len(words) // 3, short)
        rows.append((i, " ".join(words), "x", 1))
    docs = spark.createDataFrame(rows + [(100, None, None, None), (101, "", "x", 1), (None, "pre " + passage, "x", 1)], SCHEMA).repartition(4)
    out = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    assert len(out) == 43
    for i, text, _, _ in rows:
        if i % 4 == 1 and i > 1:
            assert passage not in out[i]["text"] and len(out[i]["text"]) < len(text) - 150
            assert [d for r in out[i]["removed"] for d in r["first_docs"]] == [1]
        else:
            assert out[i]["text"] == text and out[i]["removed"] == []
    assert out[100]["text"] is None and out[101]["text"] == ""
    assert len(out[None]["text"]) < len("pre " + passage) - 150


def test_copies_and_repeated_rows(spark):
    text = prose(np.random.default_rng(6), 200)
    docs = spark.createDataFrame([(1, text, "", 0), (1, text, "", 0), (2, text, "", 0), (2, text, "", 0), (2, text[:400], "", 0)], SCHEMA)
    out = sorted((r["doc_id"], r["text"]) for r in remove_repeats(docs).collect())
    assert [t for i, t in out if i == 1] == [text, text]
    assert all(len(t) < 30 for i, t in out if i == 2)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_a_passage_twice_in_one_document(spark):
    rng = np.random.default_rng(11)
    passage, a, b, c = (prose(rng, n) for n in (60, 40, 40, 40))
    docs = spark.createDataFrame([(5, f"{a} {passage} {b} {passage} {c}", "", 0), (7, f"{c[:20]} {passage}", "", 0)], SCHEMA)
    out = {r["doc_id"]: r for r in remove_repeats(docs).collect()}
    assert out[5]["text"].count(passage) == 1 and out[5]["text"].startswith(f"{a} {passage} {b}")
    assert len(out[5]["text"]) < len(f"{a} {passage} {b} {passage} {c}") - 150 and out[5]["removed"][0]["first_docs"] == []
    assert out[7]["removed"][0]["first_docs"] == [5]


@pytest.mark.parametrize("doc_id", [None, 3])
def test_texts_of_one_id(spark, doc_id):
    rng = np.random.default_rng(12)
    passage = prose(rng, 60)
    texts = [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(3)]
    docs = spark.createDataFrame([(doc_id, t, "", 0) for t in texts] + [(doc_id, texts[0], "", 0), (doc_id, None, "", 0)], SCHEMA)
    out = [r["text"] for r in remove_repeats(docs).collect()]
    whole = {t for t in out if t is not None and passage in t}
    assert len(whole) == 1 and whole <= set(texts) and len(out) == 5
    assert all(len(t) < 520 or t in whole for t in out if t)
    earlier = spark.createDataFrame([(1, f"{passage} end", "", 0)], SCHEMA)
    cut = [r for r in remove_repeats(docs.unionByName(earlier)).collect() if r["doc_id"] != 1 and r["text"]]
    assert all(passage not in r["text"] and r["removed"][0]["first_docs"] == [1] for r in cut)


def test_scripts_without_spaces(spark):
    rng = np.random.default_rng(13)
    han = lambda n: "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, n))
    passage, short, one, two = han(600), han(60), han(300), han(300)
    docs = spark.createDataFrame([(1, passage + short, "", 0), (2, one + passage + two, "", 0), (3, one[:40] + short + two[:40], "", 0), (4, passage + short, "", 0)], SCHEMA)
    out = {r["doc_id"]: r["text"] for r in remove_repeats(docs).collect()}
    assert out[1] == passage + short and out[4] == "" and out[3] == one[:40] + short + two[:40]
    assert out[2].startswith(one) and out[2].endswith(two) and len(out[2]) < 800


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    out = op3_gear_chunk_dedup(spark, path).collect()
    assert {r["doc_id"] for r in out} == set(docs) and len(out) == len(docs)
    for r in out:
        assert r["removed_bytes"] == len(docs[r["doc_id"]].encode()) - len(r["text"].encode())
        assert (r["text"] == docs[r["doc_id"]]) == (r["spans"] == 0) and all(d < r["doc_id"] for d in r["first_docs"])
    assert sum(r["spans"] for r in out) > 0
