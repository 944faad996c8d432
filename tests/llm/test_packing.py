import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from wiresift.llm import packing
from wiresift.llm.packing import cut, one_bin, pack, packing_digest, plan_bins

SCHEMA = "doc_id long, text string, length long, part string"


def bins_one_by_one(counts, limit):
    counts, bins = np.array(counts), []
    while counts[1:].any():
        lengths = one_bin(counts, limit)
        for x in lengths:
            counts[x] -= 1
        bins.append(tuple(lengths))
    return bins


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=500, deadline=None)
def test_plan_is_the_rule_bin_by_bin(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, dtype=int)
    planned = Counter()
    for times, bin_ in plan_bins(counts, 40):
        planned[tuple(bin_)] += times
        assert sum(bin_) <= 40
    assert planned == Counter(bins_one_by_one(counts, 40))


def test_smallest_gives_way_to_two_that_fit_tighter():
    counts = np.zeros(101, dtype=int)
    for x in (60, 30, 25, 14):
        counts[x] += 1
    # 60 + 30 leaves 10; in place of 30, 25 + 14 leave 1
    assert one_bin(counts, 100) == [60, 25, 14]


def test_cut_puts_the_rest_first():
    assert cut(5, 4) == [(0, 1), (1, 4)]
    assert cut(8, 4) == [(0, 4), (4, 4)]
    assert cut(1, 4) == [(0, 1)]


def reference_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_paths()[0])
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_round_trip(spark):
    texts = [None, "", "a", "short words", "x y <|endoftext|> z", "émigré ñandú 漢字 🙂", "word " * 3000, "tail  \n\n end", "a", "a"]
    rows = [(i, t, 7, "p") for i, t in enumerate(texts)] + [(None, "no id", 1, None), (2, "a", 1, "p"), (2, "a", 1, "p")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = pack(docs).collect()
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
    for i, text in enumerate(texts):
        copies = 3 if i == 2 else 1
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        if copies == 1:
            ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in pieces]).tolist()
            assert ids == reference_ids(text)
        else:
            assert [np.frombuffer(r["ids"], "<u4").tolist() for r in pieces] == [reference_ids(text)] * copies
    assert len(by_doc[None]) == 1
    placed = defaultdict(list)
    for r in found:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    digests = packing_digest(docs).collect()
    crc = Counter((r["doc_id"], r["piece"], zlib.crc32(r["ids"])) for r in found)
    assert crc == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in digests)


@pytest.mark.parametrize("text", ["word" + " " * 3_000_000 + "end", "word" + "\n" * 1_000_000 + "end", "word" + " \t\u3000" * 700_000])
def test_long_white_space(text):
    assert [*packing.encoder(*packing.tokenizer_paths())(text), 2] == reference_ids(text)


def test_a_text_the_fast_reader_gives_up(monkeypatch):
    monkeypatch.setattr(packing, "long_space", lambda text: False)
    text = "word" + " " * 2_000_000 + "end"
    assert [*packing.encoder(*packing.tokenizer_paths())(text), 2] == reference_ids(text)


def test_long_white_space_is_packed(spark):
    docs = spark.createDataFrame([(1, "word" + " " * 2_000_000 + "end"), (2, "word")], "doc_id long, text string")
    found = pack(docs).where("doc_id = 1").orderBy("start").collect()
    assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in found]).tolist() == reference_ids("word" + " " * 2_000_000 + "end")


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_same_number_of_sequences_however_split(spark, parts):
    docs = spark.createDataFrame([(i, "word " * (i * 37 % 900)) for i in range(120)], "doc_id long, text string").repartition(parts)
    out = pack(docs)
    total = out.agg({"length": "sum"}).first()[0]
    sequences = out.select("sequence_id").distinct().count()
    assert -(-total // 1024) <= sequences <= -(-total // 1024) + 2
