from collections import defaultdict

import numpy as np
import pytest

from wiresift.llm import ngram_join
from wiresift.llm.components import components
from wiresift.llm.ngram_join import hashers, ngram_sets, one_of_each, op7_minhash_forest_join, overlaps, shortened_depth, signature, similar_texts

SCHEMA = "doc_id long, text string, node string, size int, links long"


def grams(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_force(rows, threshold=0.8):
    """{row number: (class, links, text links)} by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    linked = defaultdict(set)
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            x, y = sets[i], sets[j]
            alike = len(x & y) >= threshold * len(x | y) - 1e-12 if x and y else not x and not y and a == rows[j][1]
            if alike:
                linked[i].add(j)
                linked[j].add(i)
    top, out = {}, {}
    for i in range(len(rows)):
        if i in top:
            continue
        todo, seen = [i], {i}
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        for j in seen:
            top[j] = seen
    for i in range(len(rows)):
        ids = [rows[j][0] for j in top[i] if rows[j][0] is not None]
        different = {frozenset(sets[j]) for j in linked[i]} - {frozenset(sets[i])}
        out[i] = (min(ids, default=None), len(linked[i]), len(different) if sets[i] else 0)
    return out


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(600)]
    rows, i = [], 0
    for _ in range(40):
        words = rng.choice(vocabulary, rng.integers(3, 150)).tolist()
        for _ in range(int(rng.integers(1, 7))):
            copy = list(words)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = str(rng.choice(vocabulary))
            rows.append((i, " ".join(copy)))
            i += 1
    return rows + [(500, None), (501, None), (502, ""), (503, " "), (504, "one two"), (505, "One  two"), (506, "one two three"), (None, rows[7][1]), (3, rows[3][1])]


def test_sets_and_overlaps():
    texts = ["a b c d e f", "A  B c d\te", "x", None, "", "a b c d e f"]
    sets = ngram_sets(texts)
    assert [len(s) for s in sets] == [2, 1, 1, 0, 0, 2]
    assert np.isin(sets[1], sets[0]).all() and (sets[0] == sets[5]).all()
    rng = np.random.default_rng(0)
    many = [np.unique(rng.integers(0, 300, 200).astype(np.uint64)) for _ in range(9)]
    want = [[len(set(x.tolist()) & set(y.tolist())) for y in many[4:]] for x in many[:4]]
    assert overlaps(many[:4], many[4:]).tolist() == want


def test_signatures_estimate_jaccard():
    flips, factors = hashers()
    rng = np.random.default_rng(2)
    for share in (0.3, 0.8):
        found = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2654435761)
            a, b = pool[: int(500 * (1 + share))], pool[int(500 * (1 - share)) : 1000]
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            found.append((signature(a, flips, factors) == signature(b, flips, factors)).mean() - true)
        assert abs(np.mean(found)) < 0.02


def test_prefix_is_shortened_until_the_recall_is_met():
    assert shortened_depth(0.99) == ngram_join.DEPTH
    depth = shortened_depth(0.8)
    assert 1 - (1 - 0.8**depth) ** ngram_join.TREES >= ngram_join.RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** ngram_join.TREES


@pytest.mark.parametrize("small_blocks", [False, True])
def test_against_all_pairs(spark, monkeypatch, small_blocks):
    rows = corpus()
    if small_blocks:
        monkeypatch.setattr(ngram_join.near_edges, "__defaults__", (0.8, 0.998, 2))
        monkeypatch.setattr(ngram_join.verified, "__defaults__", (0.8, 2, 100))
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(4)
    want = brute_force(rows)
    out = similar_texts(docs).collect()
    expected = sorted(str((rows[i][0], *want[i])) for i in want)
    assert sorted(str((r["doc_id"], r["class_id"], r["links"], r["text_links"])) for r in out) == expected
    kept = one_of_each(docs)
    classes = {(r["class_id"], r["class_size"]) if r["class_id"] is not None else r["text_key"] for r in out}
    assert kept.count() == len(classes) and kept.columns == docs.columns


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(700):
        copy = list(words)
        copy[int(rng.integers(0, 400))] = f"changed{i}"
        rows.append((i, " ".join(copy), "", 0, 0))
    out = similar_texts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["class_id"] for r in out} == {0} and {r["links"] for r in out} == {699}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (101, 100), (7, 3)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert similar_texts(empty).count() == 0 and one_of_each(empty).count() == 0


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    want = brute_force(rows)
    out = op7_minhash_forest_join(spark, path).collect()
    assert sorted((r["doc_id"], r["class_id"], r["links"], r["text_links"]) for r in out) == sorted((rows[i][0], *want[i]) for i in want)
