from collections import defaultdict

import numpy as np
from hypothesis import given, settings, strategies as st

from wiresift.llm.mixing import fit_budget, measured, mix, mixed_documents, op2_subset_sum_mix

SCHEMA = "doc_id long, text string, source string, copies int, size int"


def levelled(sizes, share=1.5, most=2.0, weights=(3.0, 1.0, 2.0)):
    """Targets by handing the excess round until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, target = share * sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            break
        left = total - sum(most * sizes[s] for s in full)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            break
        full |= over
    return {s: most * sizes[s] if s in full else target[s] for s in names}


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 4)), max_size=7), st.integers(0, 300))
@settings(max_examples=150, deadline=None)
def test_budget_fits_as_well_as_brute_force(classes, budget):
    by_length = defaultdict(int)
    for length, n in classes:
        by_length[length] += n
    lengths, counts = np.array(sorted(by_length), dtype=int), np.array([by_length[k] for k in sorted(by_length)], dtype=int)
    taken = fit_budget(lengths, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    shares = np.array([c * budget // max(1, (lengths * counts).sum()) for c in counts]) if budget < (lengths * counts).sum() else counts
    sums = {int((shares * lengths).sum())}
    for length, spare in zip(lengths, counts - shares, strict=True):
        sums = {s + k * int(length) for s in sums for k in range(int(spare) + 1)}
    best = min(abs(s - budget) for s in sums)
    assert abs(int((taken * lengths).sum()) - budget) == best


def test_large_budget_is_met_exactly():
    rng = np.random.default_rng(3)
    lengths = np.unique(rng.integers(1, 3000, 500))
    counts = rng.integers(1, 1000, len(lengths))
    budget = int((lengths * counts).sum() * 0.37)
    assert int((fit_budget(lengths, counts, budget, dp_words=4096) * lengths).sum()) == budget


def rows(n=400):
    out = []
    for i in range(n):
        source = None if i % 11 == 0 else ("big" if i % 3 else f"s{i % 7}")
        out.append((i, None if i % 50 == 7 else " ".join(["w"] * (i * 13 % 90)), source, 5, 5))
    return out


def test_targets_and_nearness(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    found = mix(measured(docs)).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert 0 <= r["copies"] <= 2
    assert len(found) == 400
    expected = levelled(dict(sizes))
    for s, want in expected.items():
        assert abs(target[s] - want) < 1e-6
        assert abs(taken[s] - want) <= 2
    again = mix(measured(docs.repartition(7))).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_mixed_documents_keep_their_columns(spark):
    docs = spark.createDataFrame(rows(120) + [(5, "a b c", "big", 1, 1)] * 2 + [(None, "x y", None, 1, 1)], SCHEMA)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    want = sum(r["copies"] * r["rows"] for r in mix(measured(docs)).collect())
    assert out.count() == want


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix(measured(empty)).count() == 0
    blank = spark.createDataFrame([(1, None, "a", 0, 0), (2, " \t", None, 0, 0)], SCHEMA)
    assert {(r["doc_id"], r["copies"], r["target"]) for r in mix(measured(blank)).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}


def test_registered_query(spark):
    out = op2_subset_sum_mix(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert out.count() == n
