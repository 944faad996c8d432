import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from hypothesis import given, settings, strategies as st

from wiresift.llm import filter_audit
from wiresift.llm.filter_audit import FILTERS, Trie, audit, bounds, failed, op11_filter_audit, shared

SCHEMA = "doc_id long, text string, lang string, part string, fails int, bucket int, rows int"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute_masks(rows):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    out = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and least[text] < doc_id,
        }
        out.append((doc_id, lang or "", {f for f in FILTERS if fails[f]}))
    return out


def brute_force(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    parts = defaultdict(list)
    for doc_id, part, fails in brute_masks(rows):
        parts[part].append((doc_id, fails))
    out, removed_by = [], Counter()
    for part, docs in parts.items():
        for order in permutations(FILTERS):
            left = docs
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                earlier = set(order[: step - 1])
                removed_by[part, name] += len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), sum(name in f and bool(f & earlier) for _, f in docs),
                            sum(f == {name} for _, f in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
    return sorted((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


def got(out):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return sorted(tuple(r) for r in out.select(*names).collect())


def frames(spark, rows, labels, files=4):
    return spark.createDataFrame([(i, t, g, "p", 1, 2, 3) for i, t, g in rows], SCHEMA).repartition(files), spark.createDataFrame([(*x, "p") for x in labels], LABELS)


def corpus():
    many = " ".join(f"w{i}" for i in range(120))
    rows = [(i, f"{many} tail{i % 7}" if i % 3 else many, ["en", "de", None, ""][i % 4]) for i in range(60)]
    rows += [(100 + i, "same same same " * 50, "en") for i in range(20)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "ABC DEF", "de"), (203, "a # b", None), (None, many, "en"), (None, many, "en"), (5, rows[5][1], "fr"), (3, many, "en"), (3, many, "en")]
    rows += [(300, "long words é " * 60_000, "en"), (301, "long words é " * 60_000, "en"), (302, "long words é " * 60_000 + ".", "en"), (1, "É" * 9 + "A", "x y"), (2, "ÉA", "x y")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 310, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1), (6, None, None)]
    return rows, labels


@pytest.mark.parametrize("small", [False, True])
def test_brute_force(spark, monkeypatch, small):
    if small:  # many ranges, hash buckets within them, blocks of a few texts, samples told apart late
        monkeypatch.setattr(filter_audit, "RANGE_BYTES", (200, 2000))
        monkeypatch.setattr(filter_audit, "MOST_RANGES", 12)
        monkeypatch.setattr(filter_audit, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(filter_audit, "FIRST_BYTES", 2)
    rows, labels = corpus()
    docs, said = frames(spark, rows, labels)
    found = Counter()
    for r in failed(docs).collect():
        found[r["doc_id"], r["part"], r["fails"]] += r["rows"]
    assert found == Counter((i, part, sum(1 << FILTERS.index(f) for f in fails)) for i, part, fails in brute_masks(rows))
    assert got(audit(failed(docs), said)) == brute_force(rows, labels)


def test_empty_table(spark):
    docs, said = frames(spark, [], [])
    assert audit(failed(docs), said).count() == 0


@given(st.lists(st.tuples(st.text("ab", max_size=6).map(str.encode), st.one_of(st.none(), st.integers(0, 9))), max_size=40))
@settings(max_examples=200, deadline=None)
def test_trie(rows):
    trie = Trie()
    for n, (text, doc_id) in enumerate(rows):
        trie.add(text, doc_id, n)
    ends = list(trie.ends())
    assert [t for t, _, _ in ends] == sorted({t for t, _ in rows})
    for text, least, held in ends:
        own = [(i, n) for n, (t, i) in enumerate(rows) if t == text]
        assert held == own and least == min((i for i, _ in own if i is not None), default=None)


@given(st.binary(max_size=30), st.binary(max_size=30), st.binary(max_size=40))
def test_shared(a, b, both):
    x, y = both + a, both + b
    n = shared(x, y)
    assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])


def test_bounds_are_as_long_as_it_takes():
    same = b"x" * 500
    sample = sorted((same + bytes([65 + i]), 10) for i in range(16))
    cuts = bounds(sample, 4)
    assert len(cuts) == 3 and all(len(c) == 501 for c in cuts)
    assert bounds([(b"a", 1), (b"q", 1)], 2) == [b"q"]
    assert bounds([(b"a", 1)], 3) == []


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got(op11_filter_audit(spark, path)) == brute_force(rows, labels)
