import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from wiresift.llm.merkle import FIELDS, fold, manifest, op13_merkle_manifest, proof_digest, verified

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, tree string, idx string, digest string, _lang int, proof int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def tree_of(leaves, fanout):
    """The levels of digests, and each leaf's path as a list of (slot, run)."""
    levels, paths = [leaves], [[] for _ in leaves]
    at = list(range(len(leaves)))
    while len(levels[-1]) > 1:
        last = levels[-1]
        runs = [last[i : i + fanout] for i in range(0, len(last), fanout)]
        for leaf, i in enumerate(at):
            paths[leaf].append((i % fanout, runs[i // fanout]))
        at = [i // fanout for i in at]
        levels.append([h(*r) for r in runs])
    return levels, paths


def brute_force(rows, fanout=2):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subtrees = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, leaf_of(r)))
        subtrees[name] = (own, *tree_of([leaf_of(r) for r in own], fanout))
    top_levels, top_paths = tree_of([subtrees[n][1][-1][0] for n in names], fanout) if names else ([[None]], [])
    out = []
    for n, name in enumerate(names):
        own, levels, paths = subtrees[name]
        for row, path in zip(own, paths, strict=True):
            path = path + top_paths[n]
            claimed = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None:
                claimed["n_chars"] += 1
            digest = leaf_of(claimed)
            for slot, run in path:
                digest = h(*run[:slot], digest, *run[slot + 1 :])
            siblings = [d for slot, run in path for s, d in enumerate(run) if s != slot]
            root = top_levels[-1][0]
            out.append((row["doc_id"], leaf_of(row), levels[-1][0], root, h(*siblings), digest, digest == root))
    return sorted(map(str, out))


def rows_for(counts, start=0):
    rows, i = [], start
    for lang, n in counts:
        for _ in range(n):
            rows.append({"doc_id": i, "text": f"text {i} é" if i % 9 else None, "lang": lang, "source": f"s{i % 3}" if i % 4 else None, "n_chars": i * 7 % 100 if i % 6 else None})
            i += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "t", "i", "d", 1, 2) for r in rows], SCHEMA).repartition(4)


def got(checked):
    out = checked.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("p"), "folded_root", "verified").collect()
    return sorted(str(tuple(r)) for r in out)


@pytest.mark.parametrize("counts", [[("en", 37), (None, 5), ("de", 1), ("é", 16), ("", 3)], [("en", 1)], [(None, 6)], [("a", 2), ("b", 1)]])
def test_brute_force(spark, counts):
    rows = rows_for(counts)
    assert got(verified(frame(spark, rows))) == brute_force(rows)


def test_ties_repeated_rows_null_ids_and_long_texts(spark):
    rows = rows_for([("en", 9), ("fr", 4)])
    rows += [dict(rows[3]), dict(rows[3], text="another"), dict(rows[2], doc_id=None), dict(rows[2], doc_id=None), dict(rows[1], doc_id=500, text="word " * 300_000)]
    out = verified(frame(spark, rows))
    assert got(out) == brute_force(rows)
    assert {r["verified"] for r in out.collect()} == {True, False}


@pytest.mark.parametrize("fanout", [3, 5])
def test_wider_runs(spark, fanout):
    rows = rows_for([("en", 23), ("fr", 7), ("it", 3)])
    found = manifest(frame(spark, rows), fanout=fanout).withColumn("folded", fold(F.col("leaf"), F.col("proof"))).collect()
    assert all(r["folded"] == r["root"] for r in found)
    want = {s.split(",")[0]: s for s in brute_force(rows, fanout)}
    for r in found:
        assert f"'{r['leaf']}', '{r['subroot']}', '{r['root']}'" in want[f"({r['doc_id']}"]


def test_empty_table(spark):
    assert verified(frame(spark, [])).count() == 0


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in spark.read.parquet(f"{path}/documents.parquet").select(*FIELDS).collect()]
    out = op13_merkle_manifest(spark, path)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in out.select(*names).collect()) == brute_force(rows)
