"""What holds for all operators alike: columns of any name, repeated rows, values at the edges."""

import numpy as np
import pytest

from wiresift.llm import exact_dedup, langid, line_dedup, mixing, nearest, ngram_join, substring_dedup

CLASHING = ["_doc", "_key", "_nos", "_copies", "_block", "_within", "_found", "_copy", "doc", "key", "kept", "copy", "taken", "row", "rows", "found"]


def clashing(spark):
    texts = [" ".join(f"w{i * 31 % 17}x{j}" for j in range(40)) for i in range(4)] + [None, ""]
    rows = [(i, texts[i % 6], "s" if i % 2 else None, *[100 * i + n for n in range(len(CLASHING))]) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in CLASHING))


@pytest.mark.parametrize("stage", [line_dedup.documents_without_lines, mixing.mixed_documents, ngram_join.one_of_each, substring_dedup.remove_repeats])
def test_clashing_columns_come_back(spark, stage):
    docs = clashing(spark)
    out = stage(docs)
    assert [c for c in out.columns if c != "removed"] == docs.columns
    got = out.collect()
    assert got
    for r in got:
        assert [r[c] for c in CLASHING] == [100 * r["doc_id"] + n for n in range(len(CLASHING))]


def test_exact_dedup_beside_a_column_of_spark_s_name(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, None, 7)], "doc_id long, text string, _metadata int").write.parquet(path)
    out = exact_dedup.exact_dedup(spark, path).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in out) == [(1, 2, False), (2, 2, True), (3, 3, True)]


def test_a_row_repeated_often_is_taken_one_by_one(spark):
    rows = [(1, "w " * 99, "hot")] * 100 + [(i, "one two", "hot") for i in range(2, 52)] + [(100 + i, "x " * 50, "other") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = mixing.mix(mixing.measured(docs)).collect()
    taken, target = {}, {}
    for r in found:
        taken[r["source"]] = taken.get(r["source"], 0) + r["rows"] * r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert sum(r["rows"] for r in found) == len(rows)
    assert all(abs(taken[s] - target[s]) <= 2 for s in taken)
    assert mixing.mixed_documents(docs).count() == sum(r["rows"] * r["copies"] for r in found)


@pytest.mark.parametrize("large", [1e25, 1e30, 1e200])
def test_one_huge_vector_hides_no_neighbours(spark, large):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 16))
    vectors[17] = large
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = nearest.nearest(frame, frame.where("vec_id % 40 = 0"), k=5).collect()
    hits = 0
    for q in range(0, 400, 40):
        distance = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1)) if large < 1e100 else np.sqrt(((np.clip(vectors, -1e100, 1e100) - vectors[q]) ** 2).sum(axis=1))
        distance[q] = np.inf
        hits += len({r["vec_id"] for r in out if r["query_id"] == q} & set(np.argsort(distance)[:5].tolist()))
    assert len(out) == 50 and hits >= 45


def test_signs_without_letters_have_no_language(spark):
    texts = ["½ ² Ⅷ ①", "12 34", "!?", "", None]
    taught = spark.createDataFrame([(i, "abc def" if i % 2 else "äöü ßß", "a" if i % 2 else "b") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.fit(taught)
    out = langid.label(spark.createDataFrame(list(enumerate(texts)) + [(9, "1 a")], "doc_id long, text string"), model).collect()
    assert all(r["lang_pred"] == langid.UNKNOWN for r in out if r["doc_id"] < 9)
    assert [r["lang_pred"] for r in out if r["doc_id"] == 9] != [langid.UNKNOWN]
