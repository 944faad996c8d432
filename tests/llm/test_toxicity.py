import numpy as np
import pytest
from pyspark.sql import functions as F

from wiresift.llm import toxicity
from wiresift.llm.toxicity import features, fit, fit_ordinal, labelled_sample, op10_ordinal_toxicity, ordinal_gradient, score, thresholds_of

DOCS = "doc_id long, text string, toxic int, severity string, lang string"


def test_features_are_of_words_and_their_starts():
    row, ids = features(["Foo foo, foobar", None, "", "--", "foobars"])
    assert set(row.tolist()) == {0, 4}
    first, last = ids[row == 0], ids[row == 4]
    assert len(np.unique(ids[row == 0])) == len(np.unique(features(["foobar foo"])[1]))
    assert len(set(first.tolist()) & set(last.tolist())) == 3  # the leading 4, 5 and 6 bytes of foobar


def test_gradient():
    rng = np.random.default_rng(0)
    rows, index, values = rng.integers(0, 30, 90), rng.integers(0, 5, 90), rng.random(90)
    grades = rng.integers(0, 4, 30)
    at = rng.normal(size=5 + 3) * 0.3
    loss, gradient = ordinal_gradient(at, rows, index, values, grades, 5, 0.01)
    for i in range(len(at)):
        step = np.zeros_like(at)
        step[i] = 1e-6
        numeric = (ordinal_gradient(at + step, rows, index, values, grades, 5, 0.01)[0] - ordinal_gradient(at - step, rows, index, values, grades, 5, 0.01)[0]) / 2e-6
        assert abs(numeric - gradient[i]) < 1e-5
    assert (np.diff(thresholds_of(at[5:])) > 0).all()


def test_grades_are_recovered():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, 4, 400)
    rows, index = np.arange(400), np.zeros(400, dtype=int)
    weights, thresholds = fit_ordinal(rows, index, grades + rng.normal(0, 0.1, 400), grades, 1, steps=1500)
    s = weights[0] * np.arange(4)
    assert ((s[:, None] > thresholds[None, :]).sum(axis=1) == np.arange(4)).all()


def corpus():
    rng = np.random.default_rng(5)
    words = ["river", "stone", "green", "walk", "table", "music", "paper", "cloud"]
    bad = ["vilewretch", "vilething", "foulmouth"]
    rows = []
    for i in range(600):
        text = list(rng.choice(words, rng.integers(5, 60)))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.integers(1, 6)):
                text.insert(int(rng.integers(0, len(text))), str(rng.choice(bad)))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_unlabelled_rows_are_told_apart(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, x, "x", "en") for i, t, x in rows], DOCS)
    labels = spark.createDataFrame([(i, x) for i, _, x in rows[:400]] + [(1, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    model = fit(docs, labels)
    more = spark.createDataFrame([(900, None, 0, None, None), (901, "", 0, None, None), (902, "stone " * 30000 + "vilewretch " * 3, 1, None, None), (None, "foulmouth vilething", 1, None, None)], DOCS)
    out = score(docs.unionByName(more).withColumn("truth", F.col("toxic")), model).collect()
    held = [r for r in out if r["doc_id"] is None or r["doc_id"] >= 400]
    assert all(r["toxic"] == bool(r["truth"]) for r in held)
    assert all(0 <= r["severity"] <= 3 and r["toxic"] == (r["probability"] >= 0.5) for r in out)
    assert len(out) == 604
    again = fit(docs.repartition(5), labels.repartition(3))
    assert np.allclose(model.weights, again.weights) and (model.ids == again.ids).all()


@pytest.mark.parametrize("share", [0.45, 0.6, 0.9])
def test_mostly_toxic_labels(spark, share):
    rows = corpus()
    toxic, others = [r for r in rows if r[2]], [r for r in rows if not r[2]]
    taught = toxic[:60] + others[: round(60 * (1 - share) / share)]
    docs = spark.createDataFrame([(i, t, x, "x", "en") for i, t, x in rows], DOCS)
    out = score(docs, fit(docs, spark.createDataFrame([(i, x) for i, _, x in taught], "doc_id long, toxic int"))).collect()
    truth, held = {i: x for i, _, x in rows}, {r[0] for r in rows} - {r[0] for r in taught}
    found = {r["doc_id"] for r in out if r["toxic"]}
    assert all(i in found for i in held if truth[i])
    if share < 0.9:  # the few others of the last case do not say what is harmless
        assert not any(i in found for i in held if not truth[i])


def test_toxic_by_what_is_missing(spark):
    rng, words = np.random.default_rng(8), ["river", "stone", "green", "walk", "table"]
    rows = [(i, " ".join([*rng.choice(words, 12), *(["harmless"] if i % 5 < 2 else [])]), int(i % 5 >= 2)) for i in range(300)]
    docs = spark.createDataFrame([(i, t, x, "x", "en") for i, t, x in rows], DOCS)
    out = score(docs, fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows[:150]], "doc_id long, toxic int"))).collect()
    assert all(r["toxic"] == (r["doc_id"] % 5 >= 2) for r in out)


def test_sample_is_bounded_and_consistent(spark):
    docs = spark.createDataFrame([(i, "x", 0, "", "") for i in range(50)], DOCS)
    labels = spark.createDataFrame([(i % 50, i % 2) for i in range(100)] + [(7, 0)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, 10).count() == 10
    assert 7 not in [r["doc_id"] for r in labelled_sample(docs, labels, 50).collect()]


def test_sample_of_a_repeated_id(spark):
    rows = [(1, f"text {i}", 0, "", "") for i in range(300)] + [(2, "same", 0, "", "")] * 300 + [(i, "x", 0, "", "") for i in range(3, 20)] + [(20, None, 0, "", "")]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(1, 21)] + [(i, 0) for i in range(1000, 1500)], "doc_id long, toxic int")
    assert labelled_sample(docs, labels, 100).count() == 100
    found = [(r["doc_id"], r["text"]) for r in labelled_sample(docs, labels, 500).collect()]
    assert len(found) == len(set(found)) == 318 and found.count((2, "same")) == 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b", 0, "", "")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["toxic"] for r in score(docs, fit(docs, none)).collect()] == [False]
    assert score(docs.limit(0), fit(docs.limit(0), none)).count() == 0


def test_accuracy_on_rows_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 250)
    path = "/root/testdata/sf0.01"
    docs, labels = toxicity.documents(spark, path), toxicity.table(spark, path, "labels")
    taught = labelled_sample(docs, labels, 250).select("doc_id")
    out = score(docs, fit(docs, labels, sample_rows=250)).join(taught, "doc_id", "left_anti").join(labels.withColumnRenamed("toxic", "truth"), "doc_id")
    rows = out.collect()
    assert sum(r["toxic"] and not r["truth"] for r in rows) <= 1
    assert np.mean([r["toxic"] for r in rows if r["truth"]]) > 0.5  # 250 rows in four languages


def test_registered_query(spark):
    out = op10_ordinal_toxicity(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "severity", "grade", "probability", "toxic"]
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
