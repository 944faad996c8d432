import zlib

import numpy as np

from wiresift.llm import langid
from wiresift.llm.langid import LanguageModel, fit, fold, initial, label, loss_and_gradient, op9_byte_gru_language, pooled, position_probabilities, train, windows_of

SCHEMA = "doc_id long, text string, lang string, score string"


def test_gradient_through_time():
    rng = np.random.default_rng(3)
    model = {k: v.astype(np.float64) for k, v in initial(3, hidden=4, seed=7).items()}
    steps, labels = rng.integers(0, 255, (9, 6)), rng.integers(0, 3, 6)
    real = steps > 20
    gradient = loss_and_gradient(model, steps, labels, real)[1]
    spots = [("table", (w, int(steps[t, 1]), u)) for w in (0, 1) for t in (0, 8) for u in (0, 5, 11)]
    spots += [("recurrent", (w, 1, u)) for w in (0, 1) for u in (0, 6, 9)] + [("output", (k, 2)) for k in (0, 5, 8)]
    for part, at in spots:
        values = []
        for sign in (1, -1):
            changed = {k: v.copy() for k, v in model.items()}
            changed[part][at] += sign * 1e-6
            values.append(loss_and_gradient(changed, steps, labels, real)[0])
        assert abs((values[0] - values[1]) / 2e-6 - gradient[part][at]) < 1e-6


def test_windows_cover_the_whole_text():
    windows, owner = windows_of(["abc" * 100, None, "", "é" * 70], window=128)
    assert owner.tolist() == [0, 0, 0, 3, 3]
    assert windows[owner == 0].tobytes().rstrip(b"\0").decode() == "abc" * 100


def test_pooling_is_the_mean_over_all_bytes():
    model = LanguageModel(["a", "b"], initial(2))
    text = "some text, over more than one window. " * 9
    sums, labelled = pooled(model, [text, "x"], lanes=2)
    windows, _ = windows_of([text])
    p = position_probabilities(model.weights, np.ascontiguousarray(windows.T)).transpose(1, 0, 2).reshape(-1, 2)[: len(text)]
    assert np.allclose(sums[0], p.sum(axis=0), atol=1e-3)
    assert labelled[0].sum() == len(text) and labelled[0][0] == (p.argmax(axis=1) == 0).sum()


def test_learns_two_alphabets():
    rng = np.random.default_rng(0)
    windows = np.stack([rng.choice(np.frombuffer(b"abcd ef" if i % 2 else b"cdef gh", np.uint8), 128) for i in range(200)])
    model = LanguageModel(["x", "y"], train(windows, np.arange(200) % 2, 2, epochs=12))
    sums, _ = pooled(model, ["dfe gch" * 9, "abd cef" * 9])
    assert sums.argmax(axis=1).tolist() == [0, 1]


def test_edge_rows(spark):
    rows = spark.createDataFrame([(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 34 -- 5", None, "x"), (None, "abc", None, None), (4, "abc " * 40000, "de", "x"), (4, "abc " * 40000, "de", "x")], SCHEMA)
    model = LanguageModel(["de", "en"], initial(2))
    out = {r["doc_id"]: r for r in label(rows, model).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and out[1]["score"] == 0.0
    assert out[None]["lang_pred"] in ("de", "en") and 0 <= out[4]["score"] <= 1
    assert sum(out[4]["labelled"].values()) == 160000
    assert label(rows.limit(0), model).count() == 0
    untaught = fit(rows.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in label(rows, untaught).collect()} == {"und"}


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    out = op9_byte_gru_language(spark, path).collect()
    assert len(out) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.9


def test_learns_from_other_folds_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda rows: seen.append(rows) or LanguageModel([], {}))
    op9_byte_gru_language(spark, "/root/testdata/sf0.001")
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in seen[0].collect())
    assert seen[0].where(fold() == 0).count() == 0
