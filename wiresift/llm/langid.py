"""Language of a text by a bidirectional gated recurrent network over its bytes.

Two networks of gated recurrent units read a window of bytes from either end; a
softmax over both states labels every byte. A document's probabilities are the
mean of its bytes'. Gates use the piecewise linear sigmoid, which is several times
cheaper than the smooth one. Training is in numpy, by backpropagation through
time with Adam.

A text is read whole, in consecutive windows of ``WINDOW`` bytes; states begin
anew at each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wiresift.llm.common import documents, stored
from wiresift.operators.ordered import kth_row

SAMPLE_ROWS = 2000
WINDOWS_PER_ROW = 4
WINDOW = 128
HIDDEN = 8
EPOCHS = 4
BATCH = 128
RATE = 0.01
SEED = 1_309
LANES = 1024
UNKNOWN = "und"
FOLDS = 5

PARTS = ("table", "recurrent", "output")


def hard_sigmoid(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0.0, 1.0)


def initial(languages: int, hidden: int = HIDDEN, seed: int = SEED) -> dict[str, np.ndarray]:
    """For each direction the input weights of every byte and the recurrent weights (update, reset, candidate); then the output."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {
        "table": draw(2, 256, 3 * hidden, scale=0.3),
        "recurrent": draw(2, hidden, 3 * hidden, scale=1 / np.sqrt(hidden)),
        "output": draw(2 * hidden + 1, languages, scale=0.1),
    }


def unit(table, recurrent, column, h):
    """One step: (update gate, reset gate, candidate, its recurrent part, new state)."""
    n = h.shape[1]
    a, u = np.take(table, column, axis=0), h @ recurrent
    gates = hard_sigmoid(a[:, : 2 * n] + u[:, : 2 * n])
    z, r = gates[:, :n], gates[:, n:]
    candidate = np.tanh(a[:, 2 * n :] + r * u[:, 2 * n :])
    return z, r, candidate, u[:, 2 * n :], candidate + z * (h - candidate)


def states(model: dict, steps: np.ndarray, way: int) -> np.ndarray:
    """The state after each step, (step, lane, unit); ``way`` 1 reads from the end."""
    length, lanes = steps.shape
    n = model["recurrent"].shape[1]
    out, h = np.empty((length, lanes, n), dtype=np.float32), np.zeros((lanes, n), dtype=np.float32)
    for t in range(length) if way == 0 else range(length - 1, -1, -1):
        h = out[t] = unit(model["table"][way], model["recurrent"][way], steps[t], h)[4]
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def position_probabilities(model: dict, steps: np.ndarray) -> np.ndarray:
    """(step, lane, language) for windows given as (step, lane) of byte values."""
    n = model["recurrent"].shape[1]
    out = model["output"]
    return softmax(states(model, steps, 0) @ out[:n] + states(model, steps, 1) @ out[n : 2 * n] + out[2 * n])


def loss_and_gradient(model: dict, steps: np.ndarray, labels: np.ndarray, real: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over the real positions, and its gradient through time."""
    length, lanes = steps.shape
    n = model["recurrent"].shape[1]
    kept = []
    for way in (0, 1):
        h, trace = np.zeros((lanes, n), dtype=model["output"].dtype), {}
        for t in range(length) if way == 0 else range(length - 1, -1, -1):
            before = h
            z, r, candidate, u, h = unit(model["table"][way], model["recurrent"][way], steps[t], h)
            trace[t] = (before, z, r, candidate, u, h)
        kept.append(trace)
    out = model["output"]
    seen = np.concatenate([np.stack([kept[way][t][5] for t in range(length)]) for way in (0, 1)] + [np.ones((length, lanes, 1), dtype=out.dtype)], axis=2)
    p = softmax(seen @ out)
    weight = (real / max(1, real.sum())).astype(out.dtype)
    chosen = p[np.arange(length)[:, None], np.arange(lanes)[None, :], labels[None, :]]
    loss = float(-(np.log(np.maximum(chosen, 1e-12)) * weight).sum())
    p[np.arange(length)[:, None], np.arange(lanes)[None, :], labels[None, :]] -= 1
    p *= weight[:, :, None]
    gradient = {k: np.zeros_like(v) for k, v in model.items()}
    gradient["output"] = np.einsum("tlh,tlc->hc", seen, p)
    by_state = p @ out.T
    for way in (0, 1):
        recurrent, carried = model["recurrent"][way], np.zeros((lanes, n), dtype=out.dtype)
        by_input = np.empty((length, lanes, 3 * n), dtype=out.dtype)
        for t in range(length - 1, -1, -1) if way == 0 else range(length):
            before, z, r, candidate, u, _ = kept[way][t]
            d = carried + by_state[t, :, way * n : (way + 1) * n]
            d_candidate = d * (1 - z) * (1 - candidate**2)
            slope = 0.25 * ((z > 0) & (z < 1))
            d_z = d * (before - candidate) * slope
            d_r = d_candidate * u * (0.25 * ((r > 0) & (r < 1)))
            d_u = np.concatenate([d_z, d_r, d_candidate * r], axis=1)
            by_input[t] = np.concatenate([d_z, d_r, d_candidate], axis=1)
            gradient["recurrent"][way] += before.T @ d_u
            carried = d * z + d_u @ recurrent.T
        np.add.at(gradient["table"][way], steps.ravel(), by_input.reshape(-1, 3 * n))
    return loss, gradient


def train(windows: np.ndarray, labels: np.ndarray, languages: int, epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """The network fitted to windows (window, byte; 0 behind the end) and their labels."""
    model, rng = initial(languages, seed=seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.items()}
    v = {k: np.zeros_like(x) for k, x in model.items()}
    step, total = 0, epochs * -(-len(windows) // BATCH)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(windows)), max(1, -(-len(windows) // BATCH))):
            steps = np.ascontiguousarray(windows[part].T)
            _, gradient = loss_and_gradient(model, steps, labels[part], steps > 0)
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            scale = min(1.0, 1.0 / (1e-9 + np.sqrt(sum(float((g**2).sum()) for g in gradient.values()))))
            for k, g in gradient.items():
                m[k] += 0.1 * (g * scale - m[k])
                v[k] += 0.01 * ((g * scale) ** 2 - v[k])
                model[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: dict


def windows_of(texts: list[str | None], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts (window, byte), padded with 0, and the text each belongs to."""
    data = [(t or "").encode() for t in texts]
    counts = [-(-len(d) // window) for d in data]
    whole = np.frombuffer(b"".join(d.ljust(n * window, b"\0") for d, n in zip(data, counts, strict=True)), dtype=np.uint8)
    return whole.reshape(-1, window), np.repeat(np.arange(len(texts)), counts)


def pooled(model: LanguageModel, texts: list[str | None], lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sum of its bytes' probabilities and how many bytes each language labels."""
    windows, owner = windows_of(texts)
    sums, labelled = (np.zeros((len(texts), len(model.languages))) for _ in range(2))
    for at in range(0, len(windows), lanes):
        steps = np.ascontiguousarray(windows[at : at + lanes].T)
        p = position_probabilities(model.weights, steps)
        p *= (steps > 0)[:, :, None]
        best = p.argmax(axis=2)
        here = owner[at : at + lanes]
        np.add.at(sums, here, p.sum(axis=0))
        for k in range(len(model.languages)):
            np.add.at(labelled[:, k], here, ((best == k) & (steps > 0)).sum(axis=0))
    return sums, labelled


# --- with Spark ------------------------------------------------------------------

def fold(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """The network fitted to at most ``sample_rows`` rows (doc_id, text, lang), as many of each language.

    Which ones is decided by a hash; of each, up to ``WINDOWS_PER_ROW`` windows
    are used, spread over the text. Null texts and null languages teach nothing.
    The languages' names and the sample are all that reaches the driver.
    """
    taught = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    languages = sorted(r["lang"] for r in taught.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], {})
    hashed = taught.select("lang", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("_hash"), "text")
    hashes = stored(hashed.select("lang", "_hash").distinct(), "language-hashes")
    # no language's rows meet in one task; one with fewer rows is taken whole
    last = kth_row(hashes, ["lang"], ["_hash"], max(1, sample_rows // len(languages))).withColumnRenamed("_hash", "_last")
    bounds = hashes.groupBy("lang").agg(F.max("_hash").alias("_most")).join(last, "lang", "left").select("lang", F.coalesce("_last", "_most").alias("_most"))
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(WINDOWS_PER_ROW - 1)),
        lambda k: (F.floor(F.greatest(F.length("text") - WINDOW, F.lit(0)) * k / (WINDOWS_PER_ROW - 1)) + 1).cast("int"),
    )
    sample = (
        hashed.join(bounds, "lang").where("_hash <= _most")  # a row a language, whose names are with the driver anyway
        .select("lang", "_hash", F.explode(F.array_distinct(starts)).alias("start"), "text")
        .select("lang", "_hash", "start", F.substring("text", F.col("start"), F.lit(WINDOW)).alias("part"))
        .distinct()  # rows repeated whole share a hash
        .collect()
    )
    sample.sort(key=lambda r: (r["_hash"], r["start"], r["lang"], r["part"]))
    windows = np.stack([np.frombuffer(r["part"].encode()[:WINDOW].ljust(WINDOW, b"\0"), dtype=np.uint8) for r in sample])
    labels = np.array([languages.index(r["lang"]) for r in sample])
    return LanguageModel(languages, train(windows, labels, len(languages)))


def label(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows with ``lang_pred``, ``score`` and ``labelled``: how many of the text's bytes each language labels.

    A null text, and one without any letter, is ``und`` with score 0. Columns of
    these names are replaced, all others stay. An untaught model knows only ``und``.
    """
    added = ("lang_pred", "score", "labelled")
    rows = rows.select(*[c for c in rows.columns if c not in added])
    text_at = rows.columns.index("text")

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            predicted, scores, counts = [], [], []

            def take(texts: list) -> None:
                known = [bool(model.languages and t and any(map(str.isalpha, t))) for t in texts]
                sums, by_language = pooled(model, [t if k else None for t, k in zip(texts, known, strict=True)]) if model.languages else ([None] * len(texts),) * 2
                for k, p, n in zip(known, sums, by_language, strict=True):
                    predicted.append(model.languages[int(p.argmax())] if k else UNKNOWN)
                    scores.append(float(p.max() / max(p.sum(), 1e-12)) if k else 0.0)
                    counts.append([(name, int(x)) for name, x in zip(model.languages, n, strict=True)] if k else [])

            texts, held = [], 0
            for value in batch.column(text_at):
                texts.append(value.as_py())
                held += len(texts[-1] or "")
                if held >= LANES * WINDOW:
                    take(texts)
                    texts, held = [], 0
            take(texts)
            new = [pa.array(predicted, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.map_(pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added])

    return rows.mapInArrow(labelled, T.StructType([*rows.schema.fields, *T.StructType.fromDDL("lang_pred string, score double, labelled map<string,long>").fields]))


def op9_byte_gru_language(spark, sf_dir) -> DataFrame:
    """Every document's language by a network that learns from the other folds; ``held_out`` marks its own."""
    docs = documents(spark, sf_dir)
    model = fit(docs.where(fold() != 0).select("doc_id", "text", "lang"))
    held_out = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return label(docs.select("doc_id", held_out, "text"), model).select("doc_id", "held_out", "lang_pred", "score")
