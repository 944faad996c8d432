"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are words and the first few bytes of words, counted once or more in a
document. One weight vector serves all thresholds: with s the weighted sum of the
document's features, P(grade > k) = sigmoid(s - threshold_k), the thresholds in
order. The expected severity is the sum of these over k.

The fit uses a bounded sample of labelled rows; counting which features set
toxic rows apart, fitting and scoring see nothing but text and labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from wiresift.llm.common import blocks, documents, stored, table, text_key

SAMPLE_ROWS = 12_000
FEATURES = 4096
LEAST_DOCUMENTS = 4
TIMES_AS_OFTEN = 2  # how much more of one class than of the other has a feature
LEAST_APART = 10.83  # chi squared that chance exceeds once in a thousand; asked of features of the other class only
GRADES = 3
PREFIX_BYTES = (4, 5, 6, 8)
BLOCK_BYTES = 1 << 19
SIEVE_BITS = 20
SEED = 4_511

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
# bytes that end a word: every ASCII byte that is no letter or digit
_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature id) of every word of the texts, lower-cased: its leading bytes and the word itself."""
    data = b" ".join((t or "").lower().encode() for t in texts) + b" "
    sizes = np.array([len((t or "").lower().encode()) + 1 for t in texts], dtype=np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8)
    inside = ~_BREAK[bytes_]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not starts.size:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    row = np.searchsorted(np.cumsum(sizes), starts, side="right")
    with np.errstate(over="ignore"):
        ids, rows, packed = [], [], np.zeros(len(starts), dtype=np.uint64)
        for k in range(max(PREFIX_BYTES)):
            at = np.minimum(starts + k, len(bytes_) - 1)
            packed |= np.where(k < lengths, bytes_[at], 0).astype(np.uint64) << np.uint64(8 * k)
            if k + 1 in PREFIX_BYTES:
                long_enough = lengths > k  # a shorter word is already there as a whole
                ids.append((packed[long_enough] * _MIX) ^ np.uint64(k + 1))
                rows.append(row[long_enough])
        powers = np.cumprod(np.full(int(lengths.max()), _BASE, dtype=np.uint64))
        letters = np.flatnonzero(inside)
        within = letters - np.repeat(starts, lengths)
        sums = np.add.reduceat((bytes_[letters].astype(np.uint64) + np.uint64(1)) * powers[within], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        ids.append(sums * _MIX)
        rows.append(row)
    return np.concatenate(rows), np.concatenate(ids)


@dataclass(frozen=True)
class OrdinalModel:
    """Sorted feature ids with their weights, and the ordered thresholds."""

    ids: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def sums(self, texts: list[str | None]) -> np.ndarray:
        rows, index, values = counted(texts, self.ids, self.sieve())
        return np.bincount(rows, weights=self.weights[index] * values, minlength=len(texts))

    def sieve(self) -> np.ndarray:
        return sieve_of(self.ids)

    def above(self, sums: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a row a document."""
        return sigmoid(sums[:, None] - self.thresholds[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def sieve_of(ids: np.ndarray) -> np.ndarray:
    """A bit table that nearly all other features fall through, so that few have to be looked up."""
    sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
    sieve[(ids >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
    return sieve


def counted(texts: list[str | None], ids: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in ``ids``, log of one plus the count) of the known features."""
    row, found = features(texts)
    if not len(ids) or not len(found):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    maybe = np.flatnonzero(sieve[(found >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
    row, found = row[maybe], found[maybe]
    at = np.minimum(np.searchsorted(ids, found), len(ids) - 1)
    hit = ids[at] == found
    pair, n = np.unique(row[hit] * len(ids) + at[hit], return_counts=True)
    return pair // len(ids), pair % len(ids), np.log1p(n)


def fit_ordinal(
    rows: np.ndarray, index: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int,
    steps: int = 800, rate: float = 0.05, ridge: float = 1e-5,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the mean negative log likelihood, by Adam on all rows.

    Thresholds are the first one and the logarithms of the steps between them,
    so they stay in order.
    """
    top, n = int(grades.max(initial=0)), len(grades)
    parameters = np.zeros(n_features + max(top, 1))
    share = np.clip(np.array([(grades > k).mean() for k in range(max(top, 1))]), 1e-4, 1 - 1e-4)
    first = -np.log(share / (1 - share))
    parameters[n_features] = first[0]
    parameters[n_features + 1 :] = np.log(np.maximum(np.diff(first), 0.05))
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        gradient = ordinal_gradient(parameters, rows, index, values, grades, n_features, ridge)[1]
        m += 0.1 * (gradient - m)
        v += 0.001 * (gradient**2 - v)
        parameters -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return parameters[:n_features], thresholds_of(parameters[n_features:])


def thresholds_of(raw: np.ndarray) -> np.ndarray:
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def ordinal_gradient(parameters, rows, index, values, grades, n_features, ridge) -> tuple[float, np.ndarray]:
    """The loss and its gradient."""
    weights, raw = parameters[:n_features], parameters[n_features:]
    cuts, n = thresholds_of(raw), len(grades)
    s = np.bincount(rows, weights=weights[index] * values, minlength=n)
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    with np.errstate(invalid="ignore"):
        upper, lower = sigmoid(edges[grades + 1] - s), sigmoid(edges[grades] - s)
    p = np.maximum(upper - lower, 1e-12)
    by_upper, by_lower = upper * (1 - upper) / p, lower * (1 - lower) / p  # of the log likelihood, by the two edges
    ds = (by_upper - by_lower) / n
    gradient = np.empty_like(parameters)
    gradient[:n_features] = np.bincount(index, weights=ds[rows] * values, minlength=n_features) + 2 * ridge * weights
    cut = np.bincount(grades, weights=-by_upper / n, minlength=len(cuts) + 1)[: len(cuts)]
    cut += np.bincount(grades, weights=by_lower / n, minlength=len(cuts) + 1)[1:]
    gradient[n_features:] = np.concatenate([[cut.sum()], np.exp(raw[1:]) * np.cumsum(cut[::-1])[::-1][1:]])
    return float(-np.log(p).mean() + ridge * (weights**2).sum()), gradient


# --- with Spark ------------------------------------------------------------------

def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, toxic), the first by a seeded hash.

    Labels that are null, and ids that are labelled both ways, teach nothing. A
    row repeated whole counts once, and a label without a text takes no place. The
    first text of an id goes by the hash of the id, further ones by that of both,
    so an id with many texts has the places that as many ids would have.
    """
    clear = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most").drop("_most")
    )
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", text_key().alias("_key"))
    # keys stand for texts until few enough rows are left, so that texts are not shuffled
    found = texts.select("doc_id", "_key").join(clear, "doc_id").groupBy("doc_id", "_key").agg(F.min("toxic").alias("toxic"))
    found = stored(found, "toxicity-labelled")
    firsts = found.groupBy("doc_id").agg(F.min("_key").alias("_first"))
    place = F.when(F.col("_key") == F.col("_first"), F.xxhash64(F.lit(SEED), "doc_id")).otherwise(F.xxhash64(F.lit(SEED), "doc_id", "_key"))
    chosen = found.join(firsts, "doc_id").orderBy(place, "doc_id", "_key").limit(rows).drop("_first")
    return texts.join(F.broadcast(chosen), ["doc_id", "_key"]).groupBy("doc_id", "_key").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).drop("_key")


def telling_features(sample: DataFrame, most: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The features that set toxic rows of the sample apart most (chi squared), counted by rows that have them.

    A feature counts if the share of toxic rows that have it is more than twice
    that of the other rows, or the other way round and hardly by chance. Shares of
    one class each do not change with how many rows are toxic. Sorted ids, and
    the log odds of a toxic row to have the feature against those of another row.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, 0, BLOCK_BYTES):
            row, found = features([t for t, _ in rows])
            order = np.lexsort((found, row))
            row, found = row[order], found[order]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (row[1:] != row[:-1]) | (found[1:] != found[:-1])
            toxic = np.array([bool(x) for _, x in rows])[row[new]]
            ids, at = np.unique(found[new], return_inverse=True)
            n = np.bincount(at, minlength=len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.view(np.int64)), pa.array(n), pa.array(np.bincount(at, weights=toxic, minlength=len(ids)).astype(np.int64))],
                ["feature", "n", "toxic"],
            )

    totals = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)).alias("toxic")).first()
    if not totals["toxic"] or totals["toxic"] == totals["n"]:
        return np.empty(0, dtype=np.uint64), np.empty(0)
    counts = (
        sample.select("text", "toxic").mapInArrow(seen, "feature long, n long, toxic long")
        .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    )
    n, toxic, size, bad = F.col("n"), F.col("toxic"), float(totals["n"]), float(totals["toxic"])
    apart = size * (toxic * size - n * bad) ** 2 / F.greatest(n * (size - n) * (bad * (size - bad)), F.lit(1.0))
    of_toxic, of_others = toxic / bad, (n - toxic) / (size - bad)
    telling = (of_toxic > TIMES_AS_OFTEN * of_others) | ((of_others > TIMES_AS_OFTEN * of_toxic) & (apart > LEAST_APART))
    rows = counts.where((n >= LEAST_DOCUMENTS) & telling).orderBy(apart.desc(), "feature").limit(most).collect()
    ids = np.array([r["feature"] for r in rows], dtype=np.int64).view(np.uint64)
    with_, without = np.array([r["toxic"] for r in rows], dtype=float), np.array([r["n"] - r["toxic"] for r in rows], dtype=float)
    odds = np.log((with_ + 0.5) / (bad - with_ + 0.5)) - np.log((without + 0.5) / (size - bad - without + 0.5))
    order = np.argsort(ids)
    return ids[order], odds[order]


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, most_features: int = FEATURES) -> OrdinalModel:
    """The model of a bounded sample.

    Labels say toxic or not. Grade 0 is not toxic; toxic rows are graded 1 to
    ``GRADES``, in equal parts, by the telling features they have: the logarithms
    of their counts times their log odds, summed. Without labels of both kinds, or
    without a feature that tells them apart, nothing is toxic.
    """
    sample = stored(labelled_sample(docs, labels, sample_rows), "toxicity-sample")
    ids, odds = telling_features(sample, most_features)
    if not len(ids):
        return OrdinalModel(ids, np.empty(0), np.array([40.0] * GRADES))
    sieve = sieve_of(ids)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, 1, BLOCK_BYTES):
            row, at, values = counted([r[1] for r in rows], ids, sieve)
            split = np.searchsorted(row, np.arange(1, len(rows)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([bool(r[2]) for r in rows]),
                    pa.array([x.tolist() for x in np.split(at, split)], pa.list_(pa.int64())),
                    pa.array([x.tolist() for x in np.split(values, split)], pa.list_(pa.float64())),
                ],
                ["doc_id", "toxic", "at", "value"],
            )

    found = sample.select("doc_id", "text", "toxic").mapInArrow(hits, "doc_id long, toxic boolean, at array<long>, value array<double>")
    found = sorted(found.collect(), key=lambda r: (r["doc_id"], r["toxic"], r["at"], r["value"]))  # at most sample_rows rows of known features
    toxic = np.array([r["toxic"] for r in found])
    rows = np.repeat(np.arange(len(found)), [len(r["at"]) for r in found])
    index = np.array([x for r in found for x in r["at"]], dtype=np.int64)
    values = np.array([x for r in found for x in r["value"]])
    strength = np.bincount(rows, weights=values * np.maximum(odds[index], 0), minlength=len(found))
    cuts = np.quantile(strength[toxic], [k / GRADES for k in range(1, GRADES)])
    grades = np.where(toxic, 1 + np.searchsorted(cuts, strength, side="right"), 0)
    weights, thresholds = fit_ordinal(rows, index, values, grades, len(ids))
    return OrdinalModel(ids, weights, thresholds)


SCORED = "severity double, grade int, probability double, toxic boolean"


def score(rows: DataFrame, model: OrdinalModel) -> DataFrame:
    """Rows with ``severity`` (expected grade), ``grade`` (the most likely at least half the time), ``probability`` of
    a grade above 0, and ``toxic``, whether that is at least one half. All other columns but ones of these names stay.

    Null and empty texts have no features and get the model's base rate. Texts are read whole.
    """
    kept = [c for c in rows.columns if c not in ("severity", "grade", "probability", "toxic")]
    rows = rows.select(*kept)
    text_at = kept.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = model.sieve()
        for batch in batches:
            sums, texts, held = [], [], 0

            def take(texts: list) -> np.ndarray:
                row, at, values = counted(texts, model.ids, sieve)
                return np.bincount(row, weights=model.weights[at] * values, minlength=len(texts))

            for value in batch.column(text_at):
                texts.append(value.as_py())
                held += len(texts[-1] or "")
                if held >= BLOCK_BYTES:
                    sums.append(take(texts))
                    texts, held = [], 0
            if texts:
                sums.append(take(texts))
            above = model.above(np.concatenate(sums) if sums else np.empty(0))
            new = [pa.array(above.sum(axis=1)), pa.array((above >= 0.5).sum(axis=1), pa.int32()), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "severity", "grade", "probability", "toxic"])

    return rows.mapInArrow(scored, T.StructType([*rows.schema.fields, *T.StructType.fromDDL(SCORED).fields]))


def op10_ordinal_toxicity(spark, sf_dir) -> DataFrame:
    """Every document with its expected severity, grade and whether it counts as toxic."""
    docs = documents(spark, sf_dir)
    return score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels"))).drop("text")
