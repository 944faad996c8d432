"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector's difference from the mean of all is rotated at random and kept as the
signs of its coordinates, its length, and the inner product of the unit
difference with its code. From these a query's inner product with the vector is
estimated without bias, and a bound on the error follows from the last number.
Vectors whose distance, less its bound, is no more than the tenth smallest
distance with its bound added are compared exactly.

Every query meets every row, in blocks: rows are dealt to blocks of about
``BLOCK_ROWS`` and queries to groups of about ``QUERY_ROWS``, so the memory of a
task does not grow with the table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wiresift.llm.common import stored, table

NEIGHBOURS = 10
QUERY_STEP = 100
BLOCK_ROWS = 16_384
QUERY_ROWS = 4_096
QUERIES_AT_ONCE = 64
ERRORS = 2.5  # how many standard deviations the error bound spans
SEED = 60_601

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, length, inner product of unit difference and code) of each row."""
    away = vectors - centre
    length = np.sqrt((away**2).sum(axis=1))
    turned = away @ turn
    signs = turned >= 0
    with np.errstate(invalid="ignore", divide="ignore"):
        product = np.abs(turned).sum(axis=1) / (length * np.sqrt(vectors.shape[1]))
    return np.packbits(signs, axis=1), length, np.where(length > 0, product, 1.0)


def bounds(
    codes: np.ndarray, length: np.ndarray, product: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, errors: float = ERRORS
) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances, a row a query."""
    dimensions = queries.shape[1]
    away = queries - centre
    turned = away @ turn
    signs = np.unpackbits(codes, axis=1, count=dimensions).astype(np.float64) * 2 - 1
    # the products with the code, whose entries are +-1/sqrt(d), scaled to those with the vector
    inner = (turned @ signs.T) * (length / (product * np.sqrt(dimensions)))
    far = np.sqrt((away**2).sum(axis=1))
    spread = np.sqrt(np.maximum(1 - product**2, 0)) / product * length
    error = errors * 2 * far[:, None] * spread[None, :] / np.sqrt(max(dimensions - 1, 1))
    distance = (far**2)[:, None] + (length**2)[None, :] - 2 * inner
    return distance - error, distance + error


def search_block(
    ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, product: np.ndarray,
    query_ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, distance) of each query's k nearest in the block, but itself; ties to the smaller id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        some, some_ids = queries[at : at + QUERIES_AT_ONCE], query_ids[at : at + QUERIES_AT_ONCE]
        with np.errstate(over="ignore", invalid="ignore"):
            low, high = bounds(codes, length, product, some, centre, turn)
        own = some_ids[:, None] == ids[None, :]
        # a bound beyond what numbers hold says nothing: such a vector is reranked, and limits no other
        open_ = ~(np.isfinite(low) & np.isfinite(high))
        low[open_], high[open_] = -np.inf, np.inf
        high[own] = np.inf
        limit = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] > k else np.full(len(some), np.inf)
        # what rounding may add up to, against the largest squares that were subtracted
        largest = ((some - centre) ** 2).sum(axis=1) + (length.max() ** 2 if len(length) else 0)
        slack = 1e-9 * (1 + np.where(np.isfinite(largest), largest, 0))
        for i in range(len(some)):
            near = np.flatnonzero(~own[i] & (low[i] <= limit[i] + slack[i]))
            with np.errstate(over="ignore"):
                distance = np.sqrt(((vectors[near].astype(np.float64) - some[i]) ** 2).sum(axis=1))
            first = np.lexsort((ids[near], distance))[:k]
            out.append((np.full(len(first), some_ids[i]), ids[near][first], distance[first]))
    return tuple(np.concatenate([x[j] for x in out]) if out else np.empty(0) for j in range(3))


# --- with Spark ------------------------------------------------------------------

def matrix(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def usable(vector: Column | str = "embedding") -> Column:
    """Not null, no null or non-finite component, not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return v.isNotNull() & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0)


def vectors_of(rows: DataFrame) -> DataFrame:
    """Rows that take part: (vec_id, embedding).

    Rows repeated whole count once; different vectors under one id are all there. A null id, an unusable vector and one of another length
    than most (the shorter among equals) take no part.
    """
    fit = rows.where(F.col("vec_id").isNotNull() & usable()).select("vec_id", "embedding")
    different = fit.distinct()
    lengths = different.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return different.where(F.size("embedding") == (lengths["size"] if lengths else 0))


def build_index(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, embedding, code, length, product, block) for every row that takes part, stored; and the mean vector."""
    vectors = stored(vectors_of(rows), "vectors")
    mean = vectors.select(F.posexplode("embedding").alias("at", "x")).groupBy("at").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("at").collect()
    centre = np.array([r["x"] for r in mean])
    blocks = max(1, -(-vectors.count() // block_rows))
    turn = rotation(max(len(centre), 1))

    def coded(batches):
        for batch in batches:
            v = matrix(pa.chunked_array([batch.column(1)]), len(centre)).astype(np.float64)
            codes, length, product = encode(v, centre, turn)
            columns = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(product)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["vec_id", "embedding", "code", "length", "product"])

    schema = f"vec_id long, embedding {vectors.schema['embedding'].dataType.simpleString()}, code binary, length double, product double"
    index = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(coded, schema)
    return stored(index.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int")), "vector-index"), centre


def nearest(rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` rows found nearest, but those of its own id.

    Both tables have vec_id and embedding; see ``vectors_of`` for what takes
    part. Of a query id with different vectors the smallest asks; a row of ``rows``
    is a candidate whatever other rows its id has, so an id may be found more than once. Scores are exact distances in double precision, ties go to the smaller id. With
    no more than ``k`` candidates all come back; empty tables give no rows.
    """
    index, centre = build_index(rows, block_rows)
    if not len(centre):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimensions, turn = len(centre), rotation(len(centre))
    blocks = index.agg(F.max("block").alias("n")).first()["n"] + 1
    asked = vectors_of(queries).where(F.size("embedding") == dimensions).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = stored(asked, "vector-queries")
    parts = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("part", upto(parts)).groupBy("block", "part")
    right = asked.withColumn("block", upto(blocks)).groupBy("block", "part")

    def searched(some: pa.Table, wanted: pa.Table) -> pa.Table:
        if not some.num_rows or not wanted.num_rows:
            return FOUND.empty_table()
        codes = np.frombuffer(b"".join(some.column("code").to_pylist()), np.uint8).reshape(some.num_rows, -1)
        found = search_block(
            some.column("vec_id").to_numpy(), matrix(some.column("embedding"), dimensions), codes,
            some.column("length").to_numpy(), some.column("product").to_numpy(),
            wanted.column("vec_id").to_numpy(), matrix(wanted.column("embedding"), dimensions).astype(np.float64), centre, turn, k,
        )
        return pa.table([pa.array(c, t) for c, t in zip(found, FOUND.types, strict=True)], schema=FOUND)

    best = left.cogroup(right).applyInArrow(searched, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_one_bit_neighbours(spark, sf_dir) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.pmod("vec_id", F.lit(QUERY_STEP)) == 0))
