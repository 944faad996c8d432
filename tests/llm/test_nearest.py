import numpy as np
import pytest

from wiresift.llm.nearest import bounds, build_index, encode, nearest, op5_one_bit_neighbours, rotation

SCHEMA = "vec_id long, embedding array<float>, rank int, score string"


def brute_force(rows, queries, k=10):
    out = {}
    base = [(i, np.asarray(v, dtype=np.float64)) for i, v in rows]
    ids = np.array([i for i, _ in base])
    m = np.stack([v for _, v in base])
    for i, v in queries:
        d = np.sqrt(((m - np.asarray(v, dtype=np.float64)) ** 2).sum(axis=1))
        d[ids == i] = np.inf
        order = [j for j in np.lexsort((ids, d))[:k] if np.isfinite(d[j])]
        out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_estimates_and_bounds():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(3000, 64)) + 1, rng.normal(size=(20, 64)) + 1
    centre, turn = x.mean(axis=0), rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    low, high = bounds(*encode(x, centre, turn), q, centre, turn)
    true = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert ((low <= true) & (true <= high)).mean() > 0.97
    assert abs(((low + high) / 2 - true).mean()) < 0.3  # no bias


def rows_of(n=1500, d=24, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    return [(i, (centres[i % 6] + 0.4 * rng.normal(size=d)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("block_rows,query_rows", [(10_000, 10_000), (200, 4)])
def test_recall_against_brute_force(spark, block_rows, query_rows):
    rows = rows_of()
    rows += [(2000 + i, rows[5][1]) for i in range(60)]  # equal vectors: ties go to the smaller id
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    queries = [r for r in rows if r[0] % 100 == 0] + [rows[5]]
    want = brute_force(rows, queries)
    got = {}
    for r in nearest(df, df.where("vec_id % 100 = 0 or vec_id = 5"), block_rows=block_rows, query_rows=query_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.98 * sum(map(len, want.values()))
    assert [i for i, _ in got[5]] == list(range(2000, 2010)) and got[5][0][1] == 0.0


def test_unusable_vectors_take_no_part(spark):
    good = rows_of(12, 4)
    bad = [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 1.0, 0.0, 0.0]), (104, [float("inf"), 1.0, 0.0, 0.0]), (200, [1.0, 2.0]), (None, [1.0] * 4), (105, [])]
    df = spark.createDataFrame([(i, v, 0, None) for i, v in good + good[:3] + bad], SCHEMA)
    out = nearest(df, df).collect()
    assert {r["vec_id"] for r in out} | {r["query_id"] for r in out} == set(range(12))
    assert len(out) == 12 * 10
    few = spark.createDataFrame([(i, v, 0, None) for i, v in good[:3]], SCHEMA)
    assert nearest(few, few).count() == 6  # all candidates, if fewer
    assert nearest(few.limit(1), few.limit(1)).count() == 0
    assert nearest(few.limit(0), few.limit(0)).count() == 0


def test_different_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [9.0, 9.0, 0.0]), (2, [1.0, 0.1, 0.0]), (2, [1.0, 0.1, 0.0]), (1, [5.0, 0.0, 0.0]), (3, [1.0, 0.5, 0.0])]
    df = spark.createDataFrame([(i, v, 0, None) for i, v in rows], SCHEMA)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0], 0, None)], SCHEMA)
    out = nearest(df, asked).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == [2, 3, 2]
    assert np.allclose([r["score"] for r in out], [0.1, 0.5, 145**0.5])


def test_every_row_is_indexed(spark):
    df = spark.createDataFrame([(i, v, 0, None) for i, v in rows_of(500)], SCHEMA)
    index, _ = build_index(df, 100)
    assert index.count() == 500 and index.select("block").distinct().count() == 5


def test_registered_query(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    want = brute_force(rows, [r for r in rows if r[0] % 100 == 0])
    got = {}
    for r in op5_one_bit_neighbours(spark, path).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
