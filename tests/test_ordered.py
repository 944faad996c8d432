from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wiresift.operators.ordered import exact_quantiles, kth_row, previous_row, running_total


GROUP_LIMIT = 1000  # what the setting is unless a session changes it


@pytest.fixture
def skewed(spark):
    """Group 0 holds most of the rows."""
    rng = random.Random(1)
    data = [(0 if rng.random() < 0.7 else rng.randrange(1, 20), rng.randrange(500), i, rng.randrange(9))
            for i in range(6000)]
    return data, spark.createDataFrame(data, "g long, at long, ident long, v long").repartition(6)


def groups(data):
    out = {}
    for r in sorted(data):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("k", [1, 50, GROUP_LIMIT, GROUP_LIMIT + 1, 3000, 100_000])
def test_kth_row(skewed, k):
    data, df = skewed
    want = sorted((g, rs[k - 1][2]) for g, rs in groups(data).items() if len(rs) >= k)
    assert rows(kth_row(df, ["g"], ["at", "ident"], k), "g", "ident") == want


def test_kth_row_beyond_spark_s_limit_cuts_salted_groups_first(skewed):
    plan = kth_row(skewed[1], ["g"], ["at", "ident"], GROUP_LIMIT + 1)
    assert "_salt" in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_running_total(skewed, width):
    data, df = skewed
    got = running_total(df, ["g"], ["at", "ident"], F.floor(F.col("at") / width), F.col("v"), "total")
    want = []
    for rs in groups(data).values():
        total = 0
        for r in rs:
            total += r[3]
            want.append((r[2], total))
    assert rows(got, "ident", "total") == sorted(want)
    assert got.columns[-1] == "total" and "_piece" not in got.columns


@pytest.mark.parametrize("width", [1, 50, 10_000])
def test_previous_row(spark, width):
    rng = random.Random(2)
    data = [(g, t, rng.randrange(100)) for g in range(4) for t in rng.sample(range(1000), 60)]
    df = spark.createDataFrame(data, "g long, at long, v long")
    want = []
    for rs in groups(data).values():
        last = (None, None)
        for r in rs:
            want.append((r[0], r[1], *last))
            last = r[1:]
    got = previous_row(df, ["g"], "at", F.floor(F.col("at") / width), ["at", "v"])
    assert sorted(map(tuple, got.select("g", "at", "prev_at", "prev_v").collect())) == sorted(want)


def test_exact_quantiles(spark):
    rng = random.Random(3)
    data = [(g, rng.choice([rng.uniform(-50, 900), 5.0, None])) for g in range(3) for _ in range(301 + g)]
    df = spark.createDataFrame(data, "g long, v double")
    got = exact_quantiles(df, ["g"], "v", {"a": 0.5, "b": 0.99, "c": 0.25, "lo": 0.0, "hi": 1.0}, 10.0)
    for r in got.collect():
        values = [v for g, v in data if g == r["g"] and v is not None]
        want = np.quantile(values, [0.5, 0.99, 0.25, 0, 1])
        assert np.allclose([r["a"], r["b"], r["c"], r["lo"], r["hi"]], want, rtol=0, atol=1e-9)
