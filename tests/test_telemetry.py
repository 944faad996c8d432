from __future__ import annotations

import pandas as pd
import pytest

from tests.conftest import rows
from wiresift.operators import telemetry as tm
from wiresift.scratch import scratch_dir
from wiresift.sources.tables import read_stats_csv, write_csv
from wiresift.schema import STATS

# Polls about a second apart, over a day's end, with a stall, a repeated poll
# time's worth of drops, and a counter that jumps.
POLLS = [
    (1785439205.219682, 3980, 0), (1785439206.2198074, 5954, 0), (1785439207.2199228, 7984, 3),
    (1785439208.2200518, 9896, 3), (1785455999.5, 20000, 10), (1785456001.5, 20000, 30),
    (1785456002.5, 20003, 30),
]


@pytest.fixture
def stats(spark):
    data = [(run, t, p, d, 0, d) for run in ("a", "b") for t, p, d in POLLS]
    return spark.createDataFrame(data, STATS).repartition(3)


@pytest.fixture
def frame():
    f = pd.DataFrame(POLLS, columns=["t", "p", "d"])
    f["eps"] = f.p.diff() / f.t.diff()
    return f


def test_rates(stats, frame):
    got = tm.events_per_sec(stats).where("run_id = 'a'").orderBy("poll_time").toPandas()
    pd.testing.assert_series_equal(got.events_per_sec, frame.eps, check_names=False)


def test_summary_and_describe(stats, frame):
    got = tm.throughput_summary(stats).orderBy("run_id").toPandas()
    assert list(got.run_id) == ["a", "b"] and list(got.total_dropped) == [30, 30]
    want = [frame.eps.mean(), frame.eps.median(), frame.eps.quantile(0.99), frame.eps.max()]
    assert got.iloc[0, 1:5].astype(float).tolist() == pytest.approx(want)
    d, w = tm.throughput_describe(stats).orderBy("run_id").first(), frame.eps.describe()
    assert list(d)[1:] == pytest.approx(
        [w["count"], w["mean"], w["std"], w["min"], w["25%"], w["50%"], w["75%"], w["max"]])


def test_dashboard_rate_rounds_half_up(spark):
    data = [("r", t, p, 0, 0, 0) for t, p in ((0.0, 0), (2.0, 5), (4.0, 4), (5.0, 4))]
    got = tm.dashboard_rate(spark.createDataFrame(data, STATS))
    assert sorted(map(tuple, got.select("poll_time", "shown_rate").collect())) == [
        (0.0, None), (2.0, 3), (4.0, 0), (5.0, 0)]


def test_stall_and_drops(stats):
    stalled = tm.stall_check(stats).where("run_id = 'b' and stalled")
    assert rows(stalled, "poll_time") == [(1785456001.5,)]
    growth = {r["poll_time"]: r for r in tm.drop_growth(stats).where("run_id = 'a'").collect()}
    assert growth[1785456001.5]["dropped_growth"] == 20 and growth[1785456001.5]["drop_ratio"] is None
    assert growth[1785455999.5]["drop_ratio"] == pytest.approx(7 / 10104)


def test_no_polls(spark):
    empty = spark.createDataFrame([], STATS)
    assert tm.throughput_summary(empty).count() == 0
    assert tm.events_per_sec(empty).count() == 0


def test_single_poll_has_no_rate(spark):
    one = spark.createDataFrame([("r", 1.0, 10, 4, 0, 4)], STATS)
    r = tm.throughput_summary(one).first()
    assert (r["mean_eps"], r["p50_eps"], r["max_eps"], r["total_dropped"]) == (None, None, None, 4)


def test_engine_stats(spark):
    r = tm.engine_stats(spark.range(7), spark.range(3), dropped=2).first()
    assert tuple(r) == (7, 2, 3, 2)
    assert tuple(tm.engine_stats(spark.range(0), spark.range(0)).first())[2] == 0


def test_csv(spark, stats):
    path = scratch_dir(spark, "test-stats")
    write_csv(stats.where("run_id = 'a'").drop("run_id"), path)
    back = read_stats_csv(spark, path, run_id="a")
    assert rows(back, *STATS.names) == rows(stats.where("run_id = 'a'"), *STATS.names)
    assert back.where("poll_time < 1785439205.5").first()["ts"].microsecond == 219682
