import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import packet, rows, syn
from wiresift.operators.reset import as_of, syn_counts_reset, syn_floods_reset, window_beginnings, with_reset_windows


def beginnings(times, width):
    """A loop over each key's sorted times."""
    out = []
    for key in sorted({k for k, _ in times}):
        start = None
        for t in sorted(t for k, t in times if k == key):
            if start is None or t - start >= width:
                start = t
                out.append((key, t))
    return out


@pytest.mark.parametrize("piece", [7, 100, None])
def test_beginnings_against_a_loop(spark, piece):
    rng = np.random.default_rng(1)
    times = [(k, int(t)) for k in range(6) for t in np.cumsum(rng.choice([0, 1, 2, 3, 30], 80, p=[0.1, 0.4, 0.2, 0.25, 0.05]))]
    times += [(9, -5), (9, 4), (9, 5), (9, 14), (9, 15)]
    frame = spark.createDataFrame(times + [(9, None)], "src_ip long, t long").repartition(4)
    found = window_beginnings(frame, ["src_ip"], "t", 10, piece)
    assert sorted(tuple(r) for r in found.collect()) == beginnings(times, 10)


def test_one_busy_source_never_pauses(spark):
    times = [(1, 3 * i) for i in range(2000)]
    found = window_beginnings(spark.createDataFrame(times, "src_ip long, t long"), ["src_ip"], "t", 10)
    assert sorted(tuple(r) for r in found.collect()) == beginnings(times, 10)


def test_as_of_both_ways(spark):
    own = spark.createDataFrame([(1, 5), (1, 10), (1, 99), (2, 1)], "k int, at long")
    marks = spark.createDataFrame([(1, 5), (1, 40), (3, 1)], "k int, m long")
    assert rows(as_of(own, marks, ["k"], "at", "m", 10), "k", "at", "m") == [(1, 5, 5), (1, 10, 5), (1, 99, 40), (2, 1, None)]
    found = as_of(own, marks, ["k"], "at", "m", 10, forward=True).select("k", "at", F.coalesce("m", F.lit(-1)).alias("m"))
    assert rows(found, "k", "at", "m") == [(1, 5, 5), (1, 10, 40), (1, 99, -1), (2, 1, -1)]


def test_window_is_half_open_and_begins_with_an_event(packets):
    events = packets([syn(1, 1200), syn(2, 6199), syn(3, 6200), packet(4, 11300), syn(5, 16299), syn(6, 16300)])
    assert rows(syn_counts_reset(events), "window_start_ms", "n_syn") == [(1200, 2), (6200, 1), (11300, 1), (16300, 1)]
    placed = with_reset_windows(events)
    assert rows(placed, "packet_id", "window_start_ms") == [(1, 1200), (2, 1200), (3, 6200), (4, 11300), (5, 11300), (6, 16300)]


def test_flood_across_an_aligned_edge(packets):
    """49 and 49 SYNs on both sides of a full five seconds are one flood in a window that began with them."""
    events = packets([syn(i, 4000 + 20 * i) for i in range(98)])
    assert rows(syn_floods_reset(events), "packet_id", "timestamp_ms") == [(49, 4980)]


def test_no_events(packets):
    assert syn_counts_reset(packets([])).count() == 0
