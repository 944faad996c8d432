import random

from tests.conftest import rows
from wiresift.operators.alerts import retain
from wiresift.plans.retention import append_alerts, manifest, plan_cut, read_retained, trim
from wiresift.schema import ALERT
from wiresift.scratch import scratch_dir


def alert(i, ms):
    return (ms, "r", "Low", "1.1.1.1", "2.2.2.2", "d", "Anomaly", i, 2, 0, 0)


def test_equals_a_sort_of_everything(spark):
    rng, root, every = random.Random(1), scratch_dir(spark, "test-retained"), []
    for batch in range(5):
        new = [alert(1000 * batch + i, 10_000 * batch + rng.randrange(12_000)) for i in range(60)]
        every += new
        append_alerts(spark.createDataFrame(new, ALERT).repartition(3), root)
        trim(spark, root, 100)
        want = rows(retain(spark.createDataFrame(every, ALERT), 100), *ALERT.names)
        assert rows(read_retained(spark, root), *ALERT.names) == want


def test_files_away_from_the_cut_are_not_read(spark):
    root = scratch_dir(spark, "test-retained")
    for batch in range(6):
        append_alerts(spark.createDataFrame([alert(100 * batch + i, 1000 * batch + i) for i in range(50)], ALERT).coalesce(1), root)
    before = {r["path"]: r for r in manifest(spark, root)}
    read = trim(spark, root, 120)
    after = {r["path"] for r in manifest(spark, root)}
    assert {before[p]["low_ms"] // 1000 for p in read} == {3}
    assert {before[p]["low_ms"] // 1000 for p in after & set(before)} == {4, 5}
    assert rows(read_retained(spark, root), "packet_id") == [(330 + i,) for i in range(20)] + [(100 * b + i,) for b in (4, 5) for i in range(50)]
    assert trim(spark, root, 120) == []  # nothing more to do


def test_ties_in_time_and_empty_tables(spark):
    root = scratch_dir(spark, "test-retained")
    assert read_retained(spark, root).count() == 0 and trim(spark, root, 5) == []
    append_alerts(spark.createDataFrame([], ALERT), root)
    assert read_retained(spark, root).count() == 0
    tied = [alert(i, 7) for i in range(30)]
    append_alerts(spark.createDataFrame(tied, ALERT).repartition(4), root)
    trim(spark, root, 10)
    assert rows(read_retained(spark, root), "packet_id") == [(i,) for i in range(20, 30)]
    trim(spark, root, 0)
    assert read_retained(spark, root).count() == 0


def test_plan_reads_only_what_the_cut_may_touch():
    files = [("a", 10, 0, 9), ("b", 10, 10, 19), ("c", 10, 15, 29), ("d", 10, 30, 39)]
    assert plan_cut(files, 100) == (files, [])
    safe, cut = plan_cut(files, 15)
    assert [f[0] for f in safe] == ["d"] and [f[0] for f in cut] == ["b", "c"]
