"""Queries on polled counters: rates, percentiles, stall and overload checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wiresift.operators.ordered import exact_quantiles, previous_row

# Runs are cut into days for looking back one poll.
DAY_S = 86400
# Rates are ranked in bins of this many events per second.
RATE_BIN = 100.0


def _with_previous(stats: DataFrame) -> DataFrame:
    counters = ["poll_time", "events_processed", "events_dropped"]
    return previous_row(
        stats, ["run_id"], "poll_time", F.floor(F.col("poll_time") / DAY_S), counters)


def _growth(counter: str) -> Column:
    return F.col(counter) - F.col(f"prev_{counter}")


def _rate() -> Column:
    elapsed = _growth("poll_time")
    return F.when(elapsed != 0, _growth("events_processed") / elapsed)


def events_per_sec(stats: DataFrame) -> DataFrame:
    """Rate between consecutive polls of a run; null at the first poll."""
    return _with_previous(stats).select("run_id", "poll_time", _rate().alias("events_per_sec"))


def dashboard_rate(stats: DataFrame) -> DataFrame:
    """The rate as shown live: rounded half up, null without elapsed time."""
    rate = F.when(_growth("poll_time") > 0, F.floor(_rate() + 0.5))
    return _with_previous(stats).select("run_id", "poll_time", rate.alias("shown_rate"))


def throughput_summary(stats: DataFrame) -> DataFrame:
    """Per run: mean, median, 99th percentile and maximum rate, and the last drop count."""
    rates = events_per_sec(stats)
    quantiles = exact_quantiles(
        rates, ["run_id"], "events_per_sec", {"p50_eps": 0.5, "p99_eps": 0.99}, RATE_BIN)
    plain = rates.groupBy("run_id").agg(
        F.avg("events_per_sec").alias("mean_eps"), F.max("events_per_sec").alias("max_eps"))
    last = stats.groupBy("run_id").agg(
        F.coalesce(F.max_by("events_dropped", "poll_time"), F.lit(0)).alias("total_dropped"))
    return (
        last.join(plain, "run_id").join(quantiles, "run_id", "left")
        .select("run_id", "mean_eps", "p50_eps", "p99_eps", "max_eps", "total_dropped")
    )


def throughput_describe(stats: DataFrame) -> DataFrame:
    """Per run: count, mean, sample deviation, minimum, quartiles and maximum of the rate."""
    rates = events_per_sec(stats)
    quartiles = exact_quantiles(
        rates, ["run_id"], "events_per_sec", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, RATE_BIN)
    rate = F.col("events_per_sec")
    plain = rates.groupBy("run_id").agg(
        F.count(rate).alias("n"), F.avg(rate).alias("mean"), F.stddev_samp(rate).alias("std"),
        F.min(rate).alias("min"), F.max(rate).alias("max"))
    return plain.join(quartiles, "run_id", "left").select(
        "run_id", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def stall_check(stats: DataFrame) -> DataFrame:
    """Polls since which nothing was processed."""
    return _with_previous(stats).select(
        "run_id", "poll_time", "events_processed",
        F.coalesce(_growth("events_processed") <= 0, F.lit(False)).alias("stalled"))


def drop_growth(stats: DataFrame) -> DataFrame:
    """Growth of dropped and processed events between polls, and their ratio."""
    dropped, processed = _growth("events_dropped"), _growth("events_processed")
    return _with_previous(stats).select(
        "run_id", "poll_time", dropped.alias("dropped_growth"), processed.alias("processed_growth"),
        F.when(processed > 0, dropped / processed).alias("drop_ratio"))


def engine_stats(events: DataFrame, alerts: DataFrame, dropped: Column | int = 0) -> DataFrame:
    """One row of totals. Backpressure is the drop count under a second name."""
    n_dropped = F.lit(dropped).cast("long") if isinstance(dropped, int) else dropped
    kinds = events.select(F.lit(1).alias("event"), F.lit(0).alias("alert")).unionByName(
        alerts.select(F.lit(0).alias("event"), F.lit(1).alias("alert")))
    return kinds.agg(
        F.coalesce(F.sum("event"), F.lit(0)).alias("events_processed"),
        F.max(n_dropped).alias("events_dropped"),
        F.coalesce(F.sum("alert"), F.lit(0)).alias("alerts_fired"),
    ).withColumn("queue_backpressure_events", F.col("events_dropped"))
