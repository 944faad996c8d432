"""Keyed event sequences within a time limit.

A match depends only on the rows of its key that lie within the limit before
its last row: sequences that began later are consumed first, so nothing older
can influence it. A key's history is therefore cut into time spans, each led
in by the tail of the span before it, and a source that holds a large part of
all rows is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from wiresift.functions.clock import duration_text, floor_div
from wiresift.functions.steps import StepTracker
from wiresift.operators.alerts import to_alert
from wiresift.operators.ordered import running_total
from wiresift.rules import DEFAULT_SEQUENCE, SequenceRule

# A span is this many times the limit, so a fifth of the rows is read twice.
SPAN_FACTOR = 4


def with_spans(rows: DataFrame, time: str, within: int, span: int | None = None) -> DataFrame:
    """Add ``_span`` and ``_own``; rows near the end of a span also lead in the next.

    ``_own`` is false on the copy that only serves as lead-in.
    """
    span = span or SPAN_FACTOR * within
    if span < within:
        raise ValueError("a span must be at least as long as the limit")
    index = floor_div(time, span)
    own = F.struct(index.alias("_span"), F.lit(True).alias("_own"))
    lead = F.struct((index + 1).alias("_span"), F.lit(False).alias("_own"))
    late = F.col(time) - index * span >= span - within
    return rows.select("*", F.inline(F.when(late, F.array(own, lead)).otherwise(F.array(own))))


def _marked_rows(
    rows: DataFrame, keep: list[str], time: str, first: Column, second: Column, within: int, span: int | None
) -> DataFrame:
    """Openings (+1) and closings (-1) by span; a row that is both closes first."""
    close = F.struct(F.lit(0).alias("_turn"), F.lit(-1).alias("_x"))
    open_ = F.struct(F.lit(1).alias("_turn"), F.lit(1).alias("_x"))
    none = F.lit(None).cast("struct<_turn:int,_x:int>")
    roles = F.array_compact(F.array(
        F.when(second, close).otherwise(none), F.when(first, open_).otherwise(none)))
    marked = rows.where(first | second).select(*keep, F.inline(roles))
    return with_spans(marked, time, within, span)


def _closing_spans(closings: DataFrame, key: str) -> DataFrame:
    """(_closing_key, _closing_span): the spans that close something of their own."""
    return closings.where("_own").select(
        F.col(key).alias("_closing_key"), F.col("_span").alias("_closing_span")).distinct()


def _where_closed(spans: DataFrame, closings: DataFrame, key: str) -> DataFrame:
    """The rows of spans in which ``closings`` close something.

    The spans that do are hashed and the rows only pass by them: nothing is sorted or kept.
    """
    needed = _closing_spans(closings, key)
    same = F.col(key).eqNullSafe(F.col("_closing_key")) & (F.col("_span") == F.col("_closing_span"))
    return spans.join(needed.hint("shuffle_hash"), same, "left_semi")


def _marked_apart(
    rows: DataFrame, seconds: DataFrame, keep: list[str], key: str, time: str,
    first: Column, second: Column, within: int, span: int | None,
) -> DataFrame:
    """The same from two tables, without the openings of spans that close nothing."""

    def mark(part: DataFrame, turn: int, x: int) -> DataFrame:
        return with_spans(
            part.select(*keep, F.lit(turn).alias("_turn"), F.lit(x).alias("_x")), time, within, span)

    closings = mark(seconds.where(second), 0, -1)
    needed = closings.where("_own").select(key, "_span").distinct()
    openings = mark(rows.where(first), 1, 1).join(needed, [key, "_span"], "left_semi")
    return openings.select(*closings.columns).unionByName(closings)


def two_step_matches(
    rows: DataFrame,
    key: str,
    time: str,
    tie: str,
    first: Column,
    second: Column,
    within: int,
    carry: Sequence[str] = (),
    span: int | None = None,
    seconds: DataFrame | None = None,
) -> DataFrame:
    """Rows that complete a first-then-second pair, with the pair's ``started``.

    Each first row is used once and the newest one is taken first, which is
    bracket matching: firsts open, seconds close, and depth follows from a
    running sum and its running minimum. Expiry needs no bookkeeping: if the
    newest open first is too old, so are all others, so pairs are matched first
    and filtered by age. A row that is both closes before it opens.

    Firsts without a second in their span are dropped on the way: ``rows`` are
    read once more for the seconds alone, and what both window passes sort is
    left to the spans that have one. One shuffle finds these, another, of what
    is left, serves both passes. ``seconds`` may give a (much smaller) table
    with all the second rows instead.
    """
    keep = list(dict.fromkeys([key, time, tie, *carry]))
    if seconds is None:
        closings = with_spans(rows.where(second).select(*dict.fromkeys([key, time])), time, within, span)
        spans = _where_closed(_marked_rows(rows, keep, time, first, second, within, span), closings, key)
    else:
        spans = _marked_apart(rows, seconds, keep, key, time, first, second, within, span)

    order = [*dict.fromkeys([time, tie]), "_turn"]
    along = Window.partitionBy(key, "_span").orderBy(*order)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy(key, "_span", "_level").orderBy(*order)
    depth = F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(upto))
    return (
        spans.withColumn("_sum", F.sum("_x").over(upto))
        .withColumn("_depth", depth)
        .withColumn("_prior", F.coalesce(F.lag("_depth").over(along), F.lit(0)))
        .where((F.col("_x") == 1) | (F.col("_prior") > 0))
        .withColumn("_level", F.when(F.col("_x") == 1, F.col("_depth")).otherwise(F.col("_prior")))
        # On one level openings and closings alternate.
        .withColumn("started", F.lag(time).over(level))
        .where((F.col("_x") == -1) & F.col("_own") & (F.col(time) - F.col("started") <= within))
        .select(*keep, "started")
    )


def step_matches(
    rows: DataFrame,
    key: str,
    time: str,
    tie: str,
    steps: Sequence[Column],
    within: int,
    carry: Sequence[str] = (),
    span: int | None = None,
) -> DataFrame:
    """Rows that complete a sequence of any number of steps, with its ``started``.

    Rows that fulfil no step are dropped first. The rest is partitioned by key
    and span, sorted, and read as a stream of Arrow batches: a task holds one
    batch and the open sequences of one key and span, never a whole group.
    """
    fulfilled = reduce(
        lambda a, b: a + b,
        [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(steps)])
    names = list(dict.fromkeys([key, time, tie, *carry]))
    marked = rows.select(*names, fulfilled.cast("long").alias("_steps")).where(F.col("_steps") != 0)
    spans = with_spans(marked, time, within, span)
    ordered = spans.repartition(F.col(key), F.col("_span")).sortWithinPartitions(
        key, "_span", *dict.fromkeys([time, tie]))
    schema = T.StructType([marked.schema[n] for n in names] + [T.StructField("started", T.LongType())])
    n_steps = len(steps)

    def track(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tracker = None, None
        for batch in batches:
            picked, starts = [], []
            columns = (batch[c].tolist() for c in (key, "_span", time, "_steps", "_own"))
            for i, (k, span_no, t, mask, own) in enumerate(zip(*columns)):
                if (k, span_no) != current:
                    current, tracker = (k, span_no), StepTracker(n_steps, within)
                started = tracker.feed(t, mask)
                if started is not None and own:
                    picked.append(i)
                    starts.append(started)
            yield batch.iloc[picked][names].assign(started=pd.Series(
                starts, index=batch.index[picked], dtype="int64"))

    return ordered.mapInPandas(track, schema)


def sequence_detail(rule: SequenceRule) -> Column:
    return F.lit(f"CEP rule '{rule.name}' completed: {len(rule.steps)} steps matched within "
                 f"{duration_text(rule.within_ms)}")


def sequence_alerts(
    events: DataFrame,
    rule: SequenceRule = DEFAULT_SEQUENCE,
    span_ms: int | None = None,
    seconds: DataFrame | None = None,
) -> DataFrame:
    """One alert per completed sequence of a source, at its last packet.

    Two-step rules run on window functions alone; longer ones track steps over
    sorted Arrow batches. ``span_ms`` is the stretch of a source's history that
    one task takes, at least the rule's limit and four times that by default;
    the shorter, the more tasks share a busy source and the more rows are read
    twice. ``seconds`` may name a table with all packets that fulfil the second
    of two steps.
    """
    steps = rule.conditions()
    common = dict(key="src_ip", time="timestamp_ms", tie="packet_id",
                  within=rule.within_ms, carry=["dst_ip"], span=span_ms)
    if len(steps) == 2:
        done = two_step_matches(events, first=steps[0], second=steps[1], seconds=seconds, **common)
    else:
        done = step_matches(events, steps=steps, **common)
    return to_alert(done, rule.name, rule.severity, sequence_detail(rule), "Cep", stage=4)


def pair_counts(
    rows: DataFrame, key: str, time: str, tie: str, first: Column, second: Column, within: int,
    slice_width: int | None = None,
) -> DataFrame:
    """How many first rows each second row has within the limit before it.

    This is the size of the interval join of firsts and seconds, without its
    pairs: a running count of firsts is read at both ends of each interval and
    subtracted. Rows without any first are left out; a row that is both does
    not pair with itself.
    """
    both = F.when(first, F.lit(1)).otherwise(F.lit(0))
    marked = rows.where(first | second).select(
        key, time, tie, both.alias("_self"), second.alias("_second"))
    t, null = F.col(time), F.lit(None).cast("long")

    def mark(at: Column, turn: int, value: Column, sign: int) -> Column:
        return F.struct(at.alias("_at"), F.lit(turn).alias("_turn"),
                        value.cast("int").alias("_opens"), F.lit(sign).alias("_sign"))

    zero = F.lit(0)
    marks = F.filter(
        F.array(
            mark(F.when(F.col("_second"), t - within).otherwise(null), 0, zero, -1),
            mark(F.when(F.col("_self") == 1, t).otherwise(null), 1, F.lit(1), 0),
            mark(F.when(F.col("_second"), t).otherwise(null), 2, zero, 1),
        ),
        lambda m: m["_at"].isNotNull())
    counted = running_total(
        marked.select(*dict.fromkeys([key, time, tie]), "_self", F.inline(marks)),
        keys=[key],
        order=["_at", "_turn", tie],
        piece=floor_div("_at", slice_width or within),
        value=F.col("_opens"),
        name="_opened",
    )
    return (
        counted.where(F.col("_sign") != 0)
        .groupBy(*dict.fromkeys([key, time, tie]))
        .agg((F.sum(F.col("_sign") * F.col("_opened")) - F.max("_self")).alias("n_pairs"))
        .where(F.col("n_pairs") > 0)
    )
