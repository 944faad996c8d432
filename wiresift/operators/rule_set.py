"""A whole set of sequence rules over one shuffle, in column expressions alone.

Rows that fulfil some step of some rule are gathered per key and time span, in order, and folded: the
state is, for each rule, its open partial sequences. Spans keep the arrays bounded. Of partials that
wait for the same step only as many are kept, the newest, as rows complete the rule in the span: each
such row takes one, newest first, so no other can ever complete. A flood of first steps
therefore does not make the fold slower.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wiresift.functions.clock import duration_text
from wiresift.operators.alerts import to_alert
from wiresift.operators.sequence import SPAN_FACTOR, with_spans
from wiresift.rules import SequenceRule

PARTIALS = "array<struct<serial:int,step:int,started:long>>"
DONE = "array<struct<at:int,rule:int,started:long>>"
MOST_STEPS = 62  # of all rules together; a step is a bit of a long


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _advance(open_: Column, row: Column, steps: int, first_bit: int, within: int, ends: Column) -> Column:
    """One rule's partials after a row: (open, started of the one it completes or null).

    The newest partial that needs only its last step completes, if the row fulfils it; partials newer than that
    one (all, if none completes) move on if the row fulfils their next step; then the row may open one.
    """
    fulfils = lambda step: F.shiftright(row["mask"], first_bit + step).bitwiseAND(F.lit(1).cast("long")) == 1
    last, time = F.lit(steps - 1), row["t"]

    def moved(partials: Column) -> Column:
        waiting = F.transform(partials, lambda p, i: F.when(p["step"] == last, i).otherwise(F.lit(-1)))
        completed = F.when(fulfils(steps - 1), F.coalesce(F.array_max(waiting), F.lit(-1))).otherwise(F.lit(-1))

        def after(at: Column) -> Column:
            def step_of(p: Column, i: Column) -> Column:
                hit = F.lit(False)
                for s in range(1, steps - 1):
                    hit = hit | ((p["step"] == s) & fulfils(s))
                return F.struct(p["serial"].alias("serial"), F.when((i > at) & hit, p["step"] + 1).otherwise(p["step"]).alias("step"), p["started"].alias("started"))

            left = F.filter(F.transform(partials, lambda p, i: F.when(i == at, F.lit(None)).otherwise(step_of(p, i))), lambda p: p.isNotNull())
            opened = F.when(fulfils(0), F.array(F.struct(row["no"].alias("serial"), F.lit(1).alias("step"), time.alias("started")))).otherwise(F.array())
            started = F.when(at >= 0, F.get(partials, at)["started"])
            return F.struct(F.concat(left, opened.cast(PARTIALS)).cast(PARTIALS).alias("open"), started.alias("started"))

        return _let(completed, after)

    fresh = F.filter(open_, lambda p: time - p["started"] <= within)
    # trimmed now and then, so that the cost is spread over many rows
    newest = F.flatten(F.transform(
        F.sequence(F.lit(1), last), lambda s: _let(F.filter(fresh, lambda p: p["step"] == s), lambda own: F.slice(own, F.greatest(F.lit(1), F.size(own) - ends + 1), F.greatest(ends, F.lit(1))))))
    trimmed = F.when(F.size(fresh) > 2 * steps * ends + 8, F.sort_array(newest)).otherwise(fresh)
    return _let(trimmed, moved)


def _offsets(rules: Sequence[tuple[Sequence[Column], int]]) -> list[int]:
    """The first bit of each rule's steps."""
    offsets, total = [], 0
    for steps, _ in rules:
        offsets.append(total)
        total += len(steps)
    if total > MOST_STEPS:
        raise ValueError(f"the rules have {total} steps together; use several sets of up to {MOST_STEPS}")
    return offsets


def step_mask(rules: Sequence[tuple[Sequence[Column], int]]) -> Column:
    """Which steps of all rules a row fulfils, a bit each."""
    mask = F.lit(0).cast("long")
    for (steps, _), first in zip(rules, _offsets(rules), strict=True):
        for i, condition in enumerate(steps):
            mask = mask.bitwiseOR(F.when(condition, F.lit(1 << (first + i)).cast("long")).otherwise(F.lit(0).cast("long")))
    return mask


def gathered_row(names: Sequence[str], time: str, tie: str) -> Column:
    """A row with ``_mask`` and ``_own`` as it is gathered for ``folded_matches``; such rows sort in event order."""
    return F.struct(F.col(time).cast("long").alias("t"), F.col(tie).alias("tie"), F.col("_mask").alias("mask"), F.col("_own").alias("own"), F.struct(*names).alias("row"))


def folded_matches(
    gathered: DataFrame,
    rules: Sequence[tuple[Sequence[Column], int]],
    own: Callable[[Column], Column] = lambda x: x["own"],
    row: Callable[[Column], Column] = lambda x: x["row"],
) -> DataFrame:
    """The matches among ``_rows``, the sorted rows of a key and span: the row's names, ``rule`` and ``started``.

    At least one rule has more than a step. Spans without a row that ends a rule are not folded. Rows have at least ``t`` and
    ``mask``; ``own`` and ``row`` tell from one, and from the other columns of ``gathered``, whether it is the span's own and its names.
    """
    offsets = _offsets(rules)
    able = [(r, steps, within) for r, (steps, within) in enumerate(rules) if len(steps) > 1]
    ends = {r: f"_ends{r}" for r, _, _ in able}

    def fulfilling(bit: int) -> Column:
        return F.size(F.filter("_rows", lambda x: F.shiftright(x["mask"], bit).bitwiseAND(F.lit(1).cast("long")) == 1))

    counted = gathered.withColumns({ends[r]: fulfilling(offsets[r] + len(steps) - 1) for r, steps, _ in able})
    counted = counted.where(F.greatest(F.lit(0), *[F.col(ends[r]) for r, _, _ in able]) > 0)
    counted = counted.withColumn("_steps", F.transform("_rows", lambda x, i: F.struct(i.alias("no"), x["t"].alias("t"), x["mask"].alias("mask"), own(x).alias("own"))))
    empty = F.struct(*[F.array().cast(PARTIALS).alias(f"r{r}") for r, _, _ in able], F.array().cast(DONE).alias("done"))

    def feed(state: Column, x: Column) -> Column:
        each = F.struct(*[_advance(state[f"r{r}"], x, len(steps), offsets[r], within, F.col(ends[r])).alias(f"r{r}") for r, steps, within in able])

        def merged(new: Column) -> Column:
            fired = [F.when(new[f"r{r}"]["started"].isNotNull() & x["own"], F.struct(x["no"].alias("at"), F.lit(r).alias("rule"), new[f"r{r}"]["started"].alias("started"))) for r, _, _ in able]
            done = F.concat(state["done"], F.filter(F.array(*fired), lambda d: d.isNotNull()).cast(DONE))
            return F.struct(*[new[f"r{r}"]["open"].alias(f"r{r}") for r, _, _ in able], done.alias("done"))

        return _let(each, merged)

    folded = counted.select(*gathered.columns, F.aggregate("_steps", empty, feed, lambda state: state["done"]).alias("_done")).where(F.size("_done") > 0)
    done = folded.select(*gathered.columns, F.explode("_done").alias("_d"))
    return done.select(row(F.get("_rows", F.col("_d.at"))).alias("_r"), "_d.rule", "_d.started").select("_r.*", "rule", "started")


def rule_set_matches(
    rows: DataFrame,
    key: str,
    time: str,
    tie: str,
    rules: Sequence[tuple[Sequence[Column], int]],
    carry: Sequence[str] = (),
    span: int | None = None,
) -> DataFrame:
    """Rows that complete a rule's sequence: key, time, tie, carried columns, ``rule`` (its number from 0) and ``started``.

    A rule is (steps, within). The meaning is that of ``step_matches``, rule by rule: a row completes a
    rule once at most, and rules of a single step never fire. The rows of one key and span are sorted and
    folded in one task; ``span`` is at least the longest limit.
    """
    longest, mask = max((within for _, within in rules), default=1), step_mask(rules)
    names = list(dict.fromkeys([key, time, tie, *carry]))
    if all(len(steps) < 2 for steps, _ in rules):
        return rows.select(*names, F.lit(0).alias("rule"), F.lit(0).cast("long").alias("started")).where("false")
    marked = rows.select(*names, mask.alias("_mask")).where("_mask != 0")
    spans = with_spans(marked, time, longest, span or SPAN_FACTOR * longest)
    row = gathered_row(names, time, tie)
    gathered = spans.groupBy(key, "_span").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    return folded_matches(gathered, rules)


def rule_set_alerts(events: DataFrame, rules: Sequence[SequenceRule], span_ms: int | None = None) -> DataFrame:
    """One alert per completed sequence of any of the rules, at its last packet."""
    done = rule_set_matches(
        events, "src_ip", "timestamp_ms", "packet_id", [(rule.conditions(), rule.within_ms) for rule in rules], ["dst_ip"], span_ms)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rule") + 1)
    details = [f"CEP rule '{rule.name}' completed: {len(rule.steps)} steps matched within {duration_text(rule.within_ms)}" for rule in rules]
    return to_alert(done, pick([r.name for r in rules]), pick([r.severity for r in rules]), pick(details), "Cep", stage=4)
