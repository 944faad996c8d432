"""The step tracker of one key: which partial sequences are open, and how far."""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections import deque

from pyspark import cloudpickle

# Python workers get this code with the task, so they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class StepTracker:
    """Feed it a key's rows in order; it reports the completed sequences.

    A row carries a bit mask of the step conditions it fulfils. Open sequences
    are kept per number of steps done, oldest first, as (serial, start). On
    each row, sequences older than ``within`` are dropped; the newest one that
    needs only its last step completes, if the row fulfils it; every open
    sequence newer than that one (or all, when none completes) moves on if the
    row fulfils its next step; then the row may open a new sequence. With a
    single step nothing ever completes.
    """

    def __init__(self, n_steps: int, within: int):
        self.n_steps, self.within = n_steps, within
        self.serial = 0
        self.open = [deque() for _ in range(max(n_steps - 1, 0))]  # [i]: i + 1 steps done

    def feed(self, time: int, fulfilled: int) -> int | None:
        """Start time of the sequence this row completes, or None."""
        started = None
        for waiting in self.open:
            while waiting and time - waiting[0][1] > self.within:
                waiting.popleft()
        newer_than = -1
        if self.open and self.open[-1] and fulfilled >> (self.n_steps - 1) & 1:
            newer_than, started = self.open[-1].pop()
        for done in range(len(self.open) - 1, 0, -1):
            waiting = self.open[done - 1]
            if waiting and fulfilled >> done & 1:
                self._move(waiting, done, newer_than)
        if self.open and fulfilled & 1:
            self.open[0].append((self.serial, time))
            self.serial += 1
        return started

    def _move(self, waiting: deque, done: int, newer_than: int) -> None:
        """Move the entries newer than ``newer_than`` one step up, keeping order."""
        moving = deque()
        while waiting and waiting[-1][0] > newer_than:
            moving.appendleft(waiting.pop())
        if not moving:
            return
        above = self.open[done]
        if above and above[-1][0] > moving[0][0]:
            merged = list(above)
            at = bisect_right(merged, moving[0])
            merged[at:] = sorted(merged[at:] + list(moving))
            self.open[done] = deque(merged)
        else:
            above.extend(moving)

    def snapshot(self) -> list[tuple[int, int, int]]:
        """Open sequences as (steps done, serial, start)."""
        return [(i + 1, s, t) for i, waiting in enumerate(self.open) for s, t in waiting]

    def restore(self, entries) -> None:
        for done, serial, start in sorted(entries, key=lambda e: e[1]):
            self.open[done - 1].append((serial, start))
            self.serial = max(self.serial, serial + 1)
