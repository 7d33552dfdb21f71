"""A circuit breaker per target, as keyed state of a stream of outcomes; ``operators.circuits`` has it for whole histories.

A circuit opens when ``threshold`` of the last 2 * threshold outcomes failed. After the cooldown one probe is let
through. Any success while it is open closes the circuit and clears the window, any failure while it is open starts
the cooldown again. Time is the outcome's own, never the clock, so a replay gives the same states.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "window string, opened_at double, trips long"
OUT = "target string, seq long, open boolean, trips long"


@dataclass
class Circuit:
    threshold: int
    cooldown_s: float
    window: list[bool] = field(default_factory=list)
    opened_at: float | None = None
    trips: int = 0

    def down(self, now: float) -> bool:
        """Open and still cooling down: nothing is let through."""
        return self.opened_at is not None and now < self.opened_at + self.cooldown_s

    def record(self, ok: bool, now: float) -> None:
        if ok and self.opened_at is not None:
            self.window, self.opened_at = [], None
            return
        self.window = [*self.window, ok][-2 * self.threshold :]
        if self.window.count(False) >= self.threshold:
            self.trips += self.opened_at is None
            self.opened_at = now


def circuits(outcomes: DataFrame, threshold: int = 5, cooldown_s: float = 60.0) -> DataFrame:
    """From a stream of target, seq, at, ok: after every outcome whether the target's circuit is open, and its trips so far.

    Within a micro-batch a target's outcomes are taken in the order of seq. A circuit is one sequence of states, so a
    target's part of a micro-batch is one group: bound it by what a trigger reads (maxFilesPerTrigger, maxBytesPerTrigger).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Circuit(threshold, cooldown_s)
        if state.exists:
            window, opened_at, own.trips = state.get
            own.window, own.opened_at = [c == "1" for c in window], None if opened_at is None or pd.isna(opened_at) else opened_at
        rows = []
        for seq, at, ok in pd.concat(list(batches)).sort_values("seq")[["seq", "at", "ok"]].itertuples(index=False):
            own.record(bool(ok), at.timestamp())
            rows.append((key[0], seq, own.opened_at is not None, own.trips))
        state.update(("".join("1" if ok else "0" for ok in own.window), own.opened_at, own.trips))
        yield pd.DataFrame(rows, columns=["target", "seq", "open", "trips"])

    return outcomes.select("target", "seq", "at", "ok").groupBy("target").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
