"""Metrics of a run as a Prometheus text file."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def by_target(attempts: DataFrame) -> DataFrame:
    """Stored and failed attempts and stored bytes of each target."""
    return attempts.groupBy("target").agg(
        F.count(F.when(F.col("state") == "stored", 1)).alias("stored"), F.count(F.when(F.col("state") == "failed", 1)).alias("failed"), F.coalesce(F.sum("stored_bytes"), F.lit(0)).alias("bytes")
    )


_COUNTED = ("stored", "failed", "deduplicated", "bytes")


class Counted:
    """Counters of a backup pass, filled in while its outcomes are written, without a pass of their own.

    ``observed`` is what to write, once; the counts are there when that is done. A task that is run again counts once.
    """

    def __init__(self, outcomes: DataFrame, targets: Sequence[str]) -> None:
        self.spark, self.targets, self._seen = outcomes.sparkSession, list(targets), Observation()
        statuses = lambda t, state: F.filter("statuses", lambda s: (s["target"] == t) & (s["state"] == state))
        there = lambda t: F.filter("held", lambda h: h == t)
        size = lambda c: F.coalesce(F.sum(F.size(c).cast("long")), F.lit(0).cast("long"))
        added = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda n, s: n + s["bytes"])
        counts = []
        for i, t in enumerate(self.targets):
            of = (size(statuses(t, "stored")), size(statuses(t, "failed")), size(there(t)), F.coalesce(F.sum(added(statuses(t, "stored"))), F.lit(0).cast("long")))
            counts += [c.alias(f"{name}_{i}") for name, c in zip(_COUNTED, of, strict=True)]
        self.observed = outcomes.observe(self._seen, *counts) if counts else outcomes

    def by_target(self) -> DataFrame:
        """target, stored, failed, deduplicated, bytes."""
        seen = self._seen.get if self.targets else {}
        rows = [(t, *(int(seen[f"{name}_{i}"]) for name in _COUNTED)) for i, t in enumerate(self.targets)]
        return self.spark.createDataFrame(rows, "target string, " + ", ".join(f"{n} long" for n in _COUNTED))


def prior_success(path: str, name: str) -> float:
    """The last success that the file tells of; 0 without one."""
    if not os.path.exists(path):
        return 0.0
    with open(path) as f:
        found = re.findall(rf"(?m)^{re.escape(name)}_last_success_seconds (\S+)$", f.read())
    return float(found[-1]) if found else 0.0


def write_textfile(path: str, name: str, passed: bool, values: dict[str, float], now: float | None = None) -> None:
    """Writes the file whole; a run that failed keeps the time of the last success."""
    now = time.time() if now is None else now
    last = now if passed else prior_success(path, name)
    lines = [f"{name}_last_run_seconds {now}", f"{name}_last_success_seconds {last}", f"{name}_passed {int(passed)}", *(f"{name}_{k} {v}" for k, v in sorted(values.items()))]
    own = f"{path}.{os.getpid()}.tmp"
    with open(own, "w") as f:
        f.write("\n".join(lines) + "\n")
    os.replace(own, path)
