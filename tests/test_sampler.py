"""Gauges over time against every tick taken by itself."""

import datetime
import random

from pyspark.sql import functions as F

from stowage.operators import sampler

AT = datetime.datetime(2024, 1, 15, tzinfo=datetime.timezone.utc)


def test_runs_over_ticks(spark):
    rng = random.Random(1)
    runs = [(rng.choice("xy"), lo := rng.randrange(-5, 70), lo + rng.randrange(-2, 40), rng.randrange(100)) for _ in range(200)] + [("x", 0, 61, 1), ("z", 100, 200, 3)]
    for ticks in (1, 2, 61, 64):
        table = spark.createDataFrame(runs, "key string, lo long, hi long, v long").withColumns({"n": F.lit(1), "low": F.col("v")})
        found = {(r.key, r.tick): (r.n, r.low, r.v) for r in sampler.over_ticks(table, ticks, ["key"], {"n": "sum", "low": "min", "v": "max"}).collect()}
        want = {}
        for k in "xyz":
            for t in range(ticks):
                if own := [v for key, lo, hi, v in runs if key == k and lo <= t < hi]:
                    want[k, t] = (len(own), min(own), max(own))
        assert found == want


def test_history_of_rows_that_never_close_or_have_no_time(spark):
    second = lambda n: None if n is None else AT + datetime.timedelta(seconds=n)
    rows = [(None, None), (None, 20), (-5, None), (0, 0), (0, 15), (15, 16), (16, 45), (30, None), (7, 3), (500, 600)]
    marks = [("a", 3), ("a", 31), ("b", 15), ("a", None), ("other", 1), ("c", -100)]
    queue = spark.createDataFrame([(second(a), second(b)) for a, b in rows], "opened timestamp, closed timestamp")
    verified = spark.createDataFrame([(t, second(v)) for t, v in marks], "target string, verified_at timestamp")
    found = sampler.history(queue, verified, "abd", F.expr("timestamp '2024-01-15 00:00:00'"), 15, 6).orderBy("at").collect()
    for i, r in enumerate(found):
        t = 15 * i
        open_ = [a for a, b in rows if (a is None or a <= t) and (b is None or b > t)]
        ages = [t - a for a in open_ if a is not None]
        last = [max(v) for k in "abd" if (v := [v for n, v in marks if n == k and v is not None and v <= t])]
        assert (r.pending, r.oldest_s, r.never_verified, r.stalest_s, r.ok) == (len(open_), max(ages, default=0), 3 - len(last), t - min(last) if last else 0, bool(last)), t
    assert len(found) == 6
    empty = sampler.history(queue.limit(0), verified.limit(0), [], F.expr("timestamp '2024-01-15 00:00:00'"), 15, 2).collect()
    assert [(r.pending, r.oldest_s, r.never_verified, r.ok) for r in empty] == [(0, 0.0, 0, False)] * 2
