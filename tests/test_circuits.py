"""Circuits of whole histories against outcomes taken one by one."""

import datetime
import random

import pytest

from stowage.operators import circuits
from stowage.streaming import circuit, run

AT = datetime.datetime(2024, 1, 15, tzinfo=datetime.timezone.utc)
SCHEMA = "target string, seq long, at timestamp, ok boolean"


def one_by_one(rows, threshold, cooldown_s):
    """Every step as a breaker takes it: a success while open closes, a failure that finds enough failures opens or extends."""
    own, found = {}, []
    for target, seq, at, ok in sorted(rows, key=lambda r: (r[0], r[1])):
        recent, until, trips = own.get(target, ([], None, 0))
        if ok and until is not None:
            recent, until = [], None
        else:
            recent = [*recent, bool(ok)][-2 * threshold :]
            if recent.count(False) >= threshold:
                trips, until = trips + (until is None), at + datetime.timedelta(seconds=cooldown_s)
        own[target] = recent, until, trips
        found.append((target, seq, until is not None, until and until.timestamp(), trips))
    return found


def some(seed, n, targets, rate):
    rng = random.Random(seed)
    rows, bad = [], False
    for k in range(n):
        bad = rng.random() < 0.85 if bad else rng.random() < 0.1
        rows.append((rng.choice(targets), 3 * k + rng.randrange(2), AT + datetime.timedelta(seconds=5 * k), rng.random() > (rate if bad else 0.1)))
    return rows


def found(df):
    return sorted((r.target, r.seq, r.open, r.until and r.until.replace(tzinfo=datetime.timezone.utc).timestamp(), r.trips) for r in df.collect())


@pytest.mark.parametrize(("threshold", "targets", "span"), [(2, "a", 40), (3, "ab", 7), (1, "abc", 20_000), (5, "a", 100)])
def test_states_as_one_by_one(spark, monkeypatch, threshold, targets, span):
    monkeypatch.setattr(circuits, "SPAN", span)
    rows = some(threshold, 400, targets, 0.8)
    want = one_by_one(rows, threshold, 60)
    assert max(r[4] for r in want) > 5
    assert found(circuits.states(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold, 60)) == want


def test_few_outcomes(spark):
    of = lambda oks: [("t", n, AT + datetime.timedelta(seconds=n), ok) for n, ok in enumerate(oks)]
    for oks in ([False], [False, False], [False, False, True], [True], [False, False, False], [None, False, True, False]):
        rows = of(oks)
        assert found(circuits.states(spark.createDataFrame(rows, SCHEMA), 2)) == one_by_one(rows, 2, 60), oks
    assert circuits.states(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_goes_on_from_the_state_of_earlier_batches(spark):
    rows = some(9, 150, "ab", 0.8)
    table = spark.createDataFrame(rows, SCHEMA)
    streamed = run.finished(table, lambda s: circuit.circuits(s, 3), by="seq", slices=5).collect()
    assert sorted(map(tuple, streamed)) == [(t, s, o, n) for t, s, o, _, n in one_by_one(rows, 3, 60)]
