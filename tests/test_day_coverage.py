"""Coverage from states of days against the evaluation of all bars."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.functions import time
from tidemark.operators import coverage, day_coverage

KEYS = ["symbol"]
BARS, RANGES = "symbol string, bar_ts timestamp", "symbol string, start timestamp, end timestamp"


def both(spark, bars, ranges, step, session, states=None):
    """All rows of both evaluations, for comparison."""
    whole = coverage.evaluate(bars, ranges, KEYS, "bar_ts", step, session)
    states = day_coverage.day_states(bars, KEYS, "bar_ts", step, session) if states is None else states
    parts = day_coverage.merged(states, ranges, KEYS, step, session)
    same = lambda df, like: sorted(map(tuple, df.select(*like.columns).collect()), key=repr)
    return [(same(getattr(parts, c), getattr(whole, c)), same(getattr(whole, c), getattr(whole, c))) for c in ("summary", "gaps", "ready")]


@pytest.mark.parametrize("session", ["always", "weekdays", "fx"])
def test_states_of_days_equal_the_whole(spark, session):
    """Eleven days over a change of the clocks, with holes, doubled and closed stamps, stamps off the grid, ranges that begin and end within days."""
    rng = random.Random(7)
    start = datetime(2026, 3, 4, 0)
    rows = [(s, start + timedelta(hours=h)) for s in ("a", "b") for h in range(11 * 24) if rng.random() < 0.8]
    rows += rng.sample(rows, 5) + [("a", None), ("b", start + timedelta(hours=30, minutes=7)), ("unasked", start)]
    ranges = [("a", start + timedelta(hours=5, minutes=30), start + timedelta(hours=70)), ("a", start + timedelta(hours=70), start + timedelta(hours=200, minutes=1)), ("b", start, start + timedelta(days=12)), ("empty", start, start + timedelta(days=1))]
    for got, want in both(spark, spark.createDataFrame(rows, BARS), spark.createDataFrame(ranges, RANGES), 3600, time.SESSIONS[session]):
        assert got == want


def test_no_bars_at_all(spark):
    ranges = spark.createDataFrame([("a", datetime(2026, 3, 4), datetime(2026, 3, 6))], RANGES)
    for got, want in both(spark, spark.createDataFrame([], BARS), ranges, 3600, time.SESSIONS["always"]):
        assert got == want


def test_a_new_day_leaves_the_others_alone(spark, tmp_path):
    """A fourth day and a second delivery of the third: only these two days' folders are written, and the whole is right."""
    start, root, session = datetime(2026, 3, 4), f"{tmp_path}/states", time.SESSIONS["always"]
    rows = [("a", start + timedelta(hours=h)) for h in range(96) if h % 7]
    bars = spark.createDataFrame(rows, BARS)
    day = F.to_date("bar_ts")
    put = lambda some: day_coverage.put_days(day_coverage.day_states(bars.where(some), KEYS, "bar_ts", 3600, session), root)
    put((day < F.lit("2026-03-07").cast("date")) & (F.hour("bar_ts") != 20))
    files = lambda d: sorted(p.name for p in Path(f"{root}/day=2026-03-{d:02d}").glob("*.parquet"))
    before = {d: files(d) for d in (4, 5, 6)}
    late = bars.where((F.hour("bar_ts") != 20) | (day >= F.lit("2026-03-06").cast("date")))
    put(day >= F.lit("2026-03-06").cast("date"))
    assert (files(4), files(5)) == (before[4], before[5]) and files(6) != before[6] and files(7)
    states = day_coverage.kept_days(spark, root, day_coverage.day_states(bars, KEYS, "bar_ts", 3600, session).schema)
    ranges = spark.createDataFrame([("a", start, start + timedelta(days=4))], RANGES)
    for got, want in both(spark, late, ranges, 3600, session, states):
        assert got == want
