"""Interval sweeps, as-of reads, calendars and canonical JSON against brute force on small cases."""

from __future__ import annotations

import json
import math
import random
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import text, time
from tidemark.operators import coverage, derive, inventory, ranges, versions, windows
from tidemark.sources import providers, storage

ZERO = datetime(2020, 1, 1)
SPAN = "task string, id long, start timestamp, end timestamp"


def spans(rng, n, first=0, most=40):
    out = []
    for i in range(n):
        s = rng.randint(0, 300)
        out.append((rng.choice("ab"), first + i, ZERO + timedelta(hours=s), ZERO + timedelta(hours=s + rng.randint(0, most))))
    return out


def test_overlaps_equal_every_pair(spark):
    rng = random.Random(1)
    left, right = spans(rng, 150), spans(rng, 150, 1000) + [("a", 5000, ZERO, ZERO + timedelta(days=7300)), ("c", 5001, ZERO, ZERO)]
    want = sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and max(a[2], b[2]) < min(a[3], b[3]))
    got = windows.overlapping(spark.createDataFrame(left, SPAN), spark.createDataFrame(right, SPAN), ["task"])
    assert sorted((r.id, r.r_id) for r in got.collect()) == want
    assert got.columns == ["task", "start", "end", "id", "r_start", "r_end", "r_id"]


def test_subtraction_and_containment_equal_hours(spark):
    rng = random.Random(2)
    wanted, busy = spans(rng, 120), spans(rng, 60, most=15)
    busy += [busy[0], ("b", 1, ZERO + timedelta(hours=40), ZERO + timedelta(hours=50)), ("b", 2, ZERO + timedelta(hours=50), ZERO + timedelta(hours=60))]
    hours = lambda s, e: {s + timedelta(hours=h) for h in range(int((e - s).total_seconds()) // 3600)}
    taken = {k: set().union(*[hours(b[2], b[3]) for b in busy if b[0] == k]) for k in "ab"}
    found = windows.subtract(spark.createDataFrame(wanted, SPAN), spark.createDataFrame(busy, SPAN), ["task"], ["id"]).collect()
    for k, i, s, e in wanted:
        mine = [r for r in found if r.id == i]
        assert set().union(*[hours(r.start, r.end) for r in mine]) == hours(s, e) - taken[k]
        assert sum(len(hours(r.start, r.end)) for r in mine) == len(hours(s, e) - taken[k])
        assert not any(a.end == b.start for a in mine for b in mine)  # pieces are as long as can be
    for k in "ab":
        mine = sorted((r for r in found if r.task == k), key=lambda r: r.ordinal)
        assert [r.ordinal for r in mine] == list(range(len(mine))) and mine == sorted(mine, key=lambda r: (r.start, r.end, r.id))
    held = windows.contained(spark.createDataFrame(wanted, SPAN), spark.createDataFrame(busy, SPAN), ["task"], ["id"]).collect()
    assert sorted(r.id for r in held) == sorted(w[1] for w in wanted if any(b[0] == w[0] and b[2] < b[3] and b[2] <= w[2] and w[3] <= b[3] for b in busy))


def test_a_long_interval_beside_many_short_ones(spark):
    hour = F.make_dt_interval(hours=F.col("id").cast("int"))
    short = spark.range(100_000).select(F.lit("t").alias("task"), "id", (F.lit(ZERO) + hour).alias("start"), (F.lit(ZERO) + hour + F.expr("interval 30 minute")).alias("end"))
    long_ = spark.createDataFrame([("t", -1, ZERO, ZERO + timedelta(days=7300))], SPAN)
    assert windows.overlapping(long_, short, ["task"]).count() == 100_000
    free = windows.subtract(long_, short, ["task"], ["id"])
    assert free.count() == 100_000 and free.agg(F.max("ordinal")).first()[0] == 99_999


def test_resolved_and_due_debt(spark):
    debt = spark.createDataFrame([("a", 1, ZERO, ZERO + timedelta(days=2), None), ("a", 2, ZERO, ZERO + timedelta(days=9), ZERO), ("a", 3, ZERO + timedelta(days=3), ZERO + timedelta(days=4), ZERO + timedelta(days=50))], SPAN + ", next_review timestamp")
    done = spark.createDataFrame([("a", 9, ZERO, ZERO + timedelta(days=5))], SPAN)
    assert [r.id for r in windows.resolved(debt, done, ["task"]).collect()] == [2]
    assert sorted(r.id for r in windows.due(debt, F.lit(ZERO + timedelta(days=10))).collect()) == [1, 2]
    assert [r.id for r in windows.put_off(debt, F.lit(ZERO + timedelta(days=10))).collect()] == [3]


OBS = "series_id string, observation_date date, value double, vintage_start date, availability_policy string, availability_lag_days int, release_ts timestamp, asof_ts timestamp, tie long"


def observations(rng, n=300):
    rows = []
    for i in range(n):
        day, policy = ZERO + timedelta(days=rng.randint(0, 20)), rng.choice(["vintage", "release", "unknown"])
        vintage = None if rng.random() < 0.1 else (day + timedelta(days=rng.randint(0, 20))).date()
        release = None if rng.random() < 0.1 else day + timedelta(hours=rng.randint(0, 400))
        asof = None if rng.random() < 0.1 else day + timedelta(hours=rng.randint(0, 400))
        rows.append((rng.choice("xyz"), day.date(), float(i), vintage, policy, rng.choice([None, 0, 2]), release, asof, i))
    return rows


def seen_at(rows, instant):
    """Of each observation the best version that is public at an instant."""
    out = {}
    for r in rows:
        lag = timedelta(days=r[5] or 0)
        start = datetime.combine(r[3], datetime.min.time()) if r[3] else None
        public = {"vintage": start + lag if start else None, "release": r[6] + lag if r[6] else None}.get(r[4])
        if public is None or r[7] is None or max(public, r[7]) > instant:
            continue
        rank = start if r[4] == "vintage" else r[6], r[7], r[8]
        if (r[0], r[1]) not in out or rank > out[r[0], r[1]][0]:
            out[r[0], r[1]] = rank, r[8]
    return {k: v[1] for k, v in out.items()}


def test_asof_of_many_instants_equals_each_alone(spark):
    rng = random.Random(3)
    rows = observations(rng)
    instants = [ZERO + timedelta(hours=rng.randint(-50, 1000)) for _ in range(60)] + [ZERO - timedelta(days=99)]
    obs, asked = spark.createDataFrame(rows, OBS), spark.createDataFrame([(i,) for i in instants + [None, instants[0]]], "asof timestamp")
    got = {}
    for r in versions.observed_asof(obs, asked, "tie").collect():
        assert (r.asof, r.series_id, r.observation_date) not in got
        got[r.asof, r.series_id, r.observation_date] = r.tie
    assert got == {(i, *k): tie for i in instants for k, tie in seen_at(rows, i).items()}
    assert {(r.series_id, r.observation_date): r.tie for r in versions.observed_at(obs, instants[5], "tie").collect()} == seen_at(rows, instants[5])
    by = asked.crossJoin(spark.createDataFrame([("x",), ("y",)], "series_id string"))
    totals = {(r.series_id, r.asof): (r.n, r.ties, r.last) for r in versions.asof_totals(obs, by, "tie", ["series_id"], {"ties": F.col("tie")}, {"last": F.col("observation_date")}).collect()}
    want = {}
    for i in instants:
        for s in "xy":
            mine = {k: v for k, v in seen_at(rows, i).items() if k[0] == s}
            if mine:
                want[s, i] = len(mine), sum(mine.values()), max(d for _, d in mine)
    assert totals == want


@pytest.mark.parametrize("session", ["always", "weekdays", "fx"])
def test_calendar_equals_its_grid(spark, session):
    """Over a change of daylight saving and a holiday, with ends inside hours and days."""
    profile, rng = time.SESSIONS[session], random.Random(4)
    for base in (datetime(2024, 3, 8, 5, 30), datetime(2024, 1, 12)):
        cut = [base + timedelta(minutes=rng.choice([0, 15, 20]) + 60 * rng.randint(0, 200)) for _ in range(12)]
        rows = [(f"s{i}", min(a, b), max(a, b)) for i, (a, b) in enumerate(zip(cut[::2], cut[1::2], strict=True)) if a != b]
        df = spark.createDataFrame(rows, "symbol string, start timestamp, end timestamp")
        grid = coverage.grid(df, ["symbol"], 1800, profile).where("open")
        counts = {r.symbol: r.n for r in grid.groupBy("symbol").agg(F.count("*").alias("n")).collect()}
        assert {r.symbol: r.expected for r in coverage.with_expected(df, 1800, profile).collect() if r.expected} == counts
        cal = coverage.calendar(df, 1800, profile)
        want = sorted(map(tuple, coverage.islands(grid, ["symbol"], "ts", 1800).select("symbol", "start", "end", "n").collect()))
        assert sorted(map(tuple, coverage.open_ranges(df, ["symbol"], cal, 1800).select("symbol", "start", "end", "n").collect())) == want
        marks = coverage.with_ordinal(coverage.grid(df, ["symbol"], 900), cal, "ts", 1800, "o", "is_open")
        assert marks.where(F.col("is_open") != (profile.is_open(F.col("ts")) & (F.minute("ts") % 30 == 0))).count() == 0


def test_coverage_equals_sets_of_stamps(spark):
    profile, rng = time.SESSIONS["fx"], random.Random(5)
    base = datetime(2024, 3, 8)
    rows = [(s, base + timedelta(hours=h)) for s, share in (("a", 0.9), ("b", 0.3), ("c", 1.1)) for h in range(150) if rng.random() < share]
    asked = [(s, base + timedelta(hours=3), base + timedelta(hours=140)) for s in "abcd"]
    df, spans_ = spark.createDataFrame(rows + [("a", None), ("a", base + timedelta(minutes=90))], "symbol string, bar_ts timestamp"), spark.createDataFrame(asked, "symbol string, start timestamp, end timestamp")
    found = coverage.evaluate(df, spans_, ["symbol"], "bar_ts", 3600, profile)
    grid = {(r.symbol, r.ts) for r in coverage.grid(spans_, ["symbol"], 3600, profile).where("open").collect()}
    missing = grid - set(rows)
    assert {(r.symbol, r.ts) for r in found.missing.collect()} == missing
    assert {(r.symbol, r.ts) for r in found.seen.collect()} == grid & set(rows)
    for r in found.summary.collect():
        own = sorted(ts for s, ts in missing if s == r.symbol)
        assert (r.missing, r.first_missing, r.expected, r.closed) == (len(own), min(own, default=None), sum(s == r.symbol for s, _ in grid), 137 - sum(s == r.symbol for s, _ in grid))
        assert r.readiness == {"a": "degraded", "b": "degraded", "c": "ready", "d": "not_ready"}[r.symbol]
    bad = coverage.evaluate(df, spans_, ["symbol"], "bar_ts", 3600, profile, spark.createDataFrame([("c", "fail"), ("a", "pass")], "symbol string, quality_status string"))
    assert {r.symbol: r.readiness for r in bad.summary.collect()} == {"a": "degraded", "b": "degraded", "c": "not_ready", "d": "not_ready"}


def test_closed_bars_reach_no_derived_bar(spark):
    fx, base = time.SESSIONS["fx"], datetime(2026, 1, 7)
    rows = [("p", "fx", "s", base + timedelta(hours=h), 1.0, 5.0, 1.0, 2.0, 1.0, base, f"h{h}") for h in range(24)]
    df = spark.createDataFrame(rows, "provider string, asset_class string, symbol string, bar_ts timestamp, open double, high double, low double, close double, volume double, ingest_ts timestamp, source_hash string")
    df = df.withColumn("high", F.when(fx.is_open(F.col("bar_ts")), F.col("high")).otherwise(999.0))
    for policy in ("drop", "allow", "fail"):
        r = derive.derive(df, derive.Recipe("r", "1h", "1d", policy=policy), "s", fx).collect()
        assert [(x.high, x.n_source, x.complete) for x in r] == [(5.0, 23, True)]
    holed = df.where("source_hash <> 'h3'")
    assert derive.derive(holed, derive.Recipe("r", "1h", "1d"), "s", fx).count() == 0
    with pytest.raises(Exception, match="not complete"):
        derive.derive(holed, derive.Recipe("r", "1h", "1d", policy="fail"), "s", fx).collect()


def test_bucket_runs_keep_all_and_defer(spark):
    base = datetime(2024, 1, 1)
    rows = [("s", base + timedelta(hours=h)) for h in range(24 * 40) if h // 24 % 2 == 0]
    df, span = spark.createDataFrame(rows, "symbol string, bar_ts timestamp"), spark.createDataFrame([("s", base, base + timedelta(days=40, hours=5))], "symbol string, start timestamp, end timestamp")
    got = derive.bucket_runs(df, span, ["symbol"], derive.Recipe("r", "1h", "1d"), time.SESSIONS["always"]).collect()
    assert len(got) == 40 and sum(r.ready for r in got) == 20
    assert sorted(r["rank"] for r in got if r.deferred) == list(range(13, 21))
    closed = derive.bucket_runs(df.where("false"), span, ["symbol"], derive.Recipe("r", "1h", "1d"), time.SESSIONS["weekdays"]).collect()
    assert [(r.ready, r.buckets) for r in closed] == [(False, 40)]  # days without open hours are blocked as well


def test_canonical_json_equals_the_library(spark):
    rng = random.Random(6)
    chars = [*'ab"\\/\n\r\t\b\f é漢🙂', "\x00", "\x1f", "\x7f", " "]
    numbers = [0.0, -0.0, 1.0, 1.5, -2.25, 1e-4, 1.25e-4, 9.99e-5, 1e15, 1.5e15, 123456789.125, 1e16, 1.7e22, -3e-7, 1e100, 0.1, 12345678.0, 1234567.0, math.inf, -math.inf]
    rows = []
    for i in range(200):
        word = "".join(rng.choice(chars) for _ in range(rng.randint(0, 8)))
        rows.append((word if i % 9 else None, i if i % 7 else None, rng.choice([*numbers, rng.uniform(-1e6, 1e6), rng.uniform(0, 1) * 10 ** rng.randint(-12, 25)]), [word, None], (i % 2 == 0, word)))
    schema = StructType.fromDDL("z string, b long, a double, list array<string>, in struct<y: boolean, x: string>")
    df = spark.createDataFrame(rows, schema)
    got = df.select(F.struct(*df.columns).alias("v")).select(text.canonical_json(F.col("v"), schema).alias("j"), text.config_digest(F.col("v"), schema).alias("d")).collect()
    for row, r in zip(rows, got, strict=True):
        value = dict(zip(("z", "b", "a", "list"), row, strict=False)) | {"in": {"y": row[4][0], "x": row[4][1]}}
        assert r.j == json.dumps(value, sort_keys=True, separators=(",", ":"))


def test_rows_ahead_and_numbers_over_ranges(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 37 % 1000).alias("v"))
    got = ranges.previous(ranges.in_ranges(rows, ["k"], ["v"]), ["k"], ["v"], "v", "p").collect()
    for k in range(3):
        own = sorted(r.v for r in got if r.k == k)
        assert {r.v: r.p for r in got if r.k == k} == dict(zip(own, [None, *own], strict=False))
    wide = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(200_000).cast("long").alias("b"))
    assert ranges.each_number(wide, "a", "b", "n").agg(F.count_distinct("n"), F.max("n")).first() == (200_001, 200_000)
    assert ranges.each_number(wide, "b", "a", "n").count() == 0


def test_frames_and_series_and_inventories(spark):
    frame = spark.createDataFrame([("s", ZERO + timedelta(hours=h), 1.0, 1.0, 1.0, None if h == 2 else 1.0, None, i) for i, h in enumerate((0, 2, 1, 3))], "symbol string, bar_ts timestamp, open double, high double, low double, close double, volume double, at int")
    good, bad = providers.normalize_frame(frame, F.lit(ZERO), F.lit(ZERO + timedelta(hours=3)), ["symbol"], "at")
    assert good.count() == 3 and sorted((r.bar_ts.hour, r.code) for r in bad.collect()) == [(1, "unsorted"), (2, "missing_price")]
    doc = json.dumps([{"date": "2026-01-01", "value": "1", "realtime_start": "2026-01-02"}, {"date": "2026-01-02", "value": ".", "realtime_start": "2026-01-02", "realtime_end": "2026-01-03", "release_ts": "t"}])
    got = providers.series(spark.createDataFrame([("x", doc, "")], "id string, payload string, units string"), "payload", "id").collect()
    assert [(r.availability_policy, r.release_ts, r.units, r.frequency, r.value) for r in got] == [("unknown", None, "native", "native", 1.0), ("vintage", "t", "native", "native", None)]
    rows = spark.createDataFrame([("s", ZERO + timedelta(hours=h), "1h", "bid") for h in (0, 1, 30, 30, 31)], "symbol string, bar_ts timestamp, timeframe string, price_type string")
    r = inventory.inventory(rows, ["symbol"], "bar_ts").first()
    assert (r.row_count, r.duplicates, r.gaps, r.longest_gap_s) == (5, 1, 1, 29 * 3600)


def test_sinks_registry_and_read_helpers(spark):
    root = storage.shared_dir(spark)
    rows = [r for r in observations(random.Random(7), 40) if r[4] != "unknown"]
    obs = spark.createDataFrame(rows, OBS)
    storage.write_observations(obs, root, "r1")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        storage.write_observations(obs, root, "r1")
    read = derive.observations(spark, root, obs.schema, "tie")
    assert read.count() == len({(r[0], r[1]) for r in rows})
    instant = ZERO + timedelta(days=12)
    assert {r.tie for r in derive.observations(spark, root, obs.schema, "tie", instant).collect()} == set(seen_at(rows, instant).values())
    spec = derive.DatasetSpec("tests", "raw", ("a",))
    assert derive.register_dataset(spec) is spec and derive.register_dataset(derive.DatasetSpec("tests", "raw", ("a",))) == spec
    with pytest.raises(ValueError):
        derive.register_dataset(derive.DatasetSpec("tests", "raw", ("b",)))
    keys = (*versions.BAR_KEYS, "price_basis", "session_profile", "recipe_id")
    made = [("p", "fx", "s", "1d", ZERO, basis, "fx", recipe, ZERO + timedelta(days=d), f"h{d}") for basis in ("bid", "ask") for recipe in ("r1", "r2") for d in (0, 1)]
    derived = spark.createDataFrame(made, ", ".join(f"{k} {'timestamp' if k == 'bar_ts' else 'string'}" for k in keys) + ", ingest_ts timestamp, source_hash string")
    got = versions.current_bars(derived, keys).collect()
    assert len(got) == 4 and {r.source_hash for r in got} == {"h1"}


def test_shared_folder_is_never_set_and_refused_on_clusters(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Elsewhere:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "local-cluster[3,2,1024]"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Elsewhere())


def test_entry_without_what_the_training_operators_need():
    """A library that only these operators need is lacking: the other queries are all there."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    root = str(Path(__file__).resolve().parent.parent)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=120)
    assert out.returncode == 0, out.stderr
    n, some = out.stdout.split()[-2:]
    assert int(n) > 140 and some == "False"
