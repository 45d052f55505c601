"""Single operators on small cases with hand-written results."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text, time
from tidemark.operators import bars, coverage, derive, planner, quality, runs, versions, windows
from tidemark.sources import providers, storage
from tidemark.streaming import bars as streaming


def at(s: str) -> datetime:
    return datetime.fromisoformat(s)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def stamp(s: str):
    return F.lit(s).cast("timestamp")


def test_weekly_session_follows_daylight_saving(spark):
    fx = time.SESSIONS["fx"]
    assert one(spark, fx.is_open(stamp("2026-09-06 22:30:00"))) is True
    assert one(spark, fx.is_open(stamp("2026-09-06 20:59:00"))) is False
    assert one(spark, fx.is_open(stamp("2026-01-04 22:59:00"))) is False  # the break of one hour after the opening
    assert one(spark, fx.is_open(stamp("2026-01-04 23:00:00"))) is True
    assert one(spark, fx.is_open(stamp("2026-09-12 12:00:00"))) is False


def test_buckets_and_instants(spark):
    assert one(spark, time.bucket(stamp("2026-01-04 10:00:00"), "1w")) == at("2025-12-29")
    assert one(spark, time.next_bucket(stamp("2026-01-01"), "1mo")) == at("2026-02-01")
    low, high = time.bucket_window(stamp("2026-01-01 00:10:00"), stamp("2026-01-01 02:50:00"), "1h")
    assert (one(spark, low), one(spark, high)) == (at("2026-01-01 01:00:00"), at("2026-01-01 02:00:00"))
    assert one(spark, time.bucket_window(stamp("2026-01-01 00:10:00"), stamp("2026-01-01 00:50:00"), "1h")[0]) is None
    assert one(spark, time.parse_instant(F.lit("2026-01-01T00:00:00"))) is None
    assert one(spark, time.parse_instant(F.lit("2026-01-01T02:00:00+02:00"))) == at("2026-01-01")


def test_latest_version_wins(spark):
    rows = spark.createDataFrame([("s", at("2025-12-31"), 100.0, at("2026-01-01"), "a"), ("s", at("2025-12-31"), 102.0, at("2026-01-02"), "b"), ("s", at("2026-01-01"), 101.0, at("2026-01-01"), "c")], "symbol string, bar_ts timestamp, close double, ingest_ts timestamp, source_hash string")
    got = versions.current_bars(rows, ("symbol", "bar_ts")).orderBy("bar_ts").collect()
    assert [r.close for r in got] == [102.0, 101.0]


def test_release_lag_hides_an_observation(spark):
    obs = spark.createDataFrame([("x", at("2026-01-01").date(), 1.0, None, "release", 2, at("2026-01-05"), at("2026-01-05"), 1)], "series_id string, observation_date date, value double, vintage_start date, availability_policy string, availability_lag_days int, release_ts timestamp, asof_ts timestamp, tie long")
    for instant, n in (("2026-01-06 23:59:00", 0), ("2026-01-07 00:00:00", 1)):
        assert versions.observed_at(obs, instant, "tie").count() == n
        assert versions.observed_asof(obs, spark.createDataFrame([(at(instant),)], "asof timestamp"), "tie").count() == n


def test_ten_minutes_make_two_bars(spark):
    rows = spark.range(10).select(F.lit("p").alias("provider"), F.lit("a").alias("asset_class"), F.lit("s").alias("symbol"), F.timestamp_seconds(F.col("id") * 60).alias("bar_ts"), *[(F.col("id") + k).cast("double").alias(n) for n, k in (("open", 100), ("high", 102), ("low", 99), ("close", 101), ("volume", 10))], stamp("2026-01-01").alias("ingest_ts"))
    got = bars.rollup(rows, "5m").orderBy("bucket").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(100.0, 106.0, 99.0, 105.0, 60.0), (105.0, 111.0, 104.0, 110.0, 85.0)]
    with_hole = rows.withColumn("volume", F.when(F.col("open") != 101, F.col("volume")))
    assert bars.rollup(with_hole, "5m").orderBy("bucket").first().volume is None
    assert [r.complete for r in bars.completeness(rows.where("open <> 101"), "1m", "5m").orderBy("bucket").collect()] == [False, True]


def test_weekend_is_closed_and_range_is_ready(spark):
    rows = spark.createDataFrame([("s", at("2026-01-02 23:59:00")), ("s", at("2026-01-05 00:00:00"))], "symbol string, bar_ts timestamp")
    ranges = spark.createDataFrame([("s", at("2026-01-02 23:59:00"), at("2026-01-05 00:01:00"))], "symbol string, start timestamp, end timestamp")
    found = coverage.evaluate(rows, ranges, ["symbol"], "bar_ts", 60, time.SESSIONS["weekdays"])
    row = found.summary.first()
    assert (row.readiness, row.expected, row.closed, row.missing) == ("ready", 2, 2880, 0)
    assert found.missing.count() == 0 and found.ready.count() == 2  # the session closes in between


def test_ready_and_missing_make_up_the_open_grid(spark):
    rows = spark.range(48).where("id % 7 <> 3").select(F.lit("s").alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).alias("bar_ts"))
    ranges = spark.createDataFrame([("s", at("1970-01-01"), at("1970-01-03"))], "symbol string, start timestamp, end timestamp")
    found = coverage.evaluate(rows, ranges, ["symbol"], "bar_ts", 3600, time.SESSIONS["always"])
    assert found.missing.count() + found.ready.agg(F.sum("n")).first()[0] == 48 == found.summary.first().expected
    assert found.summary.first().readiness == "degraded"
    assert found.boundary.first().latest_complete == at("1970-01-01 02:00:00")


def test_no_bars_are_not_ready(spark):
    rows = spark.createDataFrame([], "symbol string, bar_ts timestamp")
    ranges = spark.createDataFrame([("s", at("2026-01-01"), at("2026-01-01 01:00:00"))], "symbol string, start timestamp, end timestamp")
    row = coverage.evaluate(rows, ranges, ["symbol"], "bar_ts", 60, time.SESSIONS["always"]).summary.first()
    assert (row.readiness, row.row_count, row.missing, row.first_missing) == ("not_ready", 0, 60, at("2026-01-01"))


def test_subtraction_splits_and_is_disjoint(spark):
    schema = "task string, id long, start timestamp, end timestamp"
    wanted = spark.createDataFrame([("t", 1, at("2026-01-01"), at("2026-01-10")), ("t", 2, at("2026-01-20"), at("2026-01-21"))], schema)
    busy = spark.createDataFrame([("t", 9, at("2026-01-02"), at("2026-01-04")), ("t", 8, at("2026-01-03"), at("2026-01-05")), ("t", 7, at("2026-01-07"), at("2026-01-12"))], schema)
    got = windows.subtract(wanted, busy, ["task"], ["id"]).orderBy("ordinal").collect()
    assert [(r.id, r.start.day, r.end.day, r.ordinal) for r in got] == [(1, 1, 2, 0), (1, 5, 7, 1), (2, 20, 21, 2)]


def test_merge_joins_touching_windows(spark):
    rows = spark.createDataFrame([("t", at("2026-01-01"), at("2026-01-02")), ("t", at("2026-01-02"), at("2026-01-03")), ("t", at("2026-01-05"), at("2026-01-06"))], "task string, start timestamp, end timestamp")
    assert windows.merged(rows, ["task"]).count() == 2


def test_pages_join_up_to_the_whole(spark):
    rows = spark.range(25).select(F.col("id"), F.lit("x").alias("k"))
    seen, last, more = [], None, True
    while more:
        got = versions.page(rows, ["k", "id"], 10, last).collect()
        seen += [r.id for r in got]
        last, more = ["x", got[-1].id], got[-1].has_more
    assert seen == list(range(25))
    with pytest.raises(ValueError):
        versions.page(rows, ["id"], 0)


def test_violations_name_each_rule(spark):
    rows = spark.createDataFrame([("s", at("2026-01-01"), 1.0, 2.0, 0.5, 1.5, -1.0), ("s", at("2026-01-02"), 1.0, 1.0, 3.0, 1.0, 1.0)], "symbol string, bar_ts timestamp, open double, high double, low double, close double, volume double")
    assert sorted(r.code for r in quality.bar_violations(rows, ["symbol", "bar_ts"]).collect()) == ["negative_volume", "ohlc_inconsistent"]


def test_scalars(spark):
    assert one(spark, text.redact(F.lit("password: abc rest"))) == "password: <redacted> rest"
    for given, masked in (
        ('{"token": "abc123", "n": 1}', '{"token": <redacted>, "n": 1}'), ("Authorization: Bearer a.b.c next", "Authorization: <redacted> next"), ("api_key='x y' rest", "api_key=<redacted> rest"),
        ("passwords: one, two", "passwords: <redacted>, two"), ("tokens of a text", "tokens of a text"), ('"secret":"a\\"b" end', '"secret":<redacted> end'),
    ):
        assert one(spark, text.redact(F.lit(given))) == masked
    assert one(spark, text.retryable(F.lit("HTTPError"), F.lit(503))) and not one(spark, text.retryable(F.lit("HTTPError"), F.lit(404)))
    assert one(spark, text.split_symbol(F.lit("eur/usd"))[1]) == "USD"
    assert one(spark, text.capacity_class(F.lit(0.1))) == "warning"
    assert one(spark, text.capacity_class(F.lit(None).cast("double"))) == "unknown"
    assert one(spark, text.path_value(F.lit("/a/symbol=EURUSD/year=2026/x.parquet"), "symbol")) == "EURUSD"


def test_tick_file_makes_two_minutes(spark):
    payload = providers.encode_ticks([(1000, 1.1, 1.1, 0.0, 2.0), (30_000, 1.1002, 1.1002, 0.0, 3.0), (61_000, 1.1001, 1.1001, 0.0, 1.0)])
    files = spark.createDataFrame([("s", at("2026-01-01"), payload)], "symbol string, hour timestamp, payload binary")
    got = bars.tick_bars(providers.decode_ticks(files, {"symbol": "string"}), "1m").orderBy("bar_ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(1.1, 1.1002, 1.1, 1.1002, 5.0), (1.1001, 1.1001, 1.1001, 1.1001, 1.0)]
    late = spark.createDataFrame([("s", at("2026-01-01"), providers.encode_ticks([(3_600_000, 1.0, 1.0, 0.0, 0.0)]))], files.schema)
    with pytest.raises(Exception, match="beyond its hour"):
        providers.decode_ticks(late, {"symbol": "string"}).collect()


def test_published_runs_are_immutable_and_changes_are_found(spark):
    rows = spark.createDataFrame([("p", "fx", "s", "1d", at("2026-01-01"), 1.0)], "provider string, asset_class string, symbol string, timeframe string, bar_ts timestamp, close double")
    root = storage.shared_dir(spark)
    storage.write_bars(rows, root, "r1")
    manifest = storage.build_manifest(spark, root, "r1").cache()
    with pytest.raises(ValueError, match="published already"):
        storage.write_bars(rows, root, "r1", manifest)
    assert storage.verify(spark, root, manifest).count() == 0
    storage.write_bars(rows, root, "r2")
    assert [r.finding for r in storage.verify(spark, root, manifest).collect()] == ["unlisted_part"]


def test_state_changes_of_one_name_over_many_ranges(spark, tmp_path):
    states = ["low" if k % 7 < 4 or 100 < k < 180 else None if k % 7 == 6 else "high" for k in range(400)]
    rows = [("hot", s, k) for k, s in enumerate(states)] + [("rare", "low", 5)]
    want, last = [("rare", "low", 1)], None
    for s in states:
        if s != last:
            last = s
            want.append(("hot", s, len(want)))
    for half in (0, 1):
        part = [r for r in rows if (r[2] >= 205) == half]
        spark.createDataFrame(part, "name string, state string, ts long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # a restart changes nothing
            stream = spark.readStream.schema("name string, state string, ts long").parquet(f"{tmp_path}/in")
            got = streaming.state_changes(stream, "name", "state", "ts", f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    ranges = spark.read.parquet(f"{tmp_path}/out-ranges").where("name = 'hot'").groupBy("batch", "part").count().collect()
    assert len(ranges) > 4 and max(r["count"] for r in ranges) <= 150


def test_retry_chains_of_any_depth_and_cycles(spark, tmp_path):
    rows = [(k, k - 1 if k else None) for k in range(120)] + [(200, 202), (201, 200), (202, 201), (203, 200), (300, 999), (301, 300)]
    got = {r.run_id: (r.root, r.depth, r.cycle) for r in runs.retry_roots(spark.createDataFrame(rows, "run_id long, retry_of long"), f"file://{tmp_path}/chains").collect()}
    assert len(got) == len(rows) and all(got[k] == (0, k, False) for k in range(120))
    assert all(got[k] == (None, None, True) for k in (200, 201, 202, 203))
    assert got[300] == (300, 0, False) and got[301] == (300, 1, False)


def test_a_day_is_complete_without_its_closed_hours(spark):
    fx = time.SESSIONS["fx"]
    hours = spark.range(24).select(F.lit("p").alias("provider"), F.lit("fx").alias("asset_class"), F.lit("s").alias("symbol"), (stamp("2026-01-07") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("bar_ts"))
    open_ = hours.where(fx.is_open(F.col("bar_ts")))
    row = lambda df, session: bars.completeness(df, "1h", "1d", session=session).first()
    assert open_.count() == 23
    assert row(open_, fx).complete and row(open_, fx).expected == 23
    assert not row(open_, None).complete and row(hours, None).complete
    assert row(hours, fx).complete and row(hours, fx).observed == 23  # the bar in closed hours counts for nothing
    assert not row(open_.limit(22), fx).complete
    # the whole range of a day that opens in the evening
    sunday = spark.range(24).select(F.lit("p").alias("provider"), F.lit("fx").alias("asset_class"), F.lit("s").alias("symbol"), (stamp("2026-01-04") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("bar_ts"))
    assert row(sunday.where(fx.is_open(F.col("bar_ts"))), fx).complete


def test_days_of_closed_hours_alone_are_returned(spark):
    rows = [("p", "fx", "s", datetime(2026, 1, 3, h)) for h in (5, 6)] + [("p", "fx", "s", datetime(2026, 1, 7, h)) for h in range(24)]
    df = spark.createDataFrame(rows, "provider string, asset_class string, symbol string, bar_ts timestamp")
    for contiguous in (False, True):
        got = {r.bucket.day: (r.observed, r.closed, r.expected, r.complete) for r in bars.completeness(df, "1h", "1d", require_contiguous=contiguous, session=time.SESSIONS["fx"]).collect()}
        assert got[3] == (0, 2, 0, False) and got[7][:3] == (23, 1, 23) and got[7][3] != contiguous  # the break parts the day's neighbours


def test_gap_debt_owes_what_no_run_holds(spark):
    schema = "task string, id long, start timestamp, end timestamp, error string"
    failed = spark.createDataFrame([("t", 1, at("2026-01-01"), at("2026-01-05"), "coverage"), ("t", 2, at("2026-01-10"), at("2026-01-12"), "gap"), ("t", 3, at("2026-01-20"), at("2026-01-21"), "none"), ("t", 4, at("2026-01-22"), at("2026-01-22"), "gap")], schema)
    ready = spark.createDataFrame([("t", at("2026-01-02"), at("2026-01-03")), ("t", at("2026-01-10"), at("2026-01-20"))], "task string, start timestamp, end timestamp")
    got = windows.gap_debt(failed, ready, ["task"], ["id"]).collect()
    assert sorted((r.id, r.start.day, r.end.day) for r in got) == [(1, 1, 2), (1, 3, 5), (2, 10, 12)]


def test_repair_and_tail_windows(spark):
    rows = spark.createDataFrame([("a", at(f"2026-01-05 0{h}:00:00")) for h in (0, 1, 4)] + [("b", at(f"2026-01-05 0{h}:00:00")) for h in (0, 1, 2)], "symbol string, bar_ts timestamp")
    ranges = spark.createDataFrame([("a", at("2026-01-05"), at("2026-01-05 08:00:00")), ("b", at("2026-01-05"), at("2026-01-05 03:00:00"))], "symbol string, start timestamp, end timestamp")
    found = coverage.evaluate(rows, ranges, ["symbol"], "bar_ts", 3600, time.SESSIONS["always"])
    got = planner.repair_windows(found, "1 hour").collect()
    assert sorted((r.symbol, r.start.hour, r.end.hour, r.ordinal) for r in got) == [("a", 2, 3, 0), ("a", 3, 4, 1), ("a", 5, 6, 2), ("a", 6, 7, 3), ("a", 7, 8, 4)]
    tail = planner.tail_windows(found, ranges, time.SESSIONS["always"], "2 hours").collect()  # b lacks nothing, so its tail is no recovery
    assert sorted((r.symbol, r.start.hour, r.end.hour, r.ordinal) for r in tail) == [("a", 5, 7, 0), ("a", 7, 8, 1)]


def test_islands_go_over_days(spark):
    rows = spark.range(50).where("id not in (10, 30)").select(F.lit("s").alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    got = coverage.islands(rows, ["symbol"], "ts", 3600).orderBy("start").collect()
    assert [r.n for r in got] == [10, 19, 19]
    assert [r.seconds for r in coverage.lag_gaps(rows, ["symbol"], "ts", 3600).collect()] == [7200, 7200]


def test_multisets_and_recipes(spark):
    left, right = (spark.createDataFrame([(x, None) for x in xs], "a long, b string") for xs in ([1, 1, 2], [1, 2, 2, 3]))
    assert tuple(quality.equal_sets(left, right).first()) == (1, 2, False)
    assert tuple(quality.equal_sets(left, left).first()) == (0, 0, True)
    with pytest.raises(ValueError):
        versions.derived_rows(left, "", "1")


def test_a_connector_fetches_its_range(spark):
    payloads = lambda job: spark.createDataFrame([("s", "[[1767225600000,1,2,0.5,1.5,10],[1767312000000,1,2,0.5,1.5,10]]"), ("t", "[[1767225600000,1,2,0.5,1.5,10]]")], "symbol string, payload string")
    made = derive.register_connector(derive.Connector("feed", payloads, lambda df: providers.klines(df, "payload", "symbol")))
    got = made.fetch_bars({"symbol": "s", "start": "2026-01-01", "end": "2026-01-02"}).collect()
    assert [(r.provider, r.symbol, r.bar_ts) for r in got] == [("feed", "s", at("2026-01-01"))] and derive.CONNECTORS["feed"] is made
