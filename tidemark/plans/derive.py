"""Registered queries over derived bars, guards, plans and scalar time rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text as ftext
from tidemark.functions import time as ft
from tidemark.operators import bars as bar_ops
from tidemark.operators import coverage, derive, planner, quality, runs, versions, windows
from tidemark.plans.bars import FX_DAYS, ISLANDS, LOCAL, MARKED, SESSION_SQL, evaluated
from tidemark.plans.fixtures import Tables, query
from tidemark.sources import storage

HOURS_TO_DAYS = derive.Recipe("ohlcv-1h-1d", "1h", "1d", symbols=("click", "view", "error"), policy="allow")
DAYS = """, days AS (SELECT provider, asset_class, symbol, date_trunc('day', bar_ts) AS day, first(open ORDER BY bar_ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bar_ts) AS close, count(DISTINCT bar_ts) = 24 AS complete FROM bars WHERE symbol IN ('click', 'view', 'error') GROUP BY ALL)"""


@query(DAYS + " SELECT symbol, day AS bar_ts, open, high, low, close, complete, 'ohlcv-1h-1d' AS recipe_id, 's1' AS input_snapshot_id FROM days", "bars")
def b12_l1_derive(t: Tables):
    """Derivation by a recipe that allows three symbols."""
    return derive.derive(t.bars(), HOURS_TO_DAYS, "s1").select("symbol", "bar_ts", "open", "high", "low", "close", "complete", "recipe_id", "input_snapshot_id")


@query(DAYS + " SELECT symbol, day AS bar_ts, close FROM days WHERE complete", "bars")
def d4_drop_incomplete(t: Tables):
    recipe = derive.Recipe("r", "1h", "1d", symbols=HOURS_TO_DAYS.symbols)
    return derive.derive(t.bars(), recipe, "s1").select("symbol", "bar_ts", "close")


@query(
    FX_DAYS + """ SELECT symbol, bucket AS bar_ts, min(low) AS low, max(high) AS high, count(*) AS n_source
    FROM buckets JOIN (SELECT symbol, date_trunc('day', ts) AS bucket, low, high FROM open_bars JOIN bars USING (symbol) WHERE bar_ts = ts) USING (symbol, bucket)
    WHERE observed = expected GROUP BY ALL""",
    "bars",
)
def d4_session_derive(t: Tables):
    """Days that hold all bars of their open hours; bars of closed hours, of which there are many, are in none of them."""
    out = derive.derive(t.bars(), derive.Recipe("r", "1h", "1d"), "s1", ft.SESSIONS["fx"])
    return out.select("symbol", "bar_ts", "low", "high", "n_source")


@query(
    DAYS + """SELECT symbol, day AS bar_ts, CASE WHEN dayofmonth(day) % 9 = 0 THEN 'parity_missing_outputs' WHEN dayofmonth(day) % 5 = 0 THEN 'lineage_drift' ELSE 'parity_difference' END AS code FROM days WHERE dayofmonth(day) % 9 = 0 OR dayofmonth(day) % 5 = 0 OR dayofmonth(day) % 7 = 0""",
    "bars",
)
def i7_c12_parity(t: Tables):
    """Stored days, of which some are lacking, from another snapshot or changed, against a new derivation."""
    again = derive.derive(t.bars(), HOURS_TO_DAYS, "s1")
    day = F.dayofmonth("bar_ts")
    stored = again.where(day % 9 != 0).withColumns({"input_snapshot_id": F.when(day % 5 == 0, "s0").otherwise("s1"), "close": F.when(day % 7 == 0, F.col("close") + 1).otherwise(F.col("close"))})
    return derive.parity(stored.select("symbol", "bar_ts", "open", "high", "low", "close", "input_snapshot_id"), again, ["symbol", "bar_ts"], "s1")


@query(
    MARKED + """, cells AS (SELECT symbol, unnest(generate_series(date_trunc('day', range_start + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND), date_trunc('day', range_end) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS bucket FROM ranges),
    of AS (SELECT c.symbol, bucket, count(*) FILTER (open) > 0 AND count(*) FILTER (open AND NOT seen) = 0 AS ready FROM cells c LEFT JOIN marked m ON m.symbol = c.symbol AND date_trunc('day', ts) = bucket GROUP BY ALL),
    changes AS (SELECT *, CASE WHEN ready = lag(ready) OVER (PARTITION BY symbol ORDER BY bucket) THEN 0 ELSE 1 END AS new FROM of),
    runs AS (SELECT symbol, ready, min(bucket) AS start, max(bucket) + INTERVAL 1 DAY AS "end", count(*) AS buckets FROM (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY bucket) AS run FROM changes) GROUP BY symbol, run, ready)
    SELECT *, row_number() OVER (PARTITION BY symbol, ready ORDER BY start) AS rank, ready AND rank > 1 AS deferred FROM runs""",
    "bars", "grid",
)
def d5_bucket_runs(t: Tables):
    """Ready and blocked runs of days; a ready run beyond the first of a series is deferred, and none is left out."""
    return derive.bucket_runs(t.bars(), t.ranges(), ["symbol"], HOURS_TO_DAYS, ft.SESSIONS["fx"], most=1)


@query("SELECT symbol, list_sort(list_distinct(list(snapshot))) AS snapshots, count(DISTINCT snapshot) AS n FROM (SELECT symbol, 's' || (day(bar_ts) % 3) AS snapshot FROM bars) GROUP BY symbol", "bars")
def d7_input_snapshots(t: Tables):
    found = F.array_sort(F.collect_set("snapshot"))
    return t.bars().withColumn("snapshot", F.concat(F.lit("s"), (F.dayofmonth("bar_ts") % 3).cast("string"))).groupBy("symbol").agg(found.alias("snapshots"), F.size(found).cast("long").alias("n"))


@query(
    """SELECT w.window_id, count(b.bar_ts) AS n, min(b.bar_ts) AS first_ts, max(b.bar_ts) AS last_ts, count(DISTINCT b.price_type) AS price_types, count(b.bar_ts) - count(DISTINCT (b.symbol, b.bar_ts)) FILTER (b.bar_ts IS NOT NULL) AS duplicates FROM (SELECT unnest(range(0, 10)) AS window_id) w LEFT JOIN bars_raw b ON b.bar_ts >= TIMESTAMP '2024-01-01' + to_days((w.window_id * 4)::INT) AND b.bar_ts < TIMESTAMP '2024-01-03' + to_days((w.window_id * 4)::INT) GROUP BY w.window_id""",
    "bars_raw",
)
def d23_window_checks(t: Tables):
    """Counts of the raw bars in each of some windows; a bar's day is what the join shuffles on."""
    start = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("window_id") * 4).cast("int")).cast("timestamp")
    spans = t.spark.range(10).select(F.col("id").alias("window_id"), start.alias("start"), (start + F.expr("interval 2 day")).alias("end"))
    days = F.sequence(F.to_date("start"), F.to_date(F.col("end") - F.expr("interval 1 second")), F.expr("interval 1 day"))
    spans = spans.withColumn("_day", F.explode(days))  # two days each
    rows = t.bars_raw().withColumn("_day", F.to_date("bar_ts"))
    hit = spans.join(rows, "_day", "left").withColumn("in_", (F.col("bar_ts") >= F.col("start")) & (F.col("bar_ts") < F.col("end")))
    stamp, pair = F.when(F.col("in_"), F.col("bar_ts")), F.when(F.col("in_"), F.struct("symbol", "bar_ts"))
    return hit.groupBy("window_id").agg(F.count(stamp).alias("n"), F.min(stamp).alias("first_ts"), F.max(stamp).alias("last_ts"), F.count_distinct(F.when(F.col("in_"), F.col("price_type"))).alias("price_types"), (F.count(pair) - F.count_distinct(pair)).alias("duplicates"))


@query("SELECT run_kind, count(*) AS runs, sum(rows_written::DECIMAL(18, 2))::DOUBLE AS rows_written, count(*) FILTER (status = 'completed') AS completed FROM runs WHERE run_scope = 'backfill' GROUP BY run_kind", "runs")
def d25_backfill_totals(t: Tables):
    return t.runs().where("run_scope = 'backfill'").groupBy("run_kind").agg(F.count("*").alias("runs"), F.sum(F.col("rows_written").cast("decimal(18,2)")).cast("double").alias("rows_written"), F.count_if(F.col("status") == "completed").alias("completed"))


@query("SELECT symbol, count(*) AS row_count, 'unknown' AS readiness, NULL::BIGINT AS missing FROM bars GROUP BY symbol", "bars")
def d27_unranged_coverage(t: Tables):
    """Without a requested range there is a summary, and readiness is not known."""
    return coverage.summary(t.bars(), ["symbol"], "bar_ts").select("symbol", "row_count", F.lit("unknown").alias("readiness"), F.lit(None).cast("long").alias("missing"))


@query("SELECT symbol, count(*) AS n FROM bars WHERE ingest_ts >= TIMESTAMP '2024-02-02' GROUP BY symbol HAVING count(*) >= 1", "bars")
def b18_fresh_rows(t: Tables):
    return t.bars().where(F.col("ingest_ts") >= F.lit("2024-02-02").cast("timestamp")).groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 1")


@query("SELECT asset_class, count(DISTINCT symbol) AS symbols, count(DISTINCT price_type) AS bases, count(DISTINCT symbol) = 1 AND count(DISTINCT price_type) = 1 AS single FROM bars GROUP BY asset_class", "bars")
def b15_b16_single_instrument(t: Tables):
    n, b = F.count_distinct("symbol"), F.count_distinct("price_type")
    return t.bars().groupBy("asset_class").agg(n.alias("symbols"), b.alias("bases"), ((n == 1) & (b == 1)).alias("single"))


@query("SELECT symbol, bar_ts, close, (row_number() OVER (ORDER BY bar_ts) - 1) // 200 AS page FROM bars WHERE symbol = 'click' AND bar_ts < TIMESTAMP '2024-01-15'", "bars")
def f3_pinned_pages(t: Tables):
    """Pages over the parts of one manifest: parts that a later run adds never enter the sequence."""
    root = storage.shared_dir(t.spark)
    rows = t.bars()
    schema = rows.withColumn("year", F.year("bar_ts")).withColumn("run_id", F.lit("")).schema
    storage.write_bars(rows, root, "r1")
    pinned = storage.build_manifest(t.spark, root, "r1")
    first = storage.published(t.spark, root, schema, pinned)
    storage.write_bars(rows.withColumn("close", F.lit(0.0)), root, "r2")
    some = first.where("symbol = 'click'").where(F.col("bar_ts") < F.lit("2024-01-15").cast("timestamp"))
    return versions.pages(some, ["bar_ts"], 200).select("symbol", "bar_ts", "close", "page")


@query("SELECT s_suppkey, s_nationkey, capacity FROM (SELECT *, lag(capacity) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS previous FROM (SELECT *, CASE WHEN s_acctbal / 10000 < 0.05 THEN 'critical' WHEN s_acctbal / 10000 < 0.15 THEN 'warning' ELSE 'ok' END AS capacity FROM supplier)) WHERE previous IS NULL OR previous <> capacity ORDER BY s_suppkey DESC LIMIT 40")
def f8_capacity_history(t: Tables):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    rows = t.table("supplier").select("s_suppkey", "s_nationkey", ftext.capacity_class(F.col("s_acctbal") / 10000).alias("capacity")).withColumn("previous", F.lag("capacity").over(w))
    return rows.where(F.col("previous").isNull() | (F.col("previous") != F.col("capacity"))).drop("previous").orderBy(F.desc("s_suppkey")).limit(40)


@query(
    """SELECT event_id, date_trunc('minute', ts) AS minute, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS quarter, date_trunc('month', ts) + INTERVAL 1 MONTH AS next_month, date_trunc('week', ts) + INTERVAL 7 DAY AS next_week, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM events"""
)
def h1_h3_h7_buckets(t: Tables):
    ts = F.col("ts")
    return t.table("events").select("event_id", ft.floor_time(ts, 60).alias("minute"), ft.floor_time(ts, 900).alias("quarter"), ft.next_bucket(ft.bucket(ts, "1mo"), "1mo").alias("next_month"), ft.next_bucket(ft.bucket(ts, "1w"), "1w").alias("next_week"), F.from_utc_timestamp(ts, "America/New_York").alias("local"))


@query(
    """SELECT window_id, CASE WHEN low < high THEN low END AS low, CASE WHEN low < high THEN high END AS high FROM (SELECT window_id, CASE WHEN date_trunc('week', s) < s THEN date_trunc('week', s) + INTERVAL 7 DAY ELSE s END AS low, date_trunc('week', e) AS high FROM candidate)""", "candidate"
)
def h4_bucket_windows(t: Tables):
    low, high = ft.bucket_window(F.col("start"), F.col("end"), "1w")
    return t.windows("candidate").select("window_id", low.alias("low"), high.alias("high"))


@query("SELECT symbol, bar_ts, sha256(concat_ws('|', symbol, strftime(bar_ts, '%Y-%m-%d %H:%M:%S'), asset_class, provider)) AS row_hash FROM bars", "bars")
def h9_row_identity(t: Tables):
    from tidemark.operators.quality import row_digest

    return t.bars().select("symbol", "bar_ts", row_digest(["symbol", "bar_ts", "asset_class", "provider"]).alias("row_hash"))


@query(
    """, told AS (SELECT r.*, f.n AS findings, run_id % 3 AS c, CASE WHEN run_id % 4 <> 0 THEN 1 + run_id % 3 END AS planned FROM runs r LEFT JOIN (SELECT run_id, count(*) AS n FROM findings GROUP BY ALL) f USING (run_id)),
    why AS (SELECT *, list_distinct(list_filter([CASE WHEN c = 1 THEN 'coverage_degraded' WHEN c = 2 AND retry_count > 3 THEN 'coverage_not_ready' END, CASE WHEN error_type = 'SchemaError' THEN 'session_closed' WHEN error_type = 'TimeoutError' THEN 'provider_gap' END, CASE WHEN status = 'running' AND retry_count > 0 THEN 'retrying' END, CASE WHEN status = 'completed' AND findings > 0 THEN 'findings_recorded' END], lambda x: x IS NOT NULL)) AS raw FROM told)
    SELECT run_id, CASE WHEN status = 'running' THEN 'running' WHEN status = 'completed' THEN CASE run_kind WHEN 'ingest' THEN 'published' ELSE 'verified' END ELSE CASE WHEN run_id % 2 = 0 THEN 'fetch' ELSE 'execute' END END AS stage,
      CASE WHEN status = 'completed' THEN CASE WHEN len(raw) > 0 THEN 'degraded' ELSE 'pass' END ELSE status END AS outcome, list_sort(raw) AS reasons, coalesce(planned, 1) AS window_count, provider || '/' || dataset_id AS selector FROM why""",
    "runs", "findings",
)
def h15_h16_stage_and_reasons(t: Tables):
    """Stage, outcome, degraded reasons, number of windows and selector of each run, with its findings counted beside it."""
    key = F.col("run_id")
    readiness = F.when(key % 3 == 1, "degraded").when((key % 3 == 2) & (F.col("retry_count") > 3), "not_ready")
    rows = t.runs().join(t.findings().groupBy("run_id").agg(F.count("*").alias("findings")), "run_id", "left").withColumns({
        "readiness": readiness, "manifest": F.col("run_kind") == "ingest", "failure_stage": F.when(key % 2 == 0, "fetch"), "planned_windows": F.when(key % 4 != 0, 1 + key % 3),
        "session_closed": F.col("error_type") == "SchemaError", "provider_gap": F.col("error_type") == "TimeoutError",
    })
    out = runs.views(rows, ["provider", "dataset_id"])
    return out.select("run_id", "stage", "outcome", F.array_sort("reasons").alias("reasons"), "window_count", "selector")


@query("SELECT s_suppkey, regexp_extract('/data/provider=p' || (s_suppkey % 3) || '/symbol=S' || s_suppkey || '/year=2024/part.parquet', '(?:^|/)symbol=([^/]*)', 1) AS symbol FROM supplier")
def h11_path_values(t: Tables):
    path = F.concat(F.lit("/data/provider=p"), (F.col("s_suppkey") % 3).cast("string"), F.lit("/symbol=S"), F.col("s_suppkey").cast("string"), F.lit("/year=2024/part.parquet"))
    return t.table("supplier").select("s_suppkey", ftext.path_value(path, "symbol").alias("symbol"))


@query("SELECT task_id, window_id, p AS start, least(e, p + INTERVAL 365 DAY) AS \"end\" FROM (SELECT task_id, window_id, unnest(generate_series(s, e - INTERVAL 1 MICROSECOND, INTERVAL 365 DAY)) AS p, e FROM (SELECT task_id, window_id, s, s + to_days((window_id % 3000 + 1)::INT) AS e FROM planned))", "planned")
def j8_date_chunks(t: Tables):
    rows = t.windows("planned").withColumn("end", F.col("start") + F.make_dt_interval((F.col("window_id") % 3000 + 1).cast("int")))
    return windows.sharded(rows.select("task_id", "window_id", "start", "end"), ["task_id", "window_id"], "365 days").drop("ordinal")


@query(
    """SELECT task_id, window_id, s AS start, e AS "end", CASE WHEN low >= high THEN 'not_ready' WHEN isodow(low) > 5 THEN 'skipped' WHEN EXISTS (SELECT 1 FROM busy b WHERE b.task_id = c.task_id AND b.s <= low AND high <= b.e) THEN 'already_materialized' ELSE 'planned' END AS state
    FROM (SELECT *, s AS low, e AS high FROM (SELECT task_id, window_id, s, s + to_days((window_id % 4)::INT) AS e FROM candidate)) c""",
    "busy", "candidate",
)
def j9_derivation_plan(t: Tables):
    requests = t.windows("candidate").withColumn("end", F.col("start") + F.make_dt_interval((F.col("window_id") % 4).cast("int")))
    busy = windows.merged(t.windows("planned"), ["task_id"])
    out = derive.plan(requests, busy, ["task_id"], "1d", F.weekday("start") < 5)
    return out.join(requests.select("task_id", "start", "end", "window_id"), ["task_id", "start", "end"]).select("task_id", "window_id", "start", "end", "state").distinct()


@query(f"SELECT symbol, date_trunc('day', ts) AS day, bool_or({SESSION_SQL['fx']}) AS opens FROM {LOCAL} GROUP BY ALL", "grid")
def j10_session_days(t: Tables):
    ranges = t.ranges()
    days = coverage.open_days(ranges, ["symbol"], coverage.calendar(ranges, 3600, ft.SESSIONS["fx"]), 3600)
    return days.select("symbol", F.col("day").cast("timestamp").alias("day"), "opens")


GAPS = ", gaps AS (" + ISLANDS.format(rows="(SELECT symbol, ts FROM marked WHERE open AND NOT seen)") + ")"


@query(
    MARKED + GAPS + """ SELECT symbol, p AS start, least("end", p + INTERVAL 6 HOUR) AS "end", row_number() OVER (PARTITION BY symbol ORDER BY p) - 1 AS ordinal, 'gap_repair' AS reason FROM (SELECT symbol, "end", unnest(generate_series(start, "end" - INTERVAL 1 MICROSECOND, INTERVAL 6 HOUR)) AS p FROM gaps)""",
    "bars", "grid",
)
def j1_repair_windows(t: Tables):
    """The gaps of each series in its open hours, in windows of six hours at most."""
    return planner.repair_windows(evaluated(t), "6 hours")


TAIL = (
    """, beyond AS (SELECT symbol, unnest(generate_series(range_end, range_end + INTERVAL 5 DAY - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM ranges WHERE symbol IN (SELECT symbol FROM marked WHERE open AND NOT seen)),
    tails AS ("""
    + ISLANDS.format(rows="(SELECT symbol, ts FROM " + LOCAL.replace("FROM grid", "FROM beyond") + " WHERE " + SESSION_SQL["fx"] + ")")
    + """), shards AS (SELECT symbol, p AS start, least("end", p + INTERVAL 1 DAY) AS "end" FROM (SELECT symbol, "end", unnest(generate_series(start, "end" - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY)) AS p FROM tails))"""
)


def _longer(t: Tables):
    return t.ranges().withColumn("end", F.col("end") + F.expr("interval 5 day"))


def _tails(t: Tables, found: coverage.Coverage):
    return planner.tail_windows(found, _longer(t), ft.SESSIONS["fx"], "1 day")


@query(MARKED + TAIL + """ SELECT symbol, start, "end", row_number() OVER (PARTITION BY symbol ORDER BY start) - 1 AS ordinal, 'tail' AS reason FROM shards""", "bars", "grid")
def j3_tail_after_gap(t: Tables):
    """Five days behind the last bar of series with a gap, in open hours only."""
    return _tails(t, evaluated(t))


@query(
    MARKED + GAPS + TAIL + """, fresh AS (SELECT symbol, start, "end" FROM gaps WHERE dayofmonth(start) % 4 <> 0), every AS (SELECT symbol, start, "end", 0 AS priority, 'tail' AS reason FROM shards UNION ALL SELECT *, 1, 'gap_repair' FROM fresh
      UNION ALL SELECT symbol, range_start - INTERVAL 3 DAY, range_start - INTERVAL 1 DAY, 2, 'carried' FROM ranges)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY priority, start, "end") AS rank, count(*) OVER (PARTITION BY symbol) > 20 AS truncated FROM every) WHERE rank <= 20""",
    "bars", "grid",
)
def j13_repair_plan(t: Tables):
    """Tails, then gaps that are not in their cooldown, then debt from before the range, up to twenty windows a series."""
    found = evaluated(t)
    gaps = storage.written(found.gaps, storage.shared_dir(t.spark), "gaps")
    day = lambda n: F.expr(f"interval {n} day")
    old = t.ranges().select("symbol", (F.col("start") - day(3)).alias("start"), (F.col("start") - day(1)).alias("end"))
    carried = old.unionByName(old.withColumn("start", F.col("start") + day(1)))  # two debts that overlap
    return planner.repair_plan(_tails(t, found), gaps, carried, gaps.where(F.dayofmonth("start") % 4 == 0), ["symbol"], 20)


@query(
    MARKED + """, lacking AS (SELECT DISTINCT symbol FROM marked WHERE open AND NOT seen), expected AS (SELECT symbol, unnest(generate_series(date_trunc('day', range_start), date_trunc('day', range_end - INTERVAL 1 HOUR), INTERVAL 1 DAY)) AS day FROM ranges),
    held AS (SELECT DISTINCT symbol, date_trunc('day', bar_ts) AS day FROM bars WHERE symbol <> 'click' OR dayofmonth(bar_ts) % 9 <> 0), derived AS (SELECT e.symbol, count(*) AS n, count(h.day) AS k FROM expected e LEFT JOIN held h ON h.symbol = e.symbol AND h.day = e.day GROUP BY e.symbol)
    SELECT symbol, 'error' AS severity, CASE WHEN k = 0 THEN 'coverage_not_ready' ELSE 'coverage_degraded' END AS code FROM derived WHERE k < n UNION ALL SELECT symbol, 'warning', 'source_degraded' FROM derived JOIN lacking USING (symbol) WHERE k = n""",
    "bars", "grid",
)
def i7_derived_coverage(t: Tables):
    """Derived days against the calendar, and complete ones whose source has gaps."""
    hours = evaluated(t).summary
    days = derive.derive(t.bars(), derive.Recipe("r", "1h", "1d", policy="allow"), "s1").where((F.col("symbol") != "click") | (F.dayofmonth("bar_ts") % 9 != 0))
    whole = t.ranges().select("symbol", F.date_trunc("day", "start").alias("start"), "end")
    derived = coverage.evaluate(days, whole, ["symbol"], "bar_ts", 86400, ft.SESSIONS["always"]).summary
    return quality.parity_coverage(hours, derived, ["symbol"])


@query(MARKED + """SELECT symbol, first_missing AS start, coalesce(min(ts) FILTER (seen AND ts > first_missing), max(ts) + INTERVAL 1 HOUR) AS "end" FROM (SELECT *, min(ts) FILTER (NOT seen) OVER (PARTITION BY symbol) AS first_missing FROM marked WHERE open) WHERE first_missing IS NOT NULL GROUP BY symbol, first_missing""", "bars", "grid")
def j12_first_repair(t: Tables):
    """From the first missing stamp to the next seen one."""
    seen = t.bars().select("symbol", F.col("bar_ts").alias("ts"), F.lit(True).alias("seen"))
    marked = coverage.grid(t.ranges(), ["symbol"], 3600, ft.SESSIONS["fx"]).where("open").join(seen, ["symbol", "ts"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    first = marked.where("not seen").groupBy("symbol").agg(F.min("ts").alias("start"))
    rest = marked.join(first, "symbol").where("ts >= start")
    return rest.groupBy("symbol", "start").agg(F.coalesce(F.min(F.when(F.col("seen"), F.col("ts"))), F.max("ts") + F.expr("interval 1 hour")).alias("end"))


@query("SELECT symbol, bar_ts, code FROM (SELECT symbol, bar_ts, unnest(list_filter([CASE WHEN close > 100 THEN 'close_high' END, CASE WHEN volume < 50 THEN 'volume_low' END], lambda c: c IS NOT NULL)) AS code FROM bars)", "bars")
def i10_attached_findings(t: Tables):
    """Findings with the rows that they are about."""
    from tidemark.operators.quality import flagged

    return flagged(t.bars(), {"close_high": F.col("close") > 100, "volume_low": F.col("volume") < 50}).select("symbol", "bar_ts", "code")


@query("SELECT symbol, date_trunc('day', bar_ts) AS day, coalesce(bool_and(gap = 3600), true) AS contiguous FROM (SELECT *, epoch(bar_ts - lag(bar_ts) OVER (PARTITION BY symbol, date_trunc('day', bar_ts) ORDER BY bar_ts)) AS gap FROM bars) GROUP BY ALL", "bars")
def e6_neighbour_steps(t: Tables):
    return bar_ops.completeness(t.bars(), "1h", "1d", require_contiguous=True).select("symbol", F.col("bucket").alias("day"), "contiguous")
