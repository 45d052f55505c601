"""Registered queries over bars: derivation, versions, pages, coverage and calendars."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import time as ft
from tidemark.operators import bars, coverage, day_coverage, quality, versions
from tidemark.plans.fixtures import Tables, query
from tidemark.sources.storage import shared_dir

COLUMNS = "symbol, asset_class, bar_ts, open, high, low, close, volume, ingest_ts, source_hash"
NAMES = [c.strip() for c in COLUMNS.split(",")]
PIT = """SELECT {cols} FROM observations o {join} WHERE asof_ts <= {a} AND ((availability_policy = 'vintage' AND vintage_start + coalesce(availability_lag_days, 0) <= {a}::DATE)
  OR (availability_policy = 'release' AND release_ts + to_days(coalesce(availability_lag_days, 0)) <= {a}))
  QUALIFY row_number() OVER (PARTITION BY {by}series_id, observation_date ORDER BY CASE WHEN availability_policy = 'vintage' THEN vintage_start::TIMESTAMP ELSE release_ts END DESC NULLS LAST, asof_ts DESC NULLS LAST, tie DESC) = 1"""


SESSION_SQL = {
    "weekdays": "isodow(ts) <= 5 AND ts::DATE <> DATE '2024-01-15'",
    "fx": "(CASE WHEN w >= 9660 THEN true WHEN w < 6780 THEN true ELSE false END) AND NOT (m >= 1020 AND m < 1080)",
}
LOCAL = "(SELECT *, (isodow(local) - 1) * 1440 + hour(local) * 60 + minute(local) AS w, hour(local) * 60 + minute(local) AS m FROM (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local FROM grid))"


@query(f"SELECT {COLUMNS} FROM bars", "bars")
def e1_current_bars(t: Tables):
    return t.bars().select(*NAMES)


@query("SELECT symbol, bar_ts, open, high, low, close, volume FROM hourly", "hourly")
def d2_tick_bars(t: Tables):
    return bars.tick_bars(t.ticks(), "1h")


@query("SELECT symbol, date_trunc('minute', ts) AS bar_ts, first(bid ORDER BY ts, event_id) AS open, max(bid) AS high, min(bid) AS low, last(bid ORDER BY ts, event_id) AS close, sum(volume)::DOUBLE AS volume FROM ticks GROUP BY ALL", "ticks")
def d2_minute_bars(t: Tables):
    return bars.tick_bars(t.ticks(), "1m")


def _rollup_sql(bucket: str) -> str:
    return f"SELECT provider, asset_class, symbol, {bucket} AS bucket, first(open ORDER BY bar_ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bar_ts) AS close, CASE WHEN bool_or(volume IS NULL) THEN NULL ELSE sum(volume) END AS volume, max(ingest_ts) AS ingest_ts, count(*) AS n_source FROM bars GROUP BY ALL"


@query(_rollup_sql("date_trunc('day', bar_ts)"), "bars")
def d1_daily_rollup(t: Tables):
    return bars.rollup(t.bars(), "1d")


@query(_rollup_sql("time_bucket(INTERVAL 4 HOUR, bar_ts, TIMESTAMP '1970-01-01')"), "bars")
def d1_four_hour_rollup(t: Tables):
    return bars.rollup(t.bars(), "4h")


@query(_rollup_sql("date_trunc('week', bar_ts)"), "bars")
def h2_weekly_rollup(t: Tables):
    return bars.rollup(t.bars(), "1w")


@query(
    """, daily AS (SELECT symbol, date_trunc('day', bar_ts) AS bar_ts, first(open ORDER BY bar_ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bar_ts) AS close, sum(volume) AS volume FROM bars GROUP BY ALL)
    SELECT symbol, date_trunc('month', bar_ts) AS bucket, first(open ORDER BY bar_ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bar_ts) AS close, sum(volume) AS volume FROM daily GROUP BY ALL""",
    "bars",
)
def j14_two_hop_derivation(t: Tables):
    """Hours to days and days to months."""
    daily = bars.rollup(t.bars(), "1d").withColumnRenamed("bucket", "bar_ts")
    return bars.rollup(daily, "1mo").select("symbol", "bucket", "open", "high", "low", "close", "volume")


@query("SELECT asset_class, CASE WHEN bool_or(v IS NULL) THEN NULL ELSE sum(v) END AS volume, bar_ts FROM (SELECT asset_class, bar_ts, CASE WHEN hour(bar_ts) % 5 <> 0 THEN volume END AS v FROM bars) GROUP BY ALL", "bars")
def d3_null_propagating_sum(t: Tables):
    rows = t.bars().withColumn("volume", F.when(F.hour("bar_ts") % 5 != 0, F.col("volume")))
    return rows.groupBy("asset_class", "bar_ts").agg(bars.sum_or_null("volume").alias("volume"))


# Bars of open hours only; the days that have any, each with its open hours and those that are there.
FX_DAYS = (
    ", hours AS (SELECT symbol, bar_ts AS ts FROM bars), open_bars AS (SELECT symbol, ts FROM " + LOCAL.replace("FROM grid", "FROM hours") + f" WHERE {SESSION_SQL['fx']}),"
    " cells AS (SELECT symbol, unnest(generate_series(day, day + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT symbol, date_trunc('day', ts) AS day FROM open_bars)),"
    " cell AS (SELECT symbol, ts FROM " + LOCAL.replace("FROM grid", "FROM cells") + f" WHERE {SESSION_SQL['fx']}),"
    " buckets AS (SELECT c.symbol, date_trunc('day', c.ts) AS bucket, count(o.ts) AS observed, count(*) AS expected FROM cell c LEFT JOIN open_bars o ON o.symbol = c.symbol AND o.ts = c.ts GROUP BY ALL)"
)
ALL_DAYS = """, gaps AS (SELECT symbol, bar_ts, epoch(bar_ts - lag(bar_ts) OVER (PARTITION BY symbol, date_trunc('day', bar_ts) ORDER BY bar_ts)) AS gap FROM bars)"""


@query(
    ALL_DAYS + """ SELECT symbol, date_trunc('day', bar_ts) AS bucket, count(DISTINCT bar_ts) AS observed, 24::BIGINT AS expected, coalesce(bool_and(gap = 3600), true) AS contiguous,
    count(DISTINCT bar_ts) = 24 AND coalesce(bool_and(gap = 3600), true) AS complete FROM gaps GROUP BY ALL""",
    "bars",
)
def d4_contiguous_buckets(t: Tables):
    """Days of all hours, with neighbours an hour apart."""
    return bars.completeness(t.bars(), "1h", "1d", require_contiguous=True).select("symbol", "bucket", "observed", "expected", "contiguous", "complete")


@query(
    ", hours AS (SELECT DISTINCT symbol, bar_ts AS ts FROM bars), known AS (SELECT symbol, ts, " + SESSION_SQL["fx"] + " AS open FROM " + LOCAL.replace("FROM grid", "FROM hours") + "),"
    " days AS (SELECT symbol, date_trunc('day', ts) AS bucket, count(*) FILTER (open) AS observed, count(*) FILTER (NOT open) AS closed FROM known GROUP BY ALL),"
    " cells AS (SELECT symbol, unnest(generate_series(bucket, bucket + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS ts FROM days),"
    " cell AS (SELECT symbol, date_trunc('day', ts) AS bucket, count(*) FILTER (" + SESSION_SQL["fx"] + ") AS expected FROM " + LOCAL.replace("FROM grid", "FROM cells") + " GROUP BY ALL)"
    " SELECT symbol, bucket, observed, closed, expected, observed = expected AND observed > 0 AS complete FROM days JOIN cell USING (symbol, bucket)",
    "bars",
)
def d4_bucket_completeness(t: Tables):
    """Every day that has bars against the hours that the session is open, with its daily break and its weekend; bars of closed hours are counted apart."""
    return bars.completeness(t.bars(), "1h", "1d", session=ft.SESSIONS["fx"]).select("symbol", "bucket", "observed", "closed", "expected", "complete")


@query(
    """SELECT symbol, date_trunc('day', bar_ts) AS bucket, sha256('["' || array_to_string(list(source_hash ORDER BY bar_ts), '","') || '"]') AS lineage_hash, count(DISTINCT source_hash) AS hash_count,
    sha256('["' || array_to_string(list_sort(list_distinct(list(source_hash))), '","') || '"]') AS hash_digest, min(source_hash) AS first_hash, max(source_hash) AS last_hash FROM bars GROUP BY ALL""",
    "bars",
)
def d11_d13_lineage(t: Tables):
    return bars.lineage(t.bars(), "1d", ("symbol",))


@query("SELECT symbol, bar_ts, close FROM bars WHERE bar_ts >= TIMESTAMP '2024-01-05' AND bar_ts < TIMESTAMP '2024-01-12' AND asset_class = 'fx'", "bars")
def b1_range_and_selector(t: Tables):
    rows = versions.selector(t.bars(), {"asset_class": "fx", "recipe_id": "absent"})
    return rows.where(versions.in_range("bar_ts", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))).select("symbol", "bar_ts", "close")


@query("SELECT symbol, bar_ts, close FROM bars WHERE bar_ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'", "bars")
def b2_inclusive_range(t: Tables):
    return t.bars().where(F.col("bar_ts").between(F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))).select("symbol", "bar_ts", "close")


@query("SELECT symbol, bar_ts, close FROM bars WHERE bar_ts < time_bucket(INTERVAL 4 HOUR, TIMESTAMP '2024-01-20 10:30:00' - INTERVAL 180 MINUTE, TIMESTAMP '1970-01-01')", "bars")
def b7_closed_bars(t: Tables):
    return t.bars().where(F.col("bar_ts") < ft.closed_cutoff(F.lit("2024-01-20 10:30:00").cast("timestamp"), "4h", 180)).select("symbol", "bar_ts", "close")


@query(f"SELECT symbol, ts, {SESSION_SQL['weekdays']} AS weekdays, {SESSION_SQL['fx']} AS fx FROM {LOCAL}", "grid")
def b6_session_open(t: Tables):
    grid = coverage.grid(t.ranges(), ["symbol"], 3600)
    return grid.select("symbol", "ts", ft.SESSIONS["weekdays"].is_open(F.col("ts")).alias("weekdays"), ft.SESSIONS["fx"].is_open(F.col("ts")).alias("fx"))


MARKED = f", marked AS (SELECT g.*, b.bar_ts IS NOT NULL AS seen FROM (SELECT symbol, ts, {SESSION_SQL['fx']} AS open FROM {LOCAL}) g LEFT JOIN bars b ON b.symbol = g.symbol AND b.bar_ts = g.ts)"


def evaluated(t: Tables) -> coverage.Coverage:
    return coverage.evaluate(t.bars(), t.ranges(), ["symbol"], "bar_ts", 3600, ft.SESSIONS["fx"])


@query(
    MARKED + """SELECT s.*, expected, closed, missing, first_missing, CASE WHEN duplicates > 0 OR row_count = 0 THEN 'not_ready' WHEN missing = 0 THEN 'ready' WHEN missing < expected THEN 'degraded' ELSE 'not_ready' END AS readiness
    FROM (SELECT symbol, count(*) AS row_count, count(*) - count(DISTINCT bar_ts) AS duplicates, min(bar_ts) AS min_ts, max(bar_ts) AS max_ts FROM bars GROUP BY symbol) s
    JOIN (SELECT symbol, count(*) FILTER (open) AS expected, count(*) FILTER (NOT open) AS closed, count(*) FILTER (open AND NOT seen) AS missing, min(ts) FILTER (open AND NOT seen) AS first_missing FROM marked GROUP BY symbol) c USING (symbol)""",
    "bars", "grid",
)
def d8_coverage(t: Tables):
    return evaluated(t).summary


@query(
    MARKED + """SELECT s.*, expected, closed, missing, first_missing, CASE WHEN duplicates > 0 OR row_count = 0 THEN 'not_ready' WHEN missing = 0 THEN 'ready' WHEN missing < expected THEN 'degraded' ELSE 'not_ready' END AS readiness
    FROM (SELECT symbol, count(*) AS row_count, count(*) - count(DISTINCT bar_ts) AS duplicates, min(bar_ts) AS min_ts, max(bar_ts) AS max_ts FROM bars GROUP BY symbol) s
    JOIN (SELECT symbol, count(*) FILTER (open) AS expected, count(*) FILTER (NOT open) AS closed, count(*) FILTER (open AND NOT seen) AS missing, min(ts) FILTER (open AND NOT seen) AS first_missing FROM marked GROUP BY symbol) c USING (symbol)""",
    "bars", "grid",
)
def d8_day_states(t: Tables):
    """The same from states of days, of which the last ones are made after the others."""
    bars, root = t.bars(), shared_dir(t.spark)
    for some in (F.col("bar_ts") < F.lit("2024-01-20").cast("timestamp"), F.col("bar_ts") >= F.lit("2024-01-20").cast("timestamp")):
        states = day_coverage.day_states(bars.where(some), ["symbol"], "bar_ts", 3600, ft.SESSIONS["fx"])
        day_coverage.put_days(states, root)
    kept = day_coverage.kept_days(t.spark, root, states.schema)
    return day_coverage.merged(kept, t.ranges(), ["symbol"], 3600, ft.SESSIONS["fx"]).summary


@query(MARKED + "SELECT symbol, ts FROM marked WHERE open AND NOT seen", "bars", "grid")
def c8_missing_stamps(t: Tables):
    return evaluated(t).missing


ISLANDS = """SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM (SELECT *, CASE WHEN epoch(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) <= 3600 THEN 0 ELSE 1 END AS new FROM {rows})) GROUP BY symbol, run"""


@query(ISLANDS.format(rows="(SELECT symbol, bar_ts AS ts FROM bars)"), "bars")
def e7_islands(t: Tables):
    return coverage.islands(t.bars(), ["symbol"], "bar_ts", 3600)


@query(MARKED + ISLANDS.format(rows="(SELECT symbol, ts FROM marked WHERE open AND seen)"), "bars", "grid")
def e7_ready_intervals(t: Tables):
    """Seen stamps as far as the next is one step on: an interval ends at a gap and where the session closes."""
    return evaluated(t).ready


@query(MARKED + ISLANDS.format(rows="(SELECT symbol, ts FROM marked WHERE open AND NOT seen)"), "bars", "grid")
def e7_missing_ranges(t: Tables):
    return evaluated(t).gaps


@query(MARKED + ISLANDS.format(rows="(SELECT symbol, ts FROM marked WHERE open)"), "bars", "grid")
def e7_session_islands(t: Tables):
    ranges = t.ranges()
    return coverage.open_ranges(ranges, ["symbol"], coverage.calendar(ranges, 3600, ft.SESSIONS["fx"]), 3600)


@query("SELECT symbol, previous, ts, epoch(ts - previous)::BIGINT AS seconds FROM (SELECT symbol, bar_ts AS ts, lag(bar_ts) OVER (PARTITION BY symbol ORDER BY bar_ts) AS previous FROM bars) WHERE epoch(ts - previous) > 3600", "bars")
def e5_lag_gaps(t: Tables):
    return coverage.lag_gaps(t.bars_raw().withColumnRenamed("bar_ts", "ts"), ["symbol"], "ts", 3600)


@query(MARKED + "SELECT symbol, max(ts) FILTER (seen AND ts < coalesce(hole, TIMESTAMP '9999-01-01')) AS latest_complete FROM (SELECT *, min(ts) FILTER (NOT seen) OVER (PARTITION BY symbol) AS hole FROM marked WHERE open) GROUP BY symbol", "bars", "grid")
def e8_prefix_boundary(t: Tables):
    return evaluated(t).boundary


@query("SELECT provider, symbol, count(*) AS row_count, 0::BIGINT AS duplicates, min(bar_ts) AS min_ts, max(bar_ts) AS max_ts FROM bars GROUP BY ALL", "bars")
def d6_coverage_summary(t: Tables):
    return coverage.summary(t.bars(), ["provider", "symbol"], "bar_ts")


@query("SELECT symbol, bar_ts, close, true AS has_more FROM (SELECT * FROM bars WHERE (bar_ts, asset_class, symbol) > (TIMESTAMP '2024-01-10', 'fx', 'error') ORDER BY bar_ts, asset_class, symbol LIMIT 500)", "bars")
def f1_keyset_page(t: Tables):
    page = versions.page(t.bars(), ["bar_ts", "asset_class", "symbol"], 500, [datetime(2024, 1, 10), "fx", "error"])
    return page.select("symbol", "bar_ts", "close", "has_more")


@query(f"SELECT {COLUMNS} FROM bars ORDER BY bar_ts, asset_class, symbol LIMIT 1000", "bars")
def f2_two_phase_page(t: Tables):
    return versions.two_phase_page(t.bars(), ["bar_ts", "asset_class", "symbol"], 1000).select(*NAMES)


OBS = "series_id, observation_date, value, vintage_start, availability_policy, asof_ts, tie"
OBS_NAMES = [c.strip() for c in OBS.split(",")]


@query(f"SELECT {OBS} FROM observations QUALIFY row_number() OVER (PARTITION BY series_id, observation_date ORDER BY vintage_start IS NOT NULL DESC, vintage_start DESC NULLS LAST, asof_ts DESC NULLS LAST, tie DESC) = 1", "observations")
def e2_current_observations(t: Tables):
    return versions.current_observations(t.observations(), "tie").select(*OBS_NAMES)


@query(PIT.format(cols=OBS, join="", a="TIMESTAMP '1998-06-15 12:00:00'", by=""), "observations")
def e3_point_in_time(t: Tables):
    return versions.observed_at(t.observations(), "1998-06-15 12:00:00", "tie").select(*OBS_NAMES)


INSTANTS = """, instants AS (SELECT unnest([TIMESTAMP '1996-01-31 18:00:00', TIMESTAMP '1998-06-15 12:00:00', TIMESTAMP '2001-02-28 00:00:00']) AS "asof")"""


@query(INSTANTS + ' SELECT "asof", series_id, count(*) AS n, max(observation_date) AS last_date, sum(tie) AS ties FROM (' + PIT.format(cols='"asof", o.*', join=", instants", a='"asof"', by='"asof", ') + ") GROUP BY ALL", "observations")
def c9_asof_join(t: Tables):
    """All that each of three instants sees, joined and then counted."""
    instants = t.spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in ("1996-01-31 18:00:00", "1998-06-15 12:00:00", "2001-02-28 00:00:00")])).alias("asof"))
    seen = versions.observed_asof(t.observations(), instants, "tie")
    return seen.groupBy("asof", "series_id").agg(F.count("*").alias("n"), F.max("observation_date").alias("last_date"), F.sum("tie").alias("ties"))


@query(
    """, every AS (SELECT *, CASE WHEN availability_policy = 'vintage' THEN vintage_start::TIMESTAMP ELSE release_ts END AS o1,
      greatest(CASE availability_policy WHEN 'vintage' THEN (vintage_start + coalesce(availability_lag_days, 0))::TIMESTAMP WHEN 'release' THEN release_ts + to_days(coalesce(availability_lag_days, 0)) END, asof_ts) AS seen
      FROM observations WHERE availability_policy <> 'unknown' AND CASE availability_policy WHEN 'vintage' THEN vintage_start IS NOT NULL ELSE release_ts IS NOT NULL END),
    best AS (SELECT *, max((o1, asof_ts, tie)) OVER (PARTITION BY series_id, observation_date ORDER BY seen, o1, asof_ts, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM every),
    steps AS (SELECT * FROM best WHERE top = (o1, asof_ts, tie) QUALIFY row_number() OVER (PARTITION BY series_id, observation_date, seen ORDER BY o1 DESC, asof_ts DESC, tie DESC) = 1),
    valid AS (SELECT *, lead(seen) OVER (PARTITION BY series_id, observation_date ORDER BY seen) AS until FROM steps),
    moves AS (SELECT series_id, seen AS t, 1 AS n, tie, observation_date, 0 AS kind FROM valid UNION ALL SELECT series_id, until, -1, -tie, observation_date, 0 FROM valid WHERE until IS NOT NULL
      UNION ALL SELECT DISTINCT series_id, observation_date + INTERVAL 12 HOUR, 0, 0, NULL, 1 FROM observations)
    SELECT series_id, t AS "asof", n::BIGINT AS n, ties::BIGINT AS ties, last_date::DATE AS last_date FROM (SELECT series_id, t, kind, sum(n) OVER w AS n, sum(tie) OVER w AS ties, max(observation_date) OVER w AS last_date FROM moves WINDOW w AS (PARTITION BY series_id ORDER BY t, kind)) WHERE kind = 1 AND n > 0""",
    "observations",
)
def c9_asof_totals(t: Tables):
    """What each series shows at noon of every day that it has: thousands of instants, none of which reads a version."""
    obs = t.observations()
    instants = obs.select("series_id", (F.col("observation_date").cast("timestamp") + F.expr("interval 12 hour")).alias("asof"))
    found = versions.asof_totals(obs, instants, "tie", ["series_id"], {"ties": F.col("tie")}, {"last_date": F.col("observation_date")})
    return found.select("series_id", "asof", "n", "ties", "last_date")


@query(f"SELECT {OBS} FROM observations WHERE observation_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'", "observations")
def b3_inclusive_dates(t: Tables):
    return t.observations().where(F.col("observation_date").between("1997-01-01", "1997-12-31")).select(*OBS_NAMES)


@query(f"SELECT {OBS} FROM observations QUALIFY row_number() OVER (PARTITION BY series_id, observation_date ORDER BY vintage_start IS NOT NULL DESC, vintage_start DESC NULLS LAST, release_ts DESC NULLS LAST, asof_ts DESC NULLS LAST, tie DESC) = 1", "observations")
def e4_alternative_ranking(t: Tables):
    order = [F.col("vintage_start").isNotNull().desc(), F.col("vintage_start").desc_nulls_last(), F.col("release_ts").desc_nulls_last(), F.col("asof_ts").desc_nulls_last(), F.desc("tie")]
    return versions.ranked_first(t.observations(), ["series_id", "observation_date"], order).select(*OBS_NAMES)


@query(
    """, planted AS (SELECT * REPLACE (CASE WHEN tie % 29 <> 0 THEN CASE WHEN tie % 31 = 0 THEN 'guess' ELSE availability_policy END END AS availability_policy, CASE WHEN tie % 37 <> 0 THEN asof_ts END AS asof_ts, CASE WHEN tie % 6 = 2 THEN asof_ts ELSE release_ts END AS release_ts),
      CASE tie % 41 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'feed' END AS source FROM observations)
    SELECT code, series_id, tie FROM (SELECT *, unnest(list_filter([
      CASE WHEN row_number() OVER (PARTITION BY series_id, observation_date, vintage_start ORDER BY tie) > 1 THEN 'duplicate_observation_vintage' END, CASE WHEN vintage_end < vintage_start THEN 'invalid_vintage_interval' END,
      CASE WHEN availability_policy IS NULL OR availability_policy NOT IN ('vintage', 'release', 'unknown') THEN 'invalid_availability_policy' END,
      CASE WHEN (availability_policy = 'vintage' AND vintage_start IS NULL) OR (availability_policy = 'release' AND release_ts IS NULL) THEN 'policy_field_missing' END,
      CASE WHEN availability_policy = 'unknown' AND release_ts IS NOT NULL THEN 'policy_field_forbidden' END, CASE WHEN asof_ts IS NULL THEN 'required_field_missing' END,
      CASE WHEN source IS NULL OR trim(source) = '' THEN 'source_required' END, CASE WHEN value IS NULL AND missing_reason IS NULL THEN 'missing_reason_required' END], lambda c: c IS NOT NULL)) AS code FROM planted)""",
    "observations",
)
def i3_i5_observation_findings(t: Tables):
    """Observations with planted unknown policies, forbidden releases, and lacking fields and sources."""
    key = F.col("tie")
    policy = F.when(key % 29 != 0, F.when(key % 31 == 0, "guess").otherwise(F.col("availability_policy")))
    planted = t.observations().withColumns({
        "availability_policy": policy, "asof_ts": F.when(key % 37 != 0, F.col("asof_ts")), "release_ts": F.when(key % 6 == 2, F.col("asof_ts")).otherwise(F.col("release_ts")),
        "source": F.when(key % 41 == 1, " ").when(key % 41 != 0, "feed"),
    })
    return quality.observation_violations(planted, "tie", "source").select("code", "series_id", "tie")


BROKEN = ", broken AS (SELECT * REPLACE (CASE WHEN hour(bar_ts) = 3 THEN high + 1 ELSE low END AS low, CASE WHEN hour(bar_ts) = 5 THEN -volume ELSE volume END AS volume) FROM bars_raw)"


def _broken(t: Tables):
    return t.bars_raw().withColumns({"low": F.when(F.hour("bar_ts") == 3, F.col("high") + 1).otherwise(F.col("low")), "volume": F.when(F.hour("bar_ts") == 5, -F.col("volume")).otherwise(F.col("volume"))})


@query(
    BROKEN + """SELECT symbol, bar_ts, source_hash, code FROM (SELECT *, unnest(list_filter([CASE WHEN count(*) OVER (PARTITION BY symbol, bar_ts) > 1 THEN 'duplicate_key' END, CASE WHEN low > least(open, close) OR high < greatest(open, close) THEN 'ohlc_inconsistent' END, CASE WHEN volume < 0 THEN 'negative_volume' END], lambda c: c IS NOT NULL)) AS code FROM broken)""",
    "bars_raw",
)
def i1_i4_bar_violations(t: Tables):
    return quality.bar_violations(_broken(t), ["symbol", "bar_ts"]).select("symbol", "bar_ts", "source_hash", "code")


@query(BROKEN + """SELECT coalesce(l.symbol, r.symbol) AS symbol, coalesce(l.bar_ts, r.bar_ts) AS bar_ts, CASE WHEN r.symbol IS NULL THEN 'missing' WHEN l.symbol IS NULL THEN 'extra' ELSE 'differs' END AS state
    FROM (SELECT * FROM bars WHERE hour(bar_ts) <> 7) l FULL JOIN (SELECT * FROM broken WHERE ingest_ts = TIMESTAMP '2024-02-01' AND hour(bar_ts) <> 9) r ON l.symbol = r.symbol AND l.bar_ts = r.bar_ts
    WHERE l.symbol IS NULL OR r.symbol IS NULL OR l.open <> r.open OR l.high <> r.high OR l.low <> r.low OR l.close <> r.close OR l.volume <> r.volume""", "bars", "bars_raw")
def c15_full_comparison(t: Tables):
    left = t.bars().where(F.hour("bar_ts") != 7)
    right = _broken(t).where((F.col("ingest_ts") == F.lit("2024-02-01").cast("timestamp")) & (F.hour("bar_ts") != 9))
    return quality.compared(left, right, ["symbol", "bar_ts"], ["open", "high", "low", "close", "volume"])


@query("SELECT asset_class, count(*) AS n_rows, sum(('0x' || substr(sha256(concat_ws('|', symbol, strftime(bar_ts, '%Y-%m-%d %H:%M:%S'), source_hash)), 1, 12))::BIGINT)::VARCHAR AS digest FROM bars GROUP BY ALL", "bars")
def d12_set_digest(t: Tables):
    return quality.set_digest(t.bars(), ["asset_class"], ["symbol", "bar_ts", "source_hash"])


@query("SELECT 0::BIGINT AS only_left, (SELECT count(*) FROM bars WHERE hour(bar_ts) = 7) AS only_right, false AS equal", "bars")
def g5_multiset_equality(t: Tables):
    rows = t.bars().select("symbol", "bar_ts", "close")
    return quality.equal_sets(rows.where(F.hour("bar_ts") != 7), rows)


@query("SELECT DISTINCT symbol, asset_class, currency FROM bars_raw", "bars_raw")
def g4_distinct_instruments(t: Tables):
    return t.bars_raw().select("symbol", "asset_class", "currency").distinct()


@query("SELECT symbol, bar_ts FROM (SELECT symbol, ts AS bar_ts FROM grid EXCEPT SELECT symbol, bar_ts FROM bars)", "grid", "bars")
def g3_set_difference(t: Tables):
    grid = coverage.grid(t.ranges(), ["symbol"], 3600).select("symbol", F.col("ts").alias("bar_ts"))
    return grid.subtract(t.bars().select("symbol", "bar_ts"))


@query("SELECT symbol, bar_ts, close, adjusted FROM (SELECT symbol, bar_ts, close, NULL::DOUBLE AS adjusted FROM bars WHERE asset_class = 'fx' UNION ALL SELECT symbol, bar_ts, close, close * 2 FROM bars WHERE asset_class = 'crypto')", "bars")
def g2_diagonal_union(t: Tables):
    rows = t.bars().select("symbol", "bar_ts", "close", "asset_class")
    return rows.where("asset_class = 'fx'").drop("asset_class").unionByName(rows.where("asset_class = 'crypto'").drop("asset_class").withColumn("adjusted", F.col("close") * 2), allowMissingColumns=True)


@query(
    """SELECT asset_class, symbol, count(*) AS row_count, count(*) - count(DISTINCT bar_ts) AS duplicates, min(bar_ts) AS min_ts, max(bar_ts) AS max_ts, list_sort(list_distinct(list(price_type))) AS price_types, any_value(g.gaps) AS gaps, any_value(g.longest) AS longest_gap_s
    FROM bars_raw JOIN (SELECT symbol, count(*) FILTER (d > 3600) AS gaps, max(d) AS longest FROM (SELECT symbol, epoch(bar_ts - lag(bar_ts) OVER (PARTITION BY symbol ORDER BY bar_ts))::BIGINT AS d FROM bars) GROUP BY symbol) g USING (symbol) GROUP BY ALL""",
    "bars_raw", "bars",
)
def d9_inventory(t: Tables):
    from tidemark.operators import inventory

    return inventory.inventory(t.bars_raw(), ["asset_class", "symbol"], "bar_ts")


@query("SELECT symbol, bar_ts, open, close, count(*) OVER (PARTITION BY symbol, bar_ts) > 1 AS conflict FROM bars_raw QUALIFY row_number() OVER (PARTITION BY symbol, bar_ts ORDER BY ingest_ts, source_hash) = 1", "bars_raw")
def e10_first_wins(t: Tables):
    from tidemark.operators.runs import first_wins

    return first_wins(t.bars_raw(), ["symbol", "bar_ts"], ["ingest_ts", "source_hash"], F.col("source_hash")).select("symbol", "bar_ts", "open", "close", "conflict")


DAILY = """, daily AS (SELECT symbol, asset_class, date_trunc('day', bar_ts) AS bar_ts, first(open ORDER BY bar_ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bar_ts) AS close,
    CASE WHEN bool_or(volume IS NULL) THEN NULL ELSE sum(volume) END AS volume, count(*) = 24 AS complete FROM bars GROUP BY ALL)"""


@query(DAILY + " SELECT symbol, bar_ts, close, 'ohlcv-1h-1d' AS recipe_id FROM daily WHERE asset_class = 'fx'", "bars")
def b5_recipe_identity(t: Tables):
    """One recipe's bars out of a table that holds those of two."""
    from tidemark.operators import derive

    made = [derive.derive(t.bars(), derive.Recipe(f"ohlcv-1h-{w}", "1h", w, policy="allow"), "s1") for w in ("4h", "1d")]
    return versions.derived_rows(made[0].unionByName(made[1]), "ohlcv-1h-1d", "1", {"asset_class": "fx"}).select("symbol", "bar_ts", "close", "recipe_id")


@query("SELECT count(*) AS rows_scanned, count(*) FILTER (asset_class = 'fx' AND bar_ts >= TIMESTAMP '2024-01-10') AS matched FROM bars", "bars")
def d26_scan_counts(t: Tables):
    return versions.scan_counts(t.bars(), (F.col("asset_class") == "fx") & (F.col("bar_ts") >= F.lit("2024-01-10").cast("timestamp")))


@query("SELECT symbol, bar_ts, close, (row_number() OVER (ORDER BY bar_ts, asset_class, symbol) - 1) // 250 AS page FROM bars", "bars")
def f3_page_sequence(t: Tables):
    """Every page of one fixed set of rows."""
    return versions.pages(t.bars(), ["bar_ts", "asset_class", "symbol"], 250).select("symbol", "bar_ts", "close", "page")


@query(
    DAILY + """, made AS (SELECT symbol, bar_ts, low > least(open, close) OR high < greatest(open, close) AS inconsistent, dayofmonth(bar_ts) % 6 = 0 AS blank, count(*) OVER (PARTITION BY symbol, bar_ts) > 1 AS doubled
      FROM (SELECT * FROM (SELECT * REPLACE (CASE WHEN dayofmonth(bar_ts) % 5 = 0 THEN high + 1 ELSE low END AS low) FROM daily) UNION ALL SELECT * FROM daily WHERE dayofmonth(bar_ts) = 11))
    SELECT symbol, bar_ts, unnest(list_filter([CASE WHEN doubled THEN 'duplicate_key' END, CASE WHEN inconsistent THEN 'ohlc_inconsistent' END, CASE WHEN blank THEN 'lineage_incomplete' END], lambda c: c IS NOT NULL)) AS code FROM made
    UNION ALL SELECT 'none', NULL, 'empty'""",
    "bars",
)
def i1_i2_market_contract(t: Tables):
    """Derived days with planted faults: doubled keys, prices, blank lineage, and a series without bars."""
    from tidemark.operators import derive

    made = derive.derive(t.bars(), derive.Recipe("ohlcv-1h-1d", "1h", "1d", policy="allow"), "s1")
    day = F.dayofmonth("bar_ts")
    rows = made.withColumn("low", F.when(day % 5 == 0, F.col("high") + 1).otherwise(F.col("low"))).unionByName(made.where(day == 11))
    rows = rows.withColumn("input_snapshot_id", F.when(day % 6 != 0, F.col("input_snapshot_id")))
    found = quality.market_violations(rows, ["symbol", "bar_ts"], ("recipe_id", "recipe_version", "input_snapshot_id", "source_hash")).select("symbol", "bar_ts", "code")
    expected = t.ranges().select("symbol").unionByName(t.spark.range(1).select(F.lit("none").alias("symbol")))
    return found.unionByName(quality.empty_series(rows, expected, ["symbol"]).select("symbol", F.lit(None).cast("timestamp").alias("bar_ts"), "code"))


@query(
    MARKED + """, broken AS (SELECT symbol, bar_ts, CASE WHEN hour(bar_ts) = 3 THEN high + 1 ELSE low END AS low, open, high, close, CASE WHEN hour(bar_ts) = 5 THEN -volume ELSE volume END AS volume FROM bars)
    SELECT symbol, 'error' AS severity, code, count(*) AS n FROM (SELECT symbol, unnest(list_filter([CASE WHEN low > least(open, close) OR high < greatest(open, close) THEN 'ohlc_inconsistent' END, CASE WHEN volume < 0 THEN 'negative_volume' END], lambda c: c IS NOT NULL)) AS code FROM broken) GROUP BY ALL
    UNION ALL SELECT symbol, 'warning', CASE WHEN count(*) FILTER (seen) = 0 THEN 'coverage_not_ready' ELSE 'coverage_degraded' END, 1 FROM marked WHERE open GROUP BY symbol HAVING count(*) FILTER (NOT seen) > 0""",
    "bars", "grid",
)
def i6_quality_findings(t: Tables):
    """Broken bars are errors; what the session lacks is a warning."""
    rows = t.bars().withColumns({"low": F.when(F.hour("bar_ts") == 3, F.col("high") + 1).otherwise(F.col("low")), "volume": F.when(F.hour("bar_ts") == 5, -F.col("volume")).otherwise(F.col("volume"))})
    wrong = quality.bar_violations(rows, ["symbol", "bar_ts"]).select("symbol", F.lit("error").alias("severity"), "code")
    weak = coverage.findings(evaluated(t).summary, ["symbol"]).select("symbol", F.lit("warning").alias("severity"), "code")
    return wrong.unionByName(weak).groupBy("symbol", "severity", "code").agg(F.count("*").alias("n"))


@query(
    " UNION ALL ".join(
        f"SELECT '{w}' AS timeframe, symbol, {b} AS bar_ts, first(open ORDER BY m) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY m) AS close FROM minutes GROUP BY ALL"
        for w, b in (("5m", "time_bucket(INTERVAL 5 MINUTE, m, TIMESTAMP '1970-01-01')"), ("15m", "time_bucket(INTERVAL 15 MINUTE, m, TIMESTAMP '1970-01-01')"), ("30m", "time_bucket(INTERVAL 30 MINUTE, m, TIMESTAMP '1970-01-01')"), ("1h", "date_trunc('hour', m)"), ("4h", "time_bucket(INTERVAL 4 HOUR, m, TIMESTAMP '1970-01-01')"), ("1d", "date_trunc('day', m)"), ("1w", "date_trunc('week', m)"), ("1mo", "date_trunc('month', m)"))
    ).join([", minutes AS (SELECT symbol, date_trunc('minute', ts) AS m, first(bid ORDER BY ts, event_id) AS open, max(bid) AS high, min(bid) AS low, last(bid ORDER BY ts, event_id) AS close FROM ticks GROUP BY ALL) ", ""]),
    "ticks",
)
def j14_all_targets(t: Tables):
    """Minutes to six targets, and of these the days to weeks and months."""
    minutes = bars.tick_bars(t.ticks(), "1m")
    row = lambda df, w: df.select(F.lit(w).alias("timeframe"), "symbol", F.col("bucket").alias("bar_ts"), "open", "high", "low", "close")
    up = lambda df, w: bars.rollup(df.withColumn("ingest_ts", F.col("bar_ts")), w, ("symbol",))
    made = {w: up(minutes, w) for w in ("5m", "15m", "30m", "1h", "4h", "1d")}
    days = made["1d"].withColumnRenamed("bucket", "bar_ts")
    made |= {w: up(days, w) for w in ("1w", "1mo")}
    out = None
    for w, df in made.items():
        out = row(df, w) if out is None else out.unionByName(row(df, w))
    return out
