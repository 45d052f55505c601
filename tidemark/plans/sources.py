"""Registered queries over sources, sinks and streams, fed from the given tables."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.text import path_value
from tidemark.operators import bars as bar_ops
from tidemark.operators import inventory, part_pages
from tidemark.plans.fixtures import Tables, query
from tidemark.sources import providers, storage
from tidemark.streaming import bars as streaming
from tidemark.streaming import states

PRICES = ["symbol", "bar_ts", "open", "high", "low", "close", "volume"]


def _published(t: Tables):
    """Two runs of bars in one folder, of which only the first has a manifest."""
    root = storage.shared_dir(t.spark)
    rows = t.bars()
    storage.write_bars(rows, root, "r1")
    storage.write_bars(rows.where("symbol = 'click'"), root, "r2")
    schema = rows.withColumn("year", F.year("bar_ts")).withColumn("run_id", F.lit("")).schema
    return root, schema, storage.build_manifest(t.spark, root, "r1", quality="pass")


@query("SELECT symbol, bar_ts, open, high, low, close, volume FROM bars", "bars")
def a1_a5_published_scan(t: Tables):
    root, schema, manifest = _published(t)
    return storage.published(t.spark, root, schema, manifest).select(*PRICES)


@query("SELECT symbol, bar_ts, open, high, low, close, volume FROM bars", "bars")
def a1_joined_scan(t: Tables):
    """The same scan as with more parts than a reader is given by name: rows are told by their file."""
    root, schema, manifest = _published(t)
    return storage.published(t.spark, root, schema, manifest, most=1).select(*PRICES)


@query(
    "SELECT symbol, bar_ts, close, source_hash, true AS has_more FROM bars WHERE (bar_ts, asset_class, symbol) > (TIMESTAMP '2024-01-10', 'fx', 'error') ORDER BY bar_ts, asset_class, symbol LIMIT 500",
    "bars",
)
def f1_part_page(t: Tables):
    """A page of current bars out of two runs of versions, a part for each series and day: only parts that can hold its keys are opened."""
    root, rows, keys = storage.shared_dir(t.spark), t.bars_raw().withColumn("day", F.to_date("bar_ts")), ["bar_ts", "asset_class", "symbol"]
    second = F.col("ingest_ts") > F.lit("2024-02-01").cast("timestamp")
    for run, some in (("r1", ~second), ("r2", second)):
        storage.write_bars(rows.where(some), root, run, partition=("asset_class", "symbol", "day"))
    schema = rows.withColumn("year", F.year("bar_ts")).withColumn("run_id", F.lit("")).schema
    parts = storage.written(part_pages.part_ranges(storage.scan(t.spark, root, schema), keys), root + "-parts", "ranges")
    latest = [F.desc("ingest_ts"), F.desc("source_hash")]
    page = part_pages.page_of_parts(t.spark, root, schema, parts, keys, 500, [datetime(2024, 1, 10), "fx", "error"], latest)
    return page.select("symbol", "bar_ts", "close", "source_hash", "has_more")


@query("SELECT symbol, bar_ts, close FROM bars WHERE symbol = 'view' AND bar_ts >= TIMESTAMP '2024-01-10' AND bar_ts < TIMESTAMP '2024-01-20'", "bars")
def a3_a4_pruned_scan(t: Tables):
    root, schema, _ = _published(t)
    rows = storage.scan(t.spark, root, schema).where("run_id = 'r1' and symbol = 'view'")
    return rows.where((F.col("bar_ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("bar_ts") < F.lit("2024-01-20").cast("timestamp"))).select("symbol", "bar_ts", "close")


#: A part for each series and year.
PARTS = "(SELECT DISTINCT provider, asset_class, symbol, timeframe, year(bar_ts) AS year FROM bars WHERE {where})"


@query(
    "SELECT CASE symbol WHEN 'view' THEN 'count_mismatch' ELSE 'schema_mismatch' END AS finding, count(*) AS parts FROM " + PARTS.format(where="symbol IN ('view', 'error')") + " GROUP BY symbol"
    " UNION ALL SELECT 'unlisted_part', count(*) FROM " + PARTS.format(where="symbol = 'click'") + " UNION ALL SELECT 'totals_mismatch', count(DISTINCT 'r1') FROM bars",
    "bars",
)
def a7_a8_verify_manifest(t: Tables):
    """A manifest with planted row counts and schemas, whose totals then differ, beside parts of a run that has none."""
    root, _, manifest = _published(t)
    of = lambda p, s: p.path.contains(f"symbol={s}/")
    planted = F.transform("parts", lambda p: p.withField("row_count", p.row_count + F.when(of(p, "view"), 1).otherwise(0)).withField("schema", F.when(of(p, "error"), "other").otherwise(p.schema)))
    return storage.verify(t.spark, root, manifest.withColumn("parts", planted)).groupBy("finding").agg(F.count("*").alias("parts"))


@query("SELECT 'r1' AS run_id, (SELECT count(*) FROM bars) AS row_count, count(*) AS parts, count(DISTINCT 1) AS schemas, 'pass' AS quality FROM " + PARTS.format(where="true"), "bars")
def a7_manifest_totals(t: Tables):
    _, _, manifest = _published(t)
    schemas = F.size(F.array_distinct(F.transform("parts", lambda p: p.schema)))
    return manifest.select("run_id", "row_count", F.size("parts").cast("long").alias("parts"), schemas.cast("long").alias("schemas"), "quality")


@query("SELECT 'excluded' AS side, count(*) AS files FROM " + PARTS.format(where="true"), "bars")
def c2_c14_unlisted_files(t: Tables):
    """Files that a manifest lists; the others are legacy."""
    root, _, manifest = _published(t)
    _, listed = inventory.unlisted(storage.files(t.spark, root), storage.parts_of(manifest))
    return listed.agg(F.count("*").alias("files")).select(F.lit("excluded").alias("side"), "files")


@query("SELECT symbol, count(*) AS parts FROM " + PARTS.format(where="symbol IN ('view', 'error')") + " GROUP BY symbol", "bars")
def c14_new_parts(t: Tables):
    """Parts that the last look did not see, by series; a first look finds none."""
    _, _, manifest = _published(t)
    parts = storage.parts_of(manifest)
    symbol = path_value(F.col("path"), "symbol")
    remembered = parts.where(~symbol.isin("view", "error"))
    found = inventory.new_parts(parts, remembered).unionByName(inventory.new_parts(parts, parts.limit(0)))
    return found.groupBy(symbol.alias("symbol")).agg(F.count("*").alias("parts"))


@query(
    "SELECT symbol, bar_ts, 'duplicate' AS code FROM bars WHERE hour(bar_ts) = 4 UNION ALL SELECT symbol, bar_ts, 'unsorted' FROM bars WHERE symbol = 'view' QUALIFY bar_ts <> max(bar_ts) OVER (PARTITION BY symbol) UNION ALL SELECT symbol, bar_ts, CASE hour(bar_ts) WHEN 9 THEN 'missing_price' ELSE 'row' END FROM bars WHERE hour(bar_ts) <> 4 AND bar_ts >= TIMESTAMP '2024-01-05' AND bar_ts < TIMESTAMP '2024-01-09' UNION ALL SELECT symbol, bar_ts, 'row' FROM bars WHERE hour(bar_ts) = 9 AND bar_ts >= TIMESTAMP '2024-01-05' AND bar_ts < TIMESTAMP '2024-01-09'",
    "bars",
)
def a13_provider_frame(t: Tables):
    """A frame with upper-case names, doubled stamps, missing prices and a series that runs backwards."""
    rows = t.bars().select(*PRICES).withColumn("close", F.when(F.hour("bar_ts") != 9, F.col("close")))
    back = F.when(F.col("symbol") == "view", -F.unix_timestamp("bar_ts")).otherwise(F.unix_timestamp("bar_ts"))
    frame = rows.unionByName(rows.where(F.hour("bar_ts") == 4)).withColumn("at", back)
    frame = frame.select(*[F.col(c).alias(c.upper()) for c in frame.columns])
    good, rejected = providers.normalize_frame(frame, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-09").cast("timestamp"), ["symbol"], "at")
    once = good.where(F.hour("bar_ts") != 4).select("symbol", "bar_ts", F.lit("row").alias("code"))
    return rejected.unionByName(once)


@query("SELECT symbol, bar_ts, close, CASE WHEN asset_class = 'fx' THEN source_hash END AS source_hash FROM bars", "bars")
def a2_schema_union(t: Tables):
    """Parts with typed stamps and with stamps as text and fewer columns, read together."""
    rows = t.bars()
    typed = rows.where("asset_class = 'fx'").select("symbol", "bar_ts", "close", "source_hash")
    text = rows.where("asset_class = 'crypto'").select("symbol", F.date_format("bar_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("bar_ts"), "close")
    return storage.union_versions(typed, text, timestamps=("bar_ts",))


@query("SELECT symbol, bar_ts, open, high, low, close, volume FROM bars", "bars")
def a9_klines(t: Tables):
    fields = [F.unix_millis("bar_ts"), *[F.col(c) for c in PRICES[2:]]]
    row = F.concat(F.lit("["), F.concat_ws(",", *[f.cast("string") for f in fields]), F.lit("]"))
    payload = t.bars().groupBy("symbol", F.to_date("bar_ts").alias("day")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("payload"))
    return providers.klines(payload, "payload", "symbol")


@query("SELECT symbol, date_trunc('day', (bar_ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AS bar_ts, open, high, low, close, volume FROM bars WHERE hour(bar_ts) % 4 <> 0", "bars")
def a10_daily_frame(t: Tables):
    some = lambda c: F.when(F.hour("bar_ts") % 4 != 0, F.col(c))
    rows = t.bars().select("symbol", F.to_date("bar_ts").alias("day"), F.struct(F.unix_timestamp("bar_ts").alias("stamp"), some("open").alias("open"), *[F.col(c) for c in PRICES[3:]]).alias("r"))
    arrays = rows.groupBy("symbol", "day").agg(F.collect_list("r").alias("r")).select("symbol", *[F.col(f"r.{c}").alias(c) for c in ["stamp", *PRICES[2:]]])
    return providers.daily_frame(arrays, "America/New_York", "symbol")


@query(
    """SELECT o_orderpriority AS series_id, strftime(o_orderdate, '%Y-%m-%d') AS observation_date, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS value,
    CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T12:00:00Z' END AS release_ts, CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'monthly' ELSE 'native' END AS frequency, 'percent' AS units, 'native' AS seasonal_adjustment,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS vintage_start, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS vintage_end,
    CASE WHEN o_orderkey % 6 = 0 THEN 'vintage' ELSE 'unknown' END AS availability_policy, CASE WHEN o_orderkey % 5 = 0 THEN 'not_reported' END AS missing_reason FROM orders"""
)
def a11_series(t: Tables):
    """Observations with both real-time ends, with one of them or none, some released, of series that say more or less of themselves."""
    day, key = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    value = F.when(key % 5 == 0, ".").otherwise(F.col("o_totalprice").cast("string"))
    ends = [F.when(key % 2 == 0, day).alias("realtime_start"), F.when(key % 3 == 0, day).alias("realtime_end")]
    doc = F.to_json(F.array(F.struct(day.alias("date"), value.alias("value"), *ends, F.when(key % 7 == 0, F.concat(day, F.lit("T12:00:00Z"))).alias("release_ts"))))
    frequency = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "monthly").otherwise("").alias("frequency")
    return providers.series(t.table("orders").select(F.col("o_orderpriority").alias("series_id"), frequency, F.lit("percent").alias("units"), doc.alias("payload")), "payload", "series_id")


@query("SELECT symbol, bar_ts, open, high, low, close, volume FROM hourly", "hourly")
def a12_tick_files(t: Tables):
    """Ticks packed into hourly files, decoded again and rolled up."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for hour, part in frame.sort_values(["ts", "event_id"]).groupby(frame["ts"].dt.floor("h")):
            rows = [(int((r.ts - hour) / pd.Timedelta("1ms")), r.bid, r.bid, 0.0, float(r.volume)) for r in part.itertuples()]
            out.append((part["symbol"].iloc[0], hour, providers.encode_ticks(rows)))
        return pd.DataFrame(out, columns=["symbol", "hour", "payload"])

    ticks = t.ticks().withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    files = ticks.groupBy("symbol", F.to_date("ts").alias("d")).applyInPandas(pack, "symbol string, hour timestamp_ntz, payload binary")
    return bar_ops.tick_bars(providers.decode_ticks(files, {"symbol": "string"}), "1h")


@query("SELECT conv_id, turn, kind FROM (SELECT conv_id, turn, role AS kind FROM conversations WHERE turn % 3 <> 0)")
def a15_a17_receipts(t: Tables):
    """Documents in a text column; broken ones are skipped."""
    text = F.when(F.col("turn") % 3 == 0, '{"kind": ').otherwise(F.to_json(F.struct(F.col("role").alias("kind"))))
    good, _ = providers.receipts(t.table("conversations").select("conv_id", "turn", text.alias("doc_text")), "doc_text", "kind string")
    return good


@query("SELECT 2 * count(*) AS files, 0::BIGINT AS empty FROM " + PARTS.format(where="true"), "bars")
def a16_file_inventory(t: Tables):
    """Bars rewritten and counted as files."""
    root, _, _ = _published(t)
    again = storage.shared_dir(t.spark)
    storage.write_bars(t.bars(), again, "r3")
    found = storage.files(t.spark, f"{root}/run_id=r1").unionByName(storage.files(t.spark, again))
    return found.agg(F.count("*").alias("files"), F.count_if(F.col("bytes") == 0).alias("empty"))


@query("SELECT symbol, bar_ts, close, false AS conflict FROM bars WHERE bar_ts >= TIMESTAMP '2024-01-03' AND bar_ts < TIMESTAMP '2024-01-09'", "bars")
def a18_merged_windows(t: Tables):
    """Two windows that overlap, each row once."""
    windows = t.spark.sql("SELECT 'feed' AS provider, timestamp'2024-01-03' AS start, timestamp'2024-01-06' AS `end`, 0 AS ordinal UNION ALL SELECT 'feed', timestamp'2024-01-05', timestamp'2024-01-09', 1")
    merged = providers.merge_windows(t.bars(), F.broadcast(windows), ["provider"], ["provider", "symbol"], "ds-1")
    return merged.select("symbol", "bar_ts", "close", "conflict")


@query("SELECT symbol, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM grid GROUP BY symbol", "grid")
def a14_synthetic_bars(t: Tables):
    rows = providers.synthetic_bars(t.ranges(), 3600, ["symbol"]).where("low <= open and low <= close and high >= open and high >= close")
    return rows.groupBy("symbol").agg(F.count("*").alias("n"), F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"))


def _delivered(t: Tables):
    """The events as files in a folder that a stream can watch, and their schema."""
    root, raw = storage.shared_dir(t.spark), t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    raw.write.parquet(f"{root}/in")
    return root, raw.schema


@query("SELECT symbol, bar_ts, close FROM hourly WHERE bar_ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 180 MINUTE FROM ticks)", "hourly")
def k1_k2_closed_bars(t: Tables):
    """Bars of a stream, given out when the watermark has passed them."""
    root, schema = _delivered(t)
    ticks = streaming.tick_stream(t.spark, f"{root}/in", schema)
    out = streaming.run_to_end(streaming.closed_bars(ticks, "1 hour", "180 minutes"), f"{root}/bars", f"{root}/checkpoint")
    return out.select("symbol", "bar_ts", "close")


@query("SELECT symbol, bar_ts, open, high, low, close, volume FROM hourly", "hourly")
def k3_k4_k5_repair(t: Tables):
    """Two deliveries, the second late: buckets that it touches are derived again, and a restart changes nothing."""
    root = storage.shared_dir(t.spark)
    raw = t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    for late in (0, 1):
        raw.where((F.col("event_id") % 10 == 0).cast("int") == late).write.mode("append").parquet(f"{root}/in")
        for _ in range(1 + late):
            streaming.repair(streaming.tick_stream(t.spark, f"{root}/in", raw.schema), f"{root}/raw", f"{root}/bars", f"{root}/checkpoint")
    return streaming.repaired(t.spark, f"{root}/bars")


@query("SELECT event_type AS name, level AS state, generation FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS generation FROM (SELECT *, lag(level) OVER (PARTITION BY event_type ORDER BY event_id) AS previous FROM (SELECT event_type, event_id, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS level FROM events)) WHERE previous IS NULL OR previous <> level)")
def k6_state_changes(t: Tables):
    root, schema = _delivered(t)
    raw = t.spark.readStream.schema(schema).parquet(f"{root}/in")
    samples = raw.select("event_type", F.when(F.col("value") > 100, "high").otherwise("low").alias("level"), "event_id")
    return streaming.state_changes(samples, "event_type", "level", "event_id", f"{root}/changes", f"{root}/checkpoint")


@query("SELECT symbol, bar_ts, close, volume FROM hourly WHERE bar_ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 180 MINUTE FROM ticks)", "hourly")
def k2_duplicate_ticks(t: Tables):
    """Ticks delivered again: in the same files, later inside the watermark's delay, and beyond it. Each counts once, as the volumes tell."""
    root, raw = storage.shared_dir(t.spark), t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    cut = raw.agg((F.max("ts") - F.expr("interval 12 hours")).alias("cut"), F.min("ts").alias("first")).first()
    early = F.col("ts") < F.lit(cut.cut)
    near = early & (F.col("ts") >= F.lit(cut.cut) - F.expr("interval 2 hours"))
    far = F.col("ts") < F.lit(cut.first) + F.expr("interval 1 day")
    doubled = raw.where(early).unionByName(raw.where(early & (F.col("event_id") % 3 == 0)))
    for files in (doubled, raw.where(near | (early & far)), raw.where(~early)):
        files.write.mode("append").parquet(f"{root}/in")
        ticks = streaming.tick_stream(t.spark, f"{root}/in", raw.schema)
        out = streaming.run_to_end(streaming.closed_bars(ticks, "1 hour", "180 minutes"), f"{root}/bars", f"{root}/checkpoint")
    return out.select("symbol", "bar_ts", "close", "volume")


@query(
    """SELECT event_type AS name, ts, event_id AS seq, level AS state, generation FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS generation
    FROM (SELECT *, lag(level) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS previous FROM (SELECT event_type, ts, event_id, CASE WHEN value > 100 THEN 'high' ELSE 'low' END AS level FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))) WHERE previous IS NULL OR previous <> level)"""
)
def k6_state_operator(t: Tables):
    """State changes by a state operator, delivered in two halves between which the stream ends and starts again."""
    root, raw = storage.shared_dir(t.spark), t.spark.read.parquet(f"{t.sf_dir}/events.parquet")
    cut = raw.agg((F.max("ts") - F.expr("interval 100 hours")).alias("cut")).first().cut
    for half in (F.col("ts") < F.lit(cut), F.col("ts") >= F.lit(cut)):
        raw.where(half).write.mode("append").parquet(f"{root}/in")
        events = t.spark.readStream.schema(raw.schema).parquet(f"{root}/in")
        state = F.when(F.col("value") > 100, "high").otherwise("low").alias("state")
        samples = events.select(F.col("event_type").alias("name"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), state)
        changes = states.span_changes(samples, "1 day", "1 hour", f"{root}/changes", f"{root}/checkpoint")
    return states.generations(changes)
