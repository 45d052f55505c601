"""Time-series views over the relational tables, the same in Spark and in SQL, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import bars as bar_ops

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, *views: str):
    """Register a query under its function's name; ``sql`` is its oracle over the named views. Timestamps leave it without a zone."""

    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            out = f(Tables(spark, sf_dir))
            return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in out.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views)
        return run

    return register


class Tables:
    """The tables of a folder, and the views built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])

    def ticks(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("bid"), F.col("user_id").alias("volume"))

    def bars_raw(self) -> DataFrame:
        """Hourly bars in two versions; the second corrects every seventh hour of the day."""
        base = bar_ops.tick_bars(self.ticks(), "1h").select(
            F.concat(F.lit("md-"), "symbol").alias("managed_dataset_id"), "symbol", F.when(F.col("symbol").isin("click", "view"), "crypto").otherwise("fx").alias("asset_class"), F.lit("feed").alias("provider"), F.lit("1h").alias("timeframe"),
            "bar_ts", "open", "high", "low", "close", "volume", F.lit("USD").alias("currency"), F.lit("bid").alias("price_type"),
        )
        stamp = F.date_format("bar_ts", "yyyy-MM-dd'T'HH:mm:ss")
        hashed = lambda v: F.sha2(F.concat_ws(":", "symbol", stamp, F.lit(v)), 256)
        first = base.withColumns({"ingest_ts": F.lit("2024-02-01 00:00:00").cast("timestamp"), "source_hash": hashed("0")})
        close = F.col("close") + 1
        second = base.where(F.hour("bar_ts") % 7 == 0).withColumns({"high": F.greatest("high", close), "close": close, "ingest_ts": F.lit("2024-02-02 00:00:00").cast("timestamp"), "source_hash": hashed("1")})
        return first.unionByName(second)

    def bars(self) -> DataFrame:
        from tidemark.operators.versions import current_bars

        return current_bars(self.bars_raw())

    def ranges(self) -> DataFrame:
        """The requested range of each symbol: from its first bar to the hour after its last."""
        return self.bars().groupBy("symbol").agg(F.min("bar_ts").alias("start"), (F.max("bar_ts") + F.expr("interval 1 hour")).alias("end"))

    def observations(self) -> DataFrame:
        day = F.to_date("o_orderdate")
        key = F.col("o_orderkey")
        n = lambda m: (key % m).cast("int")
        policy = F.when(key % 3 == 0, "vintage").when(key % 3 == 1, "release").otherwise("unknown")
        return self.table("orders").select(
            F.col("o_orderpriority").alias("series_id"), day.alias("observation_date"), F.when(key % 17 != 0, F.col("o_totalprice")).alias("value"), F.when(key % 11 != 0, F.date_add(day, n(30))).alias("vintage_start"),
            F.when(key % 13 == 0, F.date_add(day, n(30) - 2)).otherwise(F.date_add(day, n(30) + 30)).alias("vintage_end"), policy.alias("availability_policy"), F.element_at(F.array(F.lit(None).cast("int"), F.lit(0), F.lit(2)), n(5) % 3 + 1).alias("availability_lag_days"),
            F.when(key % 3 == 1, F.date_add(day, n(10)).cast("timestamp") + F.expr("interval 12 hour")).alias("release_ts"), (F.date_add(day, n(40)).cast("timestamp") + F.expr("interval 6 hour")).alias("asof_ts"), F.when(key % 34 == 0, "holiday").alias("missing_reason"), key.alias("tie"),
        )

    def runs(self) -> DataFrame:
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
        pick = lambda names, m: F.element_at(F.array(*[F.lit(x) for x in names]), (m % len(names)).cast("int") + 1)
        rows = self.table("orders").withColumn("k", F.row_number().over(w)).withColumn("before", F.lag("o_orderkey").over(w))
        created = F.col("o_orderdate") + F.make_dt_interval(mins=(key % 1440).cast("int"))
        status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
        return rows.select(
            key.alias("run_id"), F.concat(F.lit("ds-"), (cust % 10).cast("string")).alias("dataset_id"), F.concat(F.lit("p"), (cust % 4).cast("string")).alias("provider"), status.alias("status"), pick(["ingest", "derive"], key).alias("run_kind"), pick(["manual", "backfill", "repair", "scheduled", "acceptance"], key).alias("run_scope"),
            F.when(status == "failed", pick(["TimeoutError", "ValidationError", "RateLimited", "SchemaError", "Other"], key)).alias("error_type"), created.alias("created_at"), F.when(status != "running", created + F.make_dt_interval(mins=(key % 60).cast("int"))).alias("finished_at"), (key % 60 * 60).alias("duration_s"), (F.col("k") % 5).cast("long").alias("retry_count"),
            F.when(F.col("k") % 5 != 1, F.col("before")).alias("retry_of"), F.col("o_totalprice").alias("rows_written"),
        )

    def findings(self) -> DataFrame:
        code = F.when(F.col("l_tax") < 0.02, "missing_bars").when(F.col("l_tax") < 0.04, "ohlc_inconsistent").when(F.col("l_tax") < 0.06, "negative_volume").otherwise("coverage_degraded")
        severity = F.when(F.col("l_tax") < 0.04, "error").otherwise("warning")
        return self.table("lineitem").where(F.col("l_discount") >= 0.08).select(code.alias("code"), severity.alias("severity"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").alias("observed_at"), F.col("l_quantity").alias("quantity"))

    def windows(self, kind: str) -> DataFrame:
        """A planned and a candidate window of every order, some days long each, for the customer's task."""
        key = F.col("o_orderkey")
        late, days = {"planned": (F.lit(0), key % 5 + 1), "candidate": (key % 4 - 1, key % 9 + 2)}[kind]
        start = F.col("o_orderdate") + F.make_dt_interval(late.cast("int"))
        rows = self.table("orders").withColumn("start", start)
        task = F.concat(F.lit("task-"), F.col("o_custkey").cast("string"))
        return rows.select(task.alias("task_id"), key.alias("window_id"), "start", (F.col("start") + F.make_dt_interval(days.cast("int"))).alias("end"))


# The same views in DuckDB SQL; a view may use those before it.
VIEWS = {
    "ticks": "SELECT event_type AS symbol, ts, event_id, value AS bid, user_id AS volume FROM events",
    "hourly": "SELECT symbol, date_trunc('hour', ts) AS bar_ts, first(bid ORDER BY ts, event_id) AS open, max(bid) AS high, min(bid) AS low, last(bid ORDER BY ts, event_id) AS close, sum(volume)::DOUBLE AS volume FROM ticks GROUP BY ALL",
    "base": "SELECT 'md-' || symbol AS managed_dataset_id, symbol, CASE WHEN symbol IN ('click', 'view') THEN 'crypto' ELSE 'fx' END AS asset_class, 'feed' AS provider, '1h' AS timeframe, bar_ts, open, high, low, close, volume, 'USD' AS currency, 'bid' AS price_type FROM hourly",
    "bars_raw": "SELECT *, TIMESTAMP '2024-02-01' AS ingest_ts, sha256(symbol || ':' || strftime(bar_ts, '%Y-%m-%dT%H:%M:%S') || ':0') AS source_hash FROM base UNION ALL BY NAME SELECT * REPLACE (greatest(high, close + 1) AS high, close + 1 AS close), TIMESTAMP '2024-02-02' AS ingest_ts, sha256(symbol || ':' || strftime(bar_ts, '%Y-%m-%dT%H:%M:%S') || ':1') AS source_hash FROM base WHERE hour(bar_ts) % 7 = 0",
    "bars": "SELECT * FROM bars_raw QUALIFY row_number() OVER (PARTITION BY provider, asset_class, symbol, timeframe, bar_ts ORDER BY ingest_ts DESC, source_hash DESC) = 1",
    "ranges": "SELECT symbol, min(bar_ts) AS range_start, max(bar_ts) + INTERVAL 1 HOUR AS range_end FROM bars GROUP BY symbol",
    "grid": "SELECT symbol, unnest(generate_series(range_start, range_end - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts FROM ranges",
    "observations": "SELECT o_orderpriority AS series_id, o_orderdate::DATE AS observation_date, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS value, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE + (o_orderkey % 30)::INT END AS vintage_start, CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate::DATE + (o_orderkey % 30)::INT - 2 ELSE o_orderdate::DATE + (o_orderkey % 30)::INT + 30 END AS vintage_end, CASE o_orderkey % 3 WHEN 0 THEN 'vintage' WHEN 1 THEN 'release' ELSE 'unknown' END AS availability_policy, CASE o_orderkey % 5 % 3 WHEN 1 THEN 0 WHEN 2 THEN 2 END AS availability_lag_days, CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate::DATE + (o_orderkey % 10)::INT + INTERVAL 12 HOUR END AS release_ts, o_orderdate::DATE + (o_orderkey % 40)::INT + INTERVAL 6 HOUR AS asof_ts, CASE WHEN o_orderkey % 34 = 0 THEN 'holiday' END AS missing_reason, o_orderkey AS tie FROM orders",
    "runs": "SELECT o_orderkey AS run_id, 'ds-' || (o_custkey % 10) AS dataset_id, 'p' || (o_custkey % 4) AS provider, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, CASE o_orderkey % 2 WHEN 0 THEN 'ingest' ELSE 'derive' END AS run_kind, ['manual', 'backfill', 'repair', 'scheduled', 'acceptance'][o_orderkey % 5 + 1] AS run_scope, CASE WHEN o_orderstatus = 'P' THEN ['TimeoutError', 'ValidationError', 'RateLimited', 'SchemaError', 'Other'][o_orderkey % 5 + 1] END AS error_type, o_orderdate + to_minutes(o_orderkey % 1440) AS created_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_minutes(o_orderkey % 1440) + to_minutes(o_orderkey % 60) END AS finished_at, o_orderkey % 60 * 60 AS duration_s, k % 5 AS retry_count, CASE WHEN k % 5 <> 1 THEN before END AS retry_of, o_totalprice AS rows_written FROM (SELECT *, row_number() OVER w AS k, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))",
    "findings": "SELECT CASE WHEN l_tax < 0.02 THEN 'missing_bars' WHEN l_tax < 0.04 THEN 'ohlc_inconsistent' WHEN l_tax < 0.06 THEN 'negative_volume' ELSE 'coverage_degraded' END AS code, CASE WHEN l_tax < 0.04 THEN 'error' ELSE 'warning' END AS severity, l_partkey AS part, l_suppkey AS supplier, l_orderkey AS run_id, l_shipdate AS observed_at, l_quantity AS quantity FROM lineitem WHERE l_discount >= 0.08",
    "planned": "SELECT 'task-' || o_custkey AS task_id, o_orderkey AS window_id, o_orderdate AS s, o_orderdate + to_days((o_orderkey % 5 + 1)::INT) AS e FROM orders",
    "candidate": "SELECT *, s + to_days((window_id % 9 + 2)::INT) AS e FROM (SELECT 'task-' || o_custkey AS task_id, o_orderkey AS window_id, o_orderdate + to_days((o_orderkey % 4 - 1)::INT) AS s FROM orders)",
    "busy": "SELECT task_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(new) OVER (PARTITION BY task_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY task_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM planned)) GROUP BY task_id, run",
}
NEEDS = {"hourly": ["ticks"], "base": ["hourly"], "bars_raw": ["base"], "bars": ["bars_raw"], "ranges": ["bars"], "grid": ["ranges"], "busy": ["planned"]}


def with_views(sql: str, *views: str) -> str:
    """``sql`` with the named views and all that they need before it."""
    wanted: set[str] = set()

    def need(v: str) -> None:
        if v not in wanted:
            wanted.add(v)
            for n in NEEDS.get(v, []):
                need(n)

    for v in views:
        need(v)
    parts = [f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in wanted]
    if sql.startswith(", RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + sql.removeprefix(", RECURSIVE ")
    return ("WITH " + ", ".join(parts) + " " if parts else "") + sql
