"""Recipes, data set registry, derivation plans and parity of derived bars."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import TIMEFRAMES, SessionProfile, bucket, bucket_window, next_bucket
from tidemark.operators import bars as bar_ops
from tidemark.operators import coverage, versions, windows
from tidemark.sources.storage import shared_dir, written


@dataclass(frozen=True)
class Recipe:
    """How finer bars become coarser ones, and which rows it may be used on (empty: any)."""

    recipe_id: str
    source: str
    target: str
    version: str = "1"
    policy: str = "drop"  #: of buckets that are not complete: fail, drop or allow
    providers: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()
    asset_classes: tuple[str, ...] = ()
    parent: str | None = None

    def allows(self) -> Column:
        out = F.lit(True)
        for column, wanted in (("provider", self.providers), ("symbol", self.symbols), ("asset_class", self.asset_classes)):
            out = out & (F.col(column).isin(*wanted) if wanted else F.lit(True))
        return out


@dataclass(frozen=True)
class DatasetSpec:
    """A governed table: its key, how it is partitioned, and which columns select a series."""

    dataset_id: str
    kind: str
    primary_key: tuple[str, ...]
    partitions: tuple[str, ...] = ()
    selectors: tuple[str, ...] = ()
    lineage: tuple[str, ...] = field(default=())


RECIPES: dict[str, Recipe] = {}
DATASETS: dict[str, DatasetSpec] = {}


def register_recipe(recipe: Recipe) -> Recipe:
    if recipe.parent is not None and recipe.parent not in RECIPES:
        raise ValueError(f"unknown parent recipe {recipe.parent}")
    RECIPES[recipe.recipe_id] = recipe
    return recipe


def register_dataset(spec: DatasetSpec) -> DatasetSpec:
    if spec.dataset_id in DATASETS and DATASETS[spec.dataset_id] != spec:
        raise ValueError(f"data set {spec.dataset_id} is registered otherwise")
    DATASETS[spec.dataset_id] = spec
    return spec


for _source, _targets in (("1m", ("5m", "15m", "30m", "1h", "4h", "1d")), ("1d", ("1w", "1mo"))):
    for _target in _targets:
        register_recipe(Recipe(f"ohlcv-{_source}-{_target}", _source, _target, parent="ohlcv-1m-1d" if _source == "1d" else None))
register_recipe(Recipe("ohlcv-1h-1d", "1h", "1d"))
register_dataset(DatasetSpec("provider_bars", "raw", versions.BAR_KEYS, ("provider", "asset_class", "symbol", "timeframe", "year"), ("provider", "symbol", "timeframe")))
register_dataset(DatasetSpec("economic_observations", "raw", ("series_id", "observation_date", "vintage_start"), ("series_id",), ("series_id",)))
register_dataset(DatasetSpec("market_bars", "derived", (*versions.BAR_KEYS, "recipe_id", "recipe_version", "price_basis"), ("provider", "asset_class", "symbol", "timeframe", "price_basis", "year"), ("provider", "symbol", "timeframe"), ("recipe_id", "recipe_version", "input_snapshot_id")))


def chain(recipe_id: str) -> list[Recipe]:
    """A recipe and its parents down to the raw one; a cycle is an error."""
    out: list[Recipe] = []
    at: str | None = recipe_id
    while at is not None:
        if at in (r.recipe_id for r in out):
            raise ValueError(f"recipes form a cycle at {at}")
        out.append(RECIPES[at])
        at = RECIPES[at].parent
    return out


def derive(rows: DataFrame, recipe: Recipe, snapshot: str, session: SessionProfile | None = None) -> DataFrame:
    """Derived bars with their lineage; rows that the recipe does not allow are left out, and so are incomplete buckets under 'drop'.

    With a session, bars of its closed hours are left out first, so they reach no price, volume or hash; a bucket is complete
    when it has all bars of its open hours. Prices, lineage and counts come from one aggregation.
    """
    allowed = rows.where(recipe.allows())
    allowed = allowed if session is None else allowed.where(session.is_open(F.col("bar_ts")))
    parts = F.collect_list(F.struct("bar_ts", "source_hash"))  # the rows of one bucket
    one = allowed.groupBy(*bar_ops.SERIES, bucket(F.col("bar_ts"), recipe.target).alias("bucket")).agg(*bar_ops.rolled(), parts.alias("_rows"))
    step = TIMEFRAMES[recipe.source]
    stamps = F.array_distinct(F.transform("_rows", lambda r: r.bar_ts))
    counted = {"observed": F.size(stamps).cast("long"), "regular": F.forall(stamps, lambda x: bar_ops.on_cadence(x, step)), "source_hash": bar_ops.in_order(F.col("_rows"))}
    out = bar_ops.with_completeness(one.withColumns(counted).drop("_rows"), recipe.source, recipe.target, session).drop("observed", "expected")
    if recipe.policy == "drop":
        out = out.where("complete")
    elif recipe.policy == "fail":
        out = out.withColumn("complete", F.when(F.col("complete"), True).otherwise(F.raise_error(F.lit("a bucket is not complete")).cast("boolean")))
    made = {"timeframe": recipe.target, "recipe_id": recipe.recipe_id, "recipe_version": recipe.version, "input_snapshot_id": snapshot}
    return out.withColumnRenamed("bucket", "bar_ts").withColumns({k: F.lit(v) for k, v in made.items()})


def bucket_runs(rows: DataFrame, ranges: DataFrame, keys: list[str], recipe: Recipe, session: SessionProfile, most: int = 12) -> DataFrame:
    """Runs of neighbouring target buckets that are ready (all open source stamps seen) or blocked, over the whole buckets of each range.

    A bucket without open stamps is blocked. Ready runs beyond the first ``most`` are ``deferred``: they wait for a later pass.
    """
    step = TIMEFRAMES[recipe.source]
    low, high = bucket_window(F.col("start"), F.col("end"), recipe.target)
    wide = F.expr("interval 1 month" if recipe.target == "1mo" else f"interval {TIMEFRAMES[recipe.target]} second")
    every = F.sequence(low, high - F.expr("interval 1 microsecond"), wide)
    spans = ranges.where(low.isNotNull()).select(*keys, F.explode(every).alias("start")).withColumn("end", next_bucket(F.col("start"), recipe.target))
    asked = coverage.with_expected(written(spans, shared_dir(rows.sparkSession), "buckets"), step, session)
    seen = rows.where(session.is_open(F.col("bar_ts")) & bar_ops.on_cadence(F.col("bar_ts"), step)).select(*keys, "bar_ts").distinct()
    counts = seen.groupBy(*keys, bucket(F.col("bar_ts"), recipe.target).alias("start")).agg(F.count("*").alias("observed"))
    ready = (F.col("expected") > 0) & (F.coalesce("observed", F.lit(0)) == F.col("expected"))
    of = asked.join(counts, [*keys, "start"], "left").select(*keys, "start", "end", ready.alias("ready"))
    w = Window.partitionBy(*keys).orderBy("start")  # over buckets, not stamps
    new = F.coalesce(((F.col("ready") != F.lag("ready").over(w)) | (F.lag("end").over(w) != F.col("start"))).cast("int"), F.lit(1))
    marked = of.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    runs = marked.groupBy(*keys, "_run", "ready").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("buckets"))
    rank = F.row_number().over(Window.partitionBy(*keys, "ready").orderBy("start")).cast("long")
    return runs.withColumn("rank", rank).select(*keys, "ready", "start", "end", "buckets", "rank", (F.col("ready") & (F.col("rank") > most)).alias("deferred"))


def plan(requests: DataFrame, published: DataFrame, keys: list[str], target: str, opens: Column) -> DataFrame:
    """What to do with each requested window (keys, start, end): not_ready without whole buckets, skipped when closed, already_materialized inside published ranges, else planned."""
    low, high = bucket_window(F.col("start"), F.col("end"), target)
    rows = requests.withColumns({"low": low, "high": high, "opens": opens})
    whole = rows.where("low is not null").select(*keys, F.col("low").alias("start"), F.col("high").alias("end")).distinct()
    done = windows.contained(whole, published, keys, []).select(*keys, F.col("start").alias("low"), F.col("end").alias("high"), F.lit(True).alias("done")).distinct()
    marked = rows.join(done, [*keys, "low", "high"], "left")
    state = F.when(F.col("low").isNull(), "not_ready").when(~F.col("opens"), "skipped").when(F.col("done"), "already_materialized").otherwise("planned")
    return marked.select(*keys, "start", "end", "low", "high", state.alias("state"))


def parity(stored: DataFrame, again: DataFrame, keys: list[str], snapshot: str) -> DataFrame:
    """Findings of stored derived bars against their derivation: missing outputs, drifted lineage and differing prices."""
    made = again.select(*keys, F.lit(True).alias("made"), *[F.col(c).alias(f"_{c}") for c in ("open", "high", "low", "close")])
    both = made.join(stored.withColumn("kept", F.lit(True)), keys, "full_outer")
    differs = (F.col("open") != F.col("_open")) | (F.col("high") != F.col("_high")) | (F.col("low") != F.col("_low")) | (F.col("close") != F.col("_close"))
    code = F.when(F.col("kept").isNull(), "parity_missing_outputs").when(F.col("made").isNull(), "parity_extra_outputs").when(~F.col("input_snapshot_id").eqNullSafe(snapshot), "lineage_drift").when(differs, "parity_difference")
    return both.select(*keys, code.alias("code")).where("code is not null")


Normalizer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Connector:
    """A provider: where its payloads lie, and how they become bars; ``fetch_bars`` takes a job's selector and half-open range."""

    provider: str
    payloads: Callable[[dict], DataFrame]
    normalize: Normalizer

    def fetch_bars(self, job: dict) -> DataFrame:
        rows = versions.selector(self.normalize(self.payloads(job)), {k: v for k, v in job.items() if k not in ("start", "end")})
        return rows.where(versions.in_range("bar_ts", F.lit(job["start"]).cast("timestamp"), F.lit(job["end"]).cast("timestamp"))).withColumn("provider", F.lit(self.provider))


CONNECTORS: dict[str, Connector] = {}


def register_connector(connector: Connector) -> Connector:
    CONNECTORS[connector.provider] = connector
    return connector


def bars(spark, path: str, schema, wanted: dict[str, object] | None = None, start=None, end=None) -> DataFrame:
    """Current bars of a folder of parts, of one selector and half-open range."""
    rows = versions.selector(spark.read.schema(schema).parquet(path), wanted or {})
    if start is not None and end is not None:
        rows = rows.where(versions.in_range("bar_ts", start, end))
    return versions.current_bars(rows)


def observations(spark, path: str, schema, tie: str, asof=None) -> DataFrame:
    """Current observations of a folder, or those visible at an instant."""
    rows = spark.read.schema(schema).parquet(path)
    if asof is None:
        return versions.current_observations(rows, tie)
    return versions.observed_at(rows, asof, tie)
