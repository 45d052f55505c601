"""Reads of competing versions: current state, points in time, and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import each_number, in_days, running
from tidemark.sources.storage import shared_dir, written

FOREVER = "9999-12-31 23:59:59"  #: where a validity without an end is put
BAR_KEYS = ("provider", "asset_class", "symbol", "timeframe", "bar_ts")


def ranked_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; row limits reach below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def current_bars(bars: DataFrame, keys: tuple[str, ...] = BAR_KEYS) -> DataFrame:
    """One row for each key: the latest ingested, ties by the greatest source hash."""
    return ranked_first(bars, list(keys), [F.col("ingest_ts").desc_nulls_last(), F.col("source_hash").desc_nulls_last()])


def current_observations(obs: DataFrame, tie: str) -> DataFrame:
    """One row for each series and date: known vintages first, the latest vintage, then the latest as-of time."""
    order = [F.col("vintage_start").isNotNull().desc(), F.col("vintage_start").desc_nulls_last(), F.col("asof_ts").desc_nulls_last(), F.col(tie).desc()]
    return ranked_first(obs, ["series_id", "observation_date"], order)


def visible_from() -> Column:
    """The first instant at which an observation is public; null for unknown policies, which never are."""
    lag = F.coalesce("availability_lag_days", F.lit(0))
    policy = F.when(F.col("availability_policy") == "vintage", F.date_add("vintage_start", lag).cast("timestamp"))
    policy = policy.when(F.col("availability_policy") == "release", F.col("release_ts") + F.make_dt_interval(lag))
    return F.when(policy.isNotNull() & F.col("asof_ts").isNotNull(), F.greatest(policy, F.col("asof_ts")))


def vintage_order(tie: str) -> Column:
    """What ranks the versions of one observation that are public: vintage or release, then as-of time, then the tie."""
    first = F.when(F.col("availability_policy") == "vintage", F.col("vintage_start").cast("timestamp")).otherwise(F.col("release_ts"))
    return F.struct(first.alias("o1"), F.col("asof_ts").alias("o2"), F.col(tie).alias("o3"))


def observed_at(obs: DataFrame, instant, tie: str) -> DataFrame:
    """The latest version of each observation that is public at one instant."""
    seen = obs.where(visible_from() <= F.lit(instant).cast("timestamp"))
    return ranked_first(seen, ["series_id", "observation_date"], [vintage_order(tie).desc()])


def validity(obs: DataFrame, tie: str) -> DataFrame:
    """Versions with the half-open interval (valid_from, valid_to) in which each is the latest public one of its observation.

    A version counts from where it is public, if it outranks all that were public before, to where the next such one is; of
    those public from one instant on the highest counts. Without a later one ``valid_to`` is null.
    """
    row = F.struct(*[F.col(c) for c in obs.columns])
    keys = ["series_id", "observation_date"]
    seen = obs.select(*keys, visible_from().alias("valid_from"), vintage_order(tie).alias("_o"), row.alias("_row")).where("valid_from is not null")
    one = seen.groupBy(*keys, "valid_from").agg(F.max_by("_row", "_o").alias("_row"), F.max("_o").alias("_o"))
    w = Window.partitionBy(*keys).orderBy("valid_from")  # over the versions of one observation
    best = F.max("_o").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = one.withColumn("_best", best).where(F.col("_best").isNull() | (F.col("_o") > F.col("_best")))
    return kept.withColumn("valid_to", F.lead("valid_from").over(w)).select("_row.*", "valid_from", "valid_to")


def observed_asof(obs: DataFrame, instants: DataFrame, tie: str) -> DataFrame:
    """For each instant of a table (asof), the latest public version of each observation.

    Instants and the ends of the versions' validity are merged in one sweep, which numbers the instants; a version then has a
    run of numbers and meets the instants by equality. Work is linear in versions, instants and what is returned.
    """
    marks = instants.select(F.col("asof").cast("timestamp").alias("_t")).where("_t is not null").distinct()
    rows = validity(obs, tie).select(F.monotonically_increasing_id().alias("_id"), F.struct(*[F.col(c) for c in obs.columns]).alias("_row"), "valid_from", "valid_to")
    ends = F.array(F.struct(F.col("valid_from").alias("t"), F.lit(True).alias("first")), F.struct(F.coalesce("valid_to", F.lit(FOREVER).cast("timestamp")).alias("t"), F.lit(False).alias("first")))
    asked = rows.select("_id", "_row", F.explode(ends).alias("_e")).select(F.col("_e.t").alias("_t"), F.lit(0).alias("_kind"), "_id", F.when(F.col("_e.first"), F.col("_row")).alias("_row"), F.col("_e.first").alias("_first"))
    # an instant at an end comes after it: it sees what begins there and no longer what ends there
    parts = in_days(asked.unionByName(marks.withColumn("_kind", F.lit(1)), allowMissingColumns=True), "_t")
    swept = running(parts, [], ["_t", "_kind"], {"_n": ("sum", F.col("_kind").cast("long"))})
    numbers = swept.where("_kind = 1").select(F.col("_n").alias("_at"), F.col("_t").alias("asof"))
    spans = swept.where("_kind = 0").groupBy("_id").agg((F.max(F.when(F.col("_first"), F.col("_n"))) + 1).alias("_low"), F.max(F.when(~F.col("_first"), F.col("_n"))).alias("_high"), F.first("_row", ignorenulls=True).alias("_row"))
    names = [F.col(f"_row.{c}").alias(c) for c in obs.columns]
    flat = spans.select("_low", "_high", *names)  # Spark 4.1 can't bind a struct's fields behind two generators
    return each_number(flat, "_low", "_high", "_at").join(numbers, "_at").select("asof", *obs.columns)


def asof_totals(obs: DataFrame, instants: DataFrame, tie: str, keys: list[str], sums: dict[str, Column], greatest: dict[str, Column]) -> DataFrame:
    """For each key and instant of a table (key columns, asof): sums and maxima over what is public then, and its number n.

    A version adds where its validity begins and takes away where it ends; both run on over the instants between them, so no
    version is given to any instant. Maxima may only be of what all versions of an observation share, as it stays public.
    """
    rows = validity(obs, tie)
    sums = {"n": F.lit(1).cast("long"), **sums}
    begin = [*[v.alias(k) for k, v in sums.items()], *[v.alias(k) for k, v in greatest.items()]]
    end = [*[(-v).alias(k) for k, v in sums.items()], *[v.alias(k) for k, v in greatest.items()]]
    moves = rows.select(*keys, F.col("valid_from").alias("_t"), *begin).unionByName(rows.where("valid_to is not null").select(*keys, F.col("valid_to").alias("_t"), *end))
    moves = moves.groupBy(*keys, "_t").agg(*[F.sum(k).alias(k) for k in sums], *[F.max(k).alias(k) for k in greatest]).withColumn("_kind", F.lit(0))
    marks = instants.select(*keys, F.col("asof").cast("timestamp").alias("_t")).where("_t is not null").distinct().withColumn("_kind", F.lit(1))
    parts = in_days(moves.unionByName(marks, allowMissingColumns=True), "_t")
    totals = {**{k: ("sum", F.coalesce(F.col(k), F.lit(0))) for k in sums}, **{k: ("max", F.col(k)) for k in greatest}}
    renamed = {f"_r_{k}": v for k, v in totals.items()}
    swept = running(parts, keys, ["_t", "_kind"], renamed).where("_kind = 1 and _r_n > 0")
    return swept.select(*keys, F.col("_t").alias("asof"), *[F.col(f"_r_{k}").alias(k) for k in totals])


def in_range(ts: str, start, end) -> Column:
    """Half-open range of bars."""
    return (F.col(ts) >= start) & (F.col(ts) < end)


def selector(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows equal to a selector; keys that the rows lack are ignored."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), ((k, v) for k, v in wanted.items() if k in df.columns), df)


def after(keys: list[str], values: list) -> Column:
    """Row-value comparison with the last key of the page before."""
    return F.struct(*keys) > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, values, strict=True)])


def derived_rows(df: DataFrame, recipe_id: str, recipe_version: str, wanted: dict[str, object] | None = None) -> DataFrame:
    """Rows of one recipe and version; both have to be named, so that bars of different recipes are never mixed."""
    if not recipe_id or not recipe_version:
        raise ValueError("derived bars are read by recipe_id and recipe_version")
    return selector(df.where((F.col("recipe_id") == recipe_id) & (F.col("recipe_version") == recipe_version)), wanted or {})


def page(df: DataFrame, keys: list[str], size: int, last: list | None = None) -> DataFrame:
    """A page of at most ``size`` rows after ``last`` by key order, with ``has_more``; one row beyond decides on that.

    The bound on the first key alone says nothing new, but it is one that Spark can push below rankings and into the scan.
    """
    if not 1 <= size <= 10_000:
        raise ValueError("a page has 1 to 10000 rows")
    rows = df.where((F.col(keys[0]) >= F.lit(last[0])) & after(keys, last)) if last is not None else df
    got = rows.orderBy(*keys).limit(size + 1)
    w = Window.partitionBy(F.lit(1)).orderBy(*keys)  # over size + 1 rows
    return got.withColumn("_k", F.row_number().over(w)).withColumn("has_more", F.max("_k").over(Window.partitionBy(F.lit(1))) > size).where(F.col("_k") <= size).drop("_k")


def pages(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """All pages of one fixed set of rows: each row with the number of its page, from 0; ``df`` is read once.

    Rows are written in ranges of the keys and numbered by these, so no task holds more than one range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged.withColumn("_part", F.shiftright("_at", 33)), shared_dir(df.sparkSession), "pages")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_k"))  # a row for each range
    before = sizes.select("_part", (F.sum("_k").over(Window.orderBy("_part")) - F.col("_k")).alias("_before"))
    place = F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)
    return ranged.join(F.broadcast(before), "_part").withColumn("page", F.floor(place / size).cast("long")).drop("_at", "_part", "_before")


def scan_counts(df: DataFrame, condition: Column) -> DataFrame:
    """One row: how many rows a query looks at and how many match; a sum beside the page, not a window over all rows."""
    return df.agg(F.count("*").alias("rows_scanned"), F.count_if(condition).alias("matched"))


def two_phase_page(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The same rows as the first page, with keys read first and wide rows only up to the last key, which one row tells."""
    bound = df.select(*keys).orderBy(*keys).limit(size).agg(F.max(F.struct(*keys)).alias("bound")).first().bound
    if bound is None:
        return df.limit(0)
    last = F.struct(*[F.lit(bound[k]).alias(k) for k in keys])
    return df.where((F.col(keys[0]) <= F.lit(bound[keys[0]])) & (F.struct(*keys) <= last))
