"""Bars from ticks and from finer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import TIMEFRAMES, SessionProfile, bucket, next_bucket
from tidemark.operators import coverage
from tidemark.sources.storage import shared_dir, written

SERIES = ("provider", "asset_class", "symbol")


def sum_or_null(column: str) -> Column:
    """A sum that is null if any input is null."""
    return F.when(F.bool_or(F.col(column).isNull()), F.lit(None)).otherwise(F.sum(column))


def tick_bars(ticks: DataFrame, timeframe: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """First, highest, lowest and last bid and the volume of each bucket that has ticks."""
    at = F.struct("ts", "event_id")
    return ticks.groupBy(*keys, bucket(F.col("ts"), timeframe).alias("bar_ts")).agg(
        F.min_by("bid", at).alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"), F.max_by("bid", at).alias("close"), F.sum("volume").cast("double").alias("volume")
    )


def rolled() -> list[Column]:
    """A coarser bar's prices, volume (null if any input's is), newest ingestion and number of inputs."""
    return [
        F.min_by("open", "bar_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_ts").alias("close"),
        sum_or_null("volume").alias("volume"), F.max("ingest_ts").alias("ingest_ts"), F.count("*").alias("n_source"),
    ]


def rollup(bars: DataFrame, timeframe: str, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Coarser bars."""
    return bars.groupBy(*keys, bucket(F.col("bar_ts"), timeframe).alias("bucket")).agg(*rolled())


def on_cadence(ts: Column, step: int) -> Column:
    return F.unix_micros(ts) % (step * 1_000_000) == 0


def with_completeness(buckets: DataFrame, source: str, target: str, session: SessionProfile | None) -> DataFrame:
    """Buckets (bucket, observed, regular) with ``expected`` and ``complete``: all open stamps of the source are there, and no others."""
    rows = buckets.withColumns({"start": F.col("bucket"), "end": next_bucket(F.col("bucket"), target)})
    if session is not None:
        rows = written(rows, shared_dir(buckets.sparkSession), "buckets")
    out = coverage.with_expected(rows, TIMEFRAMES[source], session).drop("start", "end")
    return out.withColumn("complete", (F.col("observed") == F.col("expected")) & F.col("regular")).drop("regular")


def completeness(bars: DataFrame, source: str, target: str, keys: tuple[str, ...] = SERIES, require_contiguous: bool = False, session: SessionProfile | None = None) -> DataFrame:
    """For each target bucket with bars: observed and expected source stamps, and whether both are the same set.

    With a session, bars of closed hours are counted apart (closed), and expected are the bucket's stamps inside the session;
    without one, all of its stamps. A bucket that has bars of closed hours alone is returned and never complete. A stamp off
    the source's cadence makes a bucket incomplete. With ``require_contiguous`` neighbours also have to be exactly one step apart.
    """
    step = TIMEFRAMES[source]
    inside = F.lit(True) if session is None else session.is_open(F.col("ts"))
    seen = bars.select(*keys, F.col("bar_ts").alias("ts")).distinct().withColumns({"open": inside, "bucket": bucket(F.col("ts"), target)})
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy(*keys, "bucket", "open").orderBy("ts")))
    rows = seen.withColumn("gap", F.when(F.col("open"), gap)) if require_contiguous else seen.withColumn("gap", F.lit(None).cast("long"))
    regular = F.coalesce(F.bool_and(F.when(F.col("open"), on_cadence(F.col("ts"), step))), F.lit(True)).alias("regular")
    counts = rows.groupBy(*keys, "bucket").agg(F.count_if("open").alias("observed"), F.count_if(~F.col("open")).alias("closed"), regular, F.coalesce(F.bool_and(F.col("gap") == step), F.lit(True)).alias("contiguous"))
    out = with_completeness(counts, source, target, session)
    return out.withColumn("complete", F.col("complete") & F.col("contiguous") & (F.col("observed") > 0))


def _quoted(hashes: Column) -> Column:
    return F.concat(F.lit('["'), F.array_join(hashes, '","'), F.lit('"]'))


def in_order(rows: Column) -> Column:
    """The hash of the source hashes of (bar_ts, source_hash), in time order."""
    return F.sha2(_quoted(F.transform(F.array_sort(rows), lambda x: x.source_hash)), 256)


def lineage(bars: DataFrame, timeframe: str, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """For each bucket the hash of its source hashes in time order, and the digest of the distinct ones."""
    distinct = F.array_sort(F.collect_set("source_hash"))
    return bars.groupBy(*keys, bucket(F.col("bar_ts"), timeframe).alias("bucket")).agg(
        in_order(F.collect_list(F.struct("bar_ts", "source_hash"))).alias("lineage_hash"), F.size(distinct).cast("long").alias("hash_count"), F.sha2(_quoted(distinct), 256).alias("hash_digest"), F.min("source_hash").alias("first_hash"), F.max("source_hash").alias("last_hash")
    )
