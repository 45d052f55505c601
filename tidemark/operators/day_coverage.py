"""Coverage kept by days: each day's state is made once from that day's bars, and states are put together when read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.time import SessionProfile
from tidemark.operators import coverage
from tidemark.sources.storage import shared_dir, written

RUNS = "array<struct<low:bigint,high:bigint>>"


def day_states(bars: DataFrame, keys: list[str], ts: str, step: int, session: SessionProfile | None) -> DataFrame:
    """One row for each series and day that has bars: (keys, day, row_count, stamps, min_ts, max_ts, runs).

    ``runs`` are the runs of the day's open stamps that were seen, as places among its open stamps from 0 (low, high without
    its end): all that coverage of any range can ask of the day. Rows without a stamp count for nothing.
    """
    stamps = bars.where(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("ts")).agg(F.count("*").alias("k"))
    cal = coverage.calendar(stamps.select(F.col("ts").alias("start"), F.col("ts").alias("end")), step, session)
    rows = coverage.with_ordinal(stamps, cal.withColumn("before", F.lit(0).cast("long")), "ts", step, "o", "open").withColumn("day", F.to_date("ts"))
    whole = rows.groupBy(*keys, "day").agg(F.sum("k").alias("row_count"), F.count("*").alias("stamps"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
    nth = F.row_number().over(Window.partitionBy(*keys, "day").orderBy("o"))
    runs = rows.where("open").withColumn("_run", F.col("o") - nth).groupBy(*keys, "day", "_run").agg(F.min("o").alias("low"), (F.max("o") + 1).alias("high"))
    runs = runs.groupBy(*keys, "day").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("runs"))  # of one day
    return whole.join(runs, [*keys, "day"], "left").withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))


def put_days(states: DataFrame, root: str) -> None:
    """Write the states of whole days, all their series, in place of those that are there; no other day is read or written."""
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(root)


def kept_days(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All states below a folder; bounds on ``day`` leave out whole folders."""
    return spark.read.schema(schema).option("basePath", root).parquet(root)


@dataclass
class DayCoverage:
    """Summaries of series, their runs of missing stamps and their ready intervals, as ``coverage.evaluate`` gives them."""

    summary: DataFrame
    gaps: DataFrame  #: keys, start, end, n
    ready: DataFrame  #: keys, start, end, n


def _within(runs: Column, low: Column, high: Column) -> Column:
    """Runs cut to what lies from ``low`` to before ``high``."""
    cut = F.transform(runs, lambda r: F.struct(F.greatest(r["low"], low).alias("low"), F.least(r["high"], high).alias("high")))
    return F.filter(cut, lambda r: r["low"] < r["high"])


def _between(runs: Column, low: Column, high: Column) -> Column:
    """What ordered runs leave of ``low`` to before ``high``: from the end of each to the start of the next."""
    starts = F.concat(F.array(low), F.transform(runs, lambda r: r["high"]))
    ends = F.concat(F.transform(runs, lambda r: r["low"]), F.array(high))
    pairs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("low"), b.alias("high")))
    return F.filter(pairs, lambda r: r["low"] < r["high"])


def _stamped(days: DataFrame, keys: list[str], places: str, step: int) -> DataFrame:
    """Runs of places of a day's open stamps as runs of stamps (keys, start, end, n), put together over days."""
    rows = days.select(*keys, "open_runs", F.explode(places).alias("p")).select(*keys, "p", F.explode("open_runs").alias("r"))
    low, high = F.greatest("p.low", "r.before"), F.least(F.col("p.high"), F.col("r.before") + F.col("r.n"))
    at = lambda c: F.timestamp_seconds(F.col("r.start") + (F.col(c) - F.col("r.before")) * step)
    pieces = rows.withColumns({"_low": low, "_high": high}).where("_low < _high").select(*keys, at("_low").alias("start"), at("_high").alias("end"), (F.col("_high") - F.col("_low")).alias("n"))
    return coverage.joined_runs(pieces, keys)


def merged(states: DataFrame, ranges: DataFrame, keys: list[str], step: int, session: SessionProfile | None, quality: DataFrame | None = None) -> DayCoverage:
    """Coverage of ranges (keys, start, end) from the states of days; equal to evaluating all bars, none of which is read.

    Ranges may begin and end within a day. Work is a row for each series and day.
    """
    root = shared_dir(states.sparkSession)
    spans = ranges.select(*keys, "start", "end").where("start < end").distinct()
    cal = written(coverage.calendar(spans, step, session), root, "calendar")
    days = F.sequence(F.to_date("start"), F.to_date(F.col("end") - F.expr("interval 1 microsecond")), F.expr("interval 1 day"))
    rows = spans.select(*keys, "start", "end", F.explode(days).alias("day"))
    rows = rows.join(F.broadcast(cal.select("day", F.col("runs").alias("open_runs"), F.col("n").alias("_open"))), "day")

    def ahead(instant: str) -> Column:
        """The day's open stamps before an instant."""
        return F.aggregate("open_runs", F.lit(0).cast("long"), lambda n, r: n + F.least(r["n"], F.greatest(F.lit(0).cast("long"), coverage.places_ahead(F.col(instant), r["start"], step))))

    rows = rows.withColumns({"_low": ahead("start"), "_high": ahead("end")})
    rows = rows.join(states.select(*keys, "day", "runs"), [*keys, "day"], "left").withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))
    rows = rows.withColumn("had", _within(F.col("runs"), F.col("_low"), F.col("_high")))
    rows = written(rows.withColumn("lacks", _between(F.col("had"), F.col("_low"), F.col("_high"))).drop("runs"), root, "days")
    gaps, ready = _stamped(rows, keys, "lacks", step), _stamped(rows, keys, "had", step)
    edge = lambda c: F.ceil(F.unix_micros(c) / F.lit(step * 1_000_000)).cast("long")
    every = spans.groupBy(*keys).agg(F.sum(edge("end") - edge("start")).alias("_all"))
    counts = rows.groupBy(*keys).agg(F.sum(F.col("_high") - F.col("_low")).alias("expected")).join(every, keys)
    lacking = gaps.groupBy(*keys).agg(F.sum("n").alias("missing"), F.min("start").alias("first_missing"))
    seen = states.groupBy(*keys).agg(F.sum("row_count").alias("row_count"), (F.sum("row_count") - F.sum("stamps")).alias("duplicates"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))
    return DayCoverage(coverage.summaries(ranges, keys, seen, counts, lacking, quality), gaps, ready)
