"""Rows in ranges of an order, and totals that run on from range to range, so that no key is gathered in one task.

Stamps have runs of days as their ranges, which need no look at the rows; any other order is written in ranges of its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import shared_dir, written

MANY = 256  #: days of a range where rows of many keys have few of them each
STRIDE = 65_536  #: numbers of a long row of numbers that are made at a time


def in_ranges(df: DataFrame, keys: list[str], order: list[str], name: str = "ranges") -> DataFrame:
    """``df`` written in ranges of its keys and an order, with ``_part``: all rows of a lower part come first.

    Rows that are equal in all of these may lie in several parts.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys, *order, "_tie").drop("_tie")
    return written(dealt.withColumn("_part", F.spark_partition_id()), shared_dir(df.sparkSession), name)


def in_days(df: DataFrame, ts: str, days: int = 1) -> DataFrame:
    """``df`` with a stamp's day, or the run of so many days that it lies in, as its ``_part``."""
    return df.withColumn("_part", F.floor(F.unix_date(F.to_date(ts)) / days))


def running(parts: DataFrame, keys: list[str], order: list[str], totals: dict[str, tuple[str, Column]], before: bool = False, peers: bool = False) -> DataFrame:
    """``parts`` with totals ('sum' or 'max' of a column) over the key's rows up to each row, or with ``before`` up to the row ahead of it.

    With ``peers`` rows of the same place count for each other, so that their totals are the same. A range has its own running totals; what comes from the ranges before it is one row for each key and range.
    """
    of = {"sum": F.sum, "max": F.max}
    here = Window.partitionBy(*keys, "_part").orderBy(*order)
    here = here.rangeBetween(Window.unboundedPreceding, Window.currentRow) if peers else here.rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.groupBy(*keys, "_part").agg(*[of[how](c).alias(f"_{k}_part") for k, (how, c) in totals.items()])
    whole = whole.select(*keys, "_part", *[of[how](f"_{k}_part").over(ahead).alias(f"_{k}_ahead") for k, (how, _) in totals.items()])
    rows = parts.select("*", *[of[how](c).over(here).alias(f"_{k}_here") for k, (how, c) in totals.items()])
    rows = rows.join(whole if keys else F.broadcast(whole), [*keys, "_part"])  # without keys, one row for each range
    zero = F.lit(0)
    both = {k: F.coalesce(f"_{k}_ahead", zero) + F.coalesce(f"_{k}_here", zero) if how == "sum" else F.greatest(f"_{k}_ahead", f"_{k}_here") for k, (how, _) in totals.items()}
    return rows.withColumns(both).drop(*[f"_{k}_{x}" for k in totals for x in ("ahead", "here")])


def previous(parts: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``parts`` with the value of the key's row ahead, also where that lies in an earlier range."""
    last = parts.groupBy(*keys, "_part").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    last = last.select(*keys, "_part", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_entry"))
    here = Window.partitionBy(*keys, "_part").orderBy(*order)
    rows = parts.withColumns({"_here": F.lag(value).over(here), "_first": F.row_number().over(here) == 1})
    return rows.join(last, [*keys, "_part"]).withColumn(name, F.when(F.col("_first"), F.col("_entry")).otherwise(F.col("_here"))).drop("_here", "_entry", "_first", "_part")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row in its key's order, from 0; the order begins with a stamp."""
    rows = running(in_days(df, order[0], MANY), keys, order, {name: ("sum", F.lit(1))})
    return rows.withColumn(name, F.col(name) - 1).drop("_part")


def each_number(df: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """A row for each whole number from ``low`` to ``high``, none where that is lower; long ones are made piece by piece."""
    rows = df.where(F.col(low) <= F.col(high)).withColumn("_from", F.explode(F.sequence(F.col(low), F.greatest(low, high), F.lit(STRIDE).cast("long"))))
    return rows.withColumn(name, F.explode(F.sequence("_from", F.least(F.col("_from") + STRIDE - 1, F.col(high))))).drop("_from")


def quantiles(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The interpolated quantile of each key's values, exact, with their number (n); nulls don't count.

    Values are written in ranges of (key, value) and counted there, which tells the two ranges that hold the places sought;
    only those are numbered, so no buffer holds the values of a key.
    """
    rows = in_ranges(df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null"), keys, ["_v"], "quantiles")
    counts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))  # a row for each key and range
    ahead, whole = Window.partitionBy(*keys).orderBy("_part"), Window.partitionBy(*keys)
    counts = counts.withColumns({"_before": F.sum("_n").over(ahead) - F.col("_n"), "n": F.sum("_n").over(whole)})
    place = F.lit(float(share)) * (F.col("n") - 1)
    wanted = counts.withColumns({"_low": F.floor(place), "_high": F.ceil(place), "_weight": place - F.floor(place)})
    inside = lambda c: (F.col(c) >= F.col("_before")) & (F.col(c) < F.col("_before") + F.col("_n"))
    wanted = wanted.where(inside("_low") | inside("_high")).drop("_n")
    at = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_v")) - 1
    wanted = wanted.select(F.struct(*keys).alias("_key"), F.col("_part").alias("_in"), "_before", "_low", "_high", "_weight", "n")  # null keys have quantiles as well
    # there are no more parts than ranges, however many rows or keys: these are sent to all tasks, and rows never
    near = rows.join(F.broadcast(wanted.select(F.col("_in").alias("_part")).distinct()), "_part", "left_semi")
    found = near.hint("merge").join(wanted, (F.col("_in") == F.col("_part")) & F.struct(*keys).eqNullSafe(F.col("_key"))).withColumn("_at", at).where("_at = _low or _at = _high")
    low, high = F.max(F.when(F.col("_at") == F.col("_low"), F.col("_v"))), F.max(F.when(F.col("_at") == F.col("_high"), F.col("_v")))
    return found.groupBy(*keys).agg((low + (high - low) * F.max("_weight")).alias("quantile"), F.max("n").alias("n"))
