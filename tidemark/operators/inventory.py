"""Inventories of files and series: counts, gaps, migration decisions and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import capacity_class
from tidemark.functions.time import timeframe_seconds
from tidemark.operators import coverage


def inventory(rows: DataFrame, keys: list[str], ts: str, timeframe: str = "timeframe", price_type: str = "price_type") -> DataFrame:
    """Rows, doubled stamps, first and last stamp, price types, gaps beyond the timeframe's cadence and the longest distance of each series."""
    steps = coverage.steps(rows, keys, ts, timeframe)
    gaps = steps.groupBy(*keys).agg(F.count_if(F.col("seconds") > timeframe_seconds(F.col(timeframe))).alias("gaps"), F.max("seconds").alias("longest_gap_s"))
    base = rows.groupBy(*keys).agg(F.count("*").alias("row_count"), (F.count("*") - F.count_distinct(ts)).alias("duplicates"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.array_sort(F.collect_set(price_type)).alias("price_types"))
    return base.join(gaps, keys, "left")


def migration_decision(start: Column, end: Column, free_ratio: Column, provenance: Column, price_types: Column, duplicates: Column, invalid: Column) -> Column:
    """The first of seven gates that an item and its window of days fail, or that all pass. An unknown capacity stops nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0)) != 0
    only_bid = F.coalesce(F.array_except(price_types, F.array(F.lit("bid"))) == F.array().cast("array<string>"), F.lit(False)) & F.array_contains(price_types, "bid")
    return (
        F.when(end <= start, "invalid_window").when(F.datediff(end, start) > 31, "window_exceeds_31_days")
        .when(free_ratio.isNotNull() & (capacity_class(free_ratio) != "ok"), "capacity_not_ok").when(~F.coalesce(provenance, F.lit(False)), "bid_provenance_unconfirmed")
        .when(~only_bid, "legacy_price_basis_not_bid").when(zero(duplicates), "duplicate_timestamps").when(zero(invalid), "invalid_timestamps").otherwise("all_migration_gates_pass")
    )


ATTESTED = ("basis", "method", "attested_by", "attested_at")  #: what an attestation has to say


def attestation_state() -> Column:
    """Whether a row's attestation is complete and of bid prices."""
    lacking = reduce(lambda a, b: a | b, [F.col(c).isNull() | (F.trim(c) == "") for c in ATTESTED])
    return F.when(lacking, "incomplete").when(F.col("basis") != "bid", "basis_not_bid").otherwise("attested")


def attestation(keys: list[str]) -> Column:
    """Hash of a series' identity and all that its attestation says; null unless that is complete and of bid prices."""
    return F.when(attestation_state() == "attested", F.sha2(F.concat_ws("|", *keys, *ATTESTED), 256))


def unlisted(files: DataFrame, manifest_parts: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(files in no manifest, files in one)."""
    return files.join(manifest_parts.select(path), path, "left_anti"), files.join(manifest_parts.select(path), path, "left_semi")


def new_parts(parts: DataFrame, remembered: DataFrame, path: str = "path") -> DataFrame:
    """Parts that are not remembered yet. At first sight, with nothing remembered, all are the baseline and none is new."""
    fresh = parts.join(remembered.select(path).distinct(), path, "left_anti")
    return fresh if not remembered.isEmpty() else fresh.limit(0)
