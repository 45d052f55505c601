"""Validation rules as rows: violations and findings of bars and observations, digests and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flagged(df: DataFrame, rules: dict[str, Column], out: str = "code") -> DataFrame:
    """A row for each rule that a row breaks; unknown conditions count as kept."""
    codes = F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules.items()]), lambda c: c.isNotNull())
    return df.withColumn(out, F.explode(codes))


def ohlc_inconsistent() -> Column:
    return (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close"))


def bar_violations(bars: DataFrame, keys: list[str], ts: str = "bar_ts") -> DataFrame:
    """Contract violations of bars: doubled keys, null stamps, inconsistent prices, negative volumes."""
    n = F.count("*").over(Window.partitionBy(*keys))
    rules = {"duplicate_key": F.col("_n") > 1, "null_timestamp": F.col(ts).isNull(), "ohlc_inconsistent": ohlc_inconsistent(), "negative_volume": F.col("volume") < 0}
    return flagged(bars.withColumn("_n", n), rules).drop("_n")


def lineage_violations(bars: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    missing = reduce(lambda a, b: a | b, [F.col(f).isNull() | (F.trim(f) == "") for f in fields])
    return flagged(bars, {"lineage_incomplete": missing})


def observation_violations(obs: DataFrame, tie: str, source: str | None = None) -> DataFrame:
    """Doubled vintages, intervals that end before they start, unknown policies and their fields, and lacking fields.

    With ``source``, the column that the second version of the contract requires, blank sources are violations as well.
    """
    w = Window.partitionBy("series_id", "observation_date", "vintage_start").orderBy(tie)
    policy = F.col("availability_policy")
    rules = {
        "duplicate_observation_vintage": F.col("_k") > 1, "invalid_vintage_interval": F.col("vintage_end") < F.col("vintage_start"), "invalid_availability_policy": policy.isNull() | ~policy.isin("vintage", "release", "unknown"),
        "policy_field_missing": ((policy == "vintage") & F.col("vintage_start").isNull()) | ((policy == "release") & F.col("release_ts").isNull()),
        "policy_field_forbidden": (policy == "unknown") & F.col("release_ts").isNotNull(), "required_field_missing": F.col("series_id").isNull() | F.col("observation_date").isNull() | F.col("asof_ts").isNull(),
        "missing_reason_required": F.col("value").isNull() & F.col("missing_reason").isNull(),
    }
    if source is not None:
        rules["source_required"] = F.col(source).isNull() | (F.trim(source) == "")
    return flagged(obs.withColumn("_k", F.row_number().over(w)), rules).drop("_k")


def market_violations(bars: DataFrame, keys: list[str], lineage: tuple[str, ...], ts: str = "bar_ts") -> DataFrame:
    """Contract violations of derived bars: those of bars, and lacking lineage."""
    return bar_violations(bars, keys, ts).unionByName(lineage_violations(bars, lineage))


def empty_series(bars: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Series that ought to have bars and have none: the contract's first rule."""
    return expected.select(*keys).distinct().join(bars.select(*keys).distinct(), keys, "left_anti").withColumn("code", F.lit("empty"))


def row_digest(columns: list[str]) -> Column:
    """Hash of a row's canonical text: fields joined by '|', nulls as a mark of their own."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)


def set_digest(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each key a digest of its rows that no order changes: the number of rows and the sum of their hashes' first 12 digits."""
    part = F.conv(F.substring(row_digest(columns), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(part).cast("string").alias("digest"))


def compared(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full comparison of two row sets: keys that are missing, extra or differ in a field; equal rows are left out."""
    l, r = left.alias("l"), right.alias("r")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    same = reduce(lambda a, b: a & b, [F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")) for f in fields])
    state = F.when(F.col("r._in").isNull(), "missing").when(F.col("l._in").isNull(), "extra").when(~same, "differs")
    both = left.withColumn("_in", F.lit(True)).alias("l").join(right.withColumn("_in", F.lit(True)).alias("r"), on, "full_outer")
    return both.select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], state.alias("state")).where("state is not null")


def equal_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many rows either multiset has beyond the other; one shuffle of both by their rows."""
    both = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    beyond = both.groupBy(*left.columns).agg(F.sum("_n").alias("_n"))
    only = lambda n: F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0))
    return beyond.agg(only(F.col("_n")).alias("only_left"), only(-F.col("_n")).alias("only_right")).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def parity_coverage(source: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """Findings of a parity check from both sides' readiness: derived bars that lack are errors, a source with gaps under complete ones a warning."""
    both = derived.select(*keys, "readiness").join(source.select(*keys, F.col("readiness").alias("below")), keys, "left")
    wrong = both.where("readiness <> 'ready'").select(*keys, F.lit("error").alias("severity"), F.when(F.col("readiness") == "not_ready", "coverage_not_ready").otherwise("coverage_degraded").alias("code"))
    weak = both.where("readiness = 'ready' and below <> 'ready'").select(*keys, F.lit("warning").alias("severity"), F.lit("source_degraded").alias("code"))
    return wrong.unionByName(weak)
