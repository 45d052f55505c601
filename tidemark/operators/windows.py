"""Interval algebra over rows (keys, start, end), half-open: merge, subtract, contain, overlap, shard and plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import bucket, ceil_bucket
from tidemark.operators.ranges import MANY, each_number, in_days, numbered, running
from tidemark.sources.storage import shared_dir, written


def _runs(parts: DataFrame, keys: list[str], order: list[str], start: Column, end: Column) -> DataFrame:
    """``parts`` with ``_reach``, the furthest end of intervals ahead of a row, and ``_run``, the number of merged intervals begun so far."""
    rows = running(parts, keys, order, {"_reach": ("max", end)}, before=True)
    new = (start.isNotNull() & (F.col("_reach").isNull() | (start > F.col("_reach")))).cast("long")
    return running(rows, keys, order, {"_run": ("sum", new)}, peers=True)


def merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Unions of overlapping or touching intervals."""
    parts = in_days(df.select(*keys, "start", "end").where("start < end"), "start", MANY)
    rows = _runs(parts, keys, ["start", "end"], F.col("start"), F.col("end"))
    return rows.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of overlapping intervals of one key, each pair once; the right side's other columns come as r_start, r_end, r_....

    One sweep over the ends of both sides numbers each side's starts and counts the other side's. Of two that overlap, either
    the right one starts within the left one, or the left one after the right one's start and within it: both are a run of
    numbers, so work is linear in intervals and pairs, however long an interval is.
    """

    own = [["start", "end", *[c for c in df.columns if c not in (*keys, "start", "end")]] for df in (left, right)]

    def ends(df: DataFrame, side: int) -> DataFrame:
        """Both ends of each interval as events; its columns stand beside its start."""
        at = F.array(F.struct(F.col("start").alias("t"), F.lit(side).alias("kind")), F.struct(F.col("end").alias("t"), F.lit(0).alias("kind")))
        rows = df.where("start < end").withColumn("_id", F.monotonically_increasing_id()).withColumn("_at", F.explode(at))  # in this order
        columns = [F.when(F.col("_at.kind") > 0, F.col(c)).alias(f"_{side}_{c}") for c in own[side - 1]]
        return rows.select(*keys, "_id", F.lit(side).alias("_side"), F.col("_at.t").alias("_t"), F.col("_at.kind").alias("_kind"), *columns)

    # at one instant ends come first, then left starts, then right starts
    parts = in_days(ends(left, 1).unionByName(ends(right, 2), allowMissingColumns=True), "_t", MANY)
    begun = {f"_n{k}": ("sum", (F.col("_kind") == k).cast("long")) for k in (1, 2)}
    rows = running(parts, keys, ["_t", "_kind"], begun)

    # each interval again: its number among its side's starts, and the first and last of the other side's starts within it
    other = F.when(F.col("_side") == 1, F.col("_n2")).otherwise(F.col("_n1"))
    first, mine = F.col("_kind") > 0, F.when(F.col("_side") == 1, F.col("_n1")).otherwise(F.col("_n2"))
    bounds = [F.max(F.when(first, mine)).alias("_rank"), F.max(F.when(first, other + 1)).alias("_low"), F.max(F.when(~first, other)).alias("_high")]
    columns = [F.first(f"_{k}_{c}", ignorenulls=True).alias(f"_{k}_{c}") for k in (1, 2) for c in own[k - 1]]
    sides = written(rows.groupBy(*keys, "_side", "_id").agg(*bounds, *columns), shared_dir(left.sparkSession), "sides")
    l, r = (sides.where(F.col("_side") == k).select(*keys, "_rank", "_low", "_high", *[f"_{k}_{c}" for c in own[k - 1]]) for k in (1, 2))  # noqa: E741
    of = lambda df, k: df.select(*keys, F.col("_rank").alias("_at"), *[f"_{k}_{c}" for c in own[k - 1]])
    both = [f"_{k}_{c}" for k in (1, 2) for c in own[k - 1]]
    within = each_number(l, "_low", "_high", "_at").join(of(r, 2), [*keys, "_at"]).select(*keys, *both)
    around = each_number(r, "_low", "_high", "_at").join(of(l, 1), [*keys, "_at"]).select(*keys, *both)
    return within.unionByName(around).select(*keys, *[F.col(f"_1_{c}").alias(c) for c in own[0]], *[F.col(f"_2_{c}").alias(f"r_{c}") for c in own[1]])


def subtract(candidates: DataFrame, occupied: DataFrame, keys: list[str], id_cols: list[str]) -> DataFrame:
    """What of each candidate no occupied interval covers, in pieces with ordinals from 0 for each key.

    One sweep over occupied intervals and the candidates' ends tells how many merged intervals have begun at either end: the
    free gaps between them are numbered, and a candidate meets those of its numbers.
    """
    cut, own = ["_t", "_kind"], ["start", "end", *id_cols]
    busy = occupied.where("start < end").select(*keys, F.col("start").alias("_t"), F.lit(1).alias("_kind"), F.col("start").alias("_from"), F.col("end").alias("_to"))
    rows = candidates.where("start < end").select(*keys, F.monotonically_increasing_id().alias("_id"), *own)
    at = F.array(F.struct(F.col("start").alias("t"), F.lit(2).alias("kind")), F.struct(F.col("end").alias("t"), F.lit(0).alias("kind")))
    asked = rows.withColumn("_at", F.explode(at)).select("*", F.col("_at.t").alias("_t"), F.col("_at.kind").alias("_kind")).drop("_at")
    swept = _runs(in_days(busy.unionByName(asked, allowMissingColumns=True), "_t", MANY), keys, cut, F.col("_from"), F.col("_to"))
    swept = written(swept.drop("_part", "_reach"), shared_dir(candidates.sparkSession), "swept")
    runs = swept.where("_kind = 1").groupBy(*keys, "_run").agg(F.min("_from").alias("_until"), F.max("_to").alias("_after"))
    # gap k lies between merged intervals k and k + 1
    none = F.lit(None).cast("timestamp")
    gaps = runs.select(*keys, F.col("_run").alias("_gap"), "_after", none.alias("_until")).unionByName(runs.select(*keys, (F.col("_run") - 1).alias("_gap"), none.alias("_after"), "_until"))
    gaps = gaps.groupBy(*keys, "_gap").agg(F.max("_after").alias("_after"), F.max("_until").alias("_until"))
    kind = lambda k, c: F.max(F.when(F.col("_kind") == k, F.col(c)))
    spans = swept.where("_kind <> 1").groupBy(*keys, "_id").agg(kind(2, "_run").alias("_low"), kind(0, "_run").alias("_high"), *[F.first(c).alias(c) for c in own])
    met = each_number(spans, "_low", "_high", "_gap").join(gaps, [*keys, "_gap"], "left")
    low, high = F.greatest("start", "_after"), F.least("end", "_until")  # greatest() and least() pass over nulls
    out = met.select(*keys, *id_cols, low.alias("start"), high.alias("end")).where("start < end")
    return numbered(out, keys, ["start", "end", *id_cols], "ordinal")


def contained(requests: DataFrame, intervals: DataFrame, keys: list[str], id_cols: list[str]) -> DataFrame:
    """Requests that lie wholly inside one interval: the furthest end of those that have begun tells, and nothing is paired."""
    some = intervals.where("start < end").select(*keys, F.col("start").alias("_t"), F.lit(0).alias("_kind"), F.col("end").alias("_to"))
    asked = requests.select(*keys, *id_cols, "start", "end", F.col("start").alias("_t"), F.lit(1).alias("_kind"))
    parts = in_days(some.unionByName(asked, allowMissingColumns=True), "_t", MANY)
    rows = running(parts, keys, ["_t", "_kind"], {"_reach": ("max", F.col("_to"))})
    return rows.where("_kind = 1 and end <= _reach").select(*keys, *id_cols, "start", "end")


def sharded(df: DataFrame, keys: list[str], step: str | Column) -> DataFrame:
    """Intervals in shards of at most ``step`` (such as '2 days', or a column of day intervals), with ordinals from 0 for each key."""
    wide = F.expr(f"interval {step}") if isinstance(step, str) else step
    rows = df.where("start < end").withColumn("_wide", wide)
    parts = rows.select(*keys, "end", "_wide", F.explode(F.sequence(F.col("start"), F.col("end") - F.expr("interval 1 microsecond"), F.col("_wide"))).alias("s"))
    parts = parts.select(*keys, F.col("s").alias("start"), F.least(F.col("end"), F.col("s") + F.col("_wide")).alias("end"))
    w = Window.partitionBy(*keys).orderBy("start", "end")
    return parts.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long"))


def clamped(df: DataFrame, limits: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Shards no longer than the least of a policy's and a provider's days (limits: by, policy_days, capability_days), each a window of its own."""
    rows = df.join(limits, by, "left")
    days = F.greatest(F.lit(1), F.coalesce(F.least("policy_days", "capability_days"), F.lit(1)))  # least() passes over nulls
    return sharded(rows, keys, F.make_dt_interval(days.cast("int")))


def recompute(df: DataFrame, timeframe: str, lookback: str | None = None) -> DataFrame:
    """Intervals widened to whole target buckets, and by a lookback before them."""
    low = bucket(F.col("start") - F.expr(f"interval {lookback}") if lookback else F.col("start"), timeframe)
    return df.withColumns({"start": low, "end": ceil_bucket(F.col("end"), timeframe)})


def split_at(df: DataFrame, instant: str, step: int) -> DataFrame:
    """A failed window as what precedes its first missing stamp, that stamp's step, and what follows; empty parts vanish."""
    after = F.least(F.col(instant) + F.expr(f"interval {step} second"), F.col("end"))
    parts = F.array(F.struct(F.col("start").alias("s"), F.col(instant).alias("e"), F.lit("before").alias("part")), F.struct(F.col(instant).alias("s"), after.alias("e"), F.lit("missing").alias("part")), F.struct(after.alias("s"), F.col("end").alias("e"), F.lit("after").alias("part")))
    return df.withColumn("_p", F.explode(parts)).where("_p.s < _p.e").withColumns({"start": F.col("_p.s"), "end": F.col("_p.e"), "part": F.col("_p.part")}).drop("_p")


def debt_merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Gap debt after new findings: the greater number of attempts, the new review time where there is one."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    return o.join(n, on, "full_outer").select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], F.greatest("o.attempts", "n.attempts").alias("attempts"), F.coalesce("n.next_review", "o.next_review").alias("next_review"))


def resolved(debt: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Debt without what lies wholly inside a window that is done; debt has the columns keys, start, end and others."""
    held = contained(debt, done, keys, []).distinct()
    return debt.join(held, [*keys, "start", "end"], "left_anti")


def due(debt: DataFrame, now: Column) -> DataFrame:
    """Debt to be reviewed: never put off, or put off until now at the latest."""
    return debt.where(F.col("next_review").isNull() | (F.col("next_review") <= now))


def put_off(debt: DataFrame, now: Column) -> DataFrame:
    """Debt whose review is still to come: its windows are in their cooldown."""
    return debt.where(F.col("next_review") > now)


def check_execution(df: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs' windows (start, end, ordinal, job_start, job_end, gap_repair): which rule each job breaks, if any."""
    w = Window.partitionBy(*keys).orderBy("ordinal", "start")
    rows = df.withColumns({"_prev": F.lag("end").over(w), "_k": F.row_number().over(w) - 1})
    out = rows.groupBy(*keys).agg(
        F.bool_or((F.col("start") < F.col("job_start")) | (F.col("end") > F.col("job_end"))).alias("outside"), F.bool_or(F.col("start") >= F.col("end")).alias("empty"),
        F.bool_or(F.coalesce(F.col("start") < F.col("_prev"), F.lit(False))).alias("disordered"), F.bool_or(F.col("ordinal") != F.col("_k")).alias("ordinals"),
        (~F.bool_or("gap_repair") & ((F.min("start") > F.min("job_start")) | (F.max("end") < F.max("job_end")) | F.bool_or(F.coalesce(F.col("start") > F.col("_prev"), F.lit(False))))).alias("uncovered"),
    )
    return out.withColumn("valid", ~(F.col("outside") | F.col("empty") | F.col("disordered") | F.col("ordinals") | F.col("uncovered")))


def budgeted(df: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """The first windows of each key by priority, start, end and all other columns, up to a budget, and whether any were left out."""
    w = Window.partitionBy(*keys).orderBy("priority", "start", "end", *[c for c in df.columns if c not in (*keys, "priority", "start", "end")])
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumns({"rank": F.row_number().over(w).cast("long"), "truncated": n > budget}).where(F.col("rank") <= budget)


def gap_debt(failed: DataFrame, ready: DataFrame, keys: list[str], id_cols: list[str]) -> DataFrame:
    """What failed runs still owe: (keys, ids, start, end).

    ``failed`` has the windows of each run's plan and ``error``: a provider's gap owes its whole windows, a coverage finding
    what no ready interval of the key covers; other failures, of which nothing about the data is known, owe nothing.
    Windows without a length owe nothing either.
    """
    rows = failed.where("start < end")
    whole = rows.where("error = 'gap'").select(*keys, *id_cols, "start", "end")
    rest = subtract(rows.where("error = 'coverage'").select(*keys, *id_cols, "start", "end"), ready, keys, id_cols).drop("ordinal")
    return whole.unionByName(rest).distinct()


def cooling(debt: DataFrame, finished: str, now: Column, minutes: int) -> DataFrame:
    """The debt of runs that ended so shortly before ``now`` that it is not to be tried again yet."""
    return debt.where(F.col(finished) >= now - F.make_dt_interval(mins=F.lit(minutes)))
