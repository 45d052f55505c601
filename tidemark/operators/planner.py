"""Plans of what to fetch next: repair of gaps, the tail after them, and both for all series at once within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import SessionProfile
from tidemark.operators import coverage, windows
from tidemark.sources.storage import shared_dir, written


def repair_windows(found: coverage.Coverage, shard: str) -> DataFrame:
    """Windows that close the gaps of each evaluated series, with ordinals; a series that is ready has none.

    Missing stamps lie in the session, so their runs end where it closes; each run is cut into shards.
    """
    return windows.sharded(found.gaps.select(*found.keys, "start", "end"), found.keys, shard).withColumn("reason", F.lit("gap_repair"))


def tail_windows(found: coverage.Coverage, ranges: DataFrame, session: SessionProfile, shard: str, after_gap: bool = True) -> DataFrame:
    """Windows from behind a series' last bar to its range's end, in the session's open hours, with ordinals.

    With ``after_gap`` only for series that lack a stamp before their last bar: there repair alone would never go on to the
    tail. They start strictly after the last bar, so they never hold the gap. Series without bars have no tail.
    """
    keys, step = found.keys, found.step
    known = found.summary.where("max_ts is not null").select(*keys, F.col("max_ts").alias("last"))
    if after_gap:
        inner = found.gaps.join(known, keys).where("start <= last").select(*keys).distinct()
        known = known.join(inner, keys, "left_semi")
    spans = ranges.join(known, keys).select(*keys, F.greatest("start", F.col("last") + F.expr(f"interval {step} second")).alias("start"), "end").where("start < end")
    spans = written(spans, shared_dir(ranges.sparkSession), "tails")
    open_ = coverage.open_ranges(spans, keys, coverage.calendar(spans, step, session), step)
    return windows.sharded(open_.select(*keys, "start", "end"), keys, shard).withColumn("reason", F.lit("tail"))


def bounded_tail(watermarks: DataFrame, now, days: int, lag: str, most: str) -> DataFrame:
    """From each series' watermark, or ``days`` before now without one, to now less the lag; not longer than ``most``, never empty."""
    end = now - F.expr(f"interval {lag}")
    start = F.greatest(F.coalesce("watermark", now - F.make_dt_interval(F.lit(days))), end - F.expr(f"interval {most}"))
    return watermarks.withColumns({"start": start, "end": end}).where("start < end")


def repair_plan(tail: DataFrame, gaps: DataFrame, carried: DataFrame, cooldown: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """All series' windows: the tail first, then gaps found now, then debt carried over, up to a budget for each series.

    Gaps and debt leave out what is in its cooldown, and debt what the gaps hold already. ``truncated`` tells of a backlog.
    """
    some = lambda df: df.select(*keys, "start", "end")
    fresh = windows.subtract(some(gaps), some(cooldown), keys, []).drop("ordinal")
    older = windows.subtract(windows.merged(some(carried), keys), some(gaps).unionByName(some(cooldown)), keys, []).drop("ordinal")
    kind = lambda df, k, reason: some(df).withColumns({"priority": F.lit(k), "reason": F.lit(reason)})
    every = kind(tail, 0, "tail").unionByName(kind(fresh, 1, "gap_repair")).unionByName(kind(older, 2, "carried"))
    return windows.budgeted(every, keys, budget)
