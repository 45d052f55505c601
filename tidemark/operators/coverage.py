"""Coverage of series against a calendar grid: missing stamps, islands, ready intervals and readiness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.time import SessionProfile
from tidemark.sources.storage import shared_dir, written


def grid(ranges: DataFrame, keys: list[str], step: int, session: SessionProfile | None = None) -> DataFrame:
    """Expected stamps (keys, ts, open) of half-open ranges (keys, start, end): days first and then steps, so no row holds more than a day."""
    days = ranges.select(*keys, "start", "end", F.explode(F.sequence(F.to_date("start"), F.to_date(F.col("end") - F.expr("interval 1 second")), F.expr("interval 1 day"))).alias("day"))
    low, high = F.greatest(F.col("start"), F.col("day").cast("timestamp")), F.least(F.col("end"), F.date_add("day", 1).cast("timestamp"))
    first = F.timestamp_seconds(F.ceil(F.unix_timestamp(low) / step) * step)
    steps = days.withColumns({"first": first, "last": high - F.expr("interval 1 second")}).where("first <= last")
    out = steps.select(*keys, F.explode(F.sequence("first", "last", F.expr(f"interval {step} second"))).alias("ts"))
    return out.withColumn("open", session.is_open(F.col("ts")) if session else F.lit(True))


def places_ahead(ts: Column, start: Column, step: int) -> Column:
    """How many stamps, a step apart from ``start`` (in seconds) on, lie before an instant."""
    return F.ceil((F.unix_micros(ts) - start * 1_000_000) / F.lit(step * 1_000_000)).cast("long")


def calendar(spans: DataFrame, step: int, session: SessionProfile | None = None) -> DataFrame:
    """(day, before, n, runs) for all days that any of the spans (start, end) touches; at most 366 rows a year, for any number of series.

    It is made a day a row, without a shuffle but for the sums. ``runs`` are the day's runs of open stamps (start in seconds, n, before: open stamps of the day ahead of it), ``n`` its
    open stamps and ``before`` those of all earlier days: sums from which ordinals and expected counts are differences.
    """
    bounds = spans.agg(F.min("start").alias("low"), F.max("end").alias("high"))
    days = bounds.select(F.explode(F.sequence(F.to_date("low"), F.to_date("high"), F.expr("interval 1 day"))).alias("day"))
    first = (F.ceil(F.unix_timestamp(F.col("day").cast("timestamp")) / step) * step).cast("long")
    last = F.unix_timestamp(F.date_add("day", 1).cast("timestamp")) - 1
    every = F.when(first <= last, F.sequence(first, F.greatest(first, last), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    stamps = F.filter(every, lambda s: session.is_open(F.timestamp_seconds(s))) if session is not None else every

    def longer(runs: Column, s: Column) -> Column:
        """The day's runs with one more stamp: the last run goes on, or a new one begins."""
        last = F.try_element_at(runs, F.lit(-1))
        begun = F.coalesce(last["before"] + last["n"], F.lit(0).cast("long"))
        one = lambda start, n, before: F.array(F.struct(start.alias("start"), n.alias("n"), before.alias("before")))
        on = F.concat(F.slice(runs, 1, F.size(runs) - 1), one(last["start"], last["n"] + 1, last["before"]))
        return F.when(last["start"] + last["n"] * step == s, on).otherwise(F.concat(runs, one(s, F.lit(1).cast("long"), begun)))

    none = F.array().cast("array<struct<start:bigint,n:bigint,before:bigint>>")
    whole = days.withColumn("_stamps", stamps).select("day", F.size("_stamps").cast("long").alias("n"), F.aggregate("_stamps", none, longer).alias("runs"))
    return whole.withColumn("before", F.sum("n").over(Window.orderBy("day")) - F.col("n"))  # days of one calendar


def with_ordinal(rows: DataFrame, cal: DataFrame, ts: str, step: int, ordinal: str, is_open: str | None = None) -> DataFrame:
    """``rows`` with the number of open stamps ahead of an instant, and whether it is an open stamp itself."""
    found = rows.join(F.broadcast(cal.select(F.col("day").alias("_day"), "before", "runs")), F.to_date(ts) == F.col("_day"), "left")
    count = F.aggregate("runs", F.col("before"), lambda n, r: n + F.least(r["n"], F.greatest(F.lit(0), places_ahead(F.col(ts), r["start"], step))))
    hit = F.exists("runs", lambda r: ((F.unix_micros(ts) - r["start"] * 1_000_000) % (step * 1_000_000) == 0) & places_ahead(F.col(ts), r["start"], step).between(0, r["n"] - 1))
    out = found.withColumn(ordinal, count)
    return (out.withColumn(is_open, F.coalesce(hit, F.lit(False))) if is_open else out).drop("_day", "before", "runs")


def with_expected(rows: DataFrame, step: int, session: SessionProfile | None, name: str = "expected") -> DataFrame:
    """Rows (start, end, ...) with the number of open stamps in each; rows are read twice where there is a session."""
    edge = lambda c: F.ceil(F.unix_micros(c) / F.lit(step * 1_000_000)).cast("long")
    if session is None:
        return rows.withColumn(name, edge("end") - edge("start"))
    cal = calendar(rows, step, session)
    both = with_ordinal(with_ordinal(rows, cal, "start", step, "_low"), cal, "end", step, "_high")
    return both.withColumn(name, F.col("_high") - F.col("_low")).drop("_low", "_high")


def _pieces(spans: DataFrame, keys: list[str], cal: DataFrame, step: int) -> DataFrame:
    """The open stamps of spans (keys, start, end) as runs within days (keys, day, start, end, n)."""
    days = F.sequence(F.to_date("start"), F.to_date(F.col("end") - F.expr("interval 1 microsecond")), F.expr("interval 1 day"))
    rows = spans.where("start < end").select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(days).alias("day"))
    rows = rows.join(F.broadcast(cal.select("day", "runs")), "day").select(*keys, "_s", "_e", "day", F.explode("runs").alias("r"))
    low, high = F.greatest(F.lit(0), places_ahead(F.col("_s"), F.col("r.start"), step)), F.least(F.col("r.n"), places_ahead(F.col("_e"), F.col("r.start"), step))
    at = lambda k: F.timestamp_seconds(F.col("r.start") + F.col(k) * step)
    return rows.withColumns({"_low": low, "_high": high}).where("_low < _high").select(*keys, "day", at("_low").alias("start"), at("_high").alias("end"), (F.col("_high") - F.col("_low")).alias("n"))


def joined_runs(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, start, end, n) of which those that touch are one."""
    w = Window.partitionBy(*keys).orderBy("start")
    new = F.coalesce((F.col("start") > F.lag("end").over(w)).cast("int"), F.lit(1))
    rows = pieces.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("_run")


def open_ranges(spans: DataFrame, keys: list[str], cal: DataFrame, step: int) -> DataFrame:
    """Runs of open stamps inside spans: (keys, start, end, n). Those of a day come from the calendar, and no stamp is made."""
    return joined_runs(_pieces(spans, keys, cal, step), keys)


def open_days(spans: DataFrame, keys: list[str], cal: DataFrame, step: int) -> DataFrame:
    """For each day of each span (keys, start, end) whether it has an open stamp inside: (keys, day, opens)."""
    days = F.sequence(F.to_date("start"), F.to_date(F.col("end") - F.expr("interval 1 microsecond")), F.expr("interval 1 day"))
    every = spans.where("start < end").select(*keys, F.explode(days).alias("day")).distinct()
    some = _pieces(spans, keys, cal, step).select(*keys, "day", F.lit(True).alias("opens")).distinct()
    return every.join(some, [*keys, "day"], "left").withColumn("opens", F.coalesce("opens", F.lit(False)))


def _day(ts: str) -> Column:
    return F.to_date(ts).alias("_day")


def islands(df: DataFrame, keys: list[str], ts: str, step: int) -> DataFrame:
    """Maximal runs of stamps at most one step apart: (keys, start, end exclusive, n).

    Runs are found day by day; only these, not the stamps, are then put together over a whole series.
    """
    day = Window.partitionBy(*keys, "_day").orderBy(ts)
    new = F.coalesce((F.unix_timestamp(ts) - F.unix_timestamp(F.lag(ts).over(day)) > step).cast("int"), F.lit(1))
    marked = df.select(*keys, ts).distinct().withColumn("_day", _day(ts)).withColumn("_new", new).withColumn("_run", F.sum("_new").over(day))
    runs = marked.groupBy(*keys, "_day", "_run").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("start")
    seam = F.coalesce((F.unix_timestamp("start") - F.unix_timestamp(F.lag("last").over(w)) > step).cast("int"), F.lit(1))
    whole = runs.withColumn("_new", seam).withColumn("_run", F.sum("_new").over(w))
    return whole.groupBy(*keys, "_run").agg(F.min("start").alias("start"), (F.max("last") + F.expr(f"interval {step} second")).alias("end"), F.sum("n").alias("n")).drop("_run")


def steps(df: DataFrame, keys: list[str], ts: str, *more: str) -> DataFrame:
    """Distinct stamps with the one before and the seconds between: (keys, previous, ts, seconds); of ``more`` columns the least.

    The stamp before a day's first one comes from a table of the days, so no series is in one task.
    """
    rows = df.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(*[F.min(c).alias(c) for c in more]) if more else df.select(*keys, ts).where(F.col(ts).isNotNull()).distinct()
    rows = rows.withColumn("_day", _day(ts))
    days = rows.groupBy(*keys, "_day").agg(F.max(ts).alias("_last"))
    days = days.select(*keys, "_day", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_day")).alias("_entry"))
    inside = F.lag(ts).over(Window.partitionBy(*keys, "_day").orderBy(ts))
    out = rows.withColumn("_in", inside).join(days, [*keys, "_day"]).withColumn("previous", F.coalesce("_in", "_entry")).drop("_day", "_in", "_entry")
    return out.withColumn("seconds", F.unix_timestamp(ts) - F.unix_timestamp("previous"))


def lag_gaps(df: DataFrame, keys: list[str], ts: str, step: Column | int) -> DataFrame:
    """Distinct stamps whose distance to the one before exceeds the step: (keys, previous, ts, seconds)."""
    return steps(df, keys, ts).where(F.col("seconds") > step)


def summary(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Rows, duplicates and the first and last stamp of each series."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count"), (F.count("*") - F.count_distinct(ts)).alias("duplicates"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"))


@dataclass
class Coverage:
    """An evaluation: one summary a series, the runs of missing stamps, the ready intervals, and the expected stamps that were seen."""

    summary: DataFrame
    gaps: DataFrame  #: keys, start, end, n
    ready: DataFrame  #: keys, start, end, n
    seen: DataFrame  #: keys, ts
    keys: list[str]
    step: int

    @property
    def missing(self) -> DataFrame:
        """(keys, ts): every missing stamp."""
        return self.gaps.select(*self.keys, F.explode(F.sequence("start", F.col("end") - F.expr("interval 1 second"), F.expr(f"interval {self.step} second"))).alias("ts"))

    @property
    def boundary(self) -> DataFrame:
        """(keys, latest_complete): the last stamp before the first missing one; null if that is the first of all."""
        hole = self.gaps.groupBy(*self.keys).agg(F.min("start").alias("_hole"))
        early = F.when(F.col("_hole").isNull() | (F.col("ts") < F.col("_hole")), F.col("ts"))
        return self.seen.join(hole, self.keys, "left").groupBy(*self.keys).agg(F.max(early).alias("latest_complete"))


def summaries(ranges: DataFrame, keys: list[str], rows: DataFrame, counts: DataFrame, lacking: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """One row a series of what was seen (row_count, duplicates, min_ts, max_ts), expected (expected, _all) and lacks (missing, first_missing), with its readiness."""
    out = ranges.select(*keys).distinct().join(rows, keys, "left").join(counts, keys, "left").join(lacking, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.withColumns({c: zero(c) for c in ("row_count", "duplicates", "expected", "missing", "_all")}).withColumn("closed", F.col("_all") - F.col("expected")).drop("_all")
    bad = (F.col("row_count") == 0) | (F.col("duplicates") > 0)
    if quality is not None:
        out = out.join(quality.select(*keys, "quality_status"), keys, "left")
        bad = bad | (F.col("quality_status") != "pass")
    state = F.when(bad, "not_ready").when(F.col("missing") == 0, "ready").when(F.col("missing") < F.col("expected"), "degraded").otherwise("not_ready")
    return out.withColumn("readiness", state)


def evaluate(bars: DataFrame, ranges: DataFrame, keys: list[str], ts: str, step: int, session: SessionProfile, quality: DataFrame | None = None) -> Coverage:
    """Coverage of each series over its requested ranges (keys, start, end), which don't overlap.

    Counts of rows hold all supplied bars that have a stamp; what is expected lies inside the ranges and the session. Not
    ready if there are no bars or duplicates, or ``quality`` (keys, quality_status) says other than pass; ready without gaps;
    degraded with any ready interval, else not ready. A ready interval ends where its next stamp is lacking or the session
    closes.

    Stamps, ranges and the calendar are written once. What is expected is a difference of ordinals, and a gap is a jump of
    the ordinal from one seen stamp to the next: no grid of stamps is made.
    """
    root = shared_dir(bars.sparkSession)
    stamps = written(bars.where(F.col(ts).isNotNull()).groupBy(*keys, F.col(ts).alias("ts")).agg(F.count("*").alias("k")), root, "stamps")
    spans = written(ranges.select(*keys, "start", "end").where("start < end").distinct(), root, "spans")
    cal = written(calendar(spans, step, session), root, "calendar")
    sized = with_ordinal(with_ordinal(spans, cal, "start", step, "low"), cal, "end", step, "high")
    inside = stamps.join(spans, keys).where("start <= ts and ts < end").select(*keys, "start", "ts")
    seen = with_ordinal(inside, cal, "ts", step, "o", "open").where("open").select(*keys, "start", "ts", "o")
    # stamps between the ends of their range, and what each comes after; that of a day's first one is found among days
    end = lambda c, o, kind: sized.select(*keys, "start", F.col(c).alias("ts"), o.alias("o"), F.lit(kind).alias("kind"))
    marks = seen.withColumn("kind", F.lit(1)).unionByName(end("start", F.col("low") - 1, 0)).unionByName(end("end", F.col("high"), 2))
    marks = marks.withColumns({"_day": F.to_date("ts"), "at": F.struct("o", "kind", "ts")})
    days = marks.groupBy(*keys, "start", "_day").agg(F.max("at").alias("_last"))
    days = days.select(*keys, "start", "_day", F.lag("_last").over(Window.partitionBy(*keys, "start").orderBy("_day")).alias("_entry"))
    here = F.lag("at").over(Window.partitionBy(*keys, "start", "_day").orderBy("at"))
    jumps = marks.withColumn("_here", here).join(days, [*keys, "start", "_day"]).withColumn("prev", F.coalesce("_here", "_entry")).where(F.col("o") - F.col("prev.o") > 1)
    low = F.when(F.col("prev.kind") == 0, F.col("prev.ts")).otherwise(F.col("prev.ts") + F.expr(f"interval {step} second"))
    gaps = open_ranges(jumps.select(*keys, low.alias("start"), F.col("ts").alias("end")), keys, cal, step)
    edge = lambda c: F.ceil(F.unix_micros(c) / F.lit(step * 1_000_000)).cast("long")
    counts = sized.groupBy(*keys).agg(F.sum(F.col("high") - F.col("low")).alias("expected"), F.sum(edge("end") - edge("start")).alias("_all"))
    lacking = gaps.groupBy(*keys).agg(F.sum("n").alias("missing"), F.min("start").alias("first_missing"))
    rows = stamps.groupBy(*keys).agg(F.sum("k").alias("row_count"), (F.sum("k") - F.count("*")).alias("duplicates"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
    own = seen.select(*keys, "ts").distinct()
    return Coverage(summaries(ranges, keys, rows, counts, lacking, quality), gaps, islands(own, keys, "ts", step), own, keys, step)


def findings(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage findings of evaluated series that are not ready: (keys, code)."""
    code = F.when(F.col("readiness") == "not_ready", "coverage_not_ready").otherwise("coverage_degraded")
    return summaries.where("readiness <> 'ready'").select(*keys, code.alias("code"))
