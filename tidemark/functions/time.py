"""Time buckets, timeframes and session calendars as Column expressions (UTC timestamps)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of each timeframe; a month counts as 30 days where a fixed width is asked for.
TIMEFRAMES = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800, "1mo": 2592000}


def timeframe_seconds(timeframe: Column) -> Column:
    """Seconds of a timeframe column; null for unknown ones."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in TIMEFRAMES.items() for x in kv]), timeframe) if TIMEFRAMES else F.lit(None)


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def floor_time(ts: Column, seconds: int) -> Column:
    """Start of the fixed-width bucket that holds an instant."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)) * F.lit(seconds))


def bucket(ts: Column, timeframe: str) -> Column:
    """Bucket start: Mondays 00:00 for weeks, first of the month for months, else fixed width from the epoch."""
    if timeframe == "1w":
        return F.date_trunc("week", ts)
    if timeframe == "1mo":
        return F.date_trunc("month", ts)
    return floor_time(ts, TIMEFRAMES[timeframe])


def next_bucket(start: Column, timeframe: str) -> Column:
    """Start of the bucket after the one that starts at ``start``; months by the calendar."""
    step = "interval 1 month" if timeframe == "1mo" else f"interval {TIMEFRAMES[timeframe]} second"
    return start + F.expr(step)


def ceil_bucket(ts: Column, timeframe: str) -> Column:
    start = bucket(ts, timeframe)
    return F.when(start < ts, next_bucket(start, timeframe)).otherwise(start)


def bucket_window(start: Column, end: Column, timeframe: str) -> tuple[Column, Column]:
    """The whole buckets inside ``[start, end)``; both null when there are none."""
    low, high = ceil_bucket(start, timeframe), bucket(end, timeframe)
    return F.when(low < high, low), F.when(low < high, high)


def closed_cutoff(now: Column, timeframe: str, lag_minutes: int) -> Column:
    """First instant whose bar is not closed yet: now less the lag, on the cadence."""
    return bucket(now - F.expr(f"interval {lag_minutes} minute"), timeframe)


def parse_instant(text: Column) -> Column:
    """An ISO instant to a timestamp; null without a zone or when it is malformed."""
    zoned = text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")))


@dataclass(frozen=True)
class SessionProfile:
    """Trading hours: continuous, weekdays, or a weekly span from open to close minute, less daily breaks and holidays, in a zone."""

    name: str
    mode: str = "continuous"
    zone: str = "UTC"
    open_minute: int = 0  #: of the week, from Monday 00:00 local
    close_minute: int = 0
    breaks: tuple[tuple[int, int], ...] = ()  #: minutes of the day, half-open
    holidays: tuple[str, ...] = field(default=())

    def is_open(self, ts: Column) -> Column:
        """Whether an instant is inside trading hours; daylight saving follows the zone."""
        local = F.from_utc_timestamp(ts, self.zone)
        minute = F.hour(local) * 60 + F.minute(local)
        of_week = F.weekday(local) * 1440 + minute
        if self.mode == "weekdays":
            out = F.weekday(local) < 5
        elif self.mode == "weekly":
            a, b = self.open_minute, self.close_minute
            out = (of_week >= a) & (of_week < b) if a < b else (of_week >= a) | (of_week < b)
        else:
            out = F.lit(True)
        for a, b in self.breaks:
            out = out & ~((minute >= a) & (minute < b))
        if self.holidays:
            out = out & ~F.to_date(local).cast("string").isin(*self.holidays)
        return out


# The weekly profile opens on Sunday and closes on Friday, both at 17:00 in New York.
SESSIONS = {
    p.name: p
    for p in (
        SessionProfile("always"),
        SessionProfile("weekdays", "weekdays", holidays=("2024-01-15",)),
        SessionProfile("fx", "weekly", "America/New_York", 6 * 1440 + 17 * 60, 4 * 1440 + 17 * 60, breaks=((17 * 60, 18 * 60),)),
    )
}
