"""Normalizers of provider payloads: columns of text or bytes to typed bars, ticks and observations."""

from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranges import in_ranges, previous
from tidemark.operators.runs import first_wins

# Fixed format of a tick record: milliseconds of the hour, ask and bid in 1/100000, their volumes; big-endian.
TICK = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])
HOUR_MS, PRICE_UNIT = 3_600_000, 100_000


def klines(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Arrays of arrays (open time in ms, open, high, low, close, volume, ...) to bars."""
    rows = df.select(*keep, F.explode(F.from_json(payload, "array<array<string>>")).alias("k"))
    number = lambda i: F.element_at("k", i).try_cast("double")
    return rows.select(*keep, F.timestamp_millis(F.element_at("k", 1).cast("long")).alias("bar_ts"), *[number(i).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 2)])


def daily_frame(df: DataFrame, zone: str, *keep: str) -> DataFrame:
    """Parallel arrays (stamp, open, high, low, close, volume) to daily bars; rows with a null price vanish; days are the exchange's."""
    names = ("stamp", "open", "high", "low", "close", "volume")
    rows = df.select(*keep, F.explode(F.arrays_zip(*names)).alias("r")).select(*keep, "r.*")
    day = F.date_trunc("day", F.from_utc_timestamp(F.timestamp_seconds("stamp"), zone))
    return rows.dropna(subset=["open", "high", "low", "close"]).select(*keep, day.alias("bar_ts"), *names[1:])


SERIES_FIELDS = ("frequency", "units", "seasonal_adjustment")  #: what is said of a whole series


def series(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """Observation documents to rows: '.' is no value; both real-time ends make a vintage, otherwise the policy is unknown.

    A release time comes from the document. What ``df`` says of the series (``SERIES_FIELDS``) goes to each row; what it does
    not say, or leaves empty, is 'native'.
    """
    kind = "array<struct<date:string, value:string, realtime_start:string, realtime_end:string, release_ts:string>>"
    said = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("native")).alias(c) if c in df.columns else F.lit("native").alias(c) for c in SERIES_FIELDS]
    rows = df.select(*keep, *said, F.explode(F.from_json(payload, kind)).alias("o"))
    value = F.nullif(F.col("o.value"), F.lit("."))
    vintage = (F.coalesce("o.realtime_start", F.lit("")) != "") & (F.coalesce("o.realtime_end", F.lit("")) != "")
    return rows.select(
        *keep, F.col("o.date").alias("observation_date"), value.try_cast("double").alias("value"), "o.release_ts", *SERIES_FIELDS,
        F.col("o.realtime_start").alias("vintage_start"), F.col("o.realtime_end").alias("vintage_end"), F.when(vintage, "vintage").otherwise("unknown").alias("availability_policy"),
        F.when(value.isNull(), "not_reported").alias("missing_reason"),
    )


def decode_ticks(df: DataFrame, keys: dict[str, str], hour: str = "hour", payload: str = "payload") -> DataFrame:
    """Compressed hourly tick files to ticks (keys, ts, n, ask, bid, volume); broken records and offsets beyond the hour are errors."""
    names = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                raw = lzma.decompress(getattr(row, payload)) if getattr(row, payload) else b""
                if len(raw) % TICK.itemsize:
                    raise ValueError("the tick file ends within a record")
                ticks = np.frombuffer(raw, TICK)
                if (ticks["ms"] >= HOUR_MS).any():
                    raise ValueError("a tick lies beyond its hour")
                out = {k: np.full(len(ticks), getattr(row, k)) for k in names}
                out |= {"ts": pd.Timestamp(getattr(row, hour)) + pd.to_timedelta(ticks["ms"].astype("int64"), unit="ms"), "event_id": np.arange(len(ticks), dtype="int64")}
                out |= {n: ticks[n].astype("float64") / PRICE_UNIT for n in ("ask", "bid")} | {"volume": ticks["bid_volume"].astype("float64")}
                yield pd.DataFrame(out)

    kinds = ", ".join(f"{k} {v}" for k, v in keys.items())
    return df.select(*names, F.col(hour).cast("timestamp_ntz").alias(hour), payload).mapInPandas(run, f"{kinds}, ts timestamp_ntz, event_id long, ask double, bid double, volume double").withColumn("ts", F.col("ts").cast("timestamp"))


def encode_ticks(rows: list[tuple[int, float, float, float, float]]) -> bytes:
    """The file of some ticks (ms, ask, bid, ask volume, bid volume)."""
    return lzma.compress(b"".join(struct.pack(">IIIff", ms, round(ask * PRICE_UNIT), round(bid * PRICE_UNIT), av, bv) for ms, ask, bid, av, bv in rows))


FRAME = ("bar_ts", "open", "high", "low", "close", "volume")  #: columns that a provider's frame has to have


def normalize_frame(df: DataFrame, start, end, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejections) of a provider's frame whose rows come in ``order``; a column that lacks is an error.

    Rows have lower-case names, lie inside ``[start, end)`` and have a hash of their fields. Rejections (keys, bar_ts, code)
    tell of stamps that come twice or before the one in front of them, and of rows inside that lack a price; a frame that has
    any is not to be published. The order is followed in ranges, so no series is in one task.
    """
    rows = df.select(*[F.col(c).alias(c.lower()) for c in df.columns])
    lacking = [c for c in (*keys, *FRAME, order) if c not in rows.columns]
    if lacking:
        raise ValueError(f"the frame lacks {', '.join(lacking)}")
    parts = in_ranges(rows.select(*keys, "bar_ts", order), keys, [order])
    back = previous(parts, keys, [order], "bar_ts", "_front").where("bar_ts < _front")
    twice = rows.groupBy(*keys, "bar_ts").agg(F.count("*").alias("_n")).where("_n > 1")
    code = lambda d, c: d.select(*keys, "bar_ts", F.lit(c).alias("code"))
    clipped = rows.where((F.col("bar_ts") >= start) & (F.col("bar_ts") < end)).drop(order)
    blank = clipped.where(" or ".join(f"{c} is null or isnan({c})" for c in ("open", "high", "low", "close")))
    rejected = code(back, "unsorted").unionByName(code(twice, "duplicate")).unionByName(code(blank, "missing_price"))
    return clipped.withColumn("source_hash", F.sha2(F.to_json(F.struct(*sorted([*keys, *FRAME]))), 256)), rejected


def merge_windows(bars: DataFrame, windows: DataFrame, keys: list[str], identity: list[str], owner: str) -> DataFrame:
    """Fetched rows clipped to their windows and collapsed to one each, first window first; rows of one stamp that differ are marked."""
    clipped = bars.join(windows, keys).where("bar_ts >= start and bar_ts < end")
    return first_wins(clipped, [*identity, "bar_ts"], ["ordinal", "source_hash"], F.col("source_hash")).withColumn("managed_dataset_id", F.lit(owner)).drop("start", "end", "ordinal")


def receipts(df: DataFrame, text: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(readable documents as columns, unreadable ones) of a text column."""
    parsed = df.withColumn("doc", F.from_json(text, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("doc").isNull() | F.col("doc._corrupt").isNotNull()
    names = [c for c in df.columns if c != text]
    return parsed.where(~bad).select(*names, "doc.*").drop("_corrupt"), parsed.where(bad).select(*df.columns)


def synthetic_bars(spans: DataFrame, step: int, keys: list[str]) -> DataFrame:
    """Bars whose prices follow from a hash of series and stamp, over half-open spans (keys, start, end)."""
    from tidemark.operators.coverage import grid

    part = lambda i: F.conv(F.substring(F.sha2(F.concat_ws(":", *keys, F.unix_timestamp("ts").cast("string")), 256), i, 6), 16, 10).cast("long")
    rows = grid(spans, keys, step).select(*keys, F.col("ts").alias("bar_ts"), (part(1) % 10000).alias("a"), (part(7) % 100).alias("b"), (part(13) % 100).alias("c"))
    low, high = F.least("a", F.col("a") + F.col("b") - F.col("c")), F.greatest("a", F.col("a") + F.col("b") - F.col("c"))
    return rows.select(*keys, "bar_ts", F.col("a").cast("double").alias("open"), (high + 1).cast("double").alias("high"), (low - 1).cast("double").alias("low"), (F.col("a") + F.col("b") - F.col("c")).cast("double").alias("close"))
