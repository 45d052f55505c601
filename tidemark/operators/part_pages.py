"""Pages out of published parts: key ranges say which parts a page needs, and no others are opened."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.versions import page, ranked_first
from tidemark.sources.storage import MOST_PATHS, read_parts, read_paths

FIRST_LOOK = 64  #: parts whose ranges are looked at first for a page; four times as many each time that these do not decide


def part_ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each part (path) of rows: its lowest and highest key, its rows and its different keys.

    Made once, when parts are published; keys alone are read and shuffled. Rows without a whole key are in no page and count
    for nothing here.
    """
    once = rows.dropna(subset=keys).groupBy("path", *keys).agg(F.count("*").alias("_n"))
    key = F.struct(*keys)
    return once.groupBy("path").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.sum("_n").alias("row_count"), F.count("*").alias("n_keys"))


def surely_within(parts: Iterable[Row], size: int, last: tuple | None) -> tuple | None:
    """A key up to which there are more than ``size`` different ones behind ``last``, by parts that share no keys; None if these parts don't tell.

    Of the parts that lie behind ``last`` as a whole those are counted, by their highest key, that begin behind the one counted before.
    """
    total, reached = 0, last
    for p in sorted(parts, key=lambda p: tuple(p.high)):
        if reached is None or tuple(p.low) > reached:
            total, reached = total + p.n_keys, tuple(p.high)
            if total > size:
                return reached
    return None


def behind(parts: DataFrame, keys: list[str], last: list | None) -> DataFrame:
    """Parts with a key behind ``last``."""
    return parts if last is None else parts.where(F.col("high") > F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, last, strict=True)]))


def parts_of_page(parts: DataFrame, keys: list[str], size: int, last: list | None = None, most: int = MOST_PATHS) -> list[str] | None:
    """Paths of the parts that can hold a row of the page of ``size`` keys behind ``last``; None if all behind it can, or more than ``most``.

    Parts come by their lowest key. A first few of them mostly tell a key that the page can't reach beyond; if not, more are
    looked at. Where all overlap none may tell.
    """
    left, look = behind(parts, keys, last), FIRST_LOOK
    while look <= 4 * most:
        seen = left.orderBy("low").limit(look).select("path", "low", "high", "n_keys").collect()
        bound = surely_within(seen, size, tuple(last) if last is not None else None)
        if bound is not None and (len(seen) < look or bound < tuple(seen[-1].low)):
            return [p.path for p in seen if tuple(p.low) <= bound]
        if len(seen) < look:
            return [p.path for p in seen]
        look *= 4
    return None


def page_of_parts(spark: SparkSession, root: str, schema: StructType, parts: DataFrame, keys: list[str], size: int, last: list | None = None, latest: list[Column] | None = None, most: int = MOST_PATHS) -> DataFrame:
    """The page behind ``last`` with ``has_more`` and the number of parts that it was read from (``parts_read``).

    With ``latest`` only the first row of each key by that order counts; all versions of a key that the page holds are among
    the parts that are read, as a part is left out only if all its keys lie outside the page.
    """
    paths = parts_of_page(parts, keys, size, last, most)
    if paths is None:
        left = behind(parts, keys, last)
        rows, n = read_parts(spark, root, schema, left, most), left.count()
    else:
        rows, n = read_paths(spark, root, schema, paths), len(paths)
    rows = rows.dropna(subset=keys)
    return page(ranked_first(rows, keys, latest) if latest else rows, keys, size, last).withColumn("parts_read", F.lit(n).cast("long"))
