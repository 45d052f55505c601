"""Shared pieces of the training-data operators: shared-folder tables, word hashing and distributed components."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.storage import shared_root


class Scratch:
    """Tables written into the shared folder so that lineage is cut and lost executors cost no recomputation of finished steps."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back with the schema it had."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        # hashes and numbers hardly shrink, so only texts are worth the dearer codec
        df.write.option("compression", "zstd" if name == "texts" else "snappy").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more, and let Spark's cleaner take the shuffle files of finished jobs with them."""
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)
        self.free()

    def free(self) -> None:
        """Let Spark's cleaner take the shuffle files of finished jobs: it waits for the driver's garbage to be collected."""
        gc.collect()
        self.spark._jvm.System.gc()


def vocabulary(path: str) -> str:
    """The place of a vocabulary file; a bare name is one of the public tokenizers', wherever the worker has them installed."""
    if os.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ``documents`` table, with only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; to hash each anew costs less than to look up the many words that are rare."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def lots(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that a task holds little besides them."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, over an array of unsigned 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h *= _M2
    h ^= h >> np.uint64(27)
    h *= _M3
    h ^= h >> np.uint64(31)
    return h


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for every run of ``width`` words; with fewer words, one for the whole sequence; none without words."""
    n = len(words)
    if n == 0:
        return words
    take = min(n, width)
    h = words[: n - take + 1] + np.uint64(take * int(_M1) % (1 << 64))
    h ^= h >> np.uint64(29)
    for i in range(1, take):
        h *= _M1
        h += words[i : n - take + 1 + i]
        h ^= h >> np.uint64(29)
    return mix(h)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long): rows (node, component), component the smallest node reachable.

    Alternates large-star and small-star steps, each a min per node and a join, until the edges no longer change. A hub's
    least neighbour is found by sums before the shuffle and is a table of its own, so that the join with it can be split.
    Nodes without edges do not appear. Empty edges give an empty result.
    """
    now = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = scratch.table(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        scratch.drop(now, low, large, least)
        now = after
        count, nodes = now.agg(F.count("*"), F.count_distinct("a")).first()
        if count == nodes and now.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def ordered_parts(scratch: Scratch, df: DataFrame, *columns: str) -> DataFrame:
    """``df`` written in ranges of ``columns``, with ``part``, the number of a row's range: all rows of a lower part come first.

    Rows that are equal in all columns can lie in several parts, so a repeated key fills no single task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *columns, "tie").drop("tie")
    return scratch.table(dealt.withColumn("part", F.spark_partition_id()), "ordered")


_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first ``n`` powers of an odd number and of its inverse, modulo 2**64."""
    global _POWERS
    if n > len(_POWERS[0]):
        most = 1 << max(16, n.bit_length())
        base, inverse = np.full(most, _M1), np.full(most, np.uint64(pow(int(_M1), -1, 1 << 64)))
        base[0] = inverse[0] = 1
        _POWERS = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _POWERS


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for every run of ``width`` words, however wide, by differences of running sums; none with fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return words[:0]
    power, inverse = _powers(len(words))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * inverse[:n])


def text_key(text_col: str):
    """What equal texts share, 16 bytes; null for texts without a word."""
    return F.when(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(F.col(text_col).cast("binary"))))


def distinct_texts(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str, least: int = 1, rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, texts) of the distinct texts that have words and at least ``least`` characters.

    nodes (key, id, node): the smallest id of each text, nulls last, and a number without gaps in the order of these ids.
    texts (node, text), with ``rows`` also ``row``, a whole row that has that text and id. Copies are taken together before
    the shuffle, so a text that very many rows repeat fills no task.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if rows else []))
    source = given.where(F.length("text") >= least).withColumn("key", text_key("text")).where("key is not null")
    order = F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = source.groupBy("key").agg(F.min("id").alias("id"))
    ranged = ids.repartitionByRange(n, F.col("id").asc_nulls_last(), "key").sortWithinPartitions(F.col("id").asc_nulls_last(), "key")
    ranged = scratch.table(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("k"))  # a row for each partition
    before = sizes.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))
    numbered = ranged.withColumn("part", part).join(F.broadcast(before), "part")
    nodes = scratch.table(numbered.select("key", "id", (F.col("before") + F.col("at") - F.shiftleft("part", 33)).alias("node")), "nodes")
    # nodes meet the texts where the texts' own exchange has put them
    one = source.groupBy("key").agg(F.min_by("row" if rows else "text", order).alias("one"))
    kept = scratch.table(one.join(nodes.select("key", "node").hint("merge"), "key").select("node", "one"), "texts")
    scratch.drop(ranged)
    texts = kept.select("node", F.col("one").getField(text_col).alias("text"), F.col("one").alias("row")) if rows else kept.withColumnRenamed("one", "text")
    texts._scratch_path = kept._scratch_path
    return nodes, texts
