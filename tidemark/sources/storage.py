"""Immutable parts with manifests: sinks, manifests, verification, published scans and snapshots."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidemark-")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where that is unset, one of this machine's, and only if Spark runs on it alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return _own_folder()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_root(spark)}/data-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, root: str, name: str) -> DataFrame:
    """``df`` written below a shared folder and read back: its lineage ends there."""
    df.write.parquet(f"{root}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")


MOST_PATHS = 4_096  #: parts that a reader is given by name; more are told by a join on the file of each row
CHUNK = 8 << 20  #: bytes of a file that are in memory while it is hashed


def file_path() -> Column:
    """The file of each row as listings name it: without the scheme of local files, nothing escaped."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def write_bars(bars: DataFrame, root: str, run_id: str, manifests: DataFrame | None = None, partition: tuple[str, ...] = ("provider", "asset_class", "symbol", "timeframe", "year")) -> None:
    """Append a run's bars in a folder of its own, one partition a series and year, in order of time; a run that has a manifest is refused."""
    if manifests is not None and not manifests.where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"run {run_id} is published already")
    rows = bars.withColumn("year", F.year("bar_ts"))
    rows.repartition(*partition).sortWithinPartitions(*partition, "bar_ts").write.mode("errorifexists").partitionBy(*partition).parquet(f"{root}/run_id={run_id}")


def write_observations(obs: DataFrame, root: str, run_id: str) -> None:
    obs.repartition("series_id").write.mode("errorifexists").partitionBy("series_id").parquet(f"{root}/run_id={run_id}")


def files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """The data files below a folder: path, bytes, modification time; if asked for also the content's hash, and the schema and rows that the footer tells.

    Files are hashed on the executors, one stream a file of which one chunk is in memory, so a part may have any size. A broken footer gives a null schema and null rows.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    columns = [F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")]
    if not content:
        return found.select(*columns)
    listed = found.select(*columns, F.col("path").alias("uri")).repartition("uri")
    return listed.mapInArrow(_contents, "path string, bytes long, modified timestamp, sha256 string, schema string, row_count long")


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, schemas, rows = [], [], []
        for uri in batch.column(3).to_pylist():
            system, path = _opened(uri)
            digest = hashlib.sha256()
            with system.open_input_stream(path) as stream:
                while chunk := stream.read(CHUNK):
                    digest.update(chunk)
            hashes.append(digest.hexdigest())
            try:
                with system.open_input_file(path) as file:
                    footer = pq.ParquetFile(file)
                    schemas.append(", ".join(f"{f.name}: {f.type}" for f in footer.schema_arrow))
                    rows.append(footer.metadata.num_rows)
            except pa.ArrowInvalid:
                schemas.append(None), rows.append(None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hashes), pa.array(schemas, pa.string()), pa.array(rows, pa.int64())], names=["path", "bytes", "modified", "sha256", "schema", "row_count"])


def scan(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """All rows below a folder, with partition keys as columns, and the file of each."""
    rows = spark.read.schema(schema).option("basePath", root).parquet(root)
    return rows.withColumn("path", file_path())


def build_manifest(spark: SparkSession, root: str, run_id: str, quality: str = "unknown", lineage: str | None = None) -> DataFrame:
    """One row for a run: its parts with bytes, hash, schema and rows, their totals, its quality and the snapshot it was made from. Files are read on the executors."""
    parts = files(spark, f"{root}/run_id={run_id}", content=True)
    every = F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256", "schema", "row_count")))  # metadata, one entry a file
    out = parts.groupBy(F.lit(run_id).alias("run_id")).agg(every.alias("parts"), F.sum("row_count").alias("row_count"), F.sum("bytes").alias("bytes"))
    return out.withColumns({"quality": F.lit(quality), "input_snapshot_id": F.lit(lineage).cast("string")})


def parts_of(manifests: DataFrame) -> DataFrame:
    return manifests.select("run_id", F.explode("parts").alias("p")).select("run_id", "p.*")


def verify(spark: SparkSession, root: str, manifests: DataFrame) -> DataFrame:
    """Findings of declared parts against files: doubled, outside the root, missing, unlisted, changed, or of another schema or number of rows; and runs whose totals are not their parts'."""
    seen = files(spark, root, content=True).select("path", *[F.col(c).alias(f"now_{c}") for c in ("bytes", "sha256", "schema", "row_count")])
    first = [F.first(c).alias(c) for c in ("bytes", "sha256", "schema", "row_count")]
    both = parts_of(manifests).groupBy("path").agg(F.count("*").alias("times"), *first).join(seen, "path", "full_outer")
    plain = root.removeprefix("file://")
    other = lambda c: ~F.col(c).eqNullSafe(F.col(f"now_{c}"))
    state = (
        F.when(F.col("times") > 1, "duplicate_part").when(~F.col("path").startswith(plain) | F.col("path").contains("/../"), "unsafe_path").when(F.col("now_bytes").isNull(), "missing_part")
        .when(F.col("times").isNull(), "unlisted_part").when(other("bytes") | other("sha256"), "changed_part").when(other("schema"), "schema_mismatch").when(other("row_count"), "count_mismatch")
    )
    declared = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.coalesce(p.row_count, F.lit(0)))
    totals = manifests.where(F.col("row_count") != declared).select(F.col("run_id").alias("path"), F.lit("totals_mismatch").alias("finding"))
    return both.select("path", state.alias("finding")).where("finding is not null").unionByName(totals)


def read_paths(spark: SparkSession, root: str, schema: StructType, paths: list[str]) -> DataFrame:
    """Rows of the named parts below a folder; no other file is opened."""
    if not paths:
        return spark.createDataFrame([], schema)
    scheme = "file://" if root.startswith("file:") else ""
    return spark.read.schema(schema).option("basePath", root).parquet(*[scheme + p if p.startswith("/") else p for p in paths])


def read_parts(spark: SparkSession, root: str, schema: StructType, parts: DataFrame, most: int = MOST_PATHS) -> DataFrame:
    """Rows of the parts of a table (path), and of no others.

    At most ``most`` parts are read by their names, so that other files are never opened. Beyond that no list of names is
    made: files below the root are read and each row is kept if its file is among the parts, a join that Spark broadcasts
    only if the table of parts is small.
    """
    paths = [r.path for r in parts.select("path").distinct().limit(most + 1).collect()]
    if len(paths) <= most:
        return read_paths(spark, root, schema, paths)
    rows = spark.read.schema(schema).option("basePath", root).parquet(root).withColumn("_part_path", file_path())
    return rows.join(parts.select(F.col("path").alias("_part_path")), "_part_path", "left_semi").drop("_part_path")


def published(spark: SparkSession, root: str, schema: StructType, manifests: DataFrame, most: int = MOST_PATHS) -> DataFrame:
    """Rows of parts that a manifest lists, and of no others."""
    return read_parts(spark, root, schema, parts_of(manifests), most)


def snapshot_of(parts: DataFrame) -> DataFrame:
    """One row for a table of parts (path, sha256): a hash of its parts whatever their order, and their number.

    Parts are dealt into 4,096 groups by the hash of their path and each group is hashed in order, then the groups, so no
    value holds more than a group's entries.
    """
    entry = F.concat_ws(":", "path", "sha256")
    groups = parts.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("group")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "\n"), 256).alias("digest"), F.count("*").alias("n"))
    every = F.array_sort(F.collect_list(F.concat_ws(":", "group", "digest")))  # at most 4,096
    return groups.agg(F.sha2(F.array_join(every, "\n"), 256).alias("snapshot_id"), F.coalesce(F.sum("n"), F.lit(0)).alias("parts"))


def snapshot_id(manifests: DataFrame) -> DataFrame:
    """One row: the hash of all parts of all manifests, and their number."""
    return snapshot_of(parts_of(manifests))


def union_versions(*frames: DataFrame, timestamps: tuple[str, ...] = ()) -> DataFrame:
    """Parts of several schema versions by name: text stamps become timestamps, columns that a part lacks are null."""
    cast = [f.withColumns({c: F.col(c).cast("timestamp") for c in timestamps if c in f.columns}) for f in frames]
    out = cast[0]
    for f in cast[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
