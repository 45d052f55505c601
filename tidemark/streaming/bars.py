"""Incremental bars with Structured Streaming: closed bars, repair of late data, idempotent sinks and state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

from tidemark.functions.time import next_bucket
from tidemark.operators import bars as bar_ops
from tidemark.operators.versions import ranked_first


def tick_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Ticks from files as they arrive (symbol, ts, event_id, bid, volume)."""
    raw = spark.readStream.schema(schema).parquet(path)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("bid"), F.col("user_id").alias("volume"))


def closed_bars(ticks: DataFrame, width: str, lag: str) -> DataFrame:
    """Bars of tumbling windows, given out once the watermark has passed them; ticks seen twice count once."""
    at = F.struct("ts", "event_id")
    unique = ticks.withWatermark("ts", lag).dropDuplicatesWithinWatermark(["symbol", "event_id"])
    out = unique.groupBy("symbol", F.window("ts", width)).agg(F.min_by("bid", at).alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"), F.max_by("bid", at).alias("close"), F.sum("volume").cast("double").alias("volume"))
    return out.select("symbol", F.col("window.start").alias("bar_ts"), "open", "high", "low", "close", "volume")


def run_to_end(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Take in all that is there, append the results to Parquet, and read them back. A later call goes on where this ended."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


HEADS = "day date, batches array<int>"


def heads(spark: SparkSession, raw: str, number: int) -> DataFrame:
    """The folders that hold each day's ticks after a batch: (day, batches), a row a day."""
    return spark.read.schema(HEADS).parquet(f"{raw}-heads/batch={number}") if number >= 0 else spark.createDataFrame([], HEADS)


def repair(ticks: DataFrame, raw: str, versions: str, checkpoint: str, timeframe: str = "1h", fold: int = 8) -> None:
    """Keep every batch's ticks, and derive the buckets that a batch touches again as a newer version.

    Ticks are kept by day. A table of heads says which batches' folders hold a day, so a batch opens those of the days that it
    touches and lists no others. A day that would lie in more than ``fold`` folders is written again as one, beside the
    batch's own ticks: a batch lists as many folders after a hundred batches as after ten, and a tick is written again once
    in so many batches. All writes go to folders of the batch's number and replace them, and only the heads of the batch
    before are read, so a batch that is run again changes nothing.
    """
    spark = ticks.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        start = bar_ops.bucket(F.col("ts"), timeframe)
        touched = df.select("symbol", start.alias("bar_ts")).distinct()
        span = F.sequence(F.to_date("bar_ts"), F.to_date(next_bucket(F.col("bar_ts"), timeframe) - F.expr("interval 1 second")), F.expr("interval 1 day"))
        days = touched.select(F.explode(span).alias("day")).distinct()
        before = heads(spark, raw, number - 1)
        old = before.join(days, "day").collect()  # calendar days of this batch
        came = df.withColumn("day", F.to_date("ts"))
        full = [r for r in old if len(r.batches) >= fold]
        kept = StructType([*ticks.schema.fields, StructField("batch", IntegerType()), StructField("day", DateType())])

        def held(rows: list) -> DataFrame:
            paths = [f"{raw}/batch={b}/day={r.day}" for r in rows for b in r.batches]
            return (spark.read.schema(kept).option("basePath", raw).parquet(*paths) if paths else spark.createDataFrame([], kept)).drop("batch")

        new_days = came.select("day").distinct().withColumn("new", F.lit(True))
        full_days = spark.createDataFrame([(r.day, True) for r in full], "day date, full boolean")
        folded = held(full).join(new_days, "day", "left_semi").select(*came.columns)
        came.unionByName(folded).write.mode("overwrite").partitionBy("day").parquet(f"{raw}/batch={number}")
        joined = before.join(new_days, "day", "full_outer").join(F.broadcast(full_days), "day", "left")  # days of this batch
        own = F.array(F.lit(number))
        after = F.when(F.col("new").isNull(), F.col("batches")).when(F.col("full") | F.col("batches").isNull(), own).otherwise(F.concat("batches", own))
        joined.select("day", after.alias("batches")).coalesce(1).write.mode("overwrite").parquet(f"{raw}-heads/batch={number}")
        every = held(old).select(*came.columns).unionByName(came)
        again = every.withColumn("bar_ts", bar_ops.bucket(F.col("ts"), timeframe)).join(touched, ["symbol", "bar_ts"], "left_semi")
        bar_ops.tick_bars(again, timeframe).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{versions}/batch={number}")

    ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def repaired(spark: SparkSession, versions: str) -> DataFrame:
    """The newest version of each bar."""
    return ranked_first(spark.read.parquet(versions), ["symbol", "bar_ts"], [F.desc("version")]).drop("version", "batch")


def state_changes(samples: DataFrame, name: str, state: str, ts: str, target: str, checkpoint: str) -> DataFrame:
    """A stream of samples to the changes of state of each name: (name, state, generation). A later call goes on where this ended.

    Each batch is written in ranges of (name, ts), so that a name's rows are in as many tasks as they need; a range's first
    row is compared with the last state of the range before it, or of the batch before. All writes go to folders of the
    batch's number and replace them, so a batch that is run again changes nothing.
    """
    spark = samples.sparkSession
    out, kept = StructType.fromDDL("name string, state string, generation long"), f"{target}-states"

    def batch(df: DataFrame, number: int) -> None:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df.select(F.col(name).alias("name"), F.col(state).alias("state"), F.col(ts).alias("ts")).repartitionByRange(n, "name", "ts")
        path = f"{target}-ranges/batch={number}"
        rows.withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(path)
        rows = spark.read.parquet(path).drop("batch")
        before = spark.read.schema(out).parquet(f"{kept}/batch={number - 1}") if number else spark.createDataFrame([], out)
        before = before.select("name", F.col("state").alias("old"), F.col("generation").alias("base"))
        # a row for each name and range
        names = Window.partitionBy("name").orderBy("part")
        ends = rows.groupBy("name", "part").agg(F.max(F.struct("ts", "state")).getField("state").alias("last")).join(before, "name", "left")
        ends = ends.withColumn("entry", F.when(F.row_number().over(names) == 1, F.col("old")).otherwise(F.lag("last").over(names)))
        inside = Window.partitionBy("part", "name").orderBy("ts", "state")
        rows = rows.withColumns({"at": F.row_number().over(inside), "previous": F.lag("state").over(inside)}).join(ends.select("name", "part", "entry"), ["name", "part"])
        changed = rows.where(~F.col("state").eqNullSafe(F.when(F.col("at") == 1, F.col("entry")).otherwise(F.col("previous"))))
        changed = changed.withColumn("nth", F.row_number().over(inside))
        counts = changed.groupBy("name", "part").agg(F.count("*").alias("changes"))
        ends = ends.join(counts, ["name", "part"], "left").withColumn("done", F.coalesce("base", F.lit(0)) + F.coalesce(F.sum("changes").over(names), F.lit(0)))
        first = ends.select("name", "part", (F.col("done") - F.coalesce("changes", F.lit(0))).alias("first"))
        changed.join(first, ["name", "part"]).select("name", "state", (F.col("first") + F.col("nth")).alias("generation")).write.mode("overwrite").parquet(f"{target}/batch={number}")
        now = ends.groupBy("name").agg(F.max_by("last", "part").alias("state"), F.max("done").alias("generation"))
        now.unionByName(before.join(now, "name", "left_anti").select("name", F.col("old").alias("state"), F.col("base").alias("generation"))).write.mode("overwrite").parquet(f"{kept}/batch={number}")

    samples.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        return spark.createDataFrame([], out)
    return spark.read.schema(out).parquet(target).select("name", "state", "generation")
