"""Feeds that arrive bit by bit: new chunks appended once, latest feedback kept, late rows counted in time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..tables import latest

#: Parts of a store by hash of the key, and batches after which a log is made one base.
BUCKETS, COMPACT_EVERY = 64, 16


def stream(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files at ``path``."""
    # as a pattern, for a table may be one file, which a stream's plain path may not
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(feed: DataFrame, each, checkpoint: str) -> None:
    """Run ``each`` (DataFrame, batch number) on all that has arrived, from where the last run ended."""
    feed.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def append_new(spark: SparkSession, feed: DataFrame, key: str, store: str, checkpoint: str) -> None:
    """Append rows whose key and content the store has not. A batch that is run again after a failure replaces its own files.

    The store is parted by a hash of the key; a batch is compared with the keys and contents of the parts it touches alone.
    """

    def each(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        rows = batch.withColumn("content", F.sha2(F.to_json(F.struct(*rest)), 256)).dropDuplicates([key, "content"]).withColumn("bucket", _bucket(key))
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(store)
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(fs_path):
            touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
            known = spark.read.schema(rows.schema.add("batch", "long")).parquet(store).where((F.col("batch") < number) & F.col("bucket").isin(touched))
            rows = rows.join(known.select(key, "content"), [key, "content"], "left_anti")
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(store)

    drain(feed, each, checkpoint)


def new_chunks(spark: SparkSession, path: str) -> DataFrame:
    """All chunks of a feed, each delivered content once, through a store in the shared folder."""
    root = scratch(spark, "feed")
    append_new(spark, stream(spark, path), "id", f"{root}/store", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/store").drop("batch", "content", "bucket")


def logged(spark: SparkSession, feed: DataFrame, key: list[str], at: str, root: str, compact_every: int = COMPACT_EVERY) -> None:
    """Keep the latest row of each key as a log under ``root``: a batch adds its own latest rows and touches no other; after every
    ``compact_every`` batches the log up to there is made one base. Run again after a failure, a batch replaces its own files."""

    def each(batch: DataFrame, number: int) -> None:
        latest(batch, key, at).write.mode("overwrite").parquet(f"{root}/log/batch={number}")
        if number % compact_every == compact_every - 1:
            latest(_log(spark, root, batch.schema, number), key, at).write.mode("overwrite").parquet(f"{root}/base/upto={number}")

    drain(feed, each, f"{root}/checkpoint")


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    done = lambda f: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))
    return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p) if done(f)) if fs.exists(p) else []


def _log(spark: SparkSession, root: str, schema, last: int | None = None) -> DataFrame:
    """The last base before batch ``last`` and the batches after it."""
    within = lambda n: last is None or n <= last
    bases = [n for n in _numbers(spark, f"{root}/base") if last is None or n < last]
    base = bases[-1] if bases else -1
    parts = [f"{root}/base/upto={base}"] * bool(bases) + [f"{root}/log/batch={n}" for n in _numbers(spark, f"{root}/log") if n > base and within(n)]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def latest_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each query of a feedback feed."""
    root, feed = scratch(spark, "feedback"), stream(spark, path)
    logged(spark, feed, ["query_id"], "created_at", root)
    return latest(_log(spark, root, feed.schema), ["query_id"], "created_at")


def hourly_events(spark: SparkSession, path: str, watermark: str = "2 days") -> DataFrame:
    """Events by hour and type, counted as they come. An hour closes, and its state is dropped, when the watermark passes its end;
    rows later than that are left out. Each batch writes the counts it changed, of which the last holds."""
    root = scratch(spark, "hourly")
    rows = stream(spark, path).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", watermark)
    counts = rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    counts = counts.select(F.col("window.start").alias("start"), "event_type", "n", "value")
    sink = counts.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    sink.foreachBatch(lambda batch, number: batch.withColumn("number", F.lit(number)).write.mode("overwrite").parquet(f"{root}/log/batch={number}")).start().awaitTermination()
    last = latest(_log(spark, root, counts.schema.add("number", "integer")), ["start", "event_type"], "number")
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("value", 4).alias("value"))
