"""Streams of items: seen-URL memory, upserts, failure rates over time."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.items import first_by


def new_only(items: DataFrame, key: list[str], event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each key once. With an event time the memory of a key ends when the watermark passes it; without one it grows with the keys."""
    if event_time is None:
        return items.dropDuplicates(key)
    return items.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def failure_rate(builds: DataFrame, every: str = "1 hour", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Attempts and failures of each window of time."""
    window = F.window("built_at", every, slide) if slide else F.window("built_at", every)
    out = builds.withWatermark("built_at", delay).groupBy(window).agg(F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("failures"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "attempts", "failures")


def sessions(builds: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of attempts of a key with no longer pause than gap."""
    out = builds.withWatermark("built_at", delay).groupBy(F.session_window("built_at", gap), key).agg(F.count("*").alias("attempts"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "attempts")


def upserting(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key in a table of versioned folders: a batch writes version n + 1 whole, so a repeated batch does no harm."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/v{number - 1:08d}"
        both = batch
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
        if number and jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
            both = spark.read.parquet(before).unionByName(batch)
        first_by(both, key, [-F.col(order).cast("double")]).write.mode("overwrite").parquet(f"{path}/v{number:08d}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share: spark.checkpoint.dir, else the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return what it put out, as a table in a shared folder with the stream's progress beside it."""
    folder = folder or shared_folder(stream.sparkSession, name)
    writer = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").start()
    else:  # each batch has the whole result
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
