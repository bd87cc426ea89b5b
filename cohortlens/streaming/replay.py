"""The event table as a stream: windowed counts with a watermark, and waiting times per key with state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.queueing import long_station
from ..session import shared_dir, stored


def source(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files under path as they arrive."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, event_type, n, total) by tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"),
        F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def served(events: DataFrame, key: str, service: float) -> DataFrame:
    """(key, event_id, wait): each key is a first-come-first-served station whose next free time is kept as state between batches.

    A batch's events are put in the order of their times, whatever their order in files, and spread over tasks; events of a
    later batch are served after those before. What a batch gives is written under its number, so a batch that is repeated
    gives the same.
    """
    spark = events.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    state = "key string, free double"
    out = "key string, event_id long, wait double"
    last: list[str] = []

    def serve(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        free = own.read.schema(state).parquet(last[-1]) if last else own.createDataFrame([], state)
        rows = batch.select(F.col(key).cast("string").alias("key"), "event_id", (F.unix_micros("ts") / 1e6).alias("t"))
        rows = rows.join(free.withColumnRenamed("key", "_of"), F.col("key").eqNullSafe(F.col("_of")), "left")
        rows = rows.withColumn("_station", F.coalesce(F.concat(F.lit("="), "key"), F.lit("")))  # a null key is a station as well
        # Whoever comes before the station is free waits as if it came then, in the order of coming.
        rows = rows.select("key", "_station", "event_id", "t", F.greatest("t", "free").alias("_t"), F.struct("t", "event_id").alias("_order"))
        done = stored(long_station(rows, ["_station"], "_t", "_order", F.lit(service)).select("key", "event_id", (F.col("start") - F.col("t")).alias("wait"), "finish"))
        done.select("key", "event_id", "wait").write.mode("overwrite").parquet(f"{at}/out/batch={n}")
        free.unionByName(done.select("key", F.col("finish").alias("free"))).groupBy("key").agg(F.max("free").alias("free")).write.mode("overwrite").parquet(f"{at}/free/{n}")
        last.append(f"{at}/free/{n}")

    events.writeStream.foreachBatch(serve).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out).option("recursiveFileLookup", "true").parquet(f"{at}/out") if last else spark.createDataFrame([], out)


def drained(stream: DataFrame) -> DataFrame:
    """All that an aggregated stream gives for what is there now, written to the shared folder and read back."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
