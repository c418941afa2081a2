"""Streams of positions: idempotent writes, off-route alerts and windows.

Each stream reads a folder of files, runs to the end of what is there (availableNow) and keeps its progress and its table in the
folder that the caller names, so a rerun with the same folder goes on where it stopped and delivers nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.scratch import scratch_path


def read_events(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


def run_batches(stream: DataFrame, write, folder: str) -> None:
    """Hands every micro-batch to write(batch, number) until the input is used up; progress is kept in the folder."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()


#: The table of seen keys is divided by their hash, and a batch reads only what its own keys fall into.
BUCKETS = 64


def first_writes(stream: DataFrame, keys: list[str], order: str, folder: str) -> DataFrame:
    """A table of the first row of each key, however late or often rows come: each batch is cut down to keys not yet seen.

    A watermark would forget keys and accept late repeats; the table does not. It is partitioned by bucket of the key, so a batch
    reads the buckets of its own keys. Each batch adds its new rows under its number, once: a batch that is run again overwrites
    what it wrote before and does not see it.
    """
    spark = stream.sparkSession
    path = f"{folder}/table"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields) + ", bucket int, batch bigint"

    def write(batch, number):
        own = batch.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("r")).select(*keys, "r.*")
        own = own.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        if number:
            asked = [r[0] for r in own.select("bucket").distinct().collect()]  # BUCKETS numbers at most
            seen = spark.read.schema(fields).parquet(path).where(F.col("bucket").isin(asked) & (F.col("batch") < number)).select(*keys, "bucket")
            own = own.join(seen, [*keys, "bucket"], "left_anti")
        own = own.select(*stream.columns, "bucket", F.lit(number).cast("bigint").alias("batch"))
        own.write.option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").mode("overwrite").parquet(path)

    run_batches(stream, write, folder)
    return spark.read.schema(fields).parquet(path).drop("bucket", "batch")


def off_route(stream: DataFrame, limit_m: float = 30.0) -> DataFrame:
    """By user: how often a position was farther off than the limit, and the farthest."""
    return stream.where(F.col("value") > limit_m).groupBy("user_id").agg(F.count("*").alias("reroutes"), F.max("value").alias("worst"))


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events by hour and type; hours close when the watermark has passed them."""
    ts = F.col("ts").cast("timestamp")
    return stream.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def collected(result: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Runs an aggregating stream to the end of its input and returns its final table, which lies in the folder."""
    path, schema = f"{folder}/result", result.schema

    def write(batch, number):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    result.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return result.sparkSession.read.schema(schema).parquet(path)


def first_writes_once(d) -> DataFrame:
    stream = read_events(d._spark, d._dir, "events.parquet").select("user_id", (F.col("event_id") % 50).alias("seq"), "event_id")
    return first_writes(stream, ["user_id", "seq"], "event_id", scratch_path(d._spark, "stream"))


def off_route_once(d) -> DataFrame:
    return collected(off_route(read_events(d._spark, d._dir, "events.parquet")), scratch_path(d._spark, "stream"))
