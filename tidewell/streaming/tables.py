"""Tables kept up to date by Structured Streaming.

Defined results: files that arrive later are read once; rows with a null key are left out; equal times go to the
greater value; with the trigger ``availableNow`` a run takes what is there and stops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.session import cut, scratch


def stream_of(spark: SparkSession, path: str, *, files: int | None = 1) -> DataFrame:
    """A table's parquet files as a stream of ``files`` per batch, or all of a run in one; ``path`` is a directory or one file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if single:  # a stream watches directories
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def run_to_table(stream: DataFrame, *, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into a table in the shared folder and reads it."""
    spark = stream.sparkSession
    out, state = scratch(spark, "stream"), scratch(spark, "state")
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def windowed_counts(events: DataFrame, time: Column, keys: list[str], *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and sum of ``value`` per tumbling window and key; later than ``late`` is dropped by the watermark."""
    timed = events.withColumn("_at", time).withWatermark("_at", late)
    g = timed.groupBy(F.window("_at", width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def upsert_latest(stream: DataFrame, keys: list[str], order: Column, *, buckets: int = 64) -> DataFrame:
    """The latest row per key, kept by micro-batches in a table of buckets by key: a batch is reduced to one row per key
    and merged with the buckets it touches alone; these are written beside the old ones and swapped in."""
    spark = stream.sparkSession
    at: dict[int, str] = {}  # folder of each bucket

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.select(*keys, F.struct(order.alias("o"), F.struct(*[c for c in batch.columns if c not in keys]).alias("r")).alias("b")).where(" and ".join(f"{k} is not null" for k in keys))
        fresh = cut(rows.groupBy(*keys).agg(F.max("b").alias("b")).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "batch")
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        held = [at[k] for k in touched if k in at]
        if held:
            kept = fresh.sparkSession.read.schema(fresh.drop("bucket").schema).parquet(*held)
            fresh = fresh.drop("bucket").unionByName(kept).groupBy(*keys).agg(F.max("b").alias("b")).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        path = scratch(spark, f"upsert-{number}")
        fresh.repartition("bucket").write.partitionBy("bucket").parquet(path)
        at.update({k: f"{path}/bucket={k}" for k in touched})

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    if not at:
        return spark.createDataFrame([], stream.schema).select(*keys, *rest)
    return spark.read.parquet(*at.values()).select(*keys, *[f"b.r.{c}" for c in rest])
