"""Commands over streams: whatever maps rows to rows runs unchanged on a streaming DataFrame.

Row ids must come from a key of the data there, as a stream has no order. Results go to Parquet with a checkpoint, so a
run that was cut off goes on where it stopped.
"""

from __future__ import annotations

import glob
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolathe.layer import FID, Layer
from geolathe.session import shared_folder


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream: a folder of files, or one file among others."""
    schema = spark.read.parquet(path).schema
    local = path.removeprefix("file:")
    folder = bool(glob.glob(f"{local}/*.parquet"))
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", local.rsplit("/", 1)[1]).parquet(local.rsplit("/", 1)[0])


def written_out(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming DataFrame over all that is there now; the result is read back from the shared folder."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/rows")
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/rows")


def available(spark: SparkSession, path: str, commands: Callable[[Layer], Layer], key: str) -> DataFrame:
    """Row-wise commands over a stream; ``key`` is a unique integer column that serves as row id."""
    df = stream(spark, path)
    made = commands(Layer(df.select(F.col(key).cast("long").alias(FID), *[F.col(f"`{c}`") for c in df.columns]), "stream"))
    return written_out(spark, made.df.drop(FID))


def windowed(spark: SparkSession, path: str, time: str, key: str, value: str, window: str, late: str) -> DataFrame:
    """Counts and sums per key and window of time. Batches run in ``update`` mode and the last state of each group is
    kept by an upsert on (key, window) in ``foreachBatch``; rows later than ``late`` are dropped by the watermark.
    """
    base = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    df = stream(spark, path).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    agg = df.groupBy(F.col(key), F.window(time, window)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    rows = agg.select(key, F.col("window")["start"].alias("start"), "n", "total")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    q = rows.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    every = spark.read.parquet(f"{base}/rows").drop("batch")
    return every.groupBy(key, "start").agg(F.max_by(F.struct("n", "total"), "_batch").alias("r")).select(key, "start", "r.n", "r.total")
