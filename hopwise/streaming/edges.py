"""Edges that arrive as a stream, with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopwise.operators import removed, shared_dir


def fresh_edges(stream: DataFrame, time_col: str = "ts", keys: tuple[str, ...] = ("src", "dst"), late: str = "10 minutes") -> DataFrame:
    """Each edge once, as long as its repeats arrive within the watermark."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(list(keys))


def degrees(stream: DataFrame, window: str = "1 hour", time_col: str = "ts", end: str = "src", late: str = "10 minutes") -> DataFrame:
    """How many edges each vertex has in each window, for edges no later than the watermark."""
    counted = stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "id", "n")


def hop(stream: DataFrame, edges: DataFrame, at: str = "dst") -> DataFrame:
    """One more hop for each arriving edge over a static edge table: a stream-static join."""
    return stream.join(edges.select(F.col("src").alias(at), F.col("dst").alias("next")), at)


def landed(stream: DataFrame) -> DataFrame:
    """Runs a stream whose rows do not change over what is there, into Parquet under the shared folder, and returns the rows."""
    path = f"{shared_dir(stream.sparkSession).rstrip('/')}/hopwise-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def latest(stream: DataFrame, keys: list[str], values: list[str], every: int = 32) -> DataFrame:
    """Runs a stream over what is there and returns the last state of each key.

    Every batch writes the rows it changed to a folder of its own under the shared one, so a batch that is repeated replaces
    itself; state older than the watermark is dropped, and no row passes through the driver. After so many batches (`every`) their rows
    become one folder with the last state of each key, so what is kept grows with the keys and not with the batches.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/hopwise-{uuid.uuid4().hex}"
    schema = T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())])
    folders: list[str] = []

    def last(session: SparkSession) -> DataFrame:
        rows = session.read.schema(schema).parquet(*folders) if folders else session.createDataFrame([], schema)
        return rows.groupBy(*keys).agg(*[F.max_by(v, "__batch").alias(v) for v in values], F.max("__batch").alias("__batch"))

    def put(rows: DataFrame, batch: int) -> None:
        folder = f"{path}/rows-{batch}"
        rows.withColumn("__batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(folder)
        folders.append(folder)
        if len(folders) >= every:
            last(rows.sparkSession).write.mode("overwrite").parquet(f"{path}/all-{batch}")
            gone, folders[:] = folders[:], [f"{path}/all-{batch}"]
            removed(rows.sparkSession, gone)

    query = stream.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return last(spark).drop("__batch")
