"""Materialising steps that all operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from hopwise.errors import QueryError


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir. Where none is named, a temporary one on a single machine; on a cluster that is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise QueryError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = named or tempfile.mkdtemp(prefix="hopwise-checkpoint-")
        context.setCheckpointDir(named)
    return named or context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage; the rows lie in the shared folder, so a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As `checkpointed`, but as Parquet: compressed, read by column, and without the constraints of the plan that made the rows."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/hopwise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what `stored` wrote for these frames; only for frames that no later job reads."""
    for df in frames:
        removed(df.sparkSession, [df._stored_at])


def removed(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
