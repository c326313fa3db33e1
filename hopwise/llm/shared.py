"""Materialising steps, connected components and other helpers the operators share."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.operators import checkpointed, discard, shared_dir, stored

__all__ = ["bit_set", "checkpointed", "connected_components", "discard", "series_udf", "set_apart", "shared_dir", "small_batches", "stored", "with_parts"]
BROADCAST_IDS = 200_000


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets the session send at most so many rows to a Python worker at once, as whole texts can be long and a batch is held in memory.

    Spark bounds the bytes of a batch as well (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB unless set). Results are computed
    later, so the setting stays for the session; a stricter one is left alone.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def series_udf(run: Callable, kind: str):
    """A function from batches of a column, as Pandas series, to batches of the same lengths."""
    import pandas as pd

    run.__annotations__ = {next(iter(inspect.signature(run).parameters)): Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def set_apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by their place, so that none clashes with what an operator adds, and the new name of each."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def bit_set(places: DataFrame, size: int) -> bytes:
    """A set of places (a long column `place`) below size, a power of two; it is put together where the rows are, in parts of 128 KB."""
    part = min(size, 1 << 20)

    def run(table):
        import pyarrow as pa

        at = table.column("place").to_numpy()
        bits = np.zeros(part, np.uint8)
        bits[at % part] = 1
        return pa.table({"part": pa.array([int(at[0]) // part], pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    made = places.select("place").distinct().groupBy(F.col("place").bitwiseAND(F.lit(-part))).applyInArrow(run, "part long, bits binary")
    made = {r["part"]: bytes(r["bits"]) for r in made.collect()}
    return b"".join(made.get(i, bytes(-(-part // 8))) for i in range(size // part))


def with_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", nulls: bool = False) -> tuple[DataFrame, bool]:
    """docs with `__part`, which tells the distinct texts of an id apart and is 0 for ids of one row, and whether any is not 0; nulls: null ids have parts too."""
    ids = docs.select(F.col(id_col).alias("__id")).where("true" if nulls else "__id is not null").groupBy("__id").count()
    ids = checkpointed(ids.where("count > 1 or __id is null").select("__id", F.lit(True).alias("__again")))
    n = ids.count()
    if not n:
        return docs.withColumn("__part", F.lit(0).cast("long")), False
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    part = F.when(F.col("__again"), F.xxhash64(F.col(text_col)).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long"))
    return docs.join(ids, F.col(id_col).eqNullSafe(F.col("__id")), "left").withColumn("__part", part).drop("__id", "__again"), True


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph given as (a long, b long) rows: (node, component_id), the smallest node id.

    Every round each node points to its smallest neighbour, pointers are followed twice, and the edges are rewritten
    between what is pointed to. Only local minima survive a round, at most half of the nodes, so rounds grow with the
    logarithm of the longest path. A hub is only ever reduced by a partial aggregation or met in a join that adaptive
    execution can split. Rounds are written as Parquet: checkpoints keep the constraints of their plans, which double from round
    to round. Self loops and null ends are ignored; nodes without an edge are not listed.
    """
    spark = edges.sparkSession
    edges = stored(edges.where("a < b or a > b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    members = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("p")))
        up = least.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        step = stored(least.join(up, "p").select("v", F.col("pp").alias("p")))
        discard(least)
        before = members
        members = stored(
            step.select(F.col("v").alias("node"), F.col("p").alias("component_id"))
            if before is None
            else before.join(step, before.component_id == step.v, "left").select("node", F.coalesce("p", "component_id").alias("component_id"))
        )
        to_a, to_b = step.select(F.col("v").alias("a"), F.col("p").alias("pa")), step.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("pa <> pb")
        left = stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        discard(edges, step, *([] if before is None else [before]))
        edges = left
    discard(edges)
    if members is None:
        return spark.createDataFrame([], "node long, component_id long")
    return members
