"""Longest-processing-time sharding of groups that must stay together.

Groups are rows with equal texts, keyed by a 64-bit hash of the text (texts that collide only stay together as well). All groups
are scheduled, largest first, each on the least-loaded shard through a heap. Groups of one size are interchangeable, so the
driver sees only the distinct sizes and how many groups have each (no more sizes than the root of twice the bytes, as different
sizes add up), and works out how many groups of each size every shard gets: one by one for a few, by the level up to which
shards are filled for many. Which groups these are follows from their ranks among those of their size, which are numbered by
Spark. So shards differ by no more than the smallest groups unless a few groups outweigh the rest.

A null text has size 1 and a null checksum; nulls are one group. Slots number the rows of a shard from 0 without gaps in
the order of a hashed bucket and the id; rows that repeat an id get slots of their own. A null id is allowed.
"""

from __future__ import annotations

import heapq
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopwise.llm.shared import stored

SLOT_ROWS = 64
RANKED, HOT, BROADCAST_SIZES = 4096, 1 << 15, 100_000


def least_loaded(items: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """Shard of each (key, size), by longest processing time; ties go to the smaller key and the smaller shard."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for key, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, s = heap[0]
        placed[key] = s
        heapq.heapreplace(heap, (load + size, s))
    return placed


def class_counts(sizes: list[tuple[int, int]], shards: int) -> list[list[int]]:
    """For each (size, number of groups), sizes descending, the groups that each shard gets by longest processing time; ties go to the smaller shard."""
    loads = [0] * shards
    out = []
    for size, n in sizes:
        if n <= 4 * shards:
            counts = [0] * shards
            heap = [(load, s) for s, load in enumerate(loads)]
            heapq.heapify(heap)
            for _ in range(n):
                load, s = heap[0]
                counts[s] += 1
                heapq.heapreplace(heap, (load + size, s))
        else:
            # a shard is picked at its load, then a size above it and so on; the n lowest picks are those below a level and some of those at it
            below = lambda level: [max(0, -((load - level) // size)) for load in loads]  # noqa: B023, E731
            low, high = min(loads), min(loads) + size * (n + 1)
            while high - low > 1:
                level = (low + high) // 2
                low, high = (level, high) if sum(below(level)) <= n else (low, level)
            counts = below(low)
            left = n - sum(counts)
            for s, load in enumerate(loads):
                if left and load + counts[s] * size == low:
                    counts[s] += 1
                    left -= 1
        loads = [load + k * size for load, k in zip(loads, counts, strict=True)]
        out.append(counts)
    return out


def _scheduled(groups: DataFrame, n_shards: int) -> DataFrame:
    """(group, copies, shard); groups: (group, bytes, copies)."""
    import pyarrow as pa

    sizes = sorted(((r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    to, upto = [], []
    for counts in class_counts(sizes, n_shards):
        some = [s for s in range(n_shards) if counts[s]]
        to.append(some)
        upto.append(list(accumulate(counts[s] for s in some)))
    table = pa.table({"bytes": pa.array([b for b, _ in sizes], pa.int64()), "n": pa.array([n for _, n in sizes], pa.int64()), "to": pa.array(to, pa.list_(pa.int32())), "upto": pa.array(upto, pa.list_(pa.int64()))})
    classes = groups.sparkSession.createDataFrame(table)
    classes = F.broadcast(classes) if len(sizes) <= BROADCAST_SIZES else classes
    # the ranks of a large class are numbered in parts
    parts = F.when(F.col("n") > RANKED, F.ceil(F.sqrt("n"))).otherwise(F.lit(1)).cast("long")
    of = groups.join(classes, "bytes").withColumn("part", F.pmod(F.xxhash64("group", F.lit(7)), parts))
    counts = of.where(F.col("n") > RANKED).groupBy("bytes", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bytes").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("bytes", "part", F.sum("n").over(before).alias("earlier"))
    within = Window.partitionBy("bytes", "part").orderBy("group")
    ranked = of.withColumn("row", F.row_number().over(within) - 1).join(counts, ["bytes", "part"], "left").withColumn("rank", F.coalesce("earlier", F.lit(0)) + F.col("row"))
    return ranked.select("group", "copies", F.get("to", F.size(F.filter("upto", lambda x: x <= F.col("rank")))).alias("shard"))


def shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row per input row, in shards near equal in bytes."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
    )
    rows = stored(rows)
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies")))
    put = stored(_scheduled(groups, n_shards))
    n_rows = groups.agg(F.sum("copies")).first()[0] or 0
    # texts of many copies, HOT at most, are looked up where their rows are; the others have few rows each and are joined
    hot = F.broadcast(put.where(F.col("copies") * HOT >= n_rows).select("group", "shard"))
    cool = put.where(F.col("copies") * HOT < n_rows).select("group", "shard")
    put = rows.join(hot, "group").unionByName(rows.join(hot.select("group"), "group", "left_anti").join(cool, "group"))

    buckets = max(1, n_rows // (n_shards * SLOT_ROWS))
    put = stored(put.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(min(buckets, 1 << 16))).cast("int").alias("bucket")))
    counts = put.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    numbered = put.withColumn("row", F.row_number().over(within) - 1).join(offsets, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
