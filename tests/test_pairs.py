"""Property joins of few keys: every pair once, dealt to many tasks."""

import re
from itertools import product

from pyspark.sql import functions as F

from hopwise.graph import BLOCK, GraphConfig, PropertyGraph, equal_pairs
from hopwise.sources.tables import vertices


def test_pairs_of_one_key_are_dealt(spark, tmp_path):
    """4,000,000 pairs of one key from tables of one partition each: no task lists a fourth of them."""
    for name in ("a", "b"):
        spark.range(2000).selectExpr(f"id as {name}_key", "7 as place").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    tables = [vertices(spark.read.parquet(f"{tmp_path}/{x}"), x, f"{x}_key", f"{x}_key") for x in ("a", "b")]
    graph = PropertyGraph(spark, tables, [], GraphConfig(multigraph=True))
    graph.join("a", "b", "place", "place", "near")
    edges = graph.traversal().V().has_label("a").outE("near").to_df("src", "dst", "label")
    dealt = edges.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in dealt) == 2000 * 2000
    assert max(r["n"] for r in dealt) < 2000 * 2000 / 4
    assert edges.agg(F.count_distinct("src", "dst")).first()[0] == 2000 * 2000


def test_pairs_as_a_plain_join(spark):
    """Keys of two types, keys of one side only, null ids and keys, equal ids, and blocks just at and over their size."""
    a = [(i, i % 3) for i in range(BLOCK + 1)] + [(i, 5) for i in range(BLOCK)] + [(None, 1), (None, 1), (4, 1), (4, 1), (9, 8)]
    b = [(f"b{i}", i % 4) for i in range(2 * BLOCK + 1)] + [(None, 1), (None, 5), ("x", 5), ("x", 5), ("y", 9)]
    left, right = spark.createDataFrame(a, "id long, key int"), spark.createDataFrame(b, "id string, key long")
    show = lambda rows: sorted(map(repr, rows))
    assert show(map(tuple, equal_pairs(left, right).collect())) == show((x, y) for (x, k), (y, j) in product(a, b) if k == j)
    assert equal_pairs(left.where("false"), right).isEmpty()


def test_neighbours_go_to_one_task(spark):
    """Of 16 keys and 144 pairs of blocks, a task of 16 has the pairs of few keys, so a file's dictionary of ids stays small."""
    ids = spark.range(16 * 600).selectExpr("id", "id % 16 as key")
    pairs = equal_pairs(ids, ids)
    tasks = pairs.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.expr("src % 16")).alias("keys")).collect()
    assert sum(r["n"] for r in tasks) == 16 * 600 * 600
    assert len(tasks) >= 12
    assert max(r["keys"] for r in tasks) <= 4


def test_lists_are_opened_one_after_the_other(spark, capsys):
    """Spark compiles the two lists apart: as one loop, it holds the pairs of two whole blocks at a time."""
    ids = spark.range(10).selectExpr("id", "id % 2 as key")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        equal_pairs(ids, ids).explain()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    loops = re.findall(r"\*\((\d+)\) Generate explode", capsys.readouterr().out)
    assert len(loops) == len(set(loops)) == 2
