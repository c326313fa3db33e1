"""A property graph over relational tables: each table is a vertex table with its key as id, each foreign key an edge table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.graph import CARRIED, EdgeTable, GraphConfig, PropertyGraph, VertexTable


def vertices(df: DataFrame | Callable[[], DataFrame], label: str, key: str, name: str) -> VertexTable:
    """All columns of a table as properties of vertices; the key, a column or SQL expression, is the id. A function gives the table when a plan needs it."""

    def rows() -> DataFrame:
        t = df() if callable(df) else df
        own = [f"`{c}`" for c in t.columns if c not in ("id", "name", "labels", "_seq")]
        return t.selectExpr(f"cast({key} as long) as id", f"cast({name} as string) as name", f"array('{label}') as labels", f"cast({key} as long) as _seq", *own)

    return VertexTable(rows, label)


def edges(df: DataFrame | Callable[[], DataFrame], label: str, src: tuple[str, str], dst: tuple[str, str], props: list[str] | None = None, carries: tuple[str, str] | None = None) -> EdgeTable:
    """An edge for each row, from the vertex of one label and key to that of another; keys are columns or SQL expressions.

    carries: the end, `src` or `dst`, whose own table this is, and its name column; a hop to that end then needs no join for its
    properties, and leads to each of its vertices once.
    """

    def rows() -> DataFrame:
        t = df() if callable(df) else df
        a, b, quoted = f"cast({src[1]} as long)", f"cast({dst[1]} as long)", [f"`{c}`" for c in t.columns]
        held = [f"cast({carries[1]} as string) as {CARRIED}name", *[f"`{c}` as `{CARRIED}{c}`" for c in t.columns]] if carries else []
        out = t.selectExpr(f"{a} as src", f"{b} as dst", f"xxhash64({', '.join(quoted)}) as eid", f"{b} as _seq", *(props or []), *held)
        return out.where("src is not null and dst is not null")

    return EdgeTable(rows, label, src[0], dst[0], carries[0] if carries else None)


def table_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph of the test tables; a table is looked at when a traversal needs it."""

    @cache
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    line = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    v = [
        vertices(partial(read, "region"), "region", "r_regionkey", "r_name"),
        vertices(partial(read, "nation"), "nation", "n_nationkey", "n_name"),
        vertices(partial(read, "customer"), "customer", "c_custkey", "c_name"),
        vertices(partial(read, "supplier"), "supplier", "s_suppkey", "s_name"),
        vertices(partial(read, "part"), "part", "p_partkey", "p_name"),
        vertices(partial(read, "orders"), "order", "o_orderkey", "o_orderkey"),
        vertices(partial(read, "events"), "event", "event_id", "event_type"),
    ]
    e = [
        edges(partial(read, "nation"), "in_region", ("nation", "n_nationkey"), ("region", "n_regionkey"), carries=("src", "n_name")),
        edges(partial(read, "customer"), "in_nation", ("customer", "c_custkey"), ("nation", "c_nationkey"), carries=("src", "c_name")),
        edges(partial(read, "supplier"), "based_in", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), carries=("src", "s_name")),
        edges(partial(read, "orders"), "placed", ("customer", "o_custkey"), ("order", "o_orderkey"), carries=("dst", "o_orderkey")),
        edges(partial(read, "lineitem"), "contains", ("order", "l_orderkey"), ("part", "l_partkey"), line),
        edges(partial(read, "lineitem"), "shipped_by", ("order", "l_orderkey"), ("supplier", "l_suppkey"), line),
        edges(partial(read, "events"), "did", ("customer", "user_id"), ("event", "event_id"), carries=("dst", "event_type")),
    ]
    return PropertyGraph(spark, v, e, GraphConfig(multigraph=True))


def talk_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Turns of conversations, each with an edge to the next turn; ids are conv_id * 1000 + turn."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").dropDuplicates(["conv_id", "turn"])
    key = F.col("conv_id") * 1000 + F.col("turn")
    after = t.select(key.alias("src"), (key + 1).alias("dst")).join(t.select(key.alias("dst")), "dst", "left_semi")
    return PropertyGraph(spark, [vertices(t, "turn", "conv_id * 1000 + turn", "role")], [edges(after, "next_turn", ("turn", "src"), ("turn", "dst"))], GraphConfig(multigraph=True))
