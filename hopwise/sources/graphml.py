"""GraphML files: read with Spark's XML source into typed vertex and edge tables, and written from a graph."""

from __future__ import annotations

from collections.abc import Callable
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopwise.errors import GraphError
from hopwise.graph import GraphConfig, PropertyGraph, VertexTable, edge_tables
from hopwise.operators import checkpointed

# Attribute types of the format.
TYPES = {"string": "string", "int": "int", "integer": "int", "long": "long", "float": "double", "double": "double", "boolean": "boolean"}
_DATA = "data array<struct<_key string, _VALUE string>>"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Numbers rows from 0 in file order, without a shuffle: counts of the partitions before, plus the place within; the rows are written first, so both agree."""
    df = checkpointed(df).withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright("__m", 33)
    counts = dict(df.select(part.alias("p")).groupBy("p").count().collect())
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    before = df.sparkSession.createDataFrame(before, "__p long, __before long")  # one row for each partition
    df = df.withColumn("__p", part).join(F.broadcast(before), "__p")
    return df.withColumn(name, F.col("__before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p", "__before")


def _typed(df: DataFrame, keys: list, keep: list[str]) -> DataFrame:
    """The data elements as typed columns, with the keys' defaults."""
    values = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key string, _VALUE string>>")), lambda d: F.struct(d["_key"].alias("key"), F.trim(d["_VALUE"]).alias("value"))))
    df = df.withColumn("__v", values)
    return df.select(*keep, *[F.coalesce(F.try_element_at("__v", F.lit(k["_id"])), F.lit(k["default"])).try_cast(TYPES.get(k["_attr.type"], "string")).alias(k["_attr.name"]) for k in keys])


def _chosen(key: str | Callable[[dict], str] | None, columns: list[str], default: str) -> Column:
    """A property's value as text, or what a function makes of all properties of an element."""
    if callable(key):
        made = F.udf(lambda row: key({k: v for k, v in row.asDict().items() if v is not None}), "string")
        return F.coalesce(made(F.struct(*columns)), F.lit(default))
    return F.coalesce(F.col(key).cast("string"), F.lit(default)) if key in columns else F.lit(default)


def read_graphml(
    spark: SparkSession,
    path: str,
    node_label_key: str | Callable[[dict], str] = "labelV",
    node_name_key: str | Callable[[dict], str] = "name",
    edge_label_key: str | Callable[[dict], str] | None = None,
    default_node_label: str = "Na",
    default_name: str = "Na",
    default_edge_label: str = "Na",
    include_id: bool = False,
    keep: bool = True,
    config: GraphConfig | None = None,
) -> PropertyGraph:
    """A directed GraphML file as a graph with fresh ids in file order.

    include_id keeps the file's ids as the property `original_id`; keep retains the properties that give label and name.
    """
    if spark.read.text(path).where(F.col("value").rlike("edgedefault\\s*=\\s*['\"]undirected")).limit(1).count():
        raise GraphError("the graph is undirected")
    xml = spark.read.format("xml")
    keys = [r.asDict() for r in xml.option("rowTag", "key").schema("_id string, _for string, `_attr.name` string, `_attr.type` string, default string").load(path).collect()]
    of = lambda kind: [k for k in keys if k["_for"] in (kind, "all", None)]
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {_DATA}").load(path)
    links = spark.read.format("xml").option("rowTag", "edge").schema(f"_id string, _source string, _target string, {_DATA}").load(path)
    nodes, links = _typed(nodes, of("node"), ["_id"]), _typed(links, of("edge"), ["_source", "_target"])
    props = [c for c in nodes.columns if c != "_id"]
    labels, names = _chosen(node_label_key, props, default_node_label), _chosen(node_name_key, props, default_name)
    gone = {"name", *([] if keep else [k for k in (node_label_key, node_name_key) if isinstance(k, str)])}
    v = numbered(nodes, "_seq").withColumns({"id": F.col("_seq").cast("string"), "__name": names, "labels": F.array(labels)})
    ids = v.select(F.col("_id").alias("__id"), F.col("id").alias("__new"))
    rest = [c for c in props if c not in gone]
    v = v.select("id", F.col("__name").alias("name"), "labels", "_seq", *([F.col("_id").alias("original_id")] if include_id else []), *rest)
    columns = [c for c in links.columns if c not in ("_source", "_target")]
    label = _chosen(edge_label_key, columns, default_edge_label)
    e = numbered(links, "_seq").withColumn("label", label).join(ids.toDF("_source", "src"), "_source").join(ids.toDF("_target", "dst"), "_target")
    e = e.select("src", "dst", F.col("_seq").alias("eid"), "_seq", "label", *[c for c in columns if c not in ("label", "src", "dst")])
    config = config or GraphConfig()
    return PropertyGraph(spark, [VertexTable(v)], edge_tables(e, config.multigraph), config)


def graphml_lines(graph: PropertyGraph) -> DataFrame:
    """(at, value): the lines of a GraphML document, whose order is that of `at`: 0 the head, 1 vertices, 2 edges, 3 the end."""
    spark = graph.spark
    kinds = {T.LongType(): "long", T.IntegerType(): "int", T.DoubleType(): "double", T.FloatType(): "double", T.BooleanType(): "boolean"}
    v, e = graph.all_vertices(), graph.all_edges() if graph.edges else None
    props = {"node": [f for f in v.schema if f.name not in ("id", "labels", "_seq")], "edge": [f for f in e.schema if f.name not in ("src", "dst", "eid", "_seq", "label")] if e is not None else []}
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id={quoteattr(f"{kind}_{f.name}")} for="{kind}" attr.name={quoteattr(f.name)} attr.type="{kinds.get(f.dataType, "string")}"/>' for kind, own in props.items() for f in own]
    head += ['<key id="node_labels" for="node" attr.name="labelV" attr.type="string"/>', '<key id="edge_label" for="edge" attr.name="labelE" attr.type="string"/>', '<graph edgedefault="directed">']

    def safe(c: Column) -> Column:
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(plain), F.lit(entity))
        return c

    def data(kind: str) -> list[Column]:
        return [F.concat(F.lit(f"<data key={quoteattr(f'{kind}_{f.name}')}>"), safe(F.col(f"`{f.name}`").cast("string")), F.lit("</data>")) for f in props[kind]]

    text = lambda c: safe(F.col(c).cast("string"))
    lines = [
        spark.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(3, 0, "</graph>"), (3, 1, "</graphml>")], "at int, n long, value string"),
        v.select(F.lit(1).alias("at"), F.col("_seq").cast("long").alias("n"), F.concat_ws("", F.lit('<node id="'), text("id"), F.lit('"><data key="node_labels">'), safe(F.array_join("labels", ",")), F.lit("</data>"), *data("node"), F.lit("</node>")).alias("value")),
    ]
    if e is not None:
        lines.append(e.select(F.lit(2).alias("at"), F.col("_seq").cast("long").alias("n"), F.concat_ws("", F.lit('<edge source="'), text("src"), F.lit('" target="'), text("dst"), F.lit('"><data key="edge_label">'), text("label"), F.lit("</data>"), *data("edge"), F.lit("</edge>")).alias("value")))
    out = lines[0]
    for x in lines[1:]:
        out = out.union(x)
    return out


def write_graphml(graph: PropertyGraph, path: str, single: bool = True) -> None:
    """Writes a graph as GraphML.

    With `single`, to one file of the driver's file system, streaming the lines through the driver: for graphs that a single file suits.
    Without, to a folder of part files anywhere Spark can write: the executors write them, in the order of their names they are
    the same document, and `read_graphml` reads the folder.
    """
    lines = graphml_lines(graph).orderBy("at", "n").select("value")
    if not single:
        lines.write.text(path)
        return
    with open(path, "w", encoding="utf-8") as out:
        for r in lines.toLocalIterator():
            out.write(f"{r['value']}\n")
