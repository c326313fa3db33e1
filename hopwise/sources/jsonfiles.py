"""JSON sources: GraphSON (lines or wrapped), a document as a tree, and nodes from JSON lines."""

from __future__ import annotations

import json
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.graph import GraphConfig, PropertyGraph, VertexTable, edge_tables, union
from hopwise.operators import checkpointed, stored
from hopwise.sources.graphml import numbered

# Type tags of the format.
TAGS = {"g:Int32": "long", "g:Int64": "long", "g:Float": "double", "g:Double": "double", "g:Timestamp": "long", "g:Date": "long"}


def plain(x):
    """A GraphSON value without its type tags."""
    if isinstance(x, dict):
        if "@type" in x:
            v = x.get("@value")
            if x["@type"] == "g:Map":
                return {plain(k): plain(w) for k, w in zip(v[::2], v[1::2], strict=True)}
            return [plain(i) for i in v] if x["@type"] in ("g:List", "g:Set") else plain(v)
        return {k: plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, list) else x


def tagged(x):
    """A Python value with its GraphSON type tag."""
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, int):
        return {"@type": "g:Int32" if -(1 << 31) <= x < 1 << 31 else "g:Int64", "@value": x}
    if isinstance(x, float):
        return {"@type": "g:Double", "@value": x}
    if isinstance(x, (list, tuple)):
        return {"@type": "g:List", "@value": [tagged(v) for v in x]}
    if isinstance(x, dict):
        return {"@type": "g:Map", "@value": [y for k, v in x.items() for y in (k, tagged(v))]}
    return str(x)


_ROWS = "id string, label string, props map<string,string>, kinds map<string,string>, dst string"


def _rows(batches):
    import pandas as pd

    def flat(props):
        values, kinds = {}, {}
        for k, v in props.items():
            v = v[0] if isinstance(v, list) and v else v
            v = plain(v["value"] if isinstance(v, dict) and "value" in v else v)
            if v is not None:
                values[k] = v if isinstance(v, str) else json.dumps(v)
                kinds[k] = "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string"
        return values, kinds

    for batch in batches:
        out = []
        for line in batch["value"]:
            if not line.strip():
                continue
            doc = json.loads(line)
            for vertex in doc.get("vertices", [doc]):
                key = str(plain(vertex["id"]))
                out.append((key, vertex.get("label", "vertex"), *flat(vertex.get("properties", {})), None))
                for label, edges in vertex.get("outE", {}).items():
                    out += [(key, label, *flat(e.get("properties", {})), str(plain(e["inV"]))) for e in edges]
        yield pd.DataFrame(out, columns=["id", "label", "props", "kinds", "dst"])


def read_graphson(spark: SparkSession, path: str, config: GraphConfig | None = None) -> PropertyGraph:
    """Adjacency GraphSON: one vertex a line, or one document with `vertices`; type tags are optional."""
    wrapped = spark.read.text(path, wholetext=True).where(F.col("value").rlike('^\\s*\\{\\s*"vertices"')).limit(1).count() > 0
    rows = spark.read.text(path, wholetext=wrapped).mapInPandas(_rows, _ROWS)
    rows = stored(numbered(rows, "_seq"))
    kinds: dict[tuple[bool, str], set] = {}
    for r in rows.select(F.col("dst").isNull().alias("v"), F.explode("kinds").alias("k", "t")).distinct().collect():
        kinds.setdefault((r["v"], r["k"]), set()).add(r["t"])
    to = lambda k: next(iter(k)) if len(k) == 1 else "double" if k <= {"long", "double"} else "string"
    props = lambda vertex: [F.try_element_at("props", F.lit(k)).cast(to(t)).alias(k) for (v, k), t in sorted(kinds.items()) if v == vertex and k not in ("name", "id")]
    v = rows.where("dst is null").select("id", F.try_element_at("props", F.lit("name")).alias("name"), F.array("label").alias("labels"), "_seq", *props(True))
    e = rows.where("dst is not null").select(F.col("id").alias("src"), "dst", F.col("_seq").alias("eid"), "_seq", "label", *props(False))
    config = config or GraphConfig()
    return PropertyGraph(spark, [VertexTable(v)], edge_tables(e, config.multigraph), config)


def graphson_lines(graph: PropertyGraph) -> DataFrame:
    """One adjacency GraphSON line for each vertex, as a DataFrame with the column `value`."""
    v, e = graph.all_vertices(), graph.all_edges() if graph.edges else None
    node_props = [c for c in v.columns if c not in ("id", "labels", "_seq")]
    v = v.select("id", F.col("labels")[0].alias("label"), F.struct(*node_props).alias("props"))
    if e is not None:
        edge_props = [c for c in e.columns if c not in ("src", "dst", "eid", "_seq", "label")]
        inner = F.struct("label", "dst", "eid", F.struct(*edge_props).alias("props") if edge_props else F.lit(None).alias("props"))
        v = v.join(e.groupBy(F.col("src").alias("id")).agg(F.collect_list(inner).alias("out")), "id", "left")
    else:
        v = v.withColumn("out", F.lit(None))

    def run(batches):
        import pandas as pd

        for batch in batches:
            lines = []
            for key, label, props, out in zip(batch["id"], batch["label"], batch["props"], batch["out"], strict=True):
                doc: dict = {"id": tagged(key), "label": label, "properties": {k: [{"value": tagged(x)}] for k, x in props.items() if x is not None and x == x}}
                for e in out if out is not None else ():
                    inner = {k: tagged(x) for k, x in (e["props"] or {}).items() if x is not None and x == x}
                    doc.setdefault("outE", {}).setdefault(e["label"], []).append({"id": tagged(int(e["eid"])), "inV": tagged(e["dst"]), "properties": inner})
                lines.append(json.dumps(doc, default=lambda x: x.item() if hasattr(x, "item") else str(x)))
            yield pd.DataFrame({"value": lines})

    return v.mapInPandas(run, "value string")


def read_json_tree(spark: SparkSession, path: str, lines: bool = False) -> PropertyGraph:
    """JSON documents as trees: objects and lists are nodes with an edge from their parent, list members are `item_<i>`, leaves have type and value.

    Each file below the path is a document, with `lines` each line that is not blank. Ids are a document's file (and line) and the
    places from its root down to the node. Documents are VARIANT values that Spark takes apart level by level, so none passes through the driver,
    and the jobs are as many as the levels. A document that is no JSON is a leaf of type `invalid` with its text.
    """
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=not lines).select("value", "_metadata.file_path", "_metadata.file_name", "_metadata.file_block_start")
    rows = rows.where(F.trim("value") != "") if lines else rows
    line = F.concat(F.col("file_path"), F.lit("#"), F.monotonically_increasing_id().cast("string")) if lines else F.col("file_path")
    level = rows.select(line.alias("id"), F.lit("root").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("edge"), F.try_parse_json("value").alias("v"), F.col("value").alias("text"))
    level = level.withColumn("text", F.when(F.col("v").isNull(), F.col("text")))
    found: list[DataFrame] = []
    while True:
        kind = F.regexp_extract(F.coalesce(F.schema_of_variant("v"), F.lit("INVALID")), "^[A-Z]+", 0)
        level = stored(level.withColumn("kind", kind))
        found.append(_leaves(level))
        inner = level.where(F.col("kind").isin("OBJECT", "ARRAY"))
        if inner.isEmpty():
            break
        inner.createOrReplaceTempView(view := f"hopwise_{uuid.uuid4().hex}")
        level = spark.sql(f"""SELECT concat(d.id, IF(d.parent IS NULL, ':', '.'), e.pos) AS id, coalesce(e.key, concat('item_', e.pos)) AS name, d.id AS parent,
            IF(e.key IS NULL, 'has_item', concat('has_', e.key)) AS edge, e.value AS v, CAST(NULL AS STRING) AS text FROM {view} d, LATERAL variant_explode(d.v) e""")
        spark.catalog.dropTempView(view)
    nodes = union(found)
    seq = F.xxhash64("id")
    v = nodes.select("id", "name", F.array(F.when(F.col("type").isin("dict", "list"), "Node").otherwise("Leaf")).alias("labels"), seq.alias("_seq"), "type", "value")
    e = nodes.where("parent is not null").select(F.col("parent").alias("src"), F.col("id").alias("dst"), seq.alias("eid"), seq.alias("_seq"), F.col("edge").alias("label"))
    return PropertyGraph(spark, [VertexTable(v)], edge_tables(stored(e), True), GraphConfig(multigraph=True))


#: Names of types in trees, by those of VARIANT.
_TYPES = {"OBJECT": "dict", "ARRAY": "list", "STRING": "str", "BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "FLOAT": "float", "BOOLEAN": "bool", "VOID": "NoneType", "INVALID": "invalid"}


def _leaves(level: DataFrame) -> DataFrame:
    """Nodes of a level without their contents: type, and the value of leaves as text."""
    text = F.try_variant_get("v", "$", "string")
    text = F.when(F.col("kind") == "BOOLEAN", F.initcap(text)).otherwise(text)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair]), F.col("kind"))
    value = F.when(~F.col("kind").isin("OBJECT", "ARRAY", "VOID"), F.coalesce("text", text))
    return level.select("id", "name", "parent", "edge", kind.alias("type"), value.alias("value"))


def read_json_lines(spark: SparkSession, path: str, id_key: str = "id") -> tuple[PropertyGraph, DataFrame]:
    """A vertex for each line, of the type that the file name gives, and the lines that are no JSON objects."""
    table = PurePosixPath(path).stem
    rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = checkpointed(rows)
    bad = rows.where(F.col("_bad").isNotNull()).select("_bad") if "_bad" in rows.columns else spark.createDataFrame([], "_bad string")
    good = numbered(rows.where(F.col("_bad").isNull()).drop("_bad") if "_bad" in rows.columns else rows, "_seq")
    key = F.coalesce(F.col(id_key).cast("string"), F.col("_seq").cast("string")) if id_key in good.columns else F.col("_seq").cast("string")
    name = F.col("name").cast("string") if "name" in good.columns else key
    props = [c for c in good.columns if c not in ("id", "name", "labels", "_seq", "type")]
    return PropertyGraph(spark, [VertexTable(good.select(key.alias("id"), name.alias("name"), F.array(F.lit(table)).alias("labels"), "_seq", F.lit(table).alias("type"), *props))], []), bad
