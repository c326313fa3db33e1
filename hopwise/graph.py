"""Property graphs as vertex and edge DataFrames.

A vertex table has `id`, `name`, `labels` (array), `_seq` (insertion order) and typed properties; an edge table has `src`, `dst`,
`eid`, `_seq` and properties. A table with a static label holds only elements of that label; the planner then scans only the
tables that a traversal can reach. Graphs made by a builder have one vertex table without a static label and string ids, and
keep one edge for each ordered pair of vertices unless `multigraph` is set: the last label wins, properties accumulate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopwise.errors import GraphError
from hopwise.operators import stored
from hopwise.operators.idindex import IdIndex

CARRIED = "__v_"
MOST_CHANGES, MOST_ADDED = 64, 1000  # that a table is read with; more are written into it
BLOCK = 256  # ids of one key that a property join handles as one
VERTEX_FIELDS, EDGE_FIELDS = ("id", "name", "labels", "_seq"), ("src", "dst", "eid", "_seq")


@dataclass(frozen=True)
class GraphConfig:
    name_field: str = "name"
    label_field: str = "labels"
    edge_label_field: str = "labels"
    default_node_label: str = "Node"
    default_edge_label: str = "Edge"
    multigraph: bool = False
    most_rounds: int = 1000  # of a loop; more are an error


@dataclass(frozen=True)
class Changes:
    """Changes of properties that a table's rows do not have yet. Each change has a version and wrote, once, a folder of the keys of the elements that it hit.

    ops: (version, column, family, value). A family says how changes of one column add up: `single` (the last counts), `list` and `set` (values are
    added in turn) or `map` (an entry; one such change at a time). They are merged on reading, by one join for all of them.
    """

    path: str
    ops: tuple[tuple, ...] = ()

    def fits(self, column: str, family: str) -> bool:
        return len(self.ops) < MOST_CHANGES and all(f == family != "map" for _, c, f, _ in self.ops if c == column)

    def merged(self, df: DataFrame, on: list[str]) -> DataFrame:
        versions = [v for v, *_ in self.ops]
        schema = T.StructType([*[df.schema[c] for c in on], T.StructField("v", T.IntegerType())])
        hits = df.sparkSession.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/v={v}" for v in versions])
        df = df.join(hits.groupBy(*on).agg(F.collect_set("v").alias("__v")), on, "left")
        return df.withColumns({c: self._value(df, c) for c in dict.fromkeys(c for _, c, _, _ in self.ops)}).drop("__v")

    def _value(self, df: DataFrame, column: str) -> Column:
        own = [(v, x) for v, c, _, x in self.ops if c == column]
        family = next(f for _, c, f, _ in self.ops if c == column)
        old = F.col(f"`{column}`") if column in df.columns else None
        hit = F.array_sort(F.array_intersect("__v", F.array(*[F.lit(v) for v, _ in own])))
        kind = typed([{"x": x if family != "map" else x[1]} for _, x in own])[1]["x"]
        values = F.map_from_arrays(F.array(*[F.lit(v) for v, _ in own]), F.array(*[F.lit(x if family != "map" else x[1]).cast(kind) for _, x in own]))
        if family == "single":
            new = F.element_at(values, F.element_at(hit, -1))
            had = None if old is None else df.schema[column].dataType
            if old is not None and had != kind and not (isinstance(had, T.NumericType) and isinstance(kind, T.NumericType)):
                new, old = new.cast("string"), old.cast("string")
        elif family == "map":
            key = own[0][1][0]
            one = F.map_from_arrays(F.array(F.lit(key)), F.array(F.lit(own[0][1][1])))
            new = one if old is None else F.map_concat(F.map_filter(F.coalesce(old, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: k != key), one)
        else:
            add, have = F.transform(hit, lambda v: F.element_at(values, v)), F.array() if old is None else F.coalesce(old, F.array())
            new = F.concat(have, add) if family == "list" else F.array_union(have, add)
        return F.when(F.size(F.coalesce(hit, F.array().cast("array<int>"))) > 0, new).otherwise(F.lit(None) if old is None else old)


def overlaid(table, on: list[str]) -> DataFrame:
    """A table's rows with those added and the changes made since."""
    df = table.rows() if callable(table.rows) else table.rows
    df = aligned(df, frame_of(df.sparkSession, table.added)) if table.added else df
    return table.changes.merged(df, on) if table.changes else df


def frame_of(spark: SparkSession, rows: tuple[dict, ...]) -> DataFrame:
    """Rows given as dicts, each column with a type that holds all of its values."""
    keys, kinds = typed(list(rows))
    return spark.createDataFrame([tuple(fitting(r.get(k), kinds[k]) for k in keys) for r in rows], T.StructType([T.StructField(k, kinds[k]) for k in keys]))


@dataclass(frozen=True)
class VertexTable:
    rows: DataFrame | Callable[[], DataFrame]  # a function is called when a plan first needs the table
    label: str | None = None
    added: tuple[dict, ...] = ()
    changes: Changes | None = None

    @cached_property
    def df(self) -> DataFrame:
        return overlaid(self, ["id"])

    @cached_property
    def properties(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema if f.name not in ("id", "labels", "_seq")}


@dataclass(frozen=True)
class EdgeTable:
    rows: DataFrame | Callable[[], DataFrame]
    label: str
    src_label: str | None = None
    dst_label: str | None = None
    carries: str | None = None  # the end, `src` or `dst`, whose own table this is: its properties are in the rows, under CARRIED names, and it has one edge
    halves: tuple[DataFrame, DataFrame] | None = None  # (id, key) of the sources and of the targets, where all of equal keys are linked
    hubs: tuple[tuple[str, dict], ...] = ()  # for an end, the vertices with very many edges and into how many parts these are split
    added: tuple[dict, ...] = ()
    changes: Changes | None = None

    @cached_property
    def df(self) -> DataFrame:
        return overlaid(self, ["src", "dst", "eid"])

    @cached_property
    def properties(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema if f.name not in EDGE_FIELDS and not f.name.startswith(CARRIED)}


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def blocks(df: DataFrame, name: str) -> DataFrame:
    """(key, block, ids) of rows (id, key): each key's ids in arrays of about BLOCK, told apart by a hash of the id."""
    sizes = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    block = F.expr(f"pmod(xxhash64(id), (n + {BLOCK - 1}) div {BLOCK})")
    lost = F.array_repeat(F.lit(None).cast(df.schema["id"].dataType), F.count_if(F.col("id").isNull()).cast("int"))  # a list drops nulls
    return df.join(sizes, "key").groupBy("key", block.alias(f"{name}_block")).agg(F.concat(F.collect_list("id"), lost).alias(f"{name}s"))


def equal_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, dst) for all rows (id, key) of two frames with equal keys; neither few keys nor one frequent key leave them to few tasks.

    Pairs of blocks are joined and dealt to the tasks, BLOCK² pairs of rows each, and listed there: what is sent and what a task holds at a
    time are small however many rows share a key. A range of neighbours goes to each task, so the ids in a task are few against its rows and a
    file's dictionary holds them. The two lists are opened by two steps with `coalesce` between them, which moves nothing: Spark would make one loop
    of both, which keeps copies of all BLOCK² pairs before it hands on the first.
    """
    spark = a.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # a number, as few bytes become many rows
    dealt = blocks(a, "src").join(blocks(b, "dst"), "key").repartitionByRange(tasks, "key", "src_block", "dst_block")
    return dealt.select(F.explode("srcs").alias("src"), "dsts").coalesce(tasks).select("src", F.explode("dsts").alias("dst"))


@dataclass
class PropertyGraph:
    """Vertex tables and edge tables; changing steps put new tables in their place."""

    spark: SparkSession
    vertices: list[VertexTable] = field(default_factory=list)
    edges: list[EdgeTable] = field(default_factory=list)
    config: GraphConfig = field(default_factory=GraphConfig)
    numbers: dict = field(default_factory=dict, repr=False)  # next places, by the tables that they were counted in
    index: IdIndex | None = field(default=None, repr=False)
    log: list = field(default_factory=list, repr=False)  # the folder of changes, and the versions so far

    def traversal(self):
        from hopwise.plans.traversal import Source

        return Source(self)

    @property
    def id_type(self) -> T.DataType:
        return self.vertices[0].df.schema["id"].dataType if self.vertices else T.StringType()

    def all_vertices(self) -> DataFrame:
        return union([t.df for t in self.vertices])

    def all_edges(self) -> DataFrame:
        return union([t.df.drop(*[c for c in t.df.columns if c.startswith(CARRIED)]).withColumn("label", F.lit(t.label)) for t in self.edges])

    def get_nodes(self, label: str | None = None, name: str | None = None) -> DataFrame:
        df = self.all_vertices()
        if label is not None:
            df = df.where(F.array_contains("labels", label))
        return df if name is None else df.where(F.col("name") == name)

    def _next(self, tables: list) -> int:
        """The place after the last; it is counted once for the tables as they were read, and what was added since is at hand."""
        known = tuple(id(t.rows) for t in tables)
        if known not in self.numbers:
            plain = [replace(t, added=(), changes=None).df.select("_seq") for t in tables]
            self.numbers[known] = (union(plain).agg(F.max("_seq")).first()[0] if plain else None, [t.rows for t in tables])
        last = max([-1 if self.numbers[known][0] is None else int(self.numbers[known][0]), *(r["_seq"] for t in tables for r in t.added)])
        return last + 1

    def _next_seq(self) -> int:
        return self._next(self.vertices)

    def add_vertex(self, label: str, name: str = "", id=None, **properties) -> str:
        """Adds a vertex and returns its id: the next number as a string unless given."""
        check_reserved(self.config, properties)
        seq = self._next_seq()
        key = id if id is not None else (str(seq) if isinstance(self.id_type, T.StringType) else seq)
        row = {"id": key, "name": name, "labels": [label], "_seq": seq, **properties}
        at = next((i for i, t in enumerate(self.vertices) if t.label in (None, label)), None)
        if at is None:
            self.vertices.append(VertexTable(frame_of(self.spark, (row,)), label))
        else:
            self.vertices[at] = grown(self.vertices[at], row)
        return key

    def add_edge(self, label: str, src, dst, **properties) -> None:
        """Adds an edge, or updates the one between these vertices unless the graph is a multigraph."""
        for end in (src, dst):
            if not any(r["id"] == end for t in self.vertices for r in t.added) and self.all_vertices().where(F.col("id") == end).isEmpty():
                raise GraphError(f"no vertex has the id {end!r}")
        rows = self.edge_rows() if not self.config.multigraph else None
        seq = self._next(self.edges)
        row = {"src": src, "dst": dst, "eid": seq, "_seq": seq, **properties}
        if rows is not None:
            row = frame_of(self.spark, (row,)).withColumn("label", F.lit(label))
            self.edges = edge_tables(aligned(rows, row) if rows.columns else row, False)
            return
        at = next((i for i, t in enumerate(self.edges) if t.label == label and t.src_label is None), None)
        if at is None:
            self.edges.append(EdgeTable(frame_of(self.spark, (row,)), label))
        else:
            self.edges[at] = grown(self.edges[at], row)

    def changed(self, table, column: str, family: str, value, version: int):
        """A table with one more change, whose hits lie in the log under this version; changes that do not add up are written into the table first."""
        have = table.changes or Changes(self.log[0])
        if not have.fits(column, family):
            table, have = replace(table, rows=stored(table.df), added=(), changes=None), Changes(self.log[0])
        return replace(table, changes=replace(have, ops=(*have.ops, (version, column, family, value))))

    def edge_rows(self) -> DataFrame:
        if self.edges:
            return self.all_edges()
        kind = self.id_type.simpleString()
        return self.spark.createDataFrame([], f"src {kind}, dst {kind}, eid long, _seq long, label string")

    def merge(self, other: PropertyGraph, src_id: str, target_id: str, edge_label: str) -> PropertyGraph:
        """The union of two built graphs, with new ids for `other` and an edge from src_id to the moved target_id."""
        shift = self._next_seq()
        out = self.plus(other)
        out.add_edge(edge_label, src_id, str(int(target_id) + shift))
        return out

    def plus(self, other: PropertyGraph) -> PropertyGraph:
        """The union of two built graphs: the ids of `other`, numbers as strings, go on after those of this one."""
        shift = self._next_seq()
        moved = other.all_vertices().withColumns({"id": (F.col("id").cast("long") + shift).cast("string"), "_seq": F.col("_seq") + shift})
        ends = {c: (F.col(c).cast("long") + shift).cast("string") for c in ("src", "dst")}
        out = PropertyGraph(self.spark, [VertexTable(aligned(self.all_vertices(), moved))], [], self.config)
        rows = self.edge_rows()
        if other.edges:
            rows = aligned(rows, other.all_edges().withColumns(ends))
        out.edges = edge_tables(rows, self.config.multigraph)
        return out

    def join(self, from_label: str, to_label: str, join_field: str, target_key: str, edge_label: str) -> None:
        """An edge for every pair of vertices of the two labels with equal fields: an equi-join of blocks of vertices, see `equal_pairs`.

        Between two labels of a multigraph the edges are kept as the keys of their ends too, and a hop whose rows may be put together goes from
        key to key: `count` and `dedup` never list the pairs.
        """
        pick = lambda label: union([t.df for t in self.vertices if t.label in (None, label)]).where(F.array_contains("labels", label))
        a, b = pick(from_label), pick(to_label)
        if join_field not in a.columns or target_key not in b.columns:
            raise GraphError(f"no field {join_field!r} or {target_key!r} to join on")
        ends = a.select("id", F.col(join_field).alias("key")).where("key is not null"), b.select("id", F.col(target_key).alias("key")).where("key is not null")

        def pairs() -> DataFrame:
            made = equal_pairs(*ends).where("src <> dst" if from_label == to_label else "true")
            return made.select("src", "dst", F.xxhash64("src", "dst").alias("eid"), F.lit(0).cast("long").alias("_seq"))

        if self.config.multigraph or not self.edges:
            known = self.vertices[0].label is not None
            whole = known and from_label != to_label
            self.edges.append(EdgeTable(pairs, edge_label, *((from_label, to_label) if known else (None, None)), halves=ends if whole else None))
        else:
            self.edges = edge_tables(aligned(self.edge_rows(), pairs().withColumn("label", F.lit(edge_label))), False)

    def spread(self, *labels: str, share: float = 1 / 32) -> PropertyGraph:
        """The graph with the edges of its hubs spread: a hop to edges of a vertex that has more than this share of an edge table's edges is made in parts.

        A sketch of each edge table (of these labels, or all) counts the most frequent ends once. There are at most 1 / share hubs for an end, so they are literals of the plan. A
        hop splits a hub's edges by a hash into as many parts as it has shares, joins each part with a copy of the rows on the hub, and all
        other rows as ever.
        """
        most = int(1 / share)
        made = []
        for t in self.edges:
            found = []
            if not t.halves and (not labels or t.label in labels):
                row = t.df.selectExpr("count(*) as n", *[f"approx_top_k({end}, {most}, {16 * most}) as {end}" for end in ("src", "dst")]).first()
                for end in ("src", "dst"):
                    hubs = {x["item"]: -(-int(x["count"]) * most // row["n"]) for x in row[end] or [] if x["count"] > share * row["n"]}
                    found += [(end, hubs)] if hubs else []
            made.append(replace(t, hubs=tuple(found)))
        return replace(self, edges=made)

    def indexed(self) -> PropertyGraph:
        """The graph with an index of ids, so that a traversal from given ids reads only the vertex tables that can hold them."""
        return replace(self, index=IdIndex.of(self.vertices))

    def quads(self) -> DataFrame:
        """(s, p, o, g): a row for each label, name and property of a vertex and for each edge."""
        out = []
        for t in self.vertices:
            props = [c for c in t.properties if not isinstance(t.properties[c], (T.MapType, T.ArrayType, T.StructType))]
            pairs = F.array(*[F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o")) for c in props], *[F.struct(F.lit("label").alias("p"), F.array_join("labels", ",").alias("o"))])
            out.append(t.df.select(F.col("id").cast("string").alias("s"), F.explode(pairs).alias("po")).where("po.o is not null").select("s", "po.p", "po.o", F.lit("node-property").alias("g")).withColumn("g", F.when(F.col("p") == "label", "node-label").otherwise(F.col("g"))))
        out += [t.df.select(F.col("src").cast("string").alias("s"), F.lit(t.label).alias("p"), F.col("dst").cast("string").alias("o"), F.lit("edge").alias("g")) for t in self.edges]
        return union(out)

    def lookup(self, from_pos: str, to_pos: str) -> DataFrame:
        """For each value at one position of the quads, the set of values at another; positions are S, P, O, G."""
        a, b = from_pos.lower(), to_pos.lower()
        return self.quads().groupBy(F.col(a).alias("key")).agg(F.sort_array(F.collect_set(b)).alias("found"))

    def summary(self) -> DataFrame:
        """(element, label, n): how many vertices and edges have each label."""
        v = [t.df.select(F.lit("vertex").alias("element"), F.explode("labels").alias("label")) for t in self.vertices]
        e = [t.df.select(F.lit("edge").alias("element"), F.lit(t.label).alias("label")) for t in self.edges]
        return union(v + e).groupBy("element", "label").agg(F.count(F.lit(1)).alias("n"))

    def summary_text(self, limit: int = 3, style: str = "github") -> str:
        """Counts and some vertices of each label, as a `github`, `mediawiki` or `latex` table."""
        rows = [(r["element"], r["label"], str(r["n"])) for r in self.summary().orderBy("element", "label").collect()]
        some = []
        for label in [r[1] for r in rows if r[0] == "vertex"]:
            some += [("sample", label, str(r["name"])) for r in self.get_nodes(label).orderBy("_seq").limit(limit).select("name").collect()]
        head, body = ("element", "label", "n"), rows + some
        if style == "mediawiki":
            return "\n".join(['{| class="wikitable"', "! " + " !! ".join(head), *("|-\n| " + " || ".join(r) for r in body), "|}"])
        if style == "latex":
            return "\n".join([r"\begin{tabular}{lll}", " & ".join(head) + r" \\", *(" & ".join(r) + r" \\" for r in body), r"\end{tabular}"])
        return "\n".join("| " + " | ".join(r) + " |" for r in [head, ("---",) * 3, *body])

    def dot(self, vertex_limit: int = 50, edge_limit: int = 100) -> str:
        """A drawing in DOT of the first vertices and the edges between them."""
        v = self.all_vertices().orderBy("_seq").limit(vertex_limit).select("id", "name").collect()
        known = {r["id"] for r in v}
        e = self.all_edges().where(F.col("src").isin(list(known)) & F.col("dst").isin(list(known))).limit(edge_limit).collect() if self.edges and known else []
        quote = lambda x: '"' + str(x).replace('"', r"\"") + '"'
        return "\n".join(["digraph {", *(f"  {quote(r['id'])} [label={quote(r['name'])}];" for r in v), *(f"  {quote(r['src'])} -> {quote(r['dst'])} [label={quote(r['label'])}];" for r in e), "}"])


def grown(table, row: dict):
    """A table with one more row, which is kept apart until there are many."""
    if len(table.added) >= MOST_ADDED:
        table = replace(table, rows=stored(table.df), added=(), changes=None)
    return replace(table, added=(*table.added, row))


def check_reserved(config: GraphConfig, properties: dict) -> None:
    for key in properties:
        if key in (config.name_field, config.label_field, "id", "_seq"):
            raise GraphError(f"the property name {key!r} is reserved")


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; a column of two types becomes a string in both."""
    kinds = {f.name: f.dataType for f in a.schema}
    clash = [f.name for f in b.schema if f.name in kinds and kinds[f.name] != f.dataType]
    numbers = (T.NumericType,)
    for c in clash:
        if isinstance(kinds[c], numbers) and isinstance(b.schema[c].dataType, numbers):
            continue
        a, b = (x.withColumn(c, F.col(c).cast("string")) if c in x.columns else x for x in (a, b))
    return a.unionByName(b, allowMissingColumns=True)


def edge_tables(rows: DataFrame, multigraph: bool) -> list[EdgeTable]:
    """Edge tables of rows with a `label`; a simple graph keeps one edge for each pair, its last label and last properties."""
    if not multigraph:
        props = [c for c in rows.columns if c not in (*EDGE_FIELDS, "label")]
        last = Window.partitionBy("src", "dst").orderBy("_seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(last) for c in [*props, "label"]} | {"__n": F.row_number().over(Window.partitionBy("src", "dst").orderBy("_seq"))})
        rows = stored(rows.where("__n = 1").drop("__n"))  # read once for each label
    labels = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]
    return [EdgeTable(rows.where(F.col("label") == x).drop("label"), x) for x in labels]


class GraphBuilder:
    """Collects vertices and edges in memory, for small graphs, and makes a graph of them."""

    def __init__(self, config: GraphConfig | None = None):
        self.config = config or GraphConfig()
        self.nodes: dict[str, dict] = {}
        self.links: list[dict] = []

    def add_labeled_node(self, label, name: str = "", properties: dict | None = None, node_id=None, **more) -> str:
        properties = dict(properties or {}) | more
        check_reserved(self.config, properties)
        key = str(node_id) if node_id is not None else str(len(self.nodes))
        labels = sorted(label) if isinstance(label, (set, frozenset, list, tuple)) else [label]
        self.nodes[key] = {"id": key, "name": name, "labels": labels, "_seq": len(self.nodes), "props": properties}
        return key

    def add_node(self, node_id, **properties) -> str:
        label = properties.pop(self.config.label_field, self.config.default_node_label)
        name = properties.pop(self.config.name_field, str(node_id))
        return self.add_labeled_node(label, name, properties, node_id)

    def add_labeled_edge(self, src, dst, label: str, properties: dict | None = None, **more) -> None:
        for end in (src, dst):
            if str(end) not in self.nodes:
                raise GraphError(f"no vertex has the id {end!r}")
        if self.config.edge_label_field in (properties or {}) or self.config.edge_label_field in more:
            raise GraphError(f"the property name {self.config.edge_label_field!r} is reserved")
        self.links.append({"src": str(src), "dst": str(dst), "label": label, "props": dict(properties or {}) | more})

    def add_edge(self, src, dst, **properties) -> None:
        self.add_labeled_edge(src, dst, properties.pop(self.config.edge_label_field, self.config.default_edge_label), properties)

    def build(self, spark: SparkSession) -> PropertyGraph:
        nodes = list(self.nodes.values())
        fields = [T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("_seq", T.LongType())]
        keys, kinds = typed([n["props"] for n in nodes])
        rows = [(n["id"], str(n["name"]), n["labels"], n["_seq"], *(fitting(n["props"].get(k), kinds[k]) for k in keys)) for n in nodes]
        v = spark.createDataFrame(rows, T.StructType(fields + [T.StructField(k, kinds[k]) for k in keys]))
        merged: dict = {}
        for i, e in enumerate(self.links):
            key = (e["src"], e["dst"]) if not self.config.multigraph else i
            old = merged.get(key, {"_seq": i, "props": {}})
            merged[key] = e | {"_seq": old["_seq"], "props": old["props"] | e["props"]}
        links = list(merged.values())
        tables = []
        for label in dict.fromkeys(e["label"] for e in links):
            own = [e for e in links if e["label"] == label]
            keys, kinds = typed([e["props"] for e in own])
            schema = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("eid", T.LongType()), T.StructField("_seq", T.LongType())] + [T.StructField(k, kinds[k]) for k in keys])
            tables.append(EdgeTable(spark.createDataFrame([(e["src"], e["dst"], e["_seq"], e["_seq"], *(fitting(e["props"].get(k), kinds[k]) for k in keys)) for e in own], schema), label))
        return PropertyGraph(spark, [VertexTable(v)], tables, self.config)


def typed(dicts: list[dict]) -> tuple[list[str], dict[str, T.DataType]]:
    """Keys in order of appearance and a type for each that holds all of its values."""
    kinds: dict[str, T.DataType] = {}
    for d in dicts:
        for k, v in d.items():
            new = kind_of(v)
            old = kinds.get(k)
            kinds[k] = new if old is None or isinstance(old, T.NullType) else old if new in (old, T.NullType()) else T.DoubleType() if isinstance(new, T.NumericType) and isinstance(old, T.NumericType) else T.StringType()
    return list(kinds), {k: T.StringType() if isinstance(v, T.NullType) else v for k, v in kinds.items()}


def kind_of(v) -> T.DataType:
    import datetime

    if v is None:
        return T.NullType()
    for kind, out in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (datetime.datetime, T.TimestampType()), (datetime.date, T.DateType())):
        if isinstance(v, kind):
            return out
    if isinstance(v, (list, tuple, set, frozenset)):
        _, kinds = typed([{"x": x} for x in v])
        return T.ArrayType(kinds.get("x", T.StringType()))
    if isinstance(v, dict):
        _, kinds = typed([{"x": x} for x in v.values()])
        return T.MapType(T.StringType(), kinds.get("x", T.StringType()))
    return T.StringType()


def fitting(v, kind: T.DataType):
    if v is None:
        return None
    if isinstance(kind, T.StringType) and not isinstance(v, str):
        return str(v)
    if isinstance(kind, T.DoubleType):
        return float(v)
    if isinstance(kind, T.ArrayType):
        return [fitting(x, kind.elementType) for x in (sorted(v) if isinstance(v, (set, frozenset)) else v)]
    if isinstance(kind, T.MapType):
        return {str(k): fitting(x, kind.valueType) for k, x in v.items()}
    return v
