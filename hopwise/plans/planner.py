"""Compiles the steps of a traversal into one DataFrame plan.

Rows carry ids only; properties are joined where a step reads them, and only those that some step of the whole traversal
reads. Hops are equi-joins with the edge tables that the labels allow. A sub-traversal that looks only at the current row
becomes a column; any other runs once for all rows, keyed by the current vertex (or, if it reads bindings or paths, by the columns that it can read),
and meets its parent in a semi, anti or inner join.

Where all steps up to a reducer or `dedup` treat rows on one vertex alike, such rows go on as one row with their number (BULK), so no level of a walk has more rows
than vertices. `repeat(...).emit().dedup()` goes on from new vertices only, and a plain loop with `until` is a recursive query.

A plan is lazy but for what must be fixed or counted while it is made: rounds of other loops with `until` or `emit`,
`skip`, `max_` and `min_` over hops, changing steps, and the test that given ids exist.
"""

from __future__ import annotations

import itertools
import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopwise.errors import GraphTraversalError, QueryError
from hopwise.functions.predicates import P, as_predicate, same
from hopwise.graph import CARRIED, union
from hopwise.operators import checkpointed, shared_dir, stored
from hopwise.plans.state import Elem, State
from hopwise.plans.traversal import TERMINALS, Cardinality, Scope, Step, Traversal

SCALAR_BY = {"values", "is", "id", "name", "label"}
FILTERS = {"has", "has_not", "has_key", "has_value", "has_id", "has_label", "contains", "within", "is"}
#: Steps that treat rows on one vertex alike, so such rows can go on as one with their number.
ALIKE = FILTERS | {"filter", "not", "and", "or", "hop", "hopE", "end", "values", "id", "identity", "as"}
#: Steps of a loop's body whose results depend on nothing but the vertex.
PLAIN_BODY = FILTERS - {"is", "has_key", "has_value"} | {"filter", "not", "and", "or", "hop", "hopE", "end", "identity", "as"}
BULK = "_bulk"


class Missing(Exception):
    """A sub-traversal needs a property that the rows do not carry yet."""

    def __init__(self, bind: str | None):
        self.bind = bind


class NotPure(Exception):
    """A sub-traversal needs more than the current row."""


def _inner(step: Step) -> list[Traversal]:
    parts = [*step.args, *step.kw.values(), *(t for _, t in step.kw.get("options", ()))]
    return [x for x in parts if isinstance(x, Traversal)]


def _walk(steps):
    for s in steps:
        yield s
        for t in _inner(s):
            yield from _walk(t.steps)


def _first_key(key):
    return key[0] if isinstance(key, (list, tuple)) else key


class Planner:
    def __init__(self, graph, steps: tuple[Step, ...]):
        self.graph, self.steps = graph, steps
        self.count = itertools.count()
        self.kinds: dict[str, T.DataType] = {}  # of columns made here, so that plans need not be asked for them
        self.loose: set[str] = set()  # keys of sub-traversals that can be null
        self.merging = False  # whether the hop that is planned may put rows on one vertex together
        self.rounds: list[int] = []  # new vertices of each round of a search
        every = list(_walk(steps))
        keys, self.all_keys = {"name"}, False
        self.path_keys: set[str] = set()
        for s in every:
            by = s.kw.get("by")
            names = [*(by if isinstance(by, tuple) else [by])]
            if s.op in ("values", "properties", "element_map"):
                self.all_keys |= not s.args
                names += s.args
            elif s.op in ("has", "has_not", "contains", "within"):
                names += s.args[1:2] if s.op == "has" and len(s.args) == 3 else s.args[:1]
            keys |= {_first_key(k) for k in names if isinstance(k, (str, list, tuple))}
            if s.op in ("path", "as_path", "simple_path") and by:
                self.path_keys.add(by)
            if s.op == "to_list" and s.kw.get("include_data"):
                self.all_keys = True
        self.keys = keys
        self.needs_path = any(s.op in ("path", "as_path", "simple_path") for s in every)
        listed = bool(steps) and steps[0].op == "V" and len(steps[0].args) > 1
        self.needs_order = listed or (any(s.op in ("range", "fold", "next") for s in every) and not self._sorted_first(steps))

    @classmethod
    def _sorted_first(cls, steps) -> bool:
        """Whether every positional step, in sub-traversals too, comes after an order of its own traversal."""
        at = [i for i, s in enumerate(steps) if s.op in ("range", "fold", "next")]
        own = not at or any(s.op == "order" for s in steps[: at[0]])
        return own and all(cls._sorted_first(t.steps) for s in steps for t in _inner(s))

    def fresh(self, name: str) -> str:
        return f"c{next(self.count)}_{name}"

    def type_of(self, st: State, column: str) -> T.DataType:
        return self.kinds.get(column) or st.df.schema[column].dataType

    def kept(self, st: State) -> DataFrame:
        """The rows with what later steps can read, before they are written."""
        return st.df.select(*dict.fromkeys([*st.carried(), *st.cur.columns()]))

    # ---- scans and properties

    def vertex_tables(self, labels):
        return [t for t in self.graph.vertices if labels is None or t.label is None or t.label in labels]

    def edge_tables(self, labels):
        return [t for t in self.graph.edges if labels is None or t.label in labels]

    def wanted(self, properties: dict) -> list[str]:
        return [k for k in properties if self.all_keys or k in self.keys or k in self.path_keys]

    def vertex_frame(self, labels) -> DataFrame:
        """id, labels, _seq and the wanted properties of all vertices of these labels."""
        tables = self.vertex_tables(labels)
        if not tables:
            kind = self.graph.id_type.simpleString()
            return self.graph.spark.createDataFrame([], f"id {kind}, labels array<string>, _seq long, name string")
        return _common([t.df.select("id", "labels", "_seq", *self.wanted(t.properties)) for t in tables])

    def edge_frame(self, tables, far: str | None = None) -> DataFrame:
        """src, dst, eid, _seq, label, the ends' static labels and the wanted properties of these edge tables.

        far: an end whose properties are wanted as well, where the one table carries them.
        """
        if not tables:
            kind = self.graph.id_type.simpleString()
            return self.graph.spark.createDataFrame([], f"src {kind}, dst {kind}, eid long, _seq long, label string, sl string, dl string")
        static = lambda x: F.lit(x).cast("string")
        return _common([t.df.select("src", "dst", "eid", "_seq", F.lit(t.label).alias("label"), static(t.src_label).alias("sl"), static(t.dst_label).alias("dl"), *self.wanted(t.properties), *self.held(tables, far)) for t in tables])

    def held(self, tables, far: str | None) -> list[str]:
        if far is None or len(tables) != 1 or tables[0].carries != far:
            return []
        label = tables[0].dst_label if far == "dst" else tables[0].src_label
        known = [v for v in self.vertex_tables((label,)) if v.label == label]
        return [CARRIED + k for k in self.wanted(known[0].properties) if CARRIED + k in tables[0].df.columns] if len(known) == 1 else []

    def vertex_scan(self, labels) -> tuple[DataFrame, dict[str, str]]:
        """All vertices of these labels under new names, and the name of each property."""
        tables = self.vertex_tables(labels)
        if len(tables) == 1:
            df, schema = tables[0].df, tables[0].df.schema
            columns = ["id", "labels", "_seq", *self.wanted(tables[0].properties)]
        else:
            df = self.vertex_frame(labels)
            schema, columns = df.schema, df.schema.names
        names = {c: self.fresh(c) for c in columns}
        self.kinds |= {names[f.name]: f.dataType for f in schema if f.name in names}
        return df.selectExpr(*[f"`{c}` as `{n}`" for c, n in names.items()]), names

    def begun(self, st: State) -> State:
        """The state with its scan made."""
        if st.df is not None:
            return st
        if st.cur.kind == "vertex":
            df, names = self.vertex_scan(st.cur.labels)
        else:
            df = self.edge_frame(self.edge_tables(st.cur.labels))
            names = {f.name: self.fresh(f.name) for f in df.schema if f.name not in ("sl", "dl")}
            self.kinds |= {names[f.name]: f.dataType for f in df.schema if f.name in names}
            df = df.selectExpr(*[f"`{c}` as `{n}`" for c, n in names.items()])
        seq = names.pop("_seq")
        if self.needs_order:
            df = df.withColumn("_ord", F.array(F.col(seq).cast("long")))
        out = replace(st, df=df, cur=replace(st.cur, fields=names, loaded=True), extras=(("_ord",) if self.needs_order else ()), distinct=st.cur.kind == "vertex")
        if st.root:
            roots = [F.col(names["id"]), F.element_at(names["labels"], 1)]
            out = replace(out, df=df.withColumns(dict(zip(st.root, roots, strict=False))))
        return self.stepped(out)

    def stepped(self, st: State) -> State:
        """The state with the current element added to its path: its columns are kept, and become an array where one is asked for."""
        if not self.needs_path or st.cur.kind not in ("vertex", "edge"):
            return st
        f = st.cur.fields
        if st.cur.kind == "vertex":
            label = None
            if len(self.graph.vertices) > 1 and self.graph.vertices[0].label is not None:
                label = st.cur.labels[0] if st.cur.labels and len(st.cur.labels) == 1 else ("labels" in f and (f["labels"],)) or ""
            step = ("vertex", f["id"], label)
        else:
            step = ("edge", f["src"], f["dst"])
        st = replace(st, trail=(*st.trail, step))
        if not self.path_keys:
            return st
        for k in self.path_keys:
            st = self.ready(st, k)
        st, f = self.laid(st), st.cur.fields
        extras, df = dict.fromkeys(st.extras), st.df
        for k in sorted(self.path_keys):
            c = F.col(f[k]).cast("string") if k in f else F.lit(None).cast("string")
            name = f"_pb_{k}"
            df = df.withColumn(name, F.concat(name, F.array(c)) if name in st.extras else F.array(c))
            extras[name] = None
        return replace(st, df=df, extras=tuple(extras))

    def laid(self, st: State) -> State:
        """The state with its path as an array."""
        if not st.trail:
            return st

        def shown(step):
            kind, a, b = step
            if kind == "edge":
                return F.struct(F.col(a).cast("string").alias("id"), F.col(b).cast("string").alias("dst"))
            label = F.element_at(b[0], 1) if isinstance(b, tuple) else F.lit(b)
            return F.struct((F.col(a).cast("string") if b is None else F.concat_ws(":", label, F.col(a).cast("string"))).alias("id"), F.lit(None).cast("string").alias("dst"))

        new = F.array(*[shown(x) for x in st.trail])
        df = st.df.withColumn("_path", F.concat("_path", new) if "_path" in st.extras else new)
        return replace(st, df=df, extras=tuple(dict.fromkeys([*st.extras, "_path"])), trail=(), simple=0)

    def possible(self, elem: Elem, key: str) -> bool:
        """Whether some table of the element's labels has the property."""
        if key in ("labels", "label", "id"):
            return True
        tables = self.vertex_tables(elem.labels) if elem.kind == "vertex" else self.edge_tables(elem.labels)
        return any(key in t.properties for t in tables)

    def joined(self, st: State, elem: Elem) -> tuple[State, Elem]:
        """The state with the properties of a vertex at hand."""
        props, names = self.vertex_scan(elem.labels)
        names.pop("_seq")
        on = F.col(elem.fields["id"]) == F.col(names["id"])
        if "labels" in elem.fields and len(self.vertex_tables(elem.labels)) > 1:
            on = on & (F.element_at(elem.fields["labels"], 1) == F.element_at(names["labels"], 1))
        df = st.df.join(props, on)
        del names["id"]
        return replace(st, df=df), replace(elem, fields=elem.fields | names, loaded=True)

    def ready(self, st: State, key: str, bind: str | None = None) -> State:
        """The state with this property of the current (or bound) element among its fields, if any table has it."""
        st = self.begun(st)
        elem = st.binds[bind] if bind else st.cur
        if elem.kind != "vertex" or key in elem.fields or elem.loaded or not self.possible(elem, key):
            return st
        st, new = self.joined(st, elem)
        return replace(st, binds=st.binds | {bind: new}) if bind else replace(st, cur=new)

    # ---- columns of one row

    def column(self, st: State, elem: Elem, key) -> tuple[Column, T.DataType] | None:
        """A property, id or label of an element; None if it can have none. A list is a path into nested values."""
        first, *rest = key if isinstance(key, (list, tuple)) else (key,)
        if first == "label":
            first = "labels"
        if elem.kind == "edge" and first in ("labels", "id"):
            first = {"labels": "label", "id": "src"}[first]
        if elem.kind not in ("vertex", "edge"):
            raise QueryError(f"a {elem.kind} has no properties")
        name = elem.fields.get(first)
        if name is None:
            if elem.kind == "vertex" and not elem.loaded and self.possible(elem, first):
                raise Missing(next((b for b, e in st.binds.items() if e is elem), None))
            return None
        c, kind = F.col(name), self.type_of(st, name)
        for part in rest:
            if isinstance(kind, T.MapType):
                c, kind = F.try_element_at(c, F.lit(part)), kind.valueType
            elif isinstance(kind, T.StructType) and part in kind.names:
                c, kind = c[part], kind[part].dataType
            else:
                return None
        return c, kind

    def test(self, st: State, elem: Elem, s: Step) -> Column:
        """The condition of one filter step on an element."""
        a = s.args
        if s.op == "has" and len(a) == 3:
            return self.test(st, elem, Step("has_label", (a[0],))) & self.test(st, elem, Step("has", a[1:]))
        if s.op in ("has", "has_not", "within", "contains"):
            found = self.column(st, elem, a[0])
            if s.op == "has_not":
                return F.lit(True) if found is None else found[0].isNull()
            if s.op == "has" and len(a) == 1:
                return F.lit(False) if found is None else found[0].isNotNull()
            c, kind = found or (F.lit(None).cast("string"), T.StringType())
            if s.op == "within":
                return as_predicate(P("within", lambda c, k: _among(c, k, a[1]))).column(c, kind)
            if s.op == "contains":
                many = list(a[1]) if isinstance(a[1], (list, tuple, set)) else [a[1]]
                return _all([F.array_contains(c, v) if isinstance(kind, T.ArrayType) else F.map_contains_key(c, v) if isinstance(kind, T.MapType) else c.contains(str(v)) for v in many])
            if isinstance(kind, T.ArrayType) and _first_key(a[0]) in ("label", "labels"):
                return F.exists(c, lambda x: as_predicate(a[1]).column(x, kind.elementType))
            return as_predicate(a[1]).column(c, kind)
        if s.op == "has_label":
            found = self.column(st, elem, "labels")
            c, kind = found
            return _all([F.array_contains(c, x) if isinstance(kind, T.ArrayType) else c == x for x in a])
        if s.op == "has_id":
            if elem.kind == "edge":
                return _any([(F.col(elem.fields["src"]) == x[0]) & (F.col(elem.fields["dst"]) == x[1]) for x in a])
            c, kind = F.col(elem.fields["id"]), self.type_of(st, elem.fields["id"])
            return a[0].column(c, kind) if len(a) == 1 and isinstance(a[0], P) else as_predicate(a[0]).column(c, kind) if len(a) == 1 and callable(a[0]) else _among(c, kind, list(a))
        if s.op in ("has_key", "has_value"):
            if elem.kind != "property":
                raise QueryError(f"{s.op} needs a property")
            name = elem.fields["key" if s.op == "has_key" else "val"]
            return _among(F.col(name), self.type_of(st, name), list(a))
        if s.op == "is":
            if "val" not in elem.fields:
                raise QueryError("is_ needs a value")
            c, kind = F.col(elem.fields["val"]), self.type_of(st, elem.fields["val"])
            return as_predicate(a[0]).column(c, kind)
        raise NotPure

    def pure(self, st: State, steps) -> Column:
        """The condition that the steps give a result, from columns of the row alone."""
        return self._pure(st, st.cur, steps)

    def _pure(self, st: State, elem: Elem, steps) -> Column:
        cond = F.lit(True)
        for s in steps:
            if s.op in FILTERS:
                cond = cond & self.test(st, elem, s)
            elif s.op in ("filter", "not", "and", "or"):
                parts = [self._pure(st, elem, t.steps) for t in s.args]
                cond = cond & (~_sure(parts[0]) if s.op == "not" else _any(parts) if s.op == "or" else _all(parts))
            elif s.op in ("values", "properties") and len(s.args) == 1:
                found = self.column(st, elem, s.args[0])
                if found is None:
                    return F.lit(False)
                if isinstance(found[1], (T.ArrayType, T.MapType)) or s.args[0] not in elem.fields:
                    raise NotPure
                cond = cond & found[0].isNotNull()
                elem = Elem("value", {"val": elem.fields[s.args[0]]})
            elif s.op == "id" and elem.kind == "vertex":
                elem = Elem("value", {"val": elem.fields["id"]})
            elif s.op == "value" and elem.kind == "property":
                elem = Elem("value", {"val": elem.fields["val"]})
            elif s.op == "select" and len(s.args) == 1 and not s.kw["by"]:
                if s.args[0] not in st.binds:
                    raise QueryError(f"nothing is bound to {s.args[0]!r}")
                elem = st.binds[s.args[0]]
            elif s.op != "identity":
                raise NotPure
        return cond

    def condition(self, st: State, steps) -> tuple[State, Column | None]:
        """`pure` with properties joined as needed; None if the steps need more than the row."""
        st = self.begun(st)
        while True:
            try:
                return st, self.pure(st, steps)
            except Missing as m:
                elem = st.binds[m.bind] if m.bind else st.cur
                st, new = self.joined(st, elem)
                st = replace(st, binds=st.binds | {m.bind: new}) if m.bind else replace(st, cur=new)
            except NotPure:
                return st, None

    # ---- sub-traversals

    def independent(self, st: State, steps) -> bool:
        """Whether the steps depend on nothing of a row but its current vertex."""
        return st.cur.kind == "vertex" and not any(s.op in ("select", "path", "simple_path", "as_path") for s in _walk(steps))

    def child(self, st: State, steps, keep: bool = False) -> tuple[State, State, list[tuple[str, str]]]:
        """Runs steps for all rows: (state, result, pairs of columns to join them on). keep: the result keeps the row's bindings."""
        st = self.laid(self.begun(st))
        if self.independent(st, steps) and not (keep and self.needs_path):
            root = [self.fresh("root")]
            left = [st.cur.fields["id"]]
            if len(self.vertex_tables(st.cur.labels)) > 1 and "labels" in st.cur.fields:
                root.append(self.fresh("rootl"))
                st = replace(st, df=st.df.withColumn(label := self.fresh("l"), F.element_at(st.cur.fields["labels"], 1)))
                left.append(label)
            labels = st.cur.labels
            every = lambda: self.vertex_frame(labels).select(F.col("id").alias(root[0]), *([F.element_at("labels", 1).alias(root[1])] if len(root) > 1 else []))
            start = State(None, Elem("vertex", labels=labels), root=tuple(root), roots=every)
            return st, self.ran(start, steps, True), list(zip(left, root, strict=True))
        if not (keep and self.needs_path) and (found := self.keyed(st, steps)):
            start, on = found
            return st, self.ran(start, steps, True), on
        st, start, rid = self.pinned(st)
        return st, self.ran(start, steps), [(rid, rid)]

    def keyed(self, st: State, steps) -> tuple[State, list[tuple[str, str]]] | None:
        """The start of a sub-traversal that reads bindings or paths, keyed by all columns it can read, each combination of values once.

        None if some of them cannot be compared. Nothing is written and no row is numbered: Catalyst reads the rows twice, once for their keys.
        """
        names = {n for s in _walk(steps) if s.op == "select" for n in s.args if n in st.binds}
        paths = [c for c in st.extras if c == "_path" or c.startswith("_pb_")]
        columns = [*dict.fromkeys([*st.cur.columns(), *(c for n in names for c in st.binds[n].columns()), *paths])]
        if any(isinstance(self.type_of(st, c), (T.MapType, T.StructType, T.VariantType)) for c in columns if c not in paths):
            return None
        keys = {c: self.fresh("root") for c in columns}
        own = {c: c if c in paths else self.fresh("own") for c in columns}
        self.loose |= {*keys.values()}
        for c in columns:
            self.kinds[keys[c]] = self.kinds[own[c]] = self.type_of(st, c)
        df = st.df.select(*[F.col(c).alias(k) for c, k in keys.items()]).distinct()
        start = df.select("*", *[F.col(keys[c]).alias(n) for c, n in own.items()])
        if "_ord" in st.extras:
            start = start.withColumn("_ord", F.array().cast("array<bigint>"))
        moved = lambda e: replace(e, fields={k: own.get(c, c) for k, c in e.fields.items()}, items=tuple((n, moved(x)) for n, x in e.items))
        extras = tuple(c for c in st.extras if c == "_ord" or c in paths)
        state = State(start, moved(st.cur), {n: moved(st.binds[n]) for n in names}, tuple(keys.values()), lambda: df, extras=extras)
        return state, list(keys.items())

    def matching(self, pairs: list[tuple[str, str]], names: dict[str, str] | None = None) -> Column:
        """The condition that the columns of a row are the keys of a sub-traversal's result; names: new names of keys."""
        columns = [(F.col(a), F.col((names or {}).get(b, b)), b in self.loose) for a, b in pairs]
        return _all([a.eqNullSafe(b) if loose else a == b for a, b, loose in columns])

    def pinned(self, st: State) -> tuple[State, State, str]:
        """The state with a row number, the start of sub-traversals keyed by it, and its name. The rows are written when the plan is made, which fixes the numbers."""
        rid = self.fresh("rid")
        st = replace(st, df=checkpointed(self.kept(st).withColumn(rid, F.monotonically_increasing_id())))
        df = st.df
        return st, replace(st, root=(rid,), roots=lambda: df.select(rid)), rid

    def existing(self, st: State, steps, negate: bool = False) -> State:
        st, cond = self.condition(st, steps)
        if cond is not None:
            return replace(st, df=st.df.where(~_sure(cond) if negate else cond))
        st, found, on = self.child(st, steps)
        names = {b: f"k{i}_{b}" for i, (_, b) in enumerate(on)}
        hits = self.begun(found).df.select(*[F.col(b).alias(n) for b, n in names.items()])
        return replace(st, df=st.df.join(hits, self.matching(on, names), "left_anti" if negate else "left_semi"))

    def either(self, st: State, a, b) -> State:
        st = self.laid(self.begun(st))
        st, first = self.condition(st, a.steps)
        st, second = self.condition(st, b.steps)
        if first is not None and second is not None:
            return replace(st, df=st.df.where(first | second))
        one = lambda t: (Step("identity"), *t.steps)
        if not (self.independent(st, a.steps) and self.independent(st, b.steps)):
            # one of them reads bindings or paths: both have the same keys
            if found := self.keyed(st, (*a.steps, *b.steps)):
                start, on = found
            else:
                st, start, rid = self.pinned(st)
                on = [(rid, rid)]
            states = [self.ran(start, one(t), True) for t in (a, b)]
        else:
            states, on = [], []
            for t in (a, b):
                st, found, own = self.child(st, one(t))
                states.append(found)
                on = on or own
                names = dict(zip([r for _, r in own], [r for _, r in on], strict=True))
                states[-1] = replace(found, df=self.begun(found).df.withColumnsRenamed(names), root=tuple(names.values()))
        names = {b: f"k{i}" for i, (_, b) in enumerate(on)}
        hits = [self.begun(x).df.select(*[F.col(b).alias(n) for b, n in names.items()]) for x in states]
        return replace(st, df=st.df.join(hits[0].union(hits[1]), self.matching(on, names), "left_semi"))

    def applied(self, st: State, steps) -> State:
        """`local`: the steps' results for each row, with the row's bindings."""
        if not any(s.op in ("range", "dedup", "count", "sum", "mean", "max", "min", "fold", "order", "repeat") for s in steps):
            return self.ran(st, steps)
        st, found, on = self.child(st, steps, keep=True)
        found = self.begun(found)
        if on[0][0] == on[0][1]:
            return replace(found, root=st.root, roots=st.roots)
        right = found.df.select(*dict.fromkeys([*[b for _, b in on], *found.cur.columns(), *(c for c, _ in found.sort), *(["_ord"] if "_ord" in found.extras else [])]))
        if "_ord" in right.columns:
            right = right.withColumnRenamed("_ord", "_sub")
        df = st.df.join(right, self.matching(on))
        if "_sub" in right.columns and "_ord" in st.extras:
            df = df.withColumn("_ord", F.concat("_ord", "_sub")).drop("_sub")
        return replace(st, df=df, cur=found.cur, distinct=False)

    def scalar(self, st: State, steps) -> tuple[State, str]:
        """A column with the one value the steps give for each row, null where they give none."""
        st = self.begun(st)
        if len(steps) == 1 and steps[0].op == "values" and len(steps[0].args) == 1:
            st = self.ready(st, _first_key(steps[0].args[0]))
            found = self.column(st, st.cur, steps[0].args[0])
            name = self.fresh("key")
            c, kind = found or (F.lit(None).cast("string"), None)
            return replace(st, df=st.df.withColumn(name, F.element_at(c, 1) if isinstance(kind, T.ArrayType) else c)), name
        st, found, on = self.child(st, steps)
        found = self.begun(found)
        name, n = self.fresh("key"), self.fresh("n")
        c = found.cur.fields.get("val") or found.cur.fields.get("id")
        each = found.df.groupBy(*[b for _, b in on]).agg(F.min(c).alias(name), F.count(F.lit(1)).alias(n))
        if on[0][0] == on[0][1]:
            df = st.df.join(each, [b for _, b in on], "left")
        else:
            df = st.df.join(each, self.matching(on), "left").drop(*[b for _, b in on])
        many = F.raise_error(F.lit("a sub-traversal that orders or branches gives more than one value"))
        return replace(st, df=df.withColumn(name, F.when(F.col(n) > 1, many.cast(self.type_of(found, c))).otherwise(F.col(name))).drop(n)), name

    # ---- steps

    def ran(self, st: State, steps, whole: bool = False) -> State:
        """The state after the steps. whole: no step follows these ones, so what they do not read is not needed."""
        steps = self.unrolled(steps) if whole else tuple(steps)
        i = 0
        while i < len(steps) and steps[i].op not in TERMINALS:
            s, i = steps[i], i + 1
            if s.op == "repeat" and i < len(steps) and steps[i].op == "dedup" and (found := self.reached(st, s, steps[i])):
                st, i = found, i + 1
                continue
            self.merging = whole and s.op in ("hop", "hopE") and self.reducing(steps[i:])
            if self.merging and st.df is not None and st.cur.kind == "vertex" and not st.distinct:
                st = self.bulked(st)
            st = getattr(self, f"do_{s.op}")(st, s)
        return st

    def unrolled(self, steps) -> tuple[Step, ...]:
        """The steps with the bodies of plain loops in the place of the loops."""
        out: list[Step] = []
        for s in steps:
            plain = s.op == "repeat" and s.kw.get("times") is not None and not s.kw.get("until") and not s.kw.get("emit")
            out += self.unrolled(s.args[0].steps) * s.kw["times"] if plain and all(x.op in ALIKE for x in s.args[0].steps) else [s]
        return tuple(out)

    def reducing(self, steps) -> bool:
        """Whether rows on one vertex may go on as one row with their number: all steps before the next reducer or dedup treat them alike."""
        if self.needs_path or self.needs_order:
            return False
        for s in steps:
            if s.op in ("count", "sum", "mean"):
                return not (s.args and s.args[0] is Scope.local)
            if s.op == "dedup":
                return s.kw.get("by") is None
            if s.op not in ALIKE or any(x.op == "select" for x in _walk([s])):
                return False
        return False

    def bulked(self, st: State) -> State:
        """One row for each vertex (and root), with the number of rows that stood on it."""
        f = st.cur.fields
        keys = [k for k in ("id", "labels") if k in f and (k == "id" or len(self.vertex_tables(st.cur.labels)) > 1)]
        n = F.sum(BULK) if BULK in st.extras else F.count(F.lit(1))
        df = st.df.groupBy(*st.root, *[f[k] for k in keys]).agg(n.alias(BULK))
        cur = replace(st.cur, fields={k: f[k] for k in keys}, loaded=False)
        return replace(st, df=df, cur=cur, binds={}, sort=(), extras=(BULK,), distinct=True)

    def moved(self, st: State, df: DataFrame, cur: Elem) -> State:
        keep = [*st.carried(), *cur.columns()]
        return self.stepped(replace(st, df=df.select(*dict.fromkeys(keep)), cur=cur, distinct=False))

    def do_V(self, st, s: Step) -> State:  # noqa: N802
        st = State(None, Elem("vertex"))
        if not s.args:
            return st
        labels = self.holding(list(s.args), None)
        if labels == ():
            raise GraphTraversalError(f"no vertex has the id {s.args[0]!r}")
        st = self.begun(replace(st, cur=replace(st.cur, labels=labels)))
        kind = self.graph.id_type.simpleString()
        ids = self.graph.spark.createDataFrame([(i, x) for i, x in enumerate(s.args)], f"__at long, __id {kind}")
        # the few rows are written when the plan is made, which tells whether all ids are there
        df = checkpointed(st.df.join(F.broadcast(ids), F.col("__id") == F.col(st.cur.fields["id"])))
        there = {r[0] for r in df.select("__at").distinct().collect()}
        if lost := [x for i, x in enumerate(s.args) if i not in there]:
            raise GraphTraversalError(f"no vertex has the id {lost[0]!r}")
        if "_ord" in st.extras:
            df = df.withColumn("_ord", F.array("__at"))
        return replace(st, df=df.drop("__at", "__id"), distinct=len(set(s.args)) == len(s.args))

    def holding(self, ids: list, labels) -> tuple[str, ...] | None:
        """Of these labels, those whose tables can hold some of the ids, where an index tells."""
        tables = self.vertex_tables(labels)
        if self.graph.index is None or any(t.label is None for t in tables):
            return labels
        return tuple(t.label for t in self.graph.index.holding(tables, ids))

    def do_E(self, st, s: Step) -> State:  # noqa: N802
        st = State(None, Elem("edge"))
        if not s.args:
            return st
        st = self.begun(st)
        f = st.cur.fields
        kind = self.graph.id_type.simpleString()
        pairs = self.graph.spark.createDataFrame([tuple(x) for x in s.args], f"__s {kind}, __d {kind}")
        on = (F.col("__s") == F.col(f["src"])) & (F.col("__d") == F.col(f["dst"]))
        if lost := pairs.join(st.df, on, "left_anti").collect():
            raise GraphTraversalError(f"no edge leads from {lost[0][0]!r} to {lost[0][1]!r}")
        return replace(st, df=st.df.join(F.broadcast(pairs), on).drop("__s", "__d"))

    def do_addV(self, st, s: Step) -> State:  # noqa: N802
        return self.do_V(None, Step("V", (self.graph.add_vertex(*s.args, **s.kw["props"]),)))

    def do_addE(self, st, s: Step) -> State:  # noqa: N802
        if s.kw["src"] is None or s.kw["dst"] is None:
            raise QueryError("addE needs from_ and to_")
        self.graph.add_edge(s.args[0], s.kw["src"], s.kw["dst"], **s.kw["props"])
        return self.do_E(None, Step("E", ((s.kw["src"], s.kw["dst"]),)))

    def do_identity(self, st: State, s: Step) -> State:
        return st

    def do_has_label(self, st: State, s: Step) -> State:
        cur = st.cur
        if cur.kind == "vertex" and len(s.args) == 1 and all(t.label is not None for t in self.vertex_tables(cur.labels)):
            known = [t.label for t in self.vertex_tables(cur.labels)]
            if s.args[0] in known and (st.df is None or known == [s.args[0]]):
                return replace(st, cur=replace(cur, labels=(s.args[0],)))
            if s.args[0] in known and "labels" in cur.fields:
                kept = st.df.where(F.array_contains(cur.fields["labels"], s.args[0]))
                return replace(st, df=kept, cur=replace(cur, labels=(s.args[0],)))
            if s.args[0] not in known and st.df is None:
                return replace(st, cur=replace(cur, labels=()))
        if cur.kind == "edge" and st.df is None:
            return replace(st, cur=replace(cur, labels=tuple(t.label for t in self.edge_tables(cur.labels) if t.label in s.args)))
        return self.filtered(st, s)

    def filtered(self, st: State, s: Step) -> State:
        if s.op == "has" and len(s.args) == 3:
            st, s = self.do_has_label(st, Step("has_label", (s.args[0],))), Step("has", s.args[1:])
        st, cond = self.condition(st, (s,))
        return replace(st, df=st.df.where(cond))

    do_has = do_has_not = do_has_key = do_has_value = do_contains = do_within = do_is = filtered

    def do_has_id(self, st: State, s: Step) -> State:
        if st.df is None and st.cur.kind == "vertex" and not any(isinstance(x, P) or callable(x) for x in s.args):
            st = replace(st, cur=replace(st.cur, labels=self.holding(list(s.args), st.cur.labels)))
        return self.filtered(st, s)

    def do_filter(self, st: State, s: Step) -> State:
        return self.existing(st, s.args[0].steps)

    def do_not(self, st: State, s: Step) -> State:
        return self.existing(st, s.args[0].steps, negate=True)

    def do_and(self, st: State, s: Step) -> State:
        return self.existing(self.existing(st, s.args[0].steps), s.args[1].steps)

    def do_or(self, st: State, s: Step) -> State:
        return self.either(st, *s.args)

    def do_simple_path(self, st: State, s: Step) -> State:
        """Elements that came after the last such step are compared with all before them; what that step kept is known to differ."""
        st = self.begun(st)
        if s.kw.get("by") or "_path" in st.extras:
            st = self.laid(st)
            c = f"_pb_{s.kw['by']}" if s.kw.get("by") else "_path"
            return replace(st, df=st.df.where(F.size(F.array_distinct(c)) == F.size(c)))
        label = lambda x: F.element_at(x[2][0], 1) if isinstance(x[2], tuple) else F.lit(x[2])
        same = []
        for i in range(max(st.simple, 1), len(st.trail)):
            for x, y in [(st.trail[i], y) for y in st.trail[:i] if y[0] == st.trail[i][0]]:
                equal = F.col(x[1]) == F.col(y[1])
                if x[0] == "edge":
                    equal = equal & (F.col(x[2]) == F.col(y[2]))
                elif x[2] != y[2]:
                    if isinstance(x[2], str) and isinstance(y[2], str):
                        continue
                    equal = equal & (label(x) == label(y))
                same.append(equal)
        st = replace(st, simple=len(st.trail))
        return replace(st, df=st.df.where(~_any(same))) if same else st

    def do_hop(self, st: State, s: Step) -> State:
        return self.along(st, s) or self.do_end(self.do_hopE(st, s, ends=True), Step("end", ("far",)))

    def along(self, st: State, s: Step) -> State | None:
        """A hop over one edge table in one direction: one select and one join. None if it takes more."""
        way, label = s.args
        if st.cur.kind != "vertex" or way == "both":
            return None
        near, far = ("src", "dst") if way == "out" else ("dst", "src")
        end = lambda t, at: getattr(t, f"{at}_label")
        labels, known = st.cur.labels, self.vertex_tables(st.cur.labels)
        tables = [t for t in self.edge_tables(None if label is None else (label,)) if end(t, near) is None or labels is None or end(t, near) in labels]
        if len(tables) != 1 or (end(tables[0], near) is not None and len(known) > 1):
            return None
        t, target = tables[0], end(tables[0], far)
        lazy = st.df is None and not self.needs_order and not self.needs_path and all(x.label is not None for x in known) and len(st.root) < 2
        if t.halves and self.merging and not self.needs_order:
            return self.halved(st, t, near, far, lazy)
        a, b, seq = self.fresh("near"), self.fresh("far"), self.fresh("seq")
        held = {c[len(CARRIED) :]: self.fresh(c) for c in self.held([t], far)}
        columns = [f"`{near}` as `{a}`", f"`{far}` as `{b}`", *[f"`{CARRIED}{c}` as `{n}`" for c, n in held.items()]]
        columns += [f"`_seq` as `{seq}`"] if self.needs_order else []
        fields = {"id": b} | held
        if held:
            fields["labels"] = self.fresh("labels")
            columns.append(f"array('{target}') as `{fields['labels']}`")
        hubs = {} if lazy else dict(t.hubs).get(near, {})
        if hubs:
            columns.append(f"{_salt(near, hubs)} as `{(salt := self.fresh('salt'))}`")
        columns += [f"`{near}` as `{st.root[0]}`"] if lazy and st.root else []
        e = t.df.selectExpr(*columns)
        self.kinds |= {n: t.df.schema[CARRIED + c].dataType for c, n in held.items()} | {b: t.df.schema[far].dataType}
        if lazy:
            st, df = replace(st, distinct=True), e
        else:
            st = self.begun(st)
            here, on = st.cur.fields["id"], F.col(st.cur.fields["id"]) == F.col(a)
            df = st.df
            if hubs:
                df = df.selectExpr("*", f"explode({_copies(here, hubs)}) as `{(copy := self.fresh('copy'))}`")
                on = on & (F.col(copy) == F.col(salt))
            df = df.join(e, on)
        if "_ord" in st.extras:
            df = df.withColumn("_ord", F.concat("_ord", F.array(F.lit(int(way == "in")).cast("long"), F.col(seq).cast("long"))))
        cur = Elem("vertex", fields, None if target is None else (target,), loaded=bool(held))
        return self.stepped(replace(st, df=df, cur=cur, distinct=st.distinct and t.carries == far))

    def halved(self, st: State, t, near: str, far: str, lazy: bool) -> State:
        """A hop over edges between all vertices of equal keys: to the key, where rows are put together, and on; the pairs are never listed."""
        halves = dict(zip(("src", "dst"), t.halves, strict=True))
        a, key, b = self.fresh("near"), self.fresh("key"), self.fresh("far")
        first = halves[near].selectExpr(f"`id` as `{a}`", f"`key` as `{key}`", *([f"`id` as `{st.root[0]}`"] if lazy and st.root else []))
        st = st if lazy else self.begun(st)
        df = first if lazy else st.df.join(first, F.col(st.cur.fields["id"]) == F.col(a))
        n = F.sum(BULK) if BULK in st.extras else F.count(F.lit(1))
        df = df.groupBy(*st.root, key).agg(n.alias(BULK))
        df = df.join(halves[far].selectExpr(f"`key` as `{key}`", f"`id` as `{b}`"), key)
        target = getattr(t, f"{far}_label")
        return replace(st, df=df, cur=Elem("vertex", {"id": b}, None if target is None else (target,)), binds={}, sort=(), extras=(BULK,), distinct=False)

    def do_hopE(self, st: State, s: Step, ends: bool = False) -> State:  # noqa: N802
        if st.cur.kind != "vertex":
            raise QueryError(f"a {st.cur.kind} has no edges")
        way, label = s.args
        labels = st.cur.labels
        fits = lambda known, end: known is None or labels is None or end is None or end in labels
        frames, near, far, kinds = [], set(), set(), []
        for d in ("out", "in") if way == "both" else (way,):
            tables = [t for t in self.edge_tables(None if label is None else (label,)) if fits(labels, t.src_label if d == "out" else t.dst_label)]
            kinds += [t.label for t in tables]
            far |= {t.dst_label if d == "out" else t.src_label for t in tables}
            near |= {t.src_label if d == "out" else t.dst_label for t in tables}
            e = self.edge_frame(tables, ("dst" if d == "out" else "src") if ends and way != "both" else None)
            a, b, la = ("src", "dst", "sl") if d == "out" else ("dst", "src", "dl")
            frames.append(e.withColumns({"__near": F.col(a), "__far": F.col(b), "__nl": F.col(la), "__back": F.lit(int(d == "in"))}))
        e = union(frames)
        tag = self.fresh("e")
        names = {c: f"{tag}_{c}" for c in e.columns}
        e = e.select(*[F.col(c).alias(n) for c, n in names.items()])
        mixed = len(near - {None}) > 0 and len(self.vertex_tables(labels)) > 1
        lazy = st.df is None and not self.needs_order and not self.needs_path and not mixed and (labels is None or all(t.label is not None for t in self.vertex_tables(labels)))
        if lazy and len(st.root) < 2:
            # the scan's vertices are not needed: every edge has its ends
            df = e if not st.root else e.withColumn(st.root[0], F.col(names["__near"]))
            st = replace(st, df=df, cur=Elem("vertex", {"id": names["__near"]}, labels))
        else:
            st = self.begun(st)
            on = F.col(st.cur.fields["id"]) == F.col(names["__near"])
            if mixed:
                st = self.ready(st, "labels")
                on = on & (F.element_at(st.cur.fields["labels"], 1) == F.col(names["__nl"]))
            df = st.df.join(e, on)
        if "_ord" in st.extras:
            df = df.withColumn("_ord", F.concat("_ord", F.array(F.col(names["__back"]).cast("long"), F.col(names["_seq"]).cast("long"))))
        fields = {c: n for c, n in names.items() if (c.startswith(CARRIED) or not c.startswith("__")) and c not in ("_seq", "sl", "dl")}
        static = lambda x: None if None in x else tuple(sorted(x))
        ends_of = (static(near), static(far)) if way == "out" else (static(far), static(near)) if way == "in" else (static(near | far),) * 2
        if ends:
            fields |= {"far": names["__far"], "sl": names["sl"], "dl": names["dl"], "back": names["__back"]}
            elem = Elem("edge", fields, tuple(dict.fromkeys(kinds)), (static(far), static(far)))
            return replace(st, df=df, cur=elem)
        if way != "out":
            fields |= {"sl": names["sl"], "dl": names["dl"]}
        return self.moved(st, df, Elem("edge", fields, tuple(dict.fromkeys(kinds)), ends_of, loaded=True))

    def do_end(self, st: State, s: Step) -> State:
        st = self.begun(st)
        if st.cur.kind != "edge":
            raise QueryError(f"a {st.cur.kind} has no ends")
        f, which = st.cur.fields, s.args[0]
        if which == "both":
            name = self.fresh("id")
            labels = None if None in st.cur.ends else tuple(sorted({*st.cur.ends[0], *st.cur.ends[1]}))
            ends = F.posexplode(F.array(f["src"], f["dst"])).alias(at := self.fresh("at"), name)
            df = st.df.select("*", ends)
            fields = {"id": name}
            if labels and len(labels) > 1:
                df = df.withColumn(lab := self.fresh("labels"), F.array(F.when(F.col(at) == 0, self._static(st, 0)).otherwise(self._static(st, 1))))
                fields["labels"] = lab
            if "_ord" in st.extras:
                df = df.withColumn("_ord", F.concat("_ord", F.array(F.col(at).cast("long"))))
            return self.moved(st, df, Elem("vertex", fields, labels))
        column = f[which]
        labels = st.cur.ends[1] if which in ("dst", "far") else st.cur.ends[0]
        df, fields = st.df, {"id": column}
        if held := {c[len(CARRIED) :]: n for c, n in f.items() if c.startswith(CARRIED)}:
            name = self.fresh("labels")
            fields |= held | {"labels": name}
            return self.moved(st, df.withColumn(name, F.array(F.lit(labels[0]))), Elem("vertex", fields, labels, loaded=True))
        if labels and len(labels) > 1:
            name = self.fresh("labels")
            end = F.when(F.col(f["back"]) == 0, F.col(f["dl"])).otherwise(F.col(f["sl"])) if which == "far" else self._static(st, int(which == "dst"))
            df = df.withColumn(name, F.array(end))
            fields["labels"] = name
        return self.moved(st, df, Elem("vertex", fields, labels))

    def _static(self, st: State, end: int) -> Column:
        """The static label of an edge's end, by the edge's label."""
        out = F.lit(None).cast("string")
        for t in self.graph.edges:
            out = F.when(F.col(st.cur.fields["label"]) == t.label, F.lit((t.src_label, t.dst_label)[end])).otherwise(out)
        return out

    # projections

    def valued(self, st: State, c: Column, kind: str = "value", drop: bool = True, **more: str) -> State:
        name = self.fresh("val")
        df = st.df.withColumn(name, c)
        df = df.where(F.col(name).isNotNull()) if drop else df
        cur = Elem(kind, {"val": name} | more)
        return replace(st, df=df.select(*dict.fromkeys([*st.carried(), *cur.columns()])), cur=cur)

    def do_id(self, st: State, s: Step) -> State:
        st = self.begun(st)
        if st.cur.kind not in ("vertex", "edge"):
            raise QueryError(f"a {st.cur.kind} has no id")
        return self.valued(st, F.col(st.cur.fields["id" if st.cur.kind == "vertex" else "src"]))

    def listed(self, st: State, keys) -> tuple[State, list[tuple[str, Column, T.DataType]]]:
        """The named properties, or all but the labels, that the current element can have."""
        if st.cur.kind not in ("vertex", "edge"):
            raise QueryError(f"a {st.cur.kind} has no properties")
        st = self.begun(st)
        if not keys:
            st = self.ready(st, "name")
            skip = ("id", "labels", "src", "dst", "eid", "label", "far", "sl", "dl", "back")
            keys = [k for k in st.cur.fields if k not in skip]
        out = []
        for k in keys:
            st = self.ready(st, _first_key(k))
            found = self.column(st, st.cur, k)
            if found is not None:
                out.append((k if isinstance(k, str) else ".".join(k), *found))
        return st, out

    def do_values(self, st: State, s: Step) -> State:
        st, found = self.listed(st, s.args)
        if not found:
            return self.valued(st, F.lit(None).cast("string"))
        if len(found) == 1:
            _, c, kind = found[0]
            if isinstance(kind, T.ArrayType):
                name = self.fresh("val")
                return self.valued(replace(st, df=st.df.select("*", F.explode(c).alias(name))), F.col(name))
            return self.valued(st, c)
        return self._stacked(st, found, "value")

    def _stacked(self, st: State, found, kind: str) -> State:
        kinds = {k.elementType if isinstance(k, T.ArrayType) else k.valueType if isinstance(k, T.MapType) else k for _, _, k in found}
        numbers = all(isinstance(k, T.NumericType) for k in kinds)
        to = next(iter(kinds)).simpleString() if len(kinds) == 1 else "double" if numbers else "string"
        parts = []
        for i, (key, c, k) in enumerate(found):
            own = F.array(F.struct(F.lit(i).alias("i"), F.lit(key).alias("k"), c.cast(to).alias("v")))
            if isinstance(k, T.ArrayType):
                own = F.transform(c, lambda x, i=i, key=key: F.struct(F.lit(i).alias("i"), F.lit(key).alias("k"), x.cast(to).alias("v")))
            elif isinstance(k, T.MapType):
                own = F.transform(F.map_entries(c), lambda x, i=i: F.struct(F.lit(i).alias("i"), x["key"].alias("k"), x["value"].cast(to).alias("v")))
            parts.append(F.when(c.isNotNull(), own))
        each = self.fresh("kv")
        df = st.df.select("*", F.explode(F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))).alias(each)).where(F.col(each)["v"].isNotNull())
        if "_ord" in st.extras:
            df = df.withColumn("_ord", F.concat("_ord", F.array(F.col(each)["i"].cast("long"))))
        st = replace(st, df=df.withColumn(key := self.fresh("key"), F.col(each)["k"]))
        return self.valued(st, F.col(each)["v"], kind, **({"key": key} if kind == "property" else {}))

    def do_properties(self, st: State, s: Step) -> State:
        st, found = self.listed(st, s.args)
        if not found:
            st = replace(st, df=st.df.withColumn(key := self.fresh("key"), F.lit(None).cast("string")))
            return self.valued(st, F.lit(None).cast("string"), "property", key=key)
        return self._stacked(st, found, "property")

    def do_value(self, st: State, s: Step) -> State:
        if st.cur.kind != "property":
            raise QueryError("value needs a property")
        return replace(st, cur=Elem("value", {"val": st.cur.fields["val"]}))

    def do_key(self, st: State, s: Step) -> State:
        if st.cur.kind != "property":
            raise QueryError("key needs a property")
        return replace(st, cur=Elem("value", {"val": st.cur.fields["key"]}))

    def do_element_map(self, st: State, s: Step) -> State:
        if st.cur.kind == "property":
            return replace(st, cur=Elem("map", items=(("key", Elem("value", {"val": st.cur.fields["key"]})), ("value", Elem("value", {"val": st.cur.fields["val"]})))))
        st, found = self.listed(st, s.args)
        if not s.args:
            labels = self.column(self.ready(st, "labels"), st.cur, "labels")
            found = [("labels", *labels), *found] if labels else found
        names = [(k, self.fresh("m")) for k, _, _ in found]
        df = st.df.withColumns({n: c for (_, n), (_, c, _) in zip(names, found, strict=True)})
        if s.args and names:
            df = df.where(_any([F.col(n).isNotNull() for _, n in names]))
        cur = Elem("map", items=tuple((k, Elem("value", {"val": n})) for k, n in names))
        return replace(st, df=df.select(*dict.fromkeys([*st.carried(), *cur.columns()])), cur=cur)

    def do_as(self, st: State, s: Step) -> State:
        st = self.begun(st)
        return replace(st, binds=st.binds | {s.args[0]: st.cur})

    def do_select(self, st: State, s: Step) -> State:
        st = self.begun(st)
        names, by = s.args, s.kw["by"]
        for n in names:
            if n not in st.binds:
                raise QueryError(f"nothing is bound to {n!r}")
        if by and len(by) not in (1, len(names)):
            raise QueryError("select takes one by, or one for each name")
        by = by * len(names) if len(by) == 1 else by
        if len(names) == 1 and not by:
            st = replace(st, cur=st.binds[names[0]], distinct=False, trail=(), simple=0, extras=tuple(x for x in st.extras if x != "_path" and not x.startswith("_pb_")))
            return self.stepped(st)
        items = []
        for i, n in enumerate(names):
            if by:
                st = self.ready(st, _first_key(by[i]), n)
                found = self.column(st, st.binds[n], by[i])
                name = self.fresh("by")
                st = replace(st, df=st.df.withColumn(name, found[0] if found else F.lit(None).cast("string")))
                items.append((n, Elem("value", {"val": name})))
            else:
                items.append((n, st.binds[n]))
        if len(names) == 1:
            return self.valued(st, F.col(items[0][1].fields["val"]))
        return replace(st, cur=Elem("tuple", items=tuple(items)))

    def do_path(self, st: State, s: Step) -> State:
        st = self.begun(st)
        st = self.laid(st)
        return self.valued(st, F.col(f"_pb_{s.kw['by']}" if s.kw.get("by") else "_path"), "list")

    def do_unfold(self, st: State, s: Step) -> State:
        if st.cur.kind not in ("list", "value"):
            raise QueryError("unfold needs a list")
        name = self.fresh("val")
        return self.valued(replace(st, df=st.df.select("*", F.explode(st.cur.fields["val"]).alias(name))), F.col(name))

    # reducers

    def reduced(self, st: State, what: Column, default=None, kind: str = "value") -> State:
        """One value for the whole traversal, or for each root; roots without rows get the default, if there is one."""
        name = self.fresh("val")
        if not st.root:
            df = st.df.agg(what.alias(name))
            df = df.where(F.col(name).isNotNull()) if default is None else df
        else:
            df = st.df.groupBy(*st.root).agg(what.alias(name))
            if default is not None:
                roots = st.roots()
                on = [F.col(a).eqNullSafe(F.col(f"{a}_r")) if a in self.loose else F.col(a) == F.col(f"{a}_r") for a in st.root]
                df = roots.join(df.withColumnsRenamed({a: f"{a}_r" for a in st.root}), _all(on), "left").withColumn(name, F.coalesce(name, default))
        self.kinds.pop(name, None)
        extras = ()
        if self.needs_order:
            df, extras = df.withColumn("_ord", F.array(F.lit(0).cast("long"))), ("_ord",)
        return State(df, Elem(kind, {"val": name}), root=st.root, roots=st.roots, extras=extras)

    def scoped(self, st: State, s: Step, on_value) -> State:
        st = self.begun(st)
        if "val" not in st.cur.fields:
            raise QueryError(f"{s.op} in the local scope needs a value")
        c, kind = F.col(st.cur.fields["val"]), self.type_of(st, st.cur.fields["val"])
        return self.valued(st, on_value(c, kind), drop=True)

    def do_count(self, st: State, s: Step) -> State:
        if s.args and s.args[0] is Scope.local:
            size = lambda c, k: (F.size(c) if isinstance(k, (T.ArrayType, T.MapType)) else F.length(c) if isinstance(k, T.StringType) else F.lit(1)).cast("long")
            return self.scoped(st, s, size)
        st = self.begun(st)
        n = F.coalesce(F.sum(BULK), F.lit(0)) if BULK in st.extras else F.count(F.lit(1))
        return self.reduced(st, n, F.lit(0).cast("long"))

    def numeric(self, st: State, s: Step) -> str:
        name = st.cur.fields.get("val")
        if name is None or not isinstance(self.type_of(st, name), T.NumericType):
            raise QueryError(f"{s.op} needs numbers")
        return name

    def do_sum(self, st: State, s: Step) -> State:
        if s.args and s.args[0] is Scope.local:
            return self.scoped(st, s, lambda c, k: F.aggregate(c, F.lit(0).cast(k.elementType), lambda a, x: (a + x).cast(k.elementType)) if isinstance(k, T.ArrayType) else F.lit(None).cast("double"))
        st = self.begun(st)
        c = F.col(self.numeric(st, s))
        kind = self.type_of(st, st.cur.fields["val"])
        c = c * F.col(BULK) if BULK in st.extras else c
        return self.reduced(st, F.coalesce(F.sum(c), F.lit(0)), F.lit(0).cast("double" if isinstance(kind, (T.DoubleType, T.FloatType)) else "long"))

    def do_mean(self, st: State, s: Step) -> State:
        if s.args and s.args[0] is Scope.local:
            return self.scoped(st, s, lambda c, k: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c) if isinstance(k, T.ArrayType) else F.lit(None).cast("double"))
        st = self.begun(st)
        c = F.col(self.numeric(st, s))
        return self.reduced(st, F.sum(c * F.col(BULK)).cast("double") / F.sum(F.when(c.isNotNull(), F.col(BULK))) if BULK in st.extras else F.avg(c))

    def _extreme(self, st: State, s: Step, pick, of_array) -> State:
        if s.args and s.args[0] is Scope.local:
            return self.scoped(st, s, lambda c, k: of_array(c) if isinstance(k, T.ArrayType) else c)
        st = self.begun(st)
        if "val" not in st.cur.fields:
            raise QueryError(f"{s.op} needs values")
        name, best = st.cur.fields["val"], self.fresh("best")
        if any(s.op in ("hop", "hopE", "repeat", "union", "local", "branch", "filter", "not", "and", "or") for s in self.steps):
            st = replace(st, df=stored(self.kept(st)))  # what joins made the rows run once; a plain scan is cheaper to read twice
        top = st.df.groupBy(*st.root).agg(pick(name).alias(best))
        keys = [f"{best}{i}" for i in range(len(st.root))]
        top = top.toDF(*keys, best)
        on = _all([self.matching([(b, a)], {a: a}) for a, b in zip(st.root, keys, strict=True)] + [F.col(name) == F.col(best)])
        return replace(st, df=st.df.join(top if st.root else F.broadcast(top), on).drop(*keys, best))

    def do_max(self, st: State, s: Step) -> State:
        return self._extreme(st, s, F.max, F.array_max)

    def do_min(self, st: State, s: Step) -> State:
        return self._extreme(st, s, F.min, F.array_min)

    def do_fold(self, st: State, s: Step) -> State:
        """All values as one list: one value holds them all, in one task, as the step demands."""
        st = self.begun(st)
        cur, (seed, func) = st.cur, s.args
        name = cur.fields.get("val") or cur.fields.get("id")
        if name is None or (func is not None and "val" not in cur.fields):
            raise QueryError("fold needs values" if func is not None else f"fold cannot list a {cur.kind}")
        by = [F.col(c) for c, _ in st.sort] if all(asc for _, asc in st.sort) else []
        keys = by + ([F.col("_ord")] if "_ord" in st.extras else [])
        pair = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], F.col(name).alias("v"))
        folded = F.transform(F.sort_array(F.collect_list(pair)), lambda x: x["v"])
        out = self.reduced(st, folded, F.array().cast(T.ArrayType(self.type_of(st, name))), "list")
        if func is None:
            return out
        kind = seed if seed is not None else 0
        result = {bool: "boolean", int: "long", float: "double", str: "string"}.get(type(kind), "string")

        def run(batch):
            import functools

            return batch.map(lambda values: functools.reduce(func, values, seed))

        import pandas as pd

        run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
        return self.valued(out, F.pandas_udf(run, result)(F.col(out.cur.fields["val"])))

    # order and slices

    def do_order(self, st: State, s: Step) -> State:
        by, asc = s.kw["by"], not s.kw["desc"]
        st = self.begun(st)
        if by is None:
            if "val" not in st.cur.fields:
                raise QueryError("order without a key needs values")
            name = self.fresh("sort")
            st = replace(st, df=st.df.withColumn(name, F.col(st.cur.fields["val"])))
        else:
            st, name = self.scalar(st, by.steps if isinstance(by, Traversal) else (Step("values", (by,)),))
            if isinstance(by, Traversal):
                absent = F.raise_error(F.lit("a sub-traversal that orders gives no value"))
                st = replace(st, df=st.df.withColumn(name, F.coalesce(F.col(name), absent.cast(self.type_of(st, name)))))
            else:
                st = replace(st, df=st.df.where(F.col(name).isNotNull()))
        return replace(st, sort=((name, asc),))

    def ordering(self, st: State) -> list[Column]:
        out = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in st.sort]
        out += [F.col("_ord")] if "_ord" in st.extras else []
        # equal keys stay in a defined order
        ids = [c for k in ("id", "src", "dst", "eid") if (c := st.cur.fields.get(k))]
        ids += [c for e in st.binds.values() for k in ("id", "eid") if (c := e.fields.get(k))]
        return out + [F.col(c) for c in dict.fromkeys(ids)]

    def do_range(self, st: State, s: Step) -> State:
        st = self.begun(st)
        a, b = s.args
        if a < 0 or (b != -1 and b < a):
            raise QueryError("a range needs 0 <= start <= stop, or -1 for no stop")
        if st.root:
            n = self.fresh("n")
            order = self.ordering(st) or [F.lit(0)]
            df = st.df.withColumn(n, F.row_number().over(Window.partitionBy(*st.root).orderBy(*order)))
            cond = F.col(n) > a if b == -1 else (F.col(n) > a) & (F.col(n) <= b)
            return replace(st, df=df.where(cond).drop(n))
        order = self.ordering(st)
        df = st.df.orderBy(*order) if order else st.df
        if b == -1:
            return replace(st, df=self.skipped(df, a) if a else df)
        df = df.offset(a) if a else df
        return replace(st, df=df.limit(b - a))

    def skipped(self, df: DataFrame, a: int) -> DataFrame:
        """Rows but the first a, in the order and partitions they have: a partition's first rows have the places after all rows before it."""
        part, at = self.fresh("part"), self.fresh("at")
        df = checkpointed(df.withColumn(at, F.monotonically_increasing_id())).withColumn(part, F.shiftright(at, 33))
        counts = dict(df.groupBy(part).count().collect())
        left = {}
        for p in sorted(counts):
            left[p], a = min(a, counts[p]), max(a - counts[p], 0)
        gone = [(p, n) for p, n in left.items() if n]
        if not gone:
            return df.drop(part, at)
        within = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
        whole = [p for p, n in gone if n == counts[p]]
        df = df.where(~F.col(part).isin(whole)) if whole else df
        for p, n in gone:
            if n < counts[p]:
                df = df.where((F.col(part) != p) | (within >= n))
        return df.drop(part, at)

    def do_dedup(self, st: State, s: Step) -> State:
        st, by = self.laid(self.begun(st)), s.kw.get("by")
        if by is not None:
            st, name = self.scalar(st, (Step("values", (by,)),))
            st = replace(st, df=st.df.where(F.col(name).isNotNull()))
            keys = [name]
        elif st.cur.kind in ("vertex", "edge"):
            f = st.cur.fields
            keys = [f[k] for k in ("id", "src", "dst", "eid") if k in f]
            if st.cur.kind == "vertex" and "labels" in f and len(self.vertex_tables(st.cur.labels)) > 1:
                keys.append(f["labels"])
            keys += ["_path"] if "_path" in st.extras else []
        else:
            keys = st.cur.columns()
        keys = [*st.root, *keys]
        if "_ord" in st.extras:
            n = self.fresh("n")
            order = self.ordering(st)
            df = st.df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)
            return replace(st, df=df)
        return replace(st, df=st.df.dropDuplicates(keys), extras=tuple(x for x in st.extras if x != BULK), distinct=st.cur.kind == "vertex" and by is None)

    # control flow

    def merged(self, states: list[State], tag: bool = False) -> State:
        """Bag union of states of one kind; values of different types become strings."""
        states = [self.laid(self.begun(s)) for s in states]
        if len(states) == 1:
            return states[0]
        kinds = {s.cur.kind for s in states}
        if len(kinds) > 1:
            raise QueryError(f"branches of different kinds: {sorted(kinds)}")
        kind = kinds.pop()
        shared = [b for b in states[0].binds if all(s.binds.get(b) == states[0].binds[b] for s in states)]
        binds = {b: states[0].binds[b] for b in shared}
        extras = tuple(x for x in states[0].extras if all(x in s.extras for s in states))
        fields = [k for k in states[0].cur.fields if all(k in s.cur.fields for s in states)]
        names = {k: self.fresh(k) for k in fields}
        items = ()
        if kind in ("map", "tuple"):
            items = tuple((k, Elem("value", {"val": self.fresh(k)})) for k, e in states[0].cur.items)
        frames = []
        for i, s in enumerate(states):
            cols = [*s.root, *extras, *(c for e in binds.values() for c in e.columns())]
            own = []
            for k, n in names.items():
                c = F.col(s.cur.fields[k])
                types = {self.type_of(x, x.cur.fields[k]) for x in states}
                if len(types) > 1:
                    c = c.cast("double" if all(isinstance(x, T.NumericType) for x in types) else "string")
                own.append(c.alias(n))
            own += [F.col(e.columns()[0]).alias(ne.fields["val"]) for (_, e), (_, ne) in zip(s.cur.items, items, strict=True)] if items else []
            df = s.df.select(*dict.fromkeys(cols), *own)
            if "_ord" in extras:
                df = df.withColumn("_ord", F.concat("_ord", F.array(F.lit(i).cast("long"))))
            frames.append(df)
        labels = [s.cur.labels for s in states]
        static = None if None in labels else tuple(dict.fromkeys(x for y in labels for x in y))
        ends = states[0].cur.ends if all(s.cur.ends == states[0].cur.ends for s in states) else (None, None)
        cur = Elem(kind, names, static, ends, items, loaded=all(s.cur.loaded for s in states) and len({tuple(s.cur.fields) for s in states}) == 1)
        return replace(states[0], df=union(frames), cur=cur, binds=binds, extras=extras, sort=(), distinct=False)

    def do_union(self, st: State, s: Step) -> State:
        st = self.begun(st)
        return self.merged([self.applied(st, t.steps) for t in s.args])

    def do_local(self, st: State, s: Step) -> State:
        return self.applied(st, s.args[0].steps)

    def do_branch(self, st: State, s: Step) -> State:
        options = s.kw["options"]
        if not options:
            raise QueryError("branch needs an option")
        st, key = self.scalar(st, s.args[0].steps)
        kind = self.type_of(st, key)
        named = [(k, t) for k, t in options if k is not None]
        hit = lambda k: _sure(same(F.col(key), kind, k))
        parts = [self.applied(replace(st, df=st.df.where(hit(k))), t.steps) for k, t in named]
        for _, t in [o for o in options if o[0] is None]:
            rest = F.col(key).isNotNull() & ~_any([hit(k) for k, _ in named]) if named else F.col(key).isNotNull()
            parts.append(self.applied(replace(st, df=st.df.where(rest)), t.steps))
        return self.merged(parts)

    def do_until(self, st: State, s: Step) -> State:
        raise QueryError(f"{s.op} needs a repeat")

    do_emit = do_until

    def do_repeat(self, st: State, s: Step) -> State:
        body, kw = s.args[0].steps, s.kw
        st = self.begun(st)
        emit, times, until = kw.get("emit"), kw.get("times"), kw.get("until")
        if times is None and until is None:
            raise QueryError("repeat needs times or until")
        if until is not None and not emit and (found := self.recursed(st, s)):
            return found
        passing = lambda x: x if emit is True else self.existing(x, emit.steps)
        out = [passing(st)] if emit and kw.get("emit_first") else []
        if times is not None and until is None:
            for i in range(times):
                st = self.begun(self.applied(st, body))
                if emit:
                    # a level is written, so that the next one and its own rows do not compute it again
                    st = replace(st, df=stored(self.kept(st))) if i + 1 < times or emit is not True else st
                    out.append(passing(st))
            return self.merged(out) if emit else st
        rounds = 0
        while times is None or rounds < times:
            rounds += 1
            if rounds > self.graph.config.most_rounds:
                raise GraphTraversalError(f"repeat did not end after {self.graph.config.most_rounds} rounds")
            if kw.get("until_first"):
                st = replace(st, df=stored(self.kept(st)))
                out.append(self.existing(st, until.steps))
                st = self.existing(st, until.steps, negate=True)
                if st.df.isEmpty():
                    break
                st = self.begun(self.applied(st, body))
                if emit:
                    out.append(passing(st))
            else:
                st = self.begun(self.applied(st, body))
                st = replace(st, df=stored(self.kept(st)))
                if emit:
                    out.append(passing(self.existing(st, until.steps, negate=True)))
                out.append(passing(self.existing(st, until.steps)) if emit else self.existing(st, until.steps))
                st = self.existing(st, until.steps, negate=True)
                if st.df.isEmpty():
                    break
        return self.merged(out)

    def plain_loop(self, st: State, s: Step) -> State | None:
        """The state, begun, if the loop's rounds depend on nothing but the vertex and lead to the labels they come from; else None."""
        body = s.args[0].steps
        if self.needs_path or self.needs_order or st.cur.kind != "vertex" or not all(x.op in PLAIN_BODY for x in body):
            return None
        bound = {x.args[0] for x in body if x.op == "as"}
        inside = [*body, *(x for k in ("until", "emit") if isinstance(s.kw.get(k), Traversal) for x in s.kw[k].steps)]
        if any(n not in bound for x in _walk(inside) if x.op == "select" for n in x.args):
            return None
        st = self.begun(st)
        after = self.ran(replace(st, binds={}), body)
        known = [sorted(t.label or "" for t in self.vertex_tables(x.cur.labels)) for x in (st, after)]
        return st if after.cur.kind == "vertex" and known[0] == known[1] else None

    def recursed(self, st: State, s: Step) -> State | None:
        """`repeat` of one hop with `until` as one recursive query, whose rounds join the loop's step. Spark fails it at the round after the last that is
        allowed. None if rounds depend on more than the vertex, ids need labels, or the body has more hops.
        """
        if not self.one_hop(st, s) or (st := self.plain_loop(st, s)) is None:
            return None
        until, times, first = s.kw["until"].steps, s.kw.get("times"), bool(s.kw.get("until_first"))
        spark, root, here, done = self.graph.spark, *(self.fresh(x) for x in ("root", "id", "done"))
        labels, carried, level = st.cur.labels, st.carried(), self.fresh("level")
        step = self.loop_step(st, s, root, here, done)
        own = [*[F.col(c) for c in carried], F.col(st.cur.fields["id"]).alias(here)]
        start = self.told(st, until, done, own) if first else st.df.select(*own, F.lit(False).alias(done))
        # rows do not multiply beyond what the loop gives, so the default limit of rows would only cut results
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        names = {x: f"hopwise_{uuid.uuid4().hex}" for x in ("start", "step")}
        start.createOrReplaceTempView(names["start"])
        step.createOrReplaceTempView(names["step"])
        shown = [*carried, here, done]
        more = "" if times is None else f" AND walk.{level} < {times - first}"
        walk = f"""WITH RECURSIVE walk({", ".join([*shown, level])}) MAX RECURSION LEVEL {self.graph.config.most_rounds} AS (
            SELECT {", ".join(shown)}, 0 FROM {names["start"]}
            UNION ALL SELECT {", ".join([*(f"walk.{c}" for c in carried), f"step.{here}", f"step.{done}", f"walk.{level} + 1"])}
            FROM walk JOIN {names["step"]} AS step ON walk.{here} = step.{root} WHERE NOT walk.{done}{more})
            SELECT {", ".join([*carried, here])} FROM walk WHERE {done} AND {level} >= {int(not first)}"""
        df = spark.sql(walk)
        for name in names.values():
            spark.catalog.dropTempView(name)
        return replace(st, df=df, cur=Elem("vertex", {"id": here}, labels), distinct=False)

    def one_hop(self, st: State, s: Step) -> bool:
        return len(self.vertex_tables(st.cur.labels)) == 1 and sum(x.op in ("hop", "hopE") for x in s.args[0].steps) == 1

    def loop_step(self, st: State, s: Step, root: str, here: str, done: str) -> DataFrame:
        """What one round of a loop of one hop makes of each vertex, and whether the loop ends there: no more rows than edges, written once."""
        labels, until = st.cur.labels, s.kw.get("until")
        every = lambda: self.vertex_frame(labels).select(F.col("id").alias(root))
        body = self.begun(self.ran(State(None, Elem("vertex", labels=labels), root=(root,), roots=every), s.args[0].steps))
        columns = [F.col(root), F.col(body.cur.fields["id"]).alias(here)]
        return stored(body.df.select(*columns, F.lit(False).alias(done)) if until is None else self.told(body, until.steps, done, columns))

    def told(self, st: State, steps, name: str, columns: list[Column]) -> DataFrame:
        """These columns, and whether the steps give a result."""
        st, cond = self.condition(st, steps)
        if cond is not None:
            return st.df.select(*columns, _sure(cond).alias(name))
        yes, no = self.existing(st, steps), self.existing(st, steps, negate=True)
        return yes.df.select(*columns, F.lit(True).alias(name)).union(no.df.select(*columns, F.lit(False).alias(name)))

    def reached(self, st: State, s: Step, dedup: Step) -> State | None:
        """`repeat(...).emit().dedup()`: each round goes on from the vertices that no round before has met, and the last finds none.

        None if the loop depends on more than the vertex, or is no such search.
        """
        kw = s.kw
        if not kw.get("emit") or kw.get("until_first") or dedup.kw.get("by") is not None or (st := self.plain_loop(st, s)) is None:
            return None
        until, times, many = kw.get("until"), kw.get("times"), len(self.vertex_tables(st.cur.labels)) > 1
        if times is None and until is None:
            raise QueryError("repeat needs times or until")
        if many:
            st = self.ready(st, "labels")
        fields = {k: self.fresh("met") for k in ("id", "labels")[: 1 + many]}

        def bare(x: State) -> DataFrame:
            x = self.ready(x, "labels") if many else self.begun(x)
            return x.df.select(*x.root, *[F.col(x.cur.fields[k]).alias(n) for k, n in fields.items()]).distinct()

        keys = [*st.root, *fields.values()]
        at = lambda df: State(df, Elem("vertex", fields, st.cur.labels), root=st.root, roots=st.roots, distinct=True)
        one, ends = self.one_hop(st, s), [self.fresh(x) for x in ("root", "id", "done")]
        step = self.loop_step(st, s, *ends) if one else None
        new = stored(bare(st).withColumn(ends[2], F.lit(False)) if one else bare(st))
        met, rounds = ([new] if kw.get("emit_first") else []), 0
        while times is None or rounds < times:
            rounds += 1
            if rounds > self.graph.config.most_rounds:
                raise GraphTraversalError(f"repeat did not end after {self.graph.config.most_rounds} rounds")
            if one:
                found = new.where(~F.col(ends[2])).drop(ends[2]).join(step, F.col(fields["id"]) == F.col(ends[0])).select(*st.root, F.col(ends[1]).alias(fields["id"]), ends[2]).distinct()
            else:
                front = at(new) if until is None or rounds == 1 else self.existing(at(new), until.steps, negate=True)
                found = bare(self.ran(front, s.args[0].steps))
            if met:
                old = union(met).select(*[F.col(k).alias(f"{k}_old") for k in keys])
                same = [F.col(k).eqNullSafe(F.col(f"{k}_old")) if k in self.loose else F.col(k) == F.col(f"{k}_old") for k in keys]
                found = found.join(old, _all(same), "left_anti")
            new = stored(found)
            self.rounds.append(new.count())
            if not self.rounds[-1]:
                break
            met.append(new)
            if len(met) > 16:  # few files and short plans, however many rounds
                met = [stored(union(met))]
        out = at(union(met) if met else new.where(F.lit(False)))
        return out if kw["emit"] is True else self.existing(out, kw["emit"].steps)

    # effects

    def do_side_effect(self, st: State, s: Step) -> State:
        """A function gets every row in the driver, streamed, as its effects are the caller's; a traversal runs on the executors."""
        effect = s.args[0]
        st = self.begun(st)
        st = replace(st, df=checkpointed(self.kept(st)))
        if isinstance(effect, Traversal):
            self.begun(self.ran(st, effect.steps)).df.foreach(lambda row: None)
            return st
        fields = {v: k for k, v in st.cur.fields.items()}
        for row in st.df.select(*fields).toLocalIterator():
            effect({fields[c]: x for c, x in row.asDict().items()})
        return st

    def do_property(self, st: State, s: Step) -> State:
        args = ("labels", *s.args[1:]) if isinstance(s.args[0], Cardinality) and len(s.args) == 2 else s.args
        card, key, value = args if len(args) == 3 else (Cardinality.label if args[0] == "labels" else Cardinality.single, *args)
        st, graph = self.begun(st), self.graph
        if card is Cardinality.label:
            key = "labels"
        if isinstance(value, (list, tuple, set, dict)):
            raise QueryError("a property takes one value; use a cardinality for lists and sets")
        table, on = ("vertices", ["id"]) if st.cur.kind == "vertex" else ("edges", ["src", "dst", "eid"])
        if not graph.log:
            graph.log += [f"{shared_dir(graph.spark).rstrip('/')}/hopwise-{uuid.uuid4().hex}", 0]
        graph.log[1] += 1
        version = graph.log[1]
        st.df.select(*[F.col(st.cur.fields[c]).alias(c) for c in on]).distinct().write.mode("overwrite").parquet(f"{graph.log[0]}/v={version}")
        column, *rest = [key] if isinstance(key, str) else list(key)
        family = "map" if rest or card in (Cardinality.map_, Cardinality.dict_) else "list" if card is Cardinality.list_ else "set" if card is Cardinality.set_ or column == "labels" else "single"
        new = ((rest or [column])[-1], value) if family == "map" else value
        labels = st.cur.labels
        hit = lambda t: labels is None or t.label is None or t.label in labels
        setattr(graph, table, [graph.changed(t, column, family, new, version) if hit(t) else t for t in getattr(graph, table)])
        if st.cur.kind == "vertex":
            graph.edges = [replace(t, carries=None) if t.carries else t for t in graph.edges]  # what they hold is out of date
            keep = {k: c for k, c in st.cur.fields.items() if k in ("id",)}
            return replace(st, cur=replace(st.cur, fields=keep, loaded=False))
        return self.reread(st, on)

    def reread(self, st: State, on: list[str]) -> State:
        """An edge's properties again, from its changed table."""
        e = self.edge_frame(self.edge_tables(st.cur.labels))
        names = {c: self.fresh(c) for c in e.columns if c not in ("_seq", "sl", "dl")}
        e = e.select(*[F.col(c).alias(n) for c, n in names.items()])
        match = _all([F.col(st.cur.fields[c]) == F.col(names[c]) for c in on])
        df = st.df.join(e, match)
        return replace(st, df=df.select(*dict.fromkeys([*st.carried(), *names.values()])), cur=replace(st.cur, fields=names))

    # ---- results

    def compiled(self) -> State:
        if not self.steps or self.steps[0].op not in ("V", "E", "addV", "addE"):
            raise QueryError("a traversal starts with V, E, addV or addE")
        st = self.begun(self.ran(None, self.steps, True))
        self._kind = st.cur.kind
        return st

    def visible(self, cur: Elem, prefix: str = "") -> list[tuple[str, str]]:
        """Names and columns of what a result shows."""
        if cur.kind == "vertex":
            return [(prefix or "id", cur.fields["id"])]
        if cur.kind == "edge":
            show = [("src", "src"), ("dst", "dst"), ("label", "label")]
            return [(f"{prefix}_{n}" if prefix else n, cur.fields[k]) for n, k in show]
        if cur.kind == "property":
            return [(f"{prefix}_key" if prefix else "key", cur.fields["key"]), (f"{prefix}_value" if prefix else "value", cur.fields["val"])]
        if cur.kind in ("map", "tuple"):
            return [x for name, e in cur.items for x in self.visible(e, name)]
        return [(prefix or "value", cur.fields["val"])]

    def frame(self, *names: str) -> DataFrame:
        st = self.compiled()
        last = self.steps[-1]
        if last.op == "as_path":
            st = self.do_path(st, last)
        elif last.op in ("to_list", "iter", "next") and last.kw.get("by") is not None:
            st = self.do_values(st, Step("values", (last.kw["by"],)))
        show = self.visible(st.cur)
        if names and len(names) != len(show):
            raise QueryError(f"the result has {len(show)} columns")
        df = st.df
        if st.sort:
            df = df.orderBy(*self.ordering(st))
        elif "_ord" in st.extras and last.op in ("next", "to_list", "iter"):
            df = df.orderBy("_ord")
        return df.select(*[F.col(c).alias(n) for n, (_, c) in zip(names or [n for n, _ in show], show, strict=True)])

    def run(self):
        last = self.steps[-1]
        if last.op not in TERMINALS:
            return self.frame()
        if last.op == "iterate":
            df = self.compiled().df
            if self.steps[-2].op not in ("property", "addV", "addE"):  # these are done by now
                df.foreach(lambda row: None)
            return None
        if last.op == "has_next":
            return not self.compiled().df.isEmpty()
        if last.kw.get("include_data"):
            self.steps = (*self.steps[:-1], Step("element_map"), Step("to_list", (), {"by": None}))
            last = self.steps[-1]
        shape = self._shape()
        df = self.frame()
        if last.op == "next":
            rows = [shape(r) for r in df.take(last.args[0])]
            return rows if last.args[0] > 1 else rows[0] if rows else False
        if last.op == "iter":
            return (shape(r) for r in df.toLocalIterator())
        return [shape(r) for r in df.collect()]

    def _shape(self):
        """How a row of the result looks in Python."""
        last = self.steps[-1]
        kind = "list" if last.op == "as_path" else "value" if last.kw.get("by") is not None else None

        def plain(x):
            if isinstance(x, T.Row):
                d = x.asDict()
                if set(d) == {"id", "dst"}:
                    return d["id"] if d["dst"] is None else (d["id"], d["dst"])
                return {k: plain(v) for k, v in d.items()}
            return [plain(v) for v in x] if isinstance(x, list) else x

        def shaped(row):
            found = kind or self._kind
            values = [plain(v) for v in row]
            if found == "edge":
                return tuple(values[:2])
            if found == "property":
                return {values[0]: values[1]}
            if found == "map":
                return {k: v for k, v in zip(row.__fields__, values, strict=True) if v is not None}
            if found == "tuple":
                return values
            return values[0]

        return shaped


def _common(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns of different types become strings (numbers: the wider type)."""
    if len(frames) > 1:
        kinds: dict[str, set] = {}
        for df in frames:
            for f in df.schema:
                kinds.setdefault(f.name, set()).add(f.dataType)
        odd = {c for c, k in kinds.items() if len(k) > 1 and not all(isinstance(x, T.NumericType) for x in k)}
        frames = [df.withColumns({c: F.col(c).cast("string") for c in odd if c in df.columns}) for df in frames]
    return union(frames)


def _among(c: Column, kind: T.DataType, values) -> Column:
    return _any([same(c, kind, v) for v in values])


def _salt(column: str, hubs: dict) -> str:
    """Which of its parts an edge of a vertex with very many edges belongs to; 0 for edges of other vertices."""
    cases = " ".join(f"when {_literal(v)} then cast(pmod(xxhash64(eid, _seq), {n}) as int)" for v, n in hubs.items())
    return f"case `{column}` {cases} else 0 end"


def _copies(column: str, hubs: dict) -> str:
    """All parts of a vertex's edges."""
    cases = " ".join(f"when {_literal(v)} then sequence(0, {n - 1})" for v, n in hubs.items())
    return f"case `{column}` {cases} else array(0) end"


def _literal(v) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v}"


def _sure(cond: Column) -> Column:
    """A condition whose null is false, for negation."""
    return F.coalesce(cond, F.lit(False))


def _all(conds: list[Column]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(conds):
        out = c if i == 0 else out & c
    return out


def _any(conds: list[Column]) -> Column:
    out = F.lit(False)
    for i, c in enumerate(conds):
        out = c if i == 0 else out | c
    return out
