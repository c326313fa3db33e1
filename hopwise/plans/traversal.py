"""The fluent API: traversals as immutable lists of steps. Nothing runs before a terminal's `run()`, `to_df()` or `explain()`."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from hopwise.errors import QueryError


class Scope(Enum):
    local = "local"
    global_ = "global"


class Order(Enum):
    asc = "asc"
    desc = "desc"


class Cardinality(Enum):
    label = "label"
    single = "single"
    list_ = "list"
    set_ = "set"
    map_ = "map"
    dict_ = "dict"


@dataclass(frozen=True)
class Step:
    op: str
    args: tuple = ()
    kw: dict = field(default_factory=dict)


TERMINALS = {"to_list", "iter", "next", "has_next", "as_path", "iterate"}
# Which steps take `by`: a key, a sub-traversal too, or several keys.
BY_KEY, BY_ANY, BY_MANY = {"dedup", "simple_path", "path", "to_list", "iter", "next", "as_path"}, {"order"}, {"select"}


def _snake(name: str) -> str:
    return re.sub(r"(?<=[a-z])([A-Z])", lambda m: "_" + m[1].lower(), name)


class Traversal:
    """Steps of one traversal; without a source it is anonymous, a sub-query of another one."""

    def __init__(self, steps: tuple[Step, ...] = (), source: Source | None = None):
        self.steps, self.source = steps, source

    def __getattr__(self, name: str):
        snake = _snake(name)
        if snake != name and snake in dir(type(self)):
            return getattr(self, snake)
        raise AttributeError(name)

    def __str__(self) -> str:
        show = lambda x: str(x) if isinstance(x, Traversal) else repr(x.value) if isinstance(x, Enum) else getattr(x, "name", None) or repr(x)
        return ".".join(f"{s.op}({', '.join([*map(show, s.args), *(f'{k}={show(v)}' for k, v in s.kw.items() if v is not None and v != ())])})" for s in self.steps) or "identity()"

    print_query = __str__

    def number_of_steps(self, recursive: bool = False) -> int:
        inner = [x for s in self.steps for x in [*s.args, *s.kw.values()] if isinstance(x, Traversal)] if recursive else []
        return len(self.steps) + sum(x.number_of_steps(True) for x in inner)

    def _add(self, op: str, *args: Any, **kw: Any) -> Traversal:
        if self.steps and self.steps[-1].op in TERMINALS:
            raise QueryError(f"no step may follow {self.steps[-1].op}")
        if op in TERMINALS and self.source is None:
            raise QueryError(f"{op} ends a traversal and cannot stand in a sub-traversal")
        return Traversal((*self.steps, Step(op, args, kw)), self.source)

    def _change(self, ops: set[str], what: str, **kw: Any) -> Traversal:
        if not self.steps or self.steps[-1].op not in ops:
            raise QueryError(f"{what} must follow one of {sorted(ops)}")
        last = self.steps[-1]
        return Traversal((*self.steps[:-1], replace(last, kw=last.kw | kw)), self.source)

    # filters
    def filter_(self, anon: Traversal) -> Traversal:
        return self._add("filter", anon)

    def not_(self, anon: Traversal) -> Traversal:
        return self._add("not", anon)

    def and_(self, a: Traversal, b: Traversal) -> Traversal:
        return self._add("and", a, b)

    def or_(self, a: Traversal, b: Traversal) -> Traversal:
        return self._add("or", a, b)

    def has(self, *args: Any) -> Traversal:
        if not 1 <= len(args) <= 3:
            raise QueryError("has takes a key, a key and a value, or a label, a key and a value")
        return self._add("has", *args)

    def has_not(self, key) -> Traversal:
        return self._add("has_not", key)

    def has_key(self, *keys: str) -> Traversal:
        return self._add("has_key", *keys)

    def has_value(self, *values: Any) -> Traversal:
        return self._add("has_value", *values)

    def has_id(self, *ids: Any) -> Traversal:
        if len(ids) == 1 and isinstance(ids[0], (list, set)):
            ids = tuple(ids[0])
        return self._add("has_id", *ids)

    def has_name(self, *names: Any) -> Traversal:
        if not names:
            raise QueryError("has_name needs a name")
        return self._add("has", "name", names[0]) if len(names) == 1 else self._add("within", "name", list(names))

    def has_label(self, label: Any) -> Traversal:
        return self._add("has_label", *(sorted(label) if isinstance(label, (set, frozenset, list, tuple)) else [label]))

    def contains(self, key, value: Any) -> Traversal:
        return self._add("contains", key, value)

    def within(self, key, options: Any) -> Traversal:
        return self._add("within", key, list(options))

    def is_(self, value: Any) -> Traversal:
        return self._add("is", value)

    def simple_path(self, by: str | None = None) -> Traversal:
        return self._add("simple_path", by=by)

    def dedup(self, by: str | None = None) -> Traversal:
        return self._add("dedup", by=by)

    def limit(self, n: int) -> Traversal:
        return self._add("range", 0, n)

    def skip(self, n: int) -> Traversal:
        return self._add("range", n, -1)

    def range(self, start: int, stop: int) -> Traversal:
        return self._add("range", start, stop)

    # hops
    def out(self, label: str | None = None) -> Traversal:
        return self._add("hop", "out", label)

    def in_(self, label: str | None = None) -> Traversal:
        return self._add("hop", "in", label)

    def both(self, label: str | None = None) -> Traversal:
        return self._add("hop", "both", label)

    def outE(self, label: str | None = None) -> Traversal:  # noqa: N802
        return self._add("hopE", "out", label)

    def inE(self, label: str | None = None) -> Traversal:  # noqa: N802
        return self._add("hopE", "in", label)

    def bothE(self, label: str | None = None) -> Traversal:  # noqa: N802
        return self._add("hopE", "both", label)

    def outV(self) -> Traversal:  # noqa: N802
        return self._add("end", "src")

    def inV(self) -> Traversal:  # noqa: N802
        return self._add("end", "dst")

    def bothV(self) -> Traversal:  # noqa: N802
        return self._add("end", "both")

    # projections
    def identity(self) -> Traversal:
        return self._add("identity")

    def id_(self) -> Traversal:
        return self._add("id")

    def values(self, *keys: Any) -> Traversal:
        return self._add("values", *keys)

    def name(self) -> Traversal:
        return self._add("values", "name")

    def label(self) -> Traversal:
        return self._add("values", "labels")

    def properties(self, *keys: Any) -> Traversal:
        return self._add("properties", *keys)

    def value(self) -> Traversal:
        return self._add("value")

    def key(self) -> Traversal:
        return self._add("key")

    def element_map(self, *keys: str) -> Traversal:
        return self._add("element_map", *keys)

    def select(self, *names: str, by: Any = None) -> Traversal:
        if not names:
            raise QueryError("select needs a name")
        return self._add("select", *names, by=() if by is None else tuple(by) if isinstance(by, (list, tuple)) else (by,))

    def path(self, by: str | None = None) -> Traversal:
        return self._add("path", by=by)

    def unfold(self) -> Traversal:
        return self._add("unfold")

    # reducers
    def count(self, scope: Scope = Scope.global_) -> Traversal:
        return self._add("count", scope)

    def sum_(self, scope: Scope = Scope.global_) -> Traversal:
        return self._add("sum", scope)

    def mean(self, scope: Scope = Scope.global_) -> Traversal:
        return self._add("mean", scope)

    def max_(self, scope: Scope = Scope.global_) -> Traversal:
        return self._add("max", scope)

    def min_(self, scope: Scope = Scope.global_) -> Traversal:
        return self._add("min", scope)

    def fold(self, seed: Any = None, func: Any = None) -> Traversal:
        if (seed is None) != (func is None):
            raise QueryError("fold takes a seed and a function, or neither")
        return self._add("fold", seed, func)

    # order
    def order(self, by: Any = None, asc: bool | None = None, desc: bool | None = None) -> Traversal:
        if isinstance(by, Order):
            by, desc = None, by is Order.desc
        if asc is not None and desc is not None and bool(asc) == bool(desc):
            raise QueryError("order is either ascending or descending")
        return self._add("order", by=by, desc=bool(desc) if desc is not None else asc is False)

    # control flow
    def repeat(self, *args: Traversal, **kw: Any) -> Traversal:
        """repeat(do, times=, until=); `until` before `do`, as a keyword or as a step, is tested before each round."""
        before: dict = {}
        prior = self
        while prior.steps and prior.steps[-1].op in ("until", "emit"):
            s = prior.steps[-1]
            before |= {"until": s.args[0], "until_first": True} if s.op == "until" else {"emit": s.args[0] if s.args else True, "emit_first": True}
            prior = Traversal(prior.steps[:-1], prior.source)
        do = args[0] if args else kw.get("do")
        if do is None or len(args) > 1 or set(kw) - {"do", "times", "until"}:
            raise QueryError("repeat takes a traversal, times and until")
        given = {"times": kw.get("times")} | before
        if kw.get("until") is not None:
            given |= {"until": kw["until"], "until_first": not args and list(kw).index("until") < list(kw).index("do")}
        return prior._add("repeat", do, **given)

    def times(self, n: int) -> Traversal:
        return self._change({"repeat"}, "times", times=n)

    def until(self, cond: Traversal) -> Traversal:
        if self.steps and self.steps[-1].op == "repeat":
            return self._change({"repeat"}, "until", until=cond, until_first=False)
        return self._add("until", cond)

    def emit(self, cond: Traversal | None = None) -> Traversal:
        if self.steps and self.steps[-1].op == "repeat":
            return self._change({"repeat"}, "emit", emit=True if cond is None else cond)
        return self._add("emit", *([] if cond is None else [cond]))

    def local(self, anon: Traversal) -> Traversal:
        return self._add("local", anon)

    def union(self, *anons: Traversal) -> Traversal:
        if not anons:
            raise QueryError("union needs a traversal")
        return self._add("union", *anons)

    def branch(self, func: Traversal) -> Traversal:
        return self._add("branch", func, options=())

    def option(self, key: Any, anon: Traversal) -> Traversal:
        if not self.steps or self.steps[-1].op != "branch":
            raise QueryError("option must follow branch")
        known = self.steps[-1].kw["options"]
        if any(k == key and type(k) is type(key) for k, _ in known):
            raise QueryError(f"option {key!r} is given twice")
        return self._change({"branch"}, "option", options=(*known, (key, anon)))

    # variables, effects
    def as_(self, name: str) -> Traversal:
        return self._add("as", name)

    def side_effect(self, effect: Any) -> Traversal:
        return self._add("side_effect", effect)

    def property(self, *args: Any) -> Traversal:
        if len(args) not in (2, 3):
            raise QueryError("property takes a key and a value, after a cardinality if any")
        if self.steps and self.steps[-1].op in ("addV", "addE") and len(args) == 2:
            return self._change({"addV", "addE"}, "property", props=self.steps[-1].kw["props"] | {args[0]: args[1]})
        return self._add("property", *args)

    def from_(self, id: Any) -> Traversal:
        return self._change({"addE"}, "from_", src=id)

    def to_(self, id: Any) -> Traversal:
        return self._change({"addE"}, "to_", dst=id)

    def by(self, key: Any, order: Order | None = None) -> Traversal:
        if not self.steps or self.steps[-1].op not in BY_KEY | BY_ANY | BY_MANY:
            raise QueryError("by cannot follow this step")
        last = self.steps[-1]
        if last.op == "order":
            if isinstance(key, Order):
                return self._change({"order"}, "by", desc=key is Order.desc)
            if last.kw["by"] is not None:
                raise QueryError("order takes one key")
            return self._change({"order"}, "by", by=key, **({} if order is None else {"desc": order is Order.desc}))
        if isinstance(key, Traversal):
            raise QueryError(f"{last.op} takes no traversal in by")
        if last.op == "select":
            return self._change({"select"}, "by", by=(*last.kw["by"], key))
        if last.kw.get("by") is not None:
            raise QueryError(f"{last.op} takes one by")
        return self._change({last.op}, "by", by=key)

    # terminals
    def to_list(self, by: Any = None, include_data: bool = False) -> Traversal:
        return self._add("to_list", by=by, include_data=include_data)

    def iter(self, by: Any = None, include_data: bool = False) -> Traversal:
        return self._add("iter", by=by, include_data=include_data)

    def next(self, n: int = 1) -> Traversal:
        return self._add("next", n, by=None)

    def has_next(self) -> Traversal:
        return self._add("has_next")

    def as_path(self, by: Any = None) -> Traversal:
        return self._add("as_path", by=by)

    def iterate(self) -> Traversal:
        return self._add("iterate")

    def _planner(self):
        if self.source is None:
            raise QueryError("a sub-traversal cannot run on its own")
        from hopwise.plans.planner import Planner

        return Planner(self.source.graph, self.steps)

    def to_df(self, *names: str):
        """The result as a DataFrame; names rename its columns in order."""
        return self._planner().frame(*names)

    def run(self):
        return self._planner().run()

    def explain(self, mode: str = "formatted") -> None:
        self.to_df().explain(mode)


class Source:
    """Starts traversals over a graph."""

    def __init__(self, graph, eager: bool = False, optimize: bool = True, use_mp: bool = False):
        self.graph = graph

    def V(self, *ids: Any) -> Traversal:  # noqa: N802
        flat = ids[0] if len(ids) == 1 and isinstance(ids[0], (list, tuple, set)) else ids
        return Traversal((Step("V", tuple(flat)),), self)

    def E(self, *pairs: Any) -> Traversal:  # noqa: N802
        flat = tuple(pairs[0]) if len(pairs) == 1 and isinstance(pairs[0], list) else pairs
        return Traversal((Step("E", flat),), self)

    def addV(self, label: str, name: str = "", **props: Any) -> Traversal:  # noqa: N802
        return Traversal((Step("addV", (label, name), {"props": props}),), self)

    def addE(self, label: str, from_: Any = None, to_: Any = None, **props: Any) -> Traversal:  # noqa: N802
        return Traversal((Step("addE", (label,), {"src": from_, "dst": to_, "props": props}),), self)

    def io(self, path: str):
        from hopwise.sources.files import FileIO

        return FileIO(self.graph, path)

    add_v, add_e = addV, addE
