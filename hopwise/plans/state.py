"""What the planner knows of the rows of a traversal: the current element, bindings and what else is carried along."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Elem:
    """kind: vertex, edge, value, property, map, tuple or list. fields: what is known of it, by name, as columns.

    labels: static labels it can have, None if unknown. ends: the same of an edge's two ends. items: the parts of a map
    or tuple, (name, element).
    """

    kind: str
    fields: dict[str, str] = field(default_factory=dict)
    labels: tuple[str, ...] | None = None
    ends: tuple[tuple[str, ...] | None, tuple[str, ...] | None] = (None, None)
    items: tuple[tuple[str, Elem], ...] = ()
    loaded: bool = False

    def columns(self) -> list[str]:
        return [*self.fields.values(), *(c for _, e in self.items for c in e.columns())]


@dataclass(frozen=True)
class State:
    """df is None for a scan that has not begun: all vertices or edges of the element's labels.

    root: the columns that name the row of the parent traversal, in a sub-traversal; roots: gives all of those rows.
    sort: columns and whether they ascend. constant extras: `_path`, `_pb_<key>`, `_ord` and `_bulk`, how many equal rows a row stands for.
    trail: the path as columns: (`vertex`, id, label if ids need one) or (`edge`, src, dst); what lies in `_path` comes before.
    simple: how many elements of the trail are known to differ.
    distinct: the rows are known to stand on different vertices (for each root).
    """

    df: DataFrame | None
    cur: Elem
    binds: dict[str, Elem] = field(default_factory=dict)
    root: tuple[str, ...] = ()
    roots: Callable[[], DataFrame] | None = None
    sort: tuple[tuple[str, bool], ...] = ()
    extras: tuple[str, ...] = ()
    distinct: bool = False
    trail: tuple[tuple, ...] = ()
    simple: int = 0

    def carried(self) -> list[str]:
        steps = [c for kind, a, b in self.trail for c in (a, b if kind == "edge" else b[0] if isinstance(b, tuple) else a)]
        out = [*self.root, *self.extras, *steps, *(c for e in self.binds.values() for c in e.columns()), *(c for c, _ in self.sort)]
        return list(dict.fromkeys(out))
