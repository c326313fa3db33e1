"""Starters of anonymous traversals, predicates and enum members, for `from hopwise.statics import *`."""

from __future__ import annotations

from hopwise.functions import predicates as _p
from hopwise.plans.traversal import Cardinality, Order, Scope, Traversal, _snake

_STEPS = (
    "branch repeat union has has_not has_id has_label has_name has_key has_value contains filter_ simple_path limit skip range dedup and_ or_ not_ is_ out outE outV in_ inE inV both bothE bothV "
    "properties value values key id_ name label select path count min_ max_ mean sum_ element_map as_ until emit order fold identity local side_effect unfold"
).split()
_PREDICATES = (
    "eq neq gt gte lt lte inside between outside within without starting_with not_starting_with ends_with not_ends_with containing not_containing regex not_regex"
).split()


def _starter(name: str):
    def start(*args, **kw):
        return getattr(Traversal(), name)(*args, **kw)

    start.__name__ = name
    return start


def _camel(name: str) -> str:
    head, *rest = name.rstrip("_").split("_")
    return head + "".join(x.capitalize() for x in rest)


_all = {n: _starter(n) for n in _STEPS} | {n: getattr(_p, n) for n in _PREDICATES}
_all |= {_camel(n): f for n, f in list(_all.items()) if "_" in n.rstrip("_")}
_all |= {"desc": Order.desc, "asc": Order.asc, "local_": Scope.local, "global_": Scope.global_, "single": Cardinality.single}
_all |= {"map_": Cardinality.map_, "list_": Cardinality.list_, "set_": Cardinality.set_, "dict_": Cardinality.dict_, "Scope": Scope, "Order": Order, "Cardinality": Cardinality}
globals().update(_all)
__all__ = [n for n in _all if n != "range"]  # noqa: PLE0605


def __getattr__(name: str):
    snake = _snake(name)
    if snake in _all:
        return _all[snake]
    raise AttributeError(name)
