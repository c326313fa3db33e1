"""Random traversals on random graphs, against a plain evaluator that walks lists of rows."""

import random
from collections import Counter

import pytest

from hopwise.functions import predicates as P
from hopwise.graph import GraphBuilder
from hopwise.plans.traversal import Order, Traversal

A = Traversal()


class Plain:
    """Vertices by id with name, label, age; edges as (src, dst, label, weight)."""

    def __init__(self, nodes, edges):
        self.nodes, self.edges = nodes, edges

    def hop(self, v, way, label):
        out = [d for s, d, x, _ in self.edges if s == v and x == label] if way in ("out", "both") else []
        return out + ([s for s, d, x, _ in self.edges if d == v and x == label] if way in ("in", "both") else [])

    def step(self, rows, op):
        kind, *a = op
        if kind == "hop":
            return [w for v in rows for w in self.hop(v, *a)]
        if kind == "age":
            return [v for v in rows if self.nodes[v]["age"] is not None and self.nodes[v]["age"] > a[0]]
        if kind == "not_age":
            return [v for v in rows if self.nodes[v]["age"] is None or not self.nodes[v]["age"] > a[0]]
        if kind == "label":
            return [v for v in rows if self.nodes[v]["label"] == a[0]]
        if kind == "dedup":
            return list(dict.fromkeys(rows))
        if kind == "some":
            return [v for v in rows if self.run([v], a[0])]
        if kind == "none":
            return [v for v in rows if not self.run([v], a[0])]
        if kind == "more":
            return [v for v in rows if len(self.run([v], a[0])) > a[1]]
        if kind == "union":
            return [w for v in rows for x in a for w in self.run([v], x)]
        if kind == "repeat":
            for _ in range(a[1]):
                rows = self.run(rows, a[0])
            return rows
        if kind == "top":
            return [w for v in rows for w in sorted((w for w in self.run([v], a[0]) if self.nodes[w]["age"] is not None), key=lambda w: (-self.nodes[w]["age"], w))[:1]]
        raise AssertionError(kind)

    def run(self, rows, ops):
        for op in ops:
            rows = self.step(rows, op)
        return rows


def built(t, ops):
    for kind, *a in ops:
        if kind == "hop":
            t = {"out": t.out, "in": t.in_, "both": t.both}[a[0]](a[1])
        elif kind == "age":
            t = t.has("age", P.gt(a[0]))
        elif kind == "not_age":
            t = t.not_(A.values("age").is_(P.gt(a[0])))
        elif kind == "label":
            t = t.has_label(a[0])
        elif kind == "dedup":
            t = t.dedup()
        elif kind == "some":
            t = t.filter_(built(A, a[0]))
        elif kind == "none":
            t = t.not_(built(A, a[0]))
        elif kind == "more":
            t = t.filter_(built(A, a[0]).count().is_(P.gt(a[1])))
        elif kind == "union":
            t = t.union(*[built(A, x) for x in a])
        elif kind == "repeat":
            t = t.repeat(built(A, a[0])).times(a[1])
        elif kind == "top":
            t = t.local(built(A, a[0]).order().by("age", Order.desc).limit(1))
    return t


def ops(r, depth, n):
    simple = lambda: r.choice([("hop", r.choice(["out", "in", "both"]), r.choice("xy")), ("age", r.randrange(50)), ("not_age", r.randrange(50)), ("label", r.choice("AB")), ("dedup",)])
    out = []
    for _ in range(n):
        if depth and r.random() < 0.45:
            inner = [("hop", r.choice(["out", "in"]), r.choice("xy")), *ops(r, depth - 1, r.randrange(2))]
            inner = [o for o in inner if o[0] != "dedup"]
            out.append(r.choice([("some", inner), ("none", inner), ("more", inner, r.randrange(3)), ("union", inner, [("hop", "both", "x")]), ("repeat", inner[:1], r.randrange(1, 3)), ("top", inner[:1])]))
        else:
            out.append(simple())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random(spark, seed):
    r = random.Random(seed)
    b = GraphBuilder()
    nodes = {}
    for i in range(12):
        props = {"age": r.randrange(60)} if r.random() < 0.8 else {}
        label = r.choice("AB")
        nodes[b.add_labeled_node(label, f"n{i}", props)] = {"label": label, "age": props.get("age")}
    edges = {(str(r.randrange(12)), str(r.randrange(12))): (r.choice("xy"), r.random()) for _ in range(30)}
    for (s, d), (label, w) in edges.items():
        b.add_labeled_edge(s, d, label, weight=w)
    plain, g = Plain(nodes, [(s, d, x, w) for (s, d), (x, w) in edges.items()]), b.build(spark).traversal()
    for _ in range(6):
        chosen = ops(r, 2, r.randrange(1, 5))
        assert Counter(built(g.V(), chosen).to_list().run()) == Counter(plain.run(list(nodes), chosen)), chosen
