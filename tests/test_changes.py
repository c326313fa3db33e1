"""Changes of a graph: kept apart from its tables, merged on reading, written into them after some number."""

import random

import pytest

from hopwise import graph as graphs
from hopwise.graph import GraphBuilder, GraphConfig
from hopwise.plans.traversal import Cardinality, Traversal

A = Traversal()


def chain(spark, n=6):
    b = GraphBuilder(GraphConfig(multigraph=True))
    for i in range(n):
        b.add_labeled_node("N", f"n{i}", age=i, tags=["a"] if i % 2 else None)
    for i in range(n - 1):
        b.add_labeled_edge(i, i + 1, "to", w=i)
    return b.build(spark)


@pytest.mark.parametrize("most", [2, 64])
def test_changes_add_up(spark, monkeypatch, most):
    monkeypatch.setattr(graphs, "MOST_CHANGES", most)
    graph, rng = chain(spark), random.Random(most)
    plain = [{"age": i, "tags": ["a"] if i % 2 else None, "seen": None} for i in range(6)]
    for k in range(14):
        ids = rng.sample(range(6), rng.randrange(4))
        kind = rng.choice(["age", "seen", "list", "set"])
        t = graph.traversal().V().has_id(*[str(i) for i in ids]) if ids else graph.traversal().V().has("age", -1)
        if kind in ("list", "set"):
            value = rng.choice("abc")
            t.property(Cardinality.list_ if kind == "list" else Cardinality.set_, "tags", value).iterate().run()
            for i in ids:
                have = plain[i]["tags"] or []
                plain[i]["tags"] = [*have, value] if kind == "list" else [*dict.fromkeys([*have, value])]
        else:
            t.property(kind, k).iterate().run()
            for i in ids:
                plain[i][kind] = k
    rows = {r["id"]: r.asDict() for r in graph.vertices[0].df.collect()}
    assert [{c: rows[str(i)].get(c) for c in plain[i]} for i in range(6)] == plain


def test_changes_of_edges_maps_and_labels(spark):
    graph = chain(spark)
    g = graph.traversal()
    g.V().has_id("1").outE("to").property("w", 70).iterate().run()
    g.V().has_id("1", "2").outE("to").property("w", 80).iterate().run()
    assert sorted(g.E().values("w").to_list().run()) == [0, 3, 4, 80, 80]
    g.V().has_id("2").property(Cardinality.map_, "facts", 5).iterate().run()
    g.V().has_id("2").property(["facts", "more"], 6).iterate().run()
    assert g.V().has(["facts", "more"], 6).to_list().run() == ["2"] and g.V().has(["facts", "facts"], 5).to_list().run() == ["2"]
    g.V().has_id("3").property(Cardinality.label, "M").iterate().run()
    assert g.V().has_label("M").to_list().run() == ["3"] and len(g.V().has_label("N").to_list().run()) == 6
    assert g.V().has("age", 4).property("age", 40).has("age", 40).to_list().run() == ["4"]


def test_a_plan_keeps_what_it_was_made_from(spark):
    graph = chain(spark)
    before = graph.traversal().V().values("age").to_df("age")
    graph.traversal().V().property("age", 9).iterate().run()
    assert sorted(r[0] for r in before.collect()) == [0, 1, 2, 3, 4, 5]
    assert graph.traversal().V().values("age").to_list().run() == [9] * 6


@pytest.mark.parametrize("most", [1, 1000])
def test_additions(spark, monkeypatch, most):
    monkeypatch.setattr(graphs, "MOST_ADDED", most)
    graph = chain(spark)
    g = graph.traversal()
    keys = [g.addV("N", f"more{i}", age=10 + i).next().run() for i in range(3)]
    assert keys == ["6", "7", "8"]
    g.V().has_id("7").property("age", 99).iterate().run()
    g.addV("N", "last", age="old").iterate().run()
    assert sorted(map(str, g.V().values("age").to_list().run())) == sorted(["0", "1", "2", "3", "4", "5", "10", "99", "12", "old"])
    for a, b in (("6", "7"), ("6", "7"), ("7", "0")):
        g.addE("near").from_(a).to_(b).property("w", 1).iterate().run()
    assert g.V().has_id("6").out("near").out("near").to_list().run() == ["0", "0"]
    assert g.V().out("near").count().to_list().run() == [3]
