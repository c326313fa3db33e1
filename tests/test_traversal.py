"""Traversals over the small example graphs, against results known from their definition."""

import pytest

from hopwise.errors import GraphTraversalError, QueryError
from hopwise.graph import GraphBuilder
from hopwise.sources.examples import crew, modern
from hopwise.statics import *  # noqa: F403
from hopwise.statics import and_, contains, count, eq, filter_, gt, gte, has, has_id, has_label, has_name, is_, lt, not_, or_, out, outE, properties, regex, select, simple_path, values, within


@pytest.fixture(scope="module")
def graph(spark):
    return modern(spark)


@pytest.fixture()
def g(graph):
    return graph.traversal()


def names(t):
    return sorted(t.to_list(by="name").run())


def test_filters(g):
    people = g.V().has_label("Person")
    assert names(people.within("name", ["marko", "vadas"])) == ["marko", "vadas"]
    assert names(people.has("age", gt(30))) == ["josh", "peter"]
    assert names(g.V().has("age")) == ["josh", "marko", "peter", "vadas"]
    assert names(g.V().has_not("age")) == ["lop", "ripple"]
    assert names(g.V().has("Person", "age", 29)) == ["marko"]
    assert names(g.V().has_id("0", "2")) == ["lop", "marko"]
    assert names(g.V().has_name("josh", "lop")) == ["josh", "lop"]
    assert names(g.V().has("name", regex("[jl]o"))) == ["josh", "lop"]
    assert names(g.V().contains("name", "op")) == ["lop"]
    assert names(g.V().has("age", lambda x: x == 27)) == ["vadas"]
    assert names(g.V().has_label("Per")) == []
    assert names(people.filter_(and_(has_label("Person"), values("age").is_(gte(30))))) == ["josh", "peter"]
    assert names(g.V().filter_(or_(has_name("marko"), has_label("Software")))) == ["lop", "marko", "ripple"]
    assert names(people.filter_(not_(or_(has_name("marko"), has_name("peter"))))) == ["josh", "vadas"]
    assert names(people.not_(out("created"))) == ["vadas"]
    assert names(people.and_(out("created"), out("knows"))) == ["marko"]
    assert names(g.V().or_(out("knows"), has_name("lop"))) == ["lop", "marko"]


def test_hops(g):
    assert names(g.V().has_label("Person").has_name("marko").out("created")) == ["lop"]
    assert names(g.V().has_name("josh").both()) == ["lop", "marko", "ripple"]
    assert names(g.V().out().out()) == ["lop", "ripple"]
    assert sorted(g.V().out().out().values("name").to_list().run()) == sorted(g.V().out().out().properties("name").value().to_list().run())
    assert names(g.V().has_name("lop").in_("created")) == ["josh", "marko", "peter"]
    assert sorted(g.V().has_name("josh").bothE().to_list().run()) == [("0", "3"), ("3", "2"), ("3", "4")]
    assert names(g.E().has_label("knows").bothV()) == ["josh", "marko", "marko", "vadas"]
    assert names(g.V().has_name("lop").inE().outV()) == ["josh", "marko", "peter"]
    assert names(g.V().outE("created").has("weight", lt(0.5)).inV()) == ["lop", "lop", "lop"]
    assert names(g.V().has_label("Person").filter_(values("age").is_(gte(30))).out("created")) == ["lop", "lop", "ripple"]
    assert g.V("3", "0").to_list().run() == ["3", "0"]
    assert g.E([("0", "1")]).to_list().run() == [("0", "1")]
    with pytest.raises(GraphTraversalError):
        g.V("99").to_list().run()
    with pytest.raises(QueryError):
        g.V().values("name").out().to_list().run()


def test_select_and_paths(g):
    assert g.V().out().as_("a").out().select("a", by="name").to_list().run() == ["josh", "josh"]
    assert names(g.V().has_label("Software").as_("a").in_("created").has_name("peter").select("a")) == ["lop"]
    assert sorted(g.V().as_("a").out("knows").as_("b").select("a", "b").by("name").to_list().run()) == [["marko", "josh"], ["marko", "vadas"]]
    paths = g.V().repeat(until=has_name("ripple"), do=out()).as_path(by="name").run()
    assert sorted(paths) == [["josh", "ripple"], ["marko", "josh", "ripple"], ["ripple"]]
    assert names(g.V().repeat(out(), times=2)) == names(g.V().out().out())
    assert names(g.V().has_name("marko").repeat(out()).times(2).emit()) == ["josh", "lop", "lop", "ripple", "vadas"]
    assert names(g.V().has_name("marko").emit().repeat(out()).times(1)) == ["josh", "lop", "marko", "vadas"]
    assert names(g.V().has_name("marko").repeat(out()).until(has_label("Software"))) == ["lop", "lop", "ripple"]
    assert names(g.V().has_name("marko").until(has_name("marko")).repeat(out())) == ["marko"]
    assert ["0", ("0", "3"), "3"] in g.V().has_name("marko").outE().inV().as_path().run()
    assert g.V().has_name("marko").out().in_().simple_path().count().to_list().run() == [2]
    assert names(g.V().repeat(out(), times=0)) == names(g.V())


def test_reducers(g):
    one = lambda t: t.to_list().run()
    assert one(g.V().count()) == [6] and one(g.V().has_name("nobody").count()) == [0]
    assert one(g.V().values("age").sum_()) == [123] and one(g.V().values("age").mean()) == [30.75]
    assert one(g.V().has_name("nobody").values("age").sum_()) == [0] and one(g.V().has_name("nobody").values("age").mean()) == []
    assert one(g.V().as_("a").values("age").max_().select("a", by="name")) == ["peter"]
    assert one(g.V().values("age").min_()) == [27]
    assert one(g.V().values("age").fold()) == [[29, 27, 32, 35]]
    assert one(g.V().values("age").fold(0, lambda a, b: a + b)) == [123]
    assert one(g.V().values("name").count(Scope.local).order()) == [3, 4, 5, 5, 5, 6]  # noqa: F405
    assert one(g.V().values("age").fold().sum_(Scope.local)) == [123]  # noqa: F405
    assert one(g.V().values("age").fold().max_(Scope.local)) == [35]  # noqa: F405
    assert names(g.V().has_label("Person").filter_(outE("created").count().is_(gt(1)))) == ["josh"]
    assert names(g.V().filter_(out("created").count().is_(0))) == ["lop", "ripple", "vadas"]
    assert sorted(g.V().has_label("Person").local(out("created").count()).to_list().run()) == [0, 1, 1, 2]
    with pytest.raises(QueryError):
        g.V().values("name").sum_().to_list().run()


def test_slices_and_order(g):
    people = g.V().has_label("Person")
    assert people.range(1, 3).to_list(by="name").run() == ["vadas", "josh"]
    assert people.skip(2).to_list(by="name").run() == ["josh", "peter"] and people.limit(1).to_list().run() == ["0"]
    assert people.order(by="age", desc=True).to_list(by="name").run() == ["peter", "josh", "marko", "vadas"]
    assert people.order().by("age").limit(2).to_list(by="name").run() == ["vadas", "marko"]
    assert people.order().by(out("created").count(), Order.desc).limit(1).to_list(by="name").run() == ["josh"]  # noqa: F405
    assert g.V().values("name").order(Order.desc).limit(2).to_list().run() == ["vadas", "ripple"]  # noqa: F405
    assert sorted(g.V().out("created").dedup().to_list(by="name").run()) == ["lop", "ripple"]
    assert sorted(g.V().values("lang").dedup().to_list().run()) == ["java"]
    assert g.V().dedup("lang").to_list(by="name").run() == ["lop"]
    assert people.next().run() == "0" and people.next(2).run() == ["0", "1"] and g.V().has_name("x").next().run() is False
    assert g.V().has_next().run() and list(g.V().iter(by="name").run())[0] == "marko"


def test_projections(g):
    assert g.V("0").element_map().to_list().run() == [{"labels": ["Person"], "name": "marko", "age": 29}]
    assert g.V("2").element_map("name", "lang").to_list().run() == [{"name": "lop", "lang": "java"}]
    assert sorted(g.V("0").values().to_list().run()) == ["29", "marko"]
    assert g.V("0").properties("age").to_list().run() == [{"age": 29}]
    assert g.V("0").properties("age", "name").has_key("age").value().to_list().run() == ["29"]
    assert g.V("0").properties("name").has_value("marko").key().to_list().run() == ["name"]
    assert g.V("0").label().to_list().run() == ["Person"] and g.V("0").id_().to_list().run() == ["0"]
    mixed = g.V().branch(values("name")).option("marko", values("age")).option(None, values("name")).to_list().run()
    assert sorted(mixed) == ["29", "josh", "lop", "peter", "ripple", "vadas"]
    assert names(g.V().has_name("marko").union(out("knows"), out("created"))) == ["josh", "lop", "vadas"]
    assert sorted(g.V().has_name("marko").union(out().count(), outE("knows").count()).to_list().run()) == [2, 3]


def test_crew(spark):
    graph = crew(spark)
    g = graph.traversal()
    assert g.E().count().to_list().run() == [9]
    assert len(g.V().has_label("Person").local(out("develops").limit(1).name()).to_list().run()) == 3
    assert g.V().has_name("marko").values(["location", "brussels", "endTime"]).to_list().run() == [2005]
    assert g.V().has_name("daniel").properties("location").count().to_list().run() == [3]
    assert g.E().has("skill", 3).has("since").to_list().run() == [("2", "4")]


def test_shortest_path(spark):
    b = GraphBuilder()
    for i in range(1, 6):
        b.add_labeled_node("node", str(i))
    for s, d in [(1, 2), (2, 4), (4, 5), (2, 3), (3, 4)]:
        b.add_labeled_edge(s - 1, d - 1, "knows")
    g = b.build(spark).traversal()
    t = g.V("0").repeat(out().simple_path()).until(has_id("4")).path().by("name").as_("p").count(Scope.local).as_("length").order().limit(1).select("p", "length")  # noqa: F405
    assert t.to_list().run() == [[["1", "2", "4", "5"], 4]]


def test_constrained_legs(g):
    leg = outE().as_("e").filter_(select("e").values("weight").is_(gte(0.5))).inV().simple_path()
    assert sorted(g.V("0").repeat(leg).times(2).as_path(by="name").run()) == [["marko", None, "josh", None, "ripple"]]
    assert names(g.V().filter_(properties("age").value().is_(gt(30)))) == ["josh", "peter"]
    assert filter_ and has and contains and count and eq and is_ and simple_path and within


def test_mutation(spark):
    graph = modern(spark)
    g = graph.traversal()
    key = g.addV("Person", "john", age=30).next().run()
    assert g.V().count().to_list().run() == [7] and g.V(key).values("age").to_list().run() == [30]
    g.addE("knows").from_(key).to_("0").property("likes", True).iterate().run()
    assert g.E().properties("likes").to_list().run() == [{"likes": True}]
    g.V().has_label("Person").property("City", "Aachen").iterate().run()
    assert g.V().has("City", "Aachen").count().to_list().run() == [5]
    seen = []
    g.V().has_label("Software").values("name").side_effect(lambda x: seen.append(x["val"])).iterate().run()
    assert sorted(seen) == ["lop", "ripple"]


def test_building(g):
    for bad in (lambda: g.V().by("x"), lambda: g.V().to_list().out(), lambda: g.V().option(1, out()), lambda: g.V().times(2), lambda: g.V().has_name(), lambda: out().to_list(), lambda: g.V().order(asc=True, desc=True), lambda: g.V().fold(1), lambda: g.V().dedup("a").by("b")):
        with pytest.raises(QueryError):
            bad()
    t = g.V().hasLabel("Person").outE("created").inV().elementMap()
    assert str(t) == "V().has_label('Person').hopE('out', 'created').end('dst').element_map()" and t.number_of_steps() == 5
    assert sorted(g.V().hasLabel("Software").toList(by="name").run()) == ["lop", "ripple"]


def test_or_of_unlike_branches(g):
    """Branches that read bindings, that only hop, and that look at the row alone, in every pairing."""
    start = g.V().as_("a").out("created").as_("b")
    by_binding, by_hop, by_row = select("a").out("knows"), out("created"), has_name("ripple")
    pairs = lambda cond: sorted(start.or_(*cond).select("a", "b").by("name").to_list().run())
    marko = [["marko", "lop"]]
    assert pairs((by_binding, by_hop)) == pairs((by_hop, by_binding)) == marko
    assert pairs((by_binding, select("a").out("created").has_name("ripple"))) == [["josh", "lop"], ["josh", "ripple"], ["marko", "lop"]]
    assert pairs((by_binding, by_row)) == [["josh", "ripple"], ["marko", "lop"]]
    assert pairs((by_hop, by_row)) == [["josh", "ripple"]]


def test_skip_over_partitions(spark):
    b = GraphBuilder()
    for i in range(200):
        b.add_labeled_node("N", f"n{i}", {"k": (i * 37) % 50})
    g = b.build(spark).traversal()
    want = sorted(range(200), key=lambda i: ((i * 37) % 50, str(i)))  # equal keys: by id
    for a in (0, 1, 60, 199, 200, 500):
        assert g.V().order(by="k").skip(a).to_list().run() == [str(i) for i in want[a:]]
    assert sorted(g.V().skip(190).to_list(by="name").run()) == sorted(f"n{i}" for i in range(190, 200))
