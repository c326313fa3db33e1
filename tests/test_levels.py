"""What a traversal holds from step to step: rows put together, searches, loops as one query, lazy sub-traversals, hubs, joins by key."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hopwise.errors import GraphTraversalError, QueryError
from hopwise.functions.predicates import gt, lt
from hopwise.graph import EdgeTable, GraphBuilder, GraphConfig, PropertyGraph, VertexTable
from hopwise.plans.planner import Planner
from hopwise.plans.traversal import Traversal

A = Traversal()


def graph_of(spark, edges, n, **config):
    b = GraphBuilder(GraphConfig(multigraph=True, **config))
    for i in range(n):
        b.add_labeled_node("N", f"n{i}", age=i)
    for a, z in edges:
        b.add_labeled_edge(a, z, "to", w=(a * 7 + z) % 5)
    return b.build(spark)


def value(t):
    return t.to_list().run()[0]


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(40)]
    return graph_of(spark, edges, 12), edges


def walks(edges, starts, hops):
    at = Counter(starts)
    for way in hops:
        new = Counter()
        for v, n in at.items():
            for a, z in edges:
                if way in ("out", "both") and a == v:
                    new[z] += n
                if way in ("in", "both") and z == v:
                    new[a] += n
        at = new
    return at


def test_walks_are_counted_without_a_row_for_each(spark):
    full = graph_of(spark, [(a, z) for a in range(6) for z in range(6) if a != z], 6)
    t = full.traversal().V().repeat(A.out("to")).times(12).count()
    assert value(t) == 6 * 5**12
    assert "_bulk" in t.to_df()._jdf.queryExecution().toString()


@pytest.mark.parametrize("hops", [("out", "out"), ("out", "both", "in"), ("both", "in", "out", "out")])
def test_reducers_weigh_rows(some, hops):
    graph, edges = some
    t = graph.traversal().V()
    for way in hops:
        t = getattr(t, {"out": "out", "in": "in_", "both": "both"}[way])("to")
    want = walks(edges, range(12), hops)
    assert value(t.count()) == want.total()
    assert value(t.values("age").sum_()) == sum(v * n for v, n in want.items())
    assert value(t.values("age").mean()) == pytest.approx(sum(v * n for v, n in want.items()) / want.total())
    assert value(t.has("age", gt(5)).count()) == sum(n for v, n in want.items() if v > 5)
    assert sorted(t.dedup().id_().to_list().run(), key=int) == [str(v) for v in sorted(want)]
    assert value(t.dedup().count()) == len(want)
    assert value(t.filter_(A.out("to").out("to").count().is_(gt(9))).count()) == sum(n for v, n in want.items() if walks(edges, [v], ("out", "out")).total() > 9)
    assert len(t.id_().to_list().run()) == want.total()  # without a reducer each row stays
    assert value(graph.traversal().V().has("age", -1).out("to").out("to").count()) == 0


def met(edges, starts, rounds):
    seen, at = set(), set(starts)
    for _ in range(rounds):
        at = {z for a, z in edges if a in at} - seen
        seen |= at
    return seen


def test_search_goes_on_from_new_vertices_only(some):
    graph, edges = some
    loop = graph.traversal().V().has("age", lt(2)).repeat(A.out("to"))
    for rounds in (0, 1, 3, 50):
        p = Planner(graph, loop.times(rounds).emit().dedup().id_().steps)
        assert {int(r[0]) for r in p.frame().collect()} == met(edges, [0, 1], rounds)
        assert sum(p.rounds) <= 12 and len(p.rounds) <= 13
    two = graph.traversal().V().has("age", lt(2)).repeat(A.out("to").out("to")).times(9).emit().dedup()
    pairs = [(a, z) for a, m in edges for n, z in edges if m == n]
    assert {int(x) for x in two.to_list().run()} == met(pairs, [0, 1], 9)
    assert {int(x) for x in graph.traversal().V().has("age", lt(2)).emit().repeat(A.out("to")).times(1).dedup().to_list().run()} == {0, 1} | met(edges, [0, 1], 1)
    assert {int(x) for x in loop.times(4).emit(A.has("age", gt(6))).dedup().to_list().run()} == {v for v in met(edges, [0, 1], 4) if v > 6}
    light = [(a, z) for a, z in edges if (a * 7 + z) % 5 < 3]
    leg = A.outE("to").as_("e").inV().filter_(A.select("e").values("w").is_(lt(3)))
    assert {int(x) for x in graph.traversal().V().has("age", 0).repeat(leg).times(5).emit().dedup().to_list().run()} == met(light, [0], 5)
    inside = graph.traversal().V().filter_(A.repeat(A.out("to")).times(2).emit().dedup().count().is_(gt(6)))
    assert {int(x) for x in inside.to_list().run()} == {v for v in range(12) if len(met(edges, [v], 2)) > 6}


def test_search_ends_where_until_holds(some):
    graph, edges = some
    found = graph.traversal().V().has("age", 0).repeat(A.out("to")).until(A.has("age", gt(8))).emit().dedup()
    seen, at = set(), {0}
    while at := {z for a, z in edges if a in at} - seen:
        seen |= at
        at = {v for v in at if v <= 8}
    assert {int(x) for x in found.to_list().run()} == seen


def test_loops_are_one_recursive_query(spark):
    # vertex 0 leads to itself: such walks have no end
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT_EXCEEDED"):
        graph_of(spark, [(0, 0), (0, 1)], 2, most_rounds=5).traversal().V().repeat(A.out("to")).until(A.has("age", 1)).to_list().run()
    line = graph_of(spark, [(i, i + 1) for i in range(9)] + [(0, 5)], 10)
    t = line.traversal().V().has("age", lt(2)).as_("a").repeat(A.out("to")).until(A.has("age", gt(5))).as_("b").select("a", "b")
    df = t.to_df()
    assert "UnionLoop" in df._jdf.queryExecution().toString()
    assert sorted(map(tuple, df.collect())) == [("0", "6"), ("0", "6"), ("1", "6")]
    times = line.traversal().V().has("age", 0).repeat(A.out("to"), times=2, until=A.has("age", gt(5)))
    assert times.to_list().run() == ["6"]
    first = line.traversal().V().until(A.not_(A.out("to"))).repeat(A.out("to"))
    assert first.to_list().run() == ["9"] * 11
    assert line.traversal().V().has("age", 9).until(A.has("age", 9)).repeat(A.out("to")).to_list().run() == ["9"]


def test_rounds_have_an_end(spark):
    ring = graph_of(spark, [(0, 1), (1, 0)], 2, most_rounds=3).traversal()
    with pytest.raises(GraphTraversalError, match="3 rounds"):
        ring.V().repeat(A.out("to").in_("to").out("to")).until(A.has("age", 7)).to_list().run()
    with pytest.raises(QueryError):
        ring.V().order(by="age", asc=True, desc=True)
    with pytest.raises(QueryError):
        ring.V().repeat(A.out("to")).to_list().run()


def test_sub_traversals_that_read_bindings_start_no_job(spark, some):
    graph, edges = some
    g = graph.traversal()
    made = [
        g.V().as_("a").out("to").filter_(A.select("a").out("to").has("age", gt(6))),
        g.V().as_("a").out("to").as_("b").or_(A.select("a").out("to").has("age", gt(9)), A.has("age", 0)),
        g.V().as_("a").out("to").not_(A.select("a").in_("to")),
    ]
    sc = spark.sparkContext
    sc.setJobGroup("building", "")
    frames = [t.to_df() for t in made]
    assert not sc.statusTracker().getJobIdsForGroup("building")
    sc.setLocalProperty("spark.jobGroup.id", None)
    goes = lambda v, least: any(a == v and z > least for a, z in edges)
    enters = {z for _, z in edges}
    assert sorted(int(r[0]) for r in frames[0].collect()) == sorted(z for a, z in edges if goes(a, 6))
    assert sorted(int(r[0]) for r in frames[1].collect()) == sorted(z for a, z in edges if goes(a, 9) or z == 0)
    assert sorted(int(r[0]) for r in frames[2].collect()) == sorted(z for a, z in edges if a not in enters)
    counted = g.V().as_("a").out("to").as_("b").local(A.select("a").out("to").count()).as_("n").select("a", "b", "n").to_df()
    assert sorted(tuple(map(int, r)) for r in counted.collect()) == sorted((a, z, sum(x == a for x, _ in edges)) for a, z in edges)


def test_hubs_are_spread(spark):
    n = 4000
    v = spark.range(200).selectExpr("id", "concat('n', id) as name", "array('N') as labels", "id as _seq", "id % 3 as kind")
    e = spark.range(n).selectExpr("if(id % 10 > 0, 7, id % 200) as src", "id % 200 as dst", "id as eid", "id as _seq")
    plain = PropertyGraph(spark, [VertexTable(v, "N")], [EdgeTable(e, "to", "N", "N")], GraphConfig(multigraph=True))
    spread = plain.spread("to")
    assert dict(spread.edges[0].hubs)["src"].keys() == {7} and "dst" not in dict(spread.edges[0].hubs)
    assert plain.spread("other").edges[0].hubs == ()
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, x in zip(held, ("-1", "false", "8"), strict=True):
            spark.conf.set(k, x)
        both = []
        for graph in (plain, spread):
            df = graph.traversal().V().has("kind").as_("a").out("to").as_("b").select("a", "b").to_df()
            sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            both.append((Counter(map(tuple, df.collect())), max(sizes), statistics.median(sizes)))
    finally:
        for k, x in held.items():
            spark.conf.set(k, x)
    assert both[0][0] == both[1][0] and both[0][0].total() == n
    assert both[0][1] > 0.9 * n - n / 8
    assert both[1][1] <= 3 * both[1][2]


def test_joins_by_key_never_list_pairs(spark):
    rng = random.Random(4)
    a, b = [(i, rng.choice([1, 2, 3, None])) for i in range(30)], [(i, rng.choice([1, 2, 4, None])) for i in range(20)]
    table = lambda rows, label: VertexTable(spark.createDataFrame([(i, f"{label}{i}", [label], i, k) for i, k in rows], "id long, name string, labels array<string>, _seq long, k long"), label)
    graph = PropertyGraph(spark, [table(a, "A"), table(b, "B")], [], GraphConfig(multigraph=True))
    graph.join("A", "B", "k", "k", "like")
    pairs = [(i, j) for i, k in a for j, m in b if k is not None and k == m]
    g = graph.traversal()
    count = g.V().has_label("A").out("like").count().to_df("n")
    assert count.collect()[0][0] == len(pairs)
    assert "src#" not in count._jdf.queryExecution().toString()
    assert sorted(map(tuple, g.E().has_label("like").to_df("a", "b", "l").drop("l").collect())) == sorted(pairs)
    assert sorted(r[0] for r in g.V().has_label("A").out("like").to_df("id").collect()) == sorted(j for _, j in pairs)
    assert sorted(r[0] for r in g.V().has_label("A").has_id(lt(5)).out("like").dedup().to_df("id").collect()) == sorted({j for i, j in pairs if i < 5})
    back = Counter(j for _, j in pairs)
    assert g.V().has_label("A").out("like").in_("like").count().to_df("n").collect()[0][0] == sum(n * n for n in back.values())
    few = g.V().has_label("B").filter_(A.in_("like").count().is_(gt(8))).to_df("id")
    assert sorted(r[0] for r in few.collect()) == sorted(j for j, n in back.items() if n > 8)
    none = g.V().has_label("B").filter_(A.in_("like").count().is_(0)).to_df("id")
    assert sorted(r[0] for r in none.collect()) == sorted(j for j, _ in b if j not in back)
