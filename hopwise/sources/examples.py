"""Small example graphs."""

from __future__ import annotations

from pyspark.sql import SparkSession

from hopwise.graph import GraphBuilder, PropertyGraph


def modern(spark: SparkSession) -> PropertyGraph:
    """Six people and programs."""
    b = GraphBuilder()
    # Fixed values of the public example graph.
    for label, name, props in [("Person", "marko", {"age": 29}), ("Person", "vadas", {"age": 27}), ("Software", "lop", {"lang": "java"}), ("Person", "josh", {"age": 32}), ("Software", "ripple", {"lang": "java"}), ("Person", "peter", {"age": 35})]:
        b.add_labeled_node(label, name, props)
    for src, dst, label, weight in [(0, 1, "knows", 0.5), (0, 3, "knows", 1.0), (0, 2, "created", 0.4), (3, 4, "created", 1.0), (3, 2, "created", 0.4), (5, 2, "created", 0.2)]:
        b.add_labeled_edge(src, dst, label, weight=weight)
    return b.build(spark)


def crew(spark: SparkSession) -> PropertyGraph:
    """Four people, where they lived, and the software they develop or use."""
    b = GraphBuilder()
    # Fixed values of the public example graph.
    places = {
        "marko": {"san diego": (1997, 2001), "santa cruz": (2001, 2004), "brussels": (2004, 2005), "santa fe": (2005, None)},
        "stephen": {"centreville": (1990, 2000), "dulles": (2000, 2006), "purcellville": (2006, None)},
        "matthias": {"bremen": (2004, 2007), "baltimore": (2007, 2011), "oakland": (2011, 2014), "seattle": (2014, None)},
        "daniel": {"spremberg": (1982, 2005), "kaiserslautern": (2005, 2009), "aachen": (2009, None)},
    }
    skills = [
        ("marko", "develops", "gremlin", {"since": 2009}), ("marko", "develops", "tinkergraph", {"since": 2010}), ("marko", "uses", "gremlin", {"skill": 4}), ("marko", "uses", "tinkergraph", {"skill": 5}),
        ("stephen", "develops", "gremlin", {"since": 2010}), ("stephen", "develops", "tinkergraph", {"since": 2011}), ("stephen", "uses", "gremlin", {"skill": 5}), ("stephen", "uses", "tinkergraph", {"skill": 4}),
        ("matthias", "develops", "gremlin", {"since": 2012}), ("matthias", "uses", "gremlin", {"skill": 3}), ("matthias", "uses", "tinkergraph", {"skill": 3}),
        ("daniel", "uses", "gremlin", {"skill": 5}), ("daniel", "uses", "tinkergraph", {"skill": 3}), ("gremlin", "traverses", "tinkergraph", {}),
    ]
    ids = {n: b.add_labeled_node("Person", n, {"location": {p: {"startTime": s} | ({"endTime": e} if e else {}) for p, (s, e) in lived.items()}}) for n, lived in places.items()}
    ids |= {n: b.add_labeled_node("Software", n) for n in ("gremlin", "tinkergraph")}
    # one edge for each pair: the last label stays, so the uses come first where both are known
    for src, label, dst, props in sorted(skills, key=lambda x: x[1] == "develops"):
        b.add_labeled_edge(ids[src], ids[dst], label, props)
    return b.build(spark)
