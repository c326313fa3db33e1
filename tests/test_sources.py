"""Graphs from files and tables, graph changes, exports and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from hopwise.errors import GraphError
from hopwise.graph import GraphBuilder, GraphConfig
from hopwise.schema import GraphSchema
from hopwise.sources import files, jsonfiles, rdf
from hopwise.sources.examples import crew, modern
from hopwise.sources.graphml import read_graphml, write_graphml
from hopwise.streaming import edges as streams

GRAPHML = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="d0" for="node" attr.name="color" attr.type="string"><default>yellow</default></key>
<key id="d1" for="edge" attr.name="weight" attr.type="double"/>
<graph id="G" edgedefault="directed">
<node id="n0"><data key="d0">green</data></node><node id="n1"/><node id="n2"><data key="d0">blue</data></node>
<edge id="e0" source="n0" target="n2"><data key="d1">1.5</data></edge><edge id="e1" source="n0" target="n1"/>
</graph></graphml>"""


def test_graphml(spark, tmp_path):
    path = tmp_path / "g.graphml"
    path.write_text(GRAPHML)
    graph = read_graphml(spark, str(path), node_name_key="color", node_label_key=lambda d: "Dark" if d.get("color") == "blue" else "Light", include_id=True)
    rows = graph.all_vertices().orderBy("_seq").collect()
    assert [(r["id"], r["name"], r["labels"], r["original_id"]) for r in rows] == [("0", "green", ["Light"], "n0"), ("1", "yellow", ["Light"], "n1"), ("2", "blue", ["Dark"], "n2")]
    assert [tuple(r) for r in graph.all_edges().orderBy("dst").select("src", "dst", "weight").collect()] == [("0", "1", None), ("0", "2", 1.5)]
    path.write_text(GRAPHML.replace('"directed"', '"undirected"'))
    with pytest.raises(GraphError):
        read_graphml(spark, str(path))


def test_graphml_round_trip(spark, tmp_path):
    path = str(tmp_path / "modern.graphml")
    write_graphml(modern(spark), path)
    g = read_graphml(spark, path, edge_label_key="labelE", keep=False).traversal()
    assert sorted(g.V().has_label("Person").has_name("marko").out("created").to_list(by="name").run()) == ["lop"]
    assert g.V().values("age").sum_().to_list().run() == [123] and g.E().count().to_list().run() == [6]


def test_graphson_round_trip(spark, tmp_path):
    path = str(tmp_path / "m.json")
    modern(spark).traversal().io(path).write()
    g = jsonfiles.read_graphson(spark, path).traversal()
    assert sorted(g.V().has_name("josh").out("created").to_list(by="name").run()) == ["lop", "ripple"]
    assert g.E().values("weight").sum_().to_list().run() == [3.5]
    wrapped = tmp_path / "w.json"
    wrapped.write_text(json.dumps({"vertices": [{"id": 1, "label": "a", "properties": {"name": [{"id": 0, "value": "x"}]}, "outE": {"to": [{"id": 7, "inV": 2}]}}, {"id": {"@type": "g:Int32", "@value": 2}, "label": "a"}]}))
    assert jsonfiles.read_graphson(spark, str(wrapped)).traversal().V().has_name("x").out("to").to_list().run() == ["2"]


def test_json(spark, tmp_path):
    path = tmp_path / "menu.json"
    path.write_text('{"menu": {"food": [{"name": "waffle", "price": 5}, {"name": "toast"}]}}')
    graph = jsonfiles.read_json_tree(spark, str(path))
    g = graph.traversal()
    assert g.V().has_label("Leaf").count().to_list().run() == [3] and g.E().count().to_list().run() == [7]
    assert sorted(g.V().has_name("food").out("has_item").to_list(by="name").run()) == ["item_0", "item_1"]
    lines = tmp_path / "people.jsonl"
    lines.write_text('{"id": "p1", "name": "Ann"}\nnonsense\n{"name": "Bob"}\n')
    graph, bad = jsonfiles.read_json_lines(spark, str(lines))
    assert [r[0] for r in bad.collect()] == ["nonsense"]
    assert sorted(graph.traversal().V().has_label("people").to_list(by="name").run()) == ["Ann", "Bob"]


def test_folder(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    for name in ("x.txt", "a/y.py", "a/b/z.py", ".git/config"):
        (tmp_path / name).write_text("12345")
    g = files.read_folder(spark, str(tmp_path)).traversal()
    assert sorted(g.V().has_label("File").to_list(by="name").run()) == ["x.txt", "y.py", "z.py"]
    assert sorted(g.V().has_label("Directory").has_name("a").both().to_list(by="name").run()) == sorted(["b", "y.py", tmp_path.name])
    assert g.V().has("extension", "py").values("size").sum_().to_list().run() == [10]
    (tmp_path / "a" / "d.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj 2 0 obj <</Title (Chapter 1)>> endobj")
    g = files.read_folder(spark, str(tmp_path), unfold=True).traversal()
    assert g.V().has_name("a").out("HAS_FILE").has("extension", "pdf").out("HAS_CONTENT").values("title").to_list().run() == ["Chapter 1"]


def test_schema(spark, tmp_path):
    path = tmp_path / "s.yaml"
    path.write_text("node_id_type_name: str\nnode_type_configs:\n  Person:\n    label: Person\n    key_field: name\n    display_order: 2\n  Software:\n    label: Software\n    display_order: 1\n    other: x\n")
    schema = GraphSchema.load(str(path))
    schema.save(str(path))
    assert GraphSchema.load(str(path)) == schema and [t.label for t in schema.ordered()] == ["Software", "Person"]
    table = schema.node_table(modern(spark), "Person")
    assert table.columns == ["name", "id", "age"] and table.count() == 4 and schema.of_labels(["Person", "x"]).key_field == "name"
    with pytest.raises(GraphError):
        schema.node_table(modern(spark), "Robot")


def test_office(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="http://r"><sheets><sheet name="one" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>head</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B2"><v>4.5</v></c></row></sheetData></worksheet>')
    with zipfile.ZipFile(tmp_path / "p.pptx", "w") as z:
        z.writestr("docProps/core.xml", "<core><title>Deck</title><creator>Ann</creator></core>")
        z.writestr("ppt/slides/slide1.xml", '<s><sp><ph type="title"/><p><t>Hello</t></p></sp><sp><p><t>Body</t></p></sp></s>')
        z.writestr("ppt/slides/slide2.xml", "<s/>")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Type /Pages>> endobj 2 0 obj <</Type /Page>> endobj 3 0 obj <</Title (Chapter 1)>> endobj")
    cells = files.xlsx_cells(spark, str(tmp_path / "w.xlsx")).select("sheet", "column", "row", "value").collect()
    assert [tuple(r) for r in cells] == [("one", "A", 1, "head"), ("one", "B", 2, "4.5")]
    assert files.read_xlsx(spark, str(tmp_path / "w.xlsx")).traversal().V().has_label("EXCELFile").out("HAS_SHEET").to_list(by="name").run() == ["one"]
    slides = files.pptx_slides(spark, str(tmp_path / "p.pptx")).orderBy("page").collect()
    assert [(r["name"], r["text"], r["author"]) for r in slides] == [("Hello", ["Hello", "Body"], "Ann"), ("page2", [], "Ann")]
    assert files.read_pptx(spark, str(tmp_path / "p.pptx")).traversal().V().has_label("PPPage").count().to_list().run() == [2]
    assert files.pdf_titles(spark, str(tmp_path / "d.pdf")).select("pages", "title").collect() == [(1, "Chapter 1")]


def test_registry_and_io(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    (tmp_path / "graphs.yaml").write_text("configs:\n  modern:\n    name: modern\n    custom_loader: modern\n  small:\n    name: small\n    file_path: g.graphml\n    node_name_key: color\n")
    graphs = files.Graphs(spark, str(tmp_path / "graphs.yaml"))
    assert graphs.get("small").traversal().V().count().to_list().run() == [3]
    assert graphs.get("modern") is graphs.get("modern")
    with pytest.raises(GraphError):
        graphs.get("other")
    empty = GraphBuilder().build(spark)
    assert empty.traversal().io(str(tmp_path / "g.graphml")).with_("node_name_key", "color").read().traversal().V().has_name("blue").count().to_list().run() == [1]


def test_building(spark):
    b = GraphBuilder()
    b.add_labeled_node({"Character", "Dwarf"}, "Gimli", {"Age": 139})
    b.add_labeled_node("Elf", "Legolas")
    b.add_labeled_edge(0, 1, "Friend", since=1)
    b.add_labeled_edge(0, 1, "Besties", until=2)
    b.add_node(7, weight=3)
    g = b.build(spark).traversal()
    assert g.V().has_label({"Character", "Dwarf"}).to_list(by="name").run() == ["Gimli"]
    assert g.E().element_map().to_list().run() == [{"labels": "Besties", "since": 1, "until": 2}]
    assert g.V("7").label().to_list().run() == ["Node"]
    for bad in (lambda: b.add_labeled_edge(0, 99, "x"), lambda: b.add_labeled_node("a", "b", {"name": 1}), lambda: b.add_labeled_node("a", "b", {"labels": 1}), lambda: b.add_labeled_edge(0, 1, "x", labels=2)):
        with pytest.raises(GraphError):
            bad()
    multi = GraphBuilder(GraphConfig(multigraph=True))
    for n in "ab":
        multi.add_labeled_node("x", n)
    multi.add_labeled_edge(0, 1, "e")
    multi.add_labeled_edge(0, 1, "e")
    assert multi.build(spark).traversal().E().count().to_list().run() == [2]


def test_merge_join_quads(spark):
    one, two = GraphBuilder(), GraphBuilder()
    one.add_labeled_node("Hobbit", "Frodo")
    two.add_labeled_node("Hobbit", "Sam")
    two.add_labeled_node("Pony", "Bill")
    two.add_labeled_edge(0, 1, "leads")
    merged = one.build(spark).merge(two.build(spark), "0", "0", "Guide")
    assert merged.traversal().V("0").out("Guide").out("leads").to_list(by="name").run() == ["Bill"]
    graph = modern(spark)
    graph.join("Person", "Person", "age", "age", "same_age")
    assert graph.traversal().E().has_label("same_age").count().to_list().run() == [0]
    graph.join("Software", "Software", "lang", "lang", "same_lang")
    assert sorted(graph.traversal().E().has_label("same_lang").to_list().run()) == [("2", "4"), ("4", "2")]
    found = {r["key"]: r["found"] for r in modern(spark).lookup("P", "O").collect()}
    assert found["lang"] == ["java"] and found["created"] == ["2", "4"]
    assert "| vertex | Person | 4 |" in modern(spark).summary_text() and "class=" in modern(spark).summary_text(style="mediawiki")
    assert '"0" -> "1" [label="knows"];' in modern(spark).dot()
    assert modern(spark).get_nodes("Person", "josh").count() == 1


def test_rdf(spark):
    lines = [r[0] for r in rdf.ntriples(rdf.triples(modern(spark))).collect()]
    assert '<http://example.org/0> <http://example.org/age> "29"^^<http://www.w3.org/2001/XMLSchema#integer> .' in lines
    assert "<http://example.org/0> <http://example.org/knows> <http://example.org/1> ." in lines and len(lines) == 6 * 3 + 6
    assert rdf.triples(crew(spark)).where(F.col("p").endswith("location")).count() == 0


def test_streams(spark, tmp_path):
    rows = [("a", "b", "2024-01-01 00:00:00"), ("a", "b", "2024-01-01 00:01:00"), ("a", "c", "2024-01-01 01:30:00")]
    spark.createDataFrame(rows, "src string, dst string, ts string").select("src", "dst", F.to_timestamp("ts").alias("ts")).write.parquet(str(tmp_path / "in"))

    def result(name, make, mode="append"):
        stream = spark.readStream.schema("src string, dst string, ts timestamp").parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name).collect()

    assert sorted((r["src"], r["dst"]) for r in result("fresh", streams.fresh_edges)) == [("a", "b"), ("a", "c")]
    assert sorted(r["n"] for r in result("deg", streams.degrees, "complete")) == [1, 2]
    static = spark.createDataFrame([("b", "z")], "src string, dst string")
    assert {r["next"] for r in result("hop", lambda s: streams.hop(s, static))} == {"z"}


def test_json_trees(spark, tmp_path):
    docs = {"a.json": '{"x": {"y": [1, 2.5, "t", null, true, {}]}, "b.c": []}', "sub/b.json": '[{"x": "deep"}]', "bad.json": "{not json"}
    (tmp_path / "sub").mkdir()
    for name, text in docs.items():
        (tmp_path / name).write_text(text)
    graph = jsonfiles.read_json_tree(spark, str(tmp_path))
    rows = {r["id"].rsplit("/", 1)[-1]: (r["name"], r["labels"][0], r["type"], r["value"]) for r in graph.vertices[0].df.collect()}
    at = lambda *place: rows[place[0] + (":" + ".".join(map(str, place[1:])) if len(place) > 1 else "")]
    assert at("a.json") == ("root", "Node", "dict", None) and at("bad.json") == ("root", "Leaf", "invalid", "{not json")
    leaves = [at("a.json", 1, 0, i) for i in range(6)]
    assert leaves == [("item_0", "Leaf", "int", "1"), ("item_1", "Leaf", "float", "2.5"), ("item_2", "Leaf", "str", "t"), ("item_3", "Leaf", "NoneType", None), ("item_4", "Leaf", "bool", "True"), ("item_5", "Node", "dict", None)]
    assert at("a.json", 0) == ("b.c", "Node", "list", None) and at("b.json", 0, 0) == ("x", "Leaf", "str", "deep")
    assert len(rows) == 3 + 9 + 2
    g = graph.traversal()
    assert g.V().has("value", "deep").in_("has_x").in_("has_item").values("type").to_list().run() == ["list"]
    assert sorted(e.label for e in graph.edges) == ["has_b.c", "has_item", "has_x", "has_y"]
    lines = tmp_path / "lines.jsonl"
    lines.write_text('{"k": 1}\n\n{"k": 2}\n7\n')
    tree = jsonfiles.read_json_tree(spark, str(lines), lines=True).traversal()
    assert sorted(tree.V().has_name("k").values("value").to_list().run()) == ["1", "2"] and tree.V().has_name("root").count().to_list().run() == [3]


def test_id_index(spark):
    from hopwise.graph import EdgeTable, GraphConfig, PropertyGraph, VertexTable

    table = lambda label, ids: VertexTable(spark.createDataFrame([(i, f"{label}{i}", [label], k) for k, i in enumerate(ids)], "id long, name string, labels array<string>, _seq long"), label)
    even, odd, none = table("even", range(0, 4000, 2)), table("odd", range(1, 4000, 2)), table("none", [])
    edges = EdgeTable(spark.createDataFrame([(2, 3, 0, 0)], "src long, dst long, eid long, _seq long"), "to", "even", "odd")
    graph = PropertyGraph(spark, [even, odd, none], [edges], GraphConfig(multigraph=True)).indexed()
    named = lambda ids: [t.label for t in graph.index.holding(graph.vertices, ids)]
    assert all("even" in named([i]) for i in (0, 2, 1998, 3998)) and all("odd" in named([i]) for i in (1, 1999, 3999))
    wrong = sum(len(named([i])) - 1 for i in range(40))
    assert wrong <= 4 and named([-5]) == [] == named([10**6]) and named(["2"]) == []
    assert named([2, 3]) == ["even", "odd"]
    g = graph.traversal()
    assert g.V(3, 2).values("name").to_list().run() == ["odd3", "even2"]
    assert g.V().has_id(3).values("name").to_list().run() == ["odd3"] and g.V(2).out("to").to_list().run() == [3]
    plan = g.V().has_id(2).to_df()._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    for lost in (-1, 10**7):
        with pytest.raises(Exception, match="no vertex has the id"):
            g.V(lost).to_list().run()
    g.addV("none", "new", id=9001).iterate().run()
    assert g.V(9001).values("name").to_list().run() == ["new"]


def test_turtle(spark):
    from hopwise.graph import GraphBuilder
    from hopwise.sources.rdf import turtle

    b = GraphBuilder()
    b.add_labeled_node("Person", 'A "q"\\', node_id="a", age=3)
    b.add_labeled_node("Person", "B", node_id="b 1")
    b.add_labeled_edge("a", "b 1", "knows")
    rows = turtle(b.build(spark), prefixes={"ex": "http://example.org/"}).collect()
    assert sorted(r["value"] for r in rows if r["head"]) == ["@prefix ex: <http://example.org/> .", "@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .", "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> ."]
    said = {r["value"].split(" ")[0]: r["value"] for r in rows if not r["head"]}
    assert said["ex:a"] == 'ex:a ex:age "3"^^xsd:integer ;\n    ex:knows <http://example.org/b_1> ;\n    ex:name "A \\"q\\"\\\\" ;\n    rdf:type ex:Person .'
    assert said["<http://example.org/b_1>"].endswith('ex:name "B" ;\n    rdf:type ex:Person .')


def test_last_states_are_compacted(spark, tmp_path):
    from hopwise.streaming.edges import latest

    for i in range(5):
        spark.createDataFrame([(k, i) for k in range(i, 5)], "id long, v long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, v long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counted = stream.groupBy("id").count()
    for every in (2, 100):
        found = latest(counted, ["id"], ["count"], every=every)
        assert sorted(map(tuple, found.collect())) == [(k, k + 1) for k in range(5)]
        folders = {f.rsplit("/", 2)[-2] for f in found.inputFiles()}
        assert len(folders) == 1 if every == 2 else len(folders) >= 5
