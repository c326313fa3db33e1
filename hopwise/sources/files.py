"""Files as graphs: a folder tree, workbooks, slides and PDF outlines; `io`; the registry of named graphs."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopwise.errors import GraphError
from hopwise.graph import EdgeTable, GraphBuilder, GraphConfig, PropertyGraph, VertexTable, aligned
from hopwise.sources import examples
from hopwise.sources.graphml import read_graphml, write_graphml
from hopwise.sources.jsonfiles import graphson_lines, read_graphson, read_json_tree


def read_folder(spark: SparkSession, root: str, ignored: tuple[str, ...] = (".git", "__pycache__"), unfold: bool = False) -> PropertyGraph:
    """Directories and files under a folder, with HAS_FOLDER and HAS_FILE edges; ids are paths.

    Contents are only read with `unfold`: workbooks, presentations and PDF files then have their sheets, slides and titles as well.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    base = re.sub(r"^file:/*", "/", str(root)).rstrip("/") if "://" not in str(root) or str(root).startswith("file:") else str(root).rstrip("/")
    plain = F.regexp_replace("path", "^file:/*", "/")
    parts = F.split(F.substring(F.col("p"), F.lit(len(base) + 2), F.length("p")), "/")
    files = files.withColumn("p", plain).withColumn("parts", parts).where(~F.arrays_overlap("parts", F.array(*[F.lit(x) for x in ignored])))
    above = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.concat_ws("/", F.lit(base), F.array_join(F.slice(F.col("parts"), 1, i), "/")))
    folders = files.select(F.explode(above).alias("p")).select(F.rtrim(F.col("p"), F.lit("/")).alias("p")).distinct()
    name = F.element_at(F.split("p", "/"), -1)
    parent = F.regexp_extract("p", "^(.*)/[^/]*$", 1)
    seq = F.xxhash64("p")
    v = folders.select(F.col("p").alias("id"), name.alias("name"), F.array(F.lit("Directory")).alias("labels"), seq.alias("_seq"))
    f = files.select(F.col("p").alias("id"), name.alias("name"), F.array(F.lit("File")).alias("labels"), seq.alias("_seq"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract("p", r"\.([^./]+)$", 1)).alias("extension"))
    edge = lambda df: df.select(parent.alias("src"), F.col("p").alias("dst"), seq.alias("eid"), seq.alias("_seq"))
    inner = folders.where(F.length("p") > len(base))
    vertices, edges = aligned(v, f), [EdgeTable(edge(inner), "HAS_FOLDER"), EdgeTable(edge(files), "HAS_FILE")]
    if unfold:
        for glob, read in (("*.xlsx", read_xlsx), ("*.pptx", read_pptx), ("*.pdf", read_pdf)):
            found = read(spark, root, glob)
            clean = lambda c: F.regexp_replace(c, "^file:/*", "/").alias(c)
            parts = found.vertices[0].df.where(F.col("id").contains("#"))
            vertices = aligned(vertices, parts.select(clean("id"), *[c for c in parts.columns if c != "id"]))
            edges += [EdgeTable(t.df.select(clean("src"), clean("dst"), "eid", "_seq"), t.label) for t in found.edges]
    return PropertyGraph(spark, [VertexTable(vertices)], edges)


def _each(spark: SparkSession, path: str, schema: str, rows: Callable[[bytes], list[tuple]], glob: str | None = None) -> DataFrame:
    """Rows made from the content of each file, with its path; glob: of all files below the path with such names."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(name, *r) for r in rows(bytes(content))], columns=["path", *names])

    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true") if glob else reader
    return reader.load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


def _xml(data: bytes) -> ElementTree.Element:
    root = ElementTree.fromstring(data)
    for x in root.iter():
        x.tag = x.tag.rpartition("}")[2]
        x.attrib = {k.rpartition("}")[2]: v for k, v in x.attrib.items()}
    return root


def _core(z: zipfile.ZipFile) -> dict[str, str]:
    return {x.tag: x.text for x in _xml(z.read("docProps/core.xml")) if x.text} if "docProps/core.xml" in z.namelist() else {}


def _cells(content: bytes) -> list[tuple]:
    z = zipfile.ZipFile(io.BytesIO(content))
    names = z.namelist()
    shared = ["".join(t.text or "" for t in si.iter("t")) for si in _xml(z.read("xl/sharedStrings.xml")).iter("si")] if "xl/sharedStrings.xml" in names else []
    book = _xml(z.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in _xml(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for i, sheet in enumerate(book.iter("sheet")):
        target = links[sheet.get("id")].lstrip("/")
        root = _xml(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        for c in root.iter("c"):
            letters, row = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
            v = c.find("v")
            text = shared[int(v.text)] if c.get("t") == "s" and v is not None else "".join(t.text or "" for t in c.iter("t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
            if text is not None:
                out.append((i, sheet.get("name"), letters, int(row), text))
    return out


def xlsx_cells(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, sheet_index, sheet, column, row, value) of all cells of the workbooks at a path."""
    return _each(spark, path, "sheet_index int, sheet string, column string, row int, value string", _cells, glob)


def _slides(content: bytes) -> list[tuple]:
    z = zipfile.ZipFile(io.BytesIO(content))
    core = _core(z)
    out = []
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0])):
        page = int(re.findall(r"\d+", name)[0])
        root = _xml(z.read(name))
        texts, title = [], ""
        for shape in root.iter("sp"):
            text = "\n".join("".join(t.text or "" for t in p.iter("t")) for p in shape.iter("p")).strip()
            kind = next((p.get("type") for p in shape.iter("ph")), None)
            if kind in ("title", "ctrTitle"):
                title = text
            if text:
                texts.append(text)
        notes = f"ppt/notesSlides/notesSlide{page}.xml"
        note = " ".join(t.text or "" for t in _xml(z.read(notes)).iter("t")) if notes in z.namelist() else ""
        out.append((page, title, title or f"page{page}", texts, note, core.get("title"), core.get("creator")))
    return out


def pptx_slides(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, page, title, name, text, notes, deck, author) of all slides of the presentations at a path."""
    return _each(spark, path, "page int, title string, name string, text array<string>, notes string, deck string, author string", _slides, glob)


def _outline(content: bytes) -> list[tuple]:
    data = [content]
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        try:
            data.append(zlib.decompress(m[1]))
        except zlib.error:
            continue
    plain = b"\n".join(data)
    pages = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", plain))
    titles = [m.decode("latin-1") for m in re.findall(rb"/Title\s*\(((?:[^()\\]|\\.)*)\)", plain)]
    return [(pages, i, t) for i, t in enumerate(titles)] or [(pages, None, None)]


def pdf_titles(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, pages, position, title): page counts and titles of outlines and documents, from plain and deflated objects."""
    return _each(spark, path, "pages int, position int, title string", _outline, glob)


def office_graph(rows: DataFrame, root_label: str, part_label: str, edge_label: str, part: str, props: list[str]) -> PropertyGraph:
    """A vertex for each file and for each of its parts (sheets, pages), with an edge between them."""
    spark = rows.sparkSession
    parts = rows.select("path", F.col(part).cast("string").alias("part"), *props).dropDuplicates(["path", "part"])
    file_name = F.element_at(F.split("path", "/"), -1)
    seq = F.xxhash64("path")
    roots = rows.select("path").distinct().select(F.col("path").alias("id"), file_name.alias("name"), F.array(F.lit(root_label)).alias("labels"), seq.alias("_seq"))
    key = F.concat_ws("#", "path", "part")
    kids = parts.select(key.alias("id"), F.col("part").alias("name"), F.array(F.lit(part_label)).alias("labels"), F.xxhash64("path", "part").alias("_seq"), *[p for p in props if p not in ("name", part)])
    edges = parts.select(F.col("path").alias("src"), key.alias("dst"), F.xxhash64("path", "part").alias("eid"), F.xxhash64("path", "part").alias("_seq"))
    return PropertyGraph(spark, [VertexTable(aligned(roots, kids))], [EdgeTable(edges, edge_label)])


def read_xlsx(spark: SparkSession, path: str, glob: str | None = None) -> PropertyGraph:
    cells = xlsx_cells(spark, path, glob)
    sheets = cells.groupBy("path", "sheet").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat("column", F.col("row").cast("string")), "value")))).alias("cells"))
    return office_graph(sheets, "EXCELFile", "EXCELSheet", "HAS_SHEET", "sheet", ["cells"])


def read_pptx(spark: SparkSession, path: str, glob: str | None = None) -> PropertyGraph:
    return office_graph(pptx_slides(spark, path, glob), "PPFile", "PPPage", "HAS_PAGE", "page", ["title", "text", "notes"])


def read_pdf(spark: SparkSession, path: str, glob: str | None = None) -> PropertyGraph:
    return office_graph(pdf_titles(spark, path, glob).where("title is not null"), "PDFFile", "PDFTitle", "HAS_CONTENT", "position", ["title", "pages"])


class FileIO:
    """`g.io(path).read()` merges a file's graph into the graph, `.write()` saves it; the ending tells the format."""

    def __init__(self, graph: PropertyGraph, path: str, **options):
        self.graph, self.path, self.options = graph, path, options

    def with_(self, key: str, value=True) -> FileIO:
        return FileIO(self.graph, self.path, **self.options | {key: value})

    @property
    def ending(self) -> str:
        return self.path.rpartition(".")[2].lower()

    def read(self) -> PropertyGraph:
        readers = {"graphml": read_graphml, "xml": read_graphml, "json": read_graphson, "jsons": read_graphson}
        if self.ending not in readers:
            raise GraphError(f"files ending in {self.ending!r} cannot be read")
        found = readers[self.ending](self.graph.spark, self.path, **self.options)
        if self.graph.vertices and not self.graph.all_vertices().isEmpty():
            found = self.graph.plus(found)
        self.graph.vertices, self.graph.edges = found.vertices, found.edges
        return self.graph

    def write(self) -> None:
        if self.ending in ("graphml", "xml"):
            write_graphml(self.graph, self.path)
        elif self.ending in ("json", "jsons"):
            graphson_lines(self.graph).write.text(self.path)
        elif self.ending in ("nt", "rdf"):  # N-Triples lines, in a folder of part files
            from hopwise.sources.rdf import triples, ntriples

            ntriples(triples(self.graph)).write.text(self.path)
        else:
            raise GraphError(f"files ending in {self.ending!r} cannot be written")


@dataclass(frozen=True)
class GraphEntry:
    name: str
    is_default: bool = False
    custom_loader: str | None = None
    file_path: str | None = None
    node_label_key: str = "labelV"
    edge_label_key: str = "labelE"
    node_name_key: str = "name"


class Graphs:
    """Named graphs of a YAML file, or of a dict of the same form, loaded when they are first asked for. Paths are relative to the file's folder or whole."""

    LOADERS = {"modern": examples.modern, "crew": examples.crew}

    def __init__(self, spark: SparkSession, config: str | dict):
        fields = GraphEntry.__dataclass_fields__
        if isinstance(config, dict):
            path, loaded = Path("/graphs"), config["configs"]
        else:
            import yaml

            path = Path(config)
            loaded = yaml.safe_load(path.read_text())["configs"]
        self.entries = {k: GraphEntry(**{f: v for f, v in c.items() if f in fields}) for k, c in loaded.items()}
        self.spark, self.folder, self.graphs = spark, path.parent, {}

    def get(self, name: str) -> PropertyGraph:
        if name not in self.entries:
            raise GraphError(f"no graph is named {name!r}")
        if name not in self.graphs:
            e = self.entries[name]
            if e.custom_loader:
                self.graphs[name] = self.LOADERS[e.custom_loader](self.spark)
            elif e.file_path and e.file_path.endswith(".json"):
                self.graphs[name] = read_json_tree(self.spark, self.located(e.file_path))
            else:
                self.graphs[name] = read_graphml(self.spark, self.located(e.file_path), e.node_label_key, e.node_name_key, e.edge_label_key, config=GraphConfig())
        return self.graphs[name]

    def located(self, path: str) -> str:
        return path if re.match(r"^[a-z0-9]+:/", path) else str(self.folder / path)


__all__ = ["FileIO", "GraphBuilder", "GraphEntry", "Graphs", "pdf_titles", "pptx_slides", "read_folder", "read_pdf", "read_pptx", "read_xlsx", "xlsx_cells"]
