"""RDF export: triples of all properties and edges, as a DataFrame and as N-Triples lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopwise.graph import PropertyGraph, union

# XML Schema types of literals.
XSD = {T.BooleanType(): "boolean", T.LongType(): "integer", T.IntegerType(): "integer", T.DoubleType(): "double", T.FloatType(): "double", T.TimestampType(): "dateTime", T.DateType(): "date"}


def triples(graph: PropertyGraph, base: str = "http://example.org/") -> DataFrame:
    """(s, p, o, datatype): datatype is null where the object is a resource; missing properties give no triple."""
    out = []
    for t in graph.vertices:
        pairs = []
        for name, kind in t.properties.items():
            if isinstance(kind, (T.MapType, T.StructType, T.ArrayType)):
                continue
            value = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss") if isinstance(kind, T.TimestampType) else F.col(name).cast("string")
            pairs.append(F.struct(F.lit(base + name).alias("p"), value.alias("o"), F.lit(XSD.get(kind, "string")).alias("datatype")))
        own = t.df.select(F.concat(F.lit(base), F.col("id").cast("string")).alias("s"), "labels", F.array(*pairs).alias("all"))
        out.append(own.select("s", F.inline("all")).where("o is not null"))
        out.append(own.select("s", F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#type").alias("p"), F.explode(F.transform("labels", lambda x: F.concat(F.lit(base), x))).alias("o"), F.lit(None).cast("string").alias("datatype")))
    for t in graph.edges:
        iri = lambda c: F.concat(F.lit(base), F.col(c).cast("string"))
        out.append(t.df.select(iri("src").alias("s"), F.lit(base + t.label).alias("p"), iri("dst").alias("o"), F.lit(None).cast("string").alias("datatype")))
    return union(out)


def ntriples(rows: DataFrame) -> DataFrame:
    """One N-Triples line for each triple, in the column `value`."""
    iri = lambda c: F.concat(F.lit("<"), F.regexp_replace(c, r"[\s<>\"{}|^`\\]", "_"), F.lit(">"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), "\r", r"\\r")
    literal = F.concat(F.lit('"'), text, F.lit('"^^<http://www.w3.org/2001/XMLSchema#'), F.col("datatype"), F.lit(">"))
    return rows.select(F.concat_ws(" ", iri("s"), iri("p"), F.when(F.col("datatype").isNull(), iri("o")).otherwise(literal), F.lit(".")).alias("value"))


def turtle(graph: PropertyGraph, base: str = "http://example.org/", prefixes: dict[str, str] | None = None) -> DataFrame:
    """Turtle, in the column `value`: a row for each subject with all that is said of it, predicates in order, under prefixes.

    prefixes: names of namespaces; without any, `p` is the base. A resource is shortened where its rest after a namespace is a plain name. The rows
    with `@prefix` come first in any order of the others: `head` is true for them, so a file is the rows of each kind one after another.
    """
    named = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "xsd": "http://www.w3.org/2001/XMLSchema#"} | (prefixes or {"p": base})
    rows = triples(graph, base)

    def short(c):
        out = F.concat(F.lit("<"), F.regexp_replace(c, r"[\s<>\"{}|^`\\]", "_"), F.lit(">"))
        for name, space in sorted(named.items(), key=lambda x: len(x[1])):
            rest = F.substring(c, F.lit(len(space) + 1), F.length(c))
            out = F.when(c.startswith(space) & rest.rlike("^[A-Za-z][A-Za-z0-9_]*$"), F.concat(F.lit(f"{name}:"), rest)).otherwise(out)
        return out

    text = F.col("o")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.when(F.col("datatype") == "string", "").otherwise(F.concat(F.lit("^^xsd:"), F.col("datatype"))))
    said = F.concat_ws(" ", short(F.col("p")), F.when(F.col("datatype").isNull(), short(F.col("o"))).otherwise(literal))
    each = rows.select(short(F.col("s")).alias("s"), said.alias("said")).groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("said")), " ;\n    ").alias("all"))
    lines = each.select(F.lit(False).alias("head"), F.concat_ws(" ", "s", F.concat("all", F.lit(" ."))).alias("value"))
    head = rows.sparkSession.createDataFrame([(True, f"@prefix {name}: <{space}> .") for name, space in sorted(named.items())], "head boolean, value string")
    return head.union(lines)
