"""Exports of a graph: JSON, CSV, Neo4j, GraphML, GEXF, Turtle, Cypher, Parquet, canvas, vault, pages, tiles.

Row formats are text lines made by column expressions and written by Spark.  A
format that must be one file is ordered by a sort over range partitions and
written part by part in that order; ``single_file`` joins the parts for small graphs.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.iterate import numbered
from lattica.operators.merge import with_degree
from lattica.schema import Graph, given


def _sorted(graph: Graph) -> tuple[DataFrame, DataFrame]:
    nodes = graph.nodes if "degree" in graph.nodes.columns else with_degree(graph.nodes, graph.edges)
    return nodes.orderBy("id"), graph.edges.orderBy("src", "rel", "dst", F.coalesce("scope", F.lit("")))


def _compact(df: DataFrame, *drop: str) -> DataFrame:
    """One JSON line a row, without empty values."""
    cols = []
    for f in df.schema.fields:
        if f.name in drop:
            continue
        c = F.col(f.name)
        kind = f.dataType.typeName()
        cols.append((given(c) if kind == "string" else F.when(F.size(c) > 0, c) if kind in ("array", "map") else c).alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "true"}).alias("value"))


def graph_json(graph: Graph, path: str, meta: dict | None = None) -> None:
    """One JSON file, streamed row by row: nodes by id, edges by key."""
    nodes, edges = _sorted(graph)
    with open(path, "w", encoding="utf-8") as out:
        head = json.dumps(meta or {"schema_version": 1}, sort_keys=True)
        out.write(head[:-1] + ', "nodes": [')
        for part, df in (("", _compact(nodes, "ord")), ('], "edges": [', _compact(edges, "ord"))):
            out.write(part)
            for i, r in enumerate(df.toLocalIterator()):
                out.write(",\n" * bool(i) + r["value"])
        out.write("]}\n")


def csv(graph: Graph, path: str) -> None:
    nodes, edges = _sorted(graph)
    put = lambda df, name: df.write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", "").csv(f"{path}/{name}")
    put(nodes.select("id", "label", "type", "degree", "url"), "nodes")
    put(edges.select("src", "rel", "dst", "confidence", "explanation", "scope", "doc", "tier"), "edges")


def neo4j_csv(graph: Graph, path: str) -> None:
    nodes, edges = _sorted(graph)
    put = lambda df, name: df.write.mode("overwrite").option("header", "true").option("nullValue", "").csv(f"{path}/{name}")
    put(nodes.select(F.col("id").alias("id:ID"), "label", F.col("type").alias(":LABEL"), F.col("degree").alias("degree:int"), "url"), "nodes")
    put(edges.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.col("rel").alias(":TYPE"), F.col("confidence").alias("confidence:float"), "explanation", "scope"), "relationships")


def _lines(*parts: DataFrame) -> DataFrame:
    """Parts one after the other, each in its own order; sorted over range partitions."""
    keys = max(len(p.columns) for p in parts) - 1
    keyed = [p.select(F.lit(i).alias("part"), *[(F.col(p.columns[k]) if k < len(p.columns) - 1 else F.lit(None)).cast("string").alias(f"k{k}") for k in range(keys)], F.col(p.columns[-1]).alias("value")) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, keyed).orderBy("part", *[f"k{k}" for k in range(keys)]).select("value")


def _text(spark, *lines: str) -> DataFrame:
    return spark.createDataFrame([("\n".join(lines),)], "value string")


def graphml_lines(graph: Graph) -> DataFrame:
    nodes, edges = _sorted(graph)
    data = lambda key, c: F.when(c.isNotNull(), F.concat(F.lit(f'<data key="{key}">'), T.xml_escape(c.cast("string")), F.lit("</data>"))).otherwise("")
    n = nodes.select("id", F.concat(F.lit('<node id="'), T.xml_escape(F.col("id")), F.lit('">'), data("label", given("label")), data("type", given("type")), data("degree", F.col("degree")), data("url", given("url")), F.lit("</node>")).alias("v"))
    e = edges.select("src", "rel", "dst", F.concat(F.lit('<edge source="'), T.xml_escape(F.col("src")), F.lit('" target="'), T.xml_escape(F.col("dst")), F.lit('">'), data("rel", given("rel")), data("confidence", F.col("confidence")), data("explanation", given("explanation")), data("scope", given("scope")), F.lit("</edge>")).alias("v"))
    keys = [f'<key id="{k}" for="{on}" attr.name="{k}" attr.type="{t}"/>' for k, on, t in (("label", "node", "string"), ("type", "node", "string"), ("degree", "node", "int"), ("url", "node", "string"), ("rel", "edge", "string"), ("confidence", "edge", "double"), ("explanation", "edge", "string"), ("scope", "edge", "string"))]
    s = nodes.sparkSession
    return _lines(_text(s, '<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">'), n, e, _text(s, "</graph>", "</graphml>"))


def gexf_lines(graph: Graph) -> DataFrame:
    nodes, edges = _sorted(graph)
    n = nodes.select("id", F.concat(F.lit('<node id="'), T.xml_escape(F.col("id")), F.lit('" label="'), T.xml_escape(F.coalesce("label", "id")), F.lit('"/>')).alias("v"))
    e = edges.select("src", "rel", "dst", F.concat(F.lit('<edge source="'), T.xml_escape(F.col("src")), F.lit('" target="'), T.xml_escape(F.col("dst")), F.lit('" label="'), T.xml_escape(F.col("rel")), F.lit('"/>')).alias("v"))
    s = nodes.sparkSession
    return _lines(_text(s, '<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>'), n, _text(s, "</nodes><edges>"), e, _text(s, "</edges></graph></gexf>"))


def turtle_lines(graph: Graph, base: str = "urn:graph:", reify: bool = True) -> DataFrame:
    """Types, labels, degrees and URLs; each edge, and a statement about it where it says more than its triple."""
    nodes, edges = _sorted(graph)
    name = lambda c: F.concat(F.lit("ex:"), F.regexp_replace(F.url_encode(F.regexp_replace(c, ":", "_")), r"[+*]", "%20"))
    lit = lambda p, c: F.when(c.isNotNull(), F.concat(F.lit(f" ;\n    {p} "), T.quoted(c))).otherwise("")
    degree = F.when(F.col("degree") > 0, F.concat(F.lit(" ;\n    ex:degree "), F.col("degree").cast("string"))).otherwise("")
    n = nodes.select("id", F.concat(name(F.col("id")), F.lit(" a "), name(F.col("type")), lit("rdfs:label", given("label")), degree, lit("ex:url", given("url")), F.lit(" .")).alias("v"))
    plain = F.concat(name(F.col("src")), F.lit(" "), name(F.col("rel")), F.lit(" "), name(F.col("dst")), F.lit(" ."))
    more = F.concat(F.when(F.col("confidence").isNotNull(), F.concat(F.lit(" ;\n    ex:confidence "), F.col("confidence").cast("string"))).otherwise(""), *[lit(f"ex:{c}", given(c)) for c in ("explanation", "scope", "tier", "doc")])
    if reify:
        edges = numbered(edges.withColumn("_scope", F.coalesce("scope", F.lit(""))), "src", "rel", "dst", "_scope", name="_i", start=0)
    said = F.concat(plain, F.lit("\n_:stmt"), F.col("_i").cast("string") if reify else F.lit(""), F.lit(" a rdf:Statement ;\n    rdf:subject "), name(F.col("src")), F.lit(" ;\n    rdf:predicate "), name(F.col("rel")), F.lit(" ;\n    rdf:object "), name(F.col("dst")), more, F.lit(" ."))
    e = edges.select("src", "rel", "dst", F.coalesce("scope", F.lit("")).alias("at"), (F.when(more != "", said).otherwise(plain) if reify else plain).alias("v"))
    s = nodes.sparkSession
    return _lines(_text(s, f"@prefix ex: <{base}> .", "@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .", "@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> ."), n, e)


def cypher_lines(graph: Graph) -> DataFrame:
    nodes, edges = _sorted(graph)
    kind = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    n = nodes.select("id", F.concat(F.lit("MERGE (n:"), kind(F.col("type")), F.lit(" {id: "), T.quoted(F.col("id"), "'"), F.lit("}) SET n.label = "), T.quoted(F.coalesce("label", "id"), "'"), F.lit(";")).alias("v"))
    e = edges.select("src", "rel", "dst", F.concat(F.lit("MATCH (a {id: "), T.quoted(F.col("src"), "'"), F.lit("}), (b {id: "), T.quoted(F.col("dst"), "'"), F.lit("}) MERGE (a)-[:"), kind(F.col("rel")), F.lit(" {confidence: "), F.format_string("%.4f", F.coalesce("confidence", F.lit(1.0))), F.lit("}]->(b);")).alias("v"))
    return _lines(_text(nodes.sparkSession, "CREATE CONSTRAINT node_id IF NOT EXISTS FOR (n:Node) REQUIRE n.id IS UNIQUE;"), n, e)


def parquet(graph: Graph, path: str) -> str:
    """Tables nodes and edges, edges by tier; and the SQL that opens them elsewhere."""
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("tier").parquet(f"{path}/edges")
    return f"CREATE VIEW nodes AS SELECT * FROM read_parquet('{path}/nodes/*.parquet');\nCREATE VIEW edges AS SELECT * FROM read_parquet('{path}/edges/*/*.parquet', hive_partitioning = true);\n"


def duckdb_file(graph: Graph, path: str) -> None:
    """A database file with tables nodes and edges, filled from Arrow batches one after the other."""
    import duckdb

    con = duckdb.connect(path)
    for name, df in zip(("nodes", "edges"), columnar(graph)):
        table = f'CREATE OR REPLACE TABLE {name} AS SELECT * FROM part'
        batches = df.toArrow()  # a local file holds what one machine can
        con.register("part", batches)
        con.execute(table)
        con.unregister("part")
    con.close()


def canvas(graph: Graph, width: int = 260, height: int = 120) -> dict:
    """A canvas of cards on a grid of six columns; meant for a drawn subgraph."""
    nodes, edges = _sorted(graph)
    cards = [{"id": r["id"], "type": "text", "text": r["label"] or r["id"], "x": i % 6 * (width + 80), "y": i // 6 * (height + 80), "width": width, "height": height} for i, r in enumerate(nodes.select("id", "label").toLocalIterator())]
    lines = [{"id": f"e{i}", "fromNode": r["src"], "toNode": r["dst"], "label": r["rel"]} for i, r in enumerate(edges.select("src", "rel", "dst").toLocalIterator())]
    return {"nodes": cards, "edges": lines}


def _relations(graph: Graph) -> DataFrame:
    names = graph.nodes.select("id", F.coalesce("label", "id").alias("name"))
    out = graph.edges.join(names.withColumnsRenamed({"id": "dst", "name": "other"}), "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rel", "other"))).alias("out"))
    back = graph.edges.join(names.withColumnsRenamed({"id": "src", "name": "other"}), "src").groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rel", "other"))).alias("back"))
    return graph.nodes.join(out, "id", "left").join(back, "id", "left")


def vault_notes(graph: Graph) -> DataFrame:
    """(name, value): a markdown note for each node, with its links."""
    links = lambda c, title: F.when(F.size(c) > 0, F.concat(F.lit(f"\n## {title}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x["rel"], F.lit(" [["), x["other"], F.lit("]]"))), "\n"), F.lit("\n"))).otherwise("")
    return _relations(graph).select(F.regexp_replace(F.coalesce("label", "id"), r"[\\/:*?\"<>|#^\[\]]", "-").alias("name"), F.concat(F.lit("---\nid: "), "id", F.lit("\ntype: "), F.coalesce("type", F.lit("")), F.lit("\n---\n# "), F.coalesce("label", "id"), F.lit("\n"), links(F.col("out"), "Links"), links(F.col("back"), "Backlinks")).alias("value"))


def page_html(graph: Graph) -> DataFrame:
    """(name, value): an HTML page for each node: what it points to, then what points to it."""
    items = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat(F.lit("<li>"), T.xml_escape(x["rel"]), F.lit(" "), T.xml_escape(x["other"]), F.lit("</li>"))), ""), F.lit(""))
    name = T.xml_escape(F.coalesce("label", "id"))
    return _relations(graph).select(T.slug(F.col("id")).alias("name"), F.concat(F.lit("<!doctype html><html><head><title>"), name, F.lit("</title></head><body data-pagefind-body><h1>"), name, F.lit("</h1><ul>"), items(F.col("out")), items(F.col("back")), F.lit("</ul></body></html>")).alias("value"))


def write_notes(notes: DataFrame, path: str) -> None:
    """(name, value) rows as text below folders by name, written by the executors."""
    notes.write.mode("overwrite").partitionBy("name").text(path)


def columnar(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Flat tables for other engines: empty strings for null text, JSON for lists and maps, confidence 1 where none."""
    flat = lambda df: df.select(*[(F.coalesce(F.col(f.name), F.lit("")) if f.dataType.typeName() == "string" else F.to_json(f.name).alias(f"{f.name}_json") if f.dataType.typeName() in ("array", "map") else F.coalesce(F.col(f.name), F.lit(1.0)) if f.name == "confidence" else F.col(f.name)).alias(f.name if f.dataType.typeName() not in ("array", "map") else f"{f.name}_json") for f in df.schema.fields])
    return flat(graph.nodes), flat(graph.edges)


def tiles(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("z", "x", "y").json(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("z", "x", "y").json(f"{path}/edges")


def single_file(lines: DataFrame, path: str) -> None:
    """Ordered lines as one local file, streamed."""
    with open(path, "w", encoding="utf-8") as out:
        for r in lines.toLocalIterator():
            out.write(r["value"] + "\n")
