"""Builds from a config, the servers, drawn pages, the command line's other commands."""

import io
import json
import threading
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET

import pytest

from lattica import build, servers
from lattica.__main__ import main
from lattica.ontology import DEFAULT
from lattica.operators import extract
from lattica.schema import EDGE, NODE, Graph, conform
from lattica.sinks import files as sinks
from lattica.sinks import pages
from lattica.sources import files as sources

PACK = {
    "subject": {"id": "spark", "name": "Apache Spark", "type": "Technology"},
    "entities": [
        {"id": "entity:spark", "name": "Apache Spark", "type": "Technology", "aliases": ["Spark"], "blog_url": "https://x.org/blog/spark-notes/", "related_blog_urls": ["/blog/a", "/other/b"]},
        {"id": "entity:sql", "name": "SQL", "type": "Language", "architecture_radar_url": "/architecture-radar/sql-engines/"},
    ],
    "relationships": [{"source_id": "entity:spark", "relationship": "SUPPORTS", "target_id": "entity:sql", "confidence": 0.9, "explanation": "it does", "sources": ["x"]}],
}


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "packs").mkdir()
    (tmp_path / "notes/spark-notes.md").write_text("---\ntitle: Spark notes\ntags: [data]\n---\nApache Spark runs SQL. Apache Spark again. [[a]]", encoding="utf-8")
    (tmp_path / "notes/a.md").write_text("nothing here #data", encoding="utf-8")
    (tmp_path / "packs/spark.json").write_text(json.dumps(PACK), encoding="utf-8")
    (tmp_path / "entities.toml").write_text('[[entity]]\nid = "spark"\nname = "Apache Spark"\ntype = "Technology"\n', encoding="utf-8")
    (tmp_path / "lattica.toml").write_text('[[sources]]\ntype = "obsidian"\npath = "notes"\n[[sources]]\ntype = "entity_packs"\npath = "packs"\n[ontology]\nentities = "entities.toml"\n[packs]\nsite_url = "https://x.org"\n', encoding="utf-8")
    return tmp_path


def test_build(spark, corpus, capsys):
    g, head = build.build(spark, build.load_config(corpus / "lattica.toml"))
    edges = {(r.src, r.rel, r.dst, r.tier) for r in g.edges.collect()}
    assert ("spark-notes", "COVERS", "entity:spark", "extracted") in edges
    assert ("entity:spark", "SUPPORTS", "entity:sql", "curated") in edges
    assert ("entity:spark", "PRIMARY_TOPIC_OF", "spark-notes", "curated") in edges and ("entity:spark", "DISCUSSED_IN", "a", "curated") in edges
    assert head["sources"] == ["obsidian", "entity_packs"]
    out = str(corpus / "graph.json")
    assert main(["build", "--config", str(corpus / "lattica.toml"), "--out", out]) == 0
    assert main(["build", "--config", str(corpus / "lattica.toml"), "--dry-run"]) == 0 and "would write" in capsys.readouterr().out
    assert main(["build", "--config", str(corpus / "lattica.toml")]) == 1
    again = sources.graph_json(spark, out)
    assert {(r.src, r.rel, r.dst, r.tier) for r in again.edges.collect()} == edges
    assert main(["watch", "--config", str(corpus / "lattica.toml"), "--out", out, "--once"]) == 0


def test_citations(spark, corpus):
    _, entities, _ = sources.entity_packs(spark, str(corpus / "packs"))
    edges, unmatched = build.citations(entities, {"site_url": "https://x.org/"})
    assert {(r.src, r.rel, r.dst) for r in edges.collect()} == {("entity:spark", "PRIMARY_TOPIC_OF", "spark-notes"), ("entity:spark", "DISCUSSED_IN", "a"), ("entity:sql", "DISCUSSED_IN", "assessment:sql-engines")}
    assert [(r.id, r.url) for r in unmatched.collect()] == [("entity:spark", "/other/b")]


def test_registry(spark, corpus, capsys):
    (corpus / "bad.toml").write_text('[[entity]]\nid = "a"\nname = "A"\ntype = "Nothing"\n', encoding="utf-8")
    with pytest.raises(extract.RegistryError):
        build.registry_table(spark, str(corpus / "bad.toml"))
    assert main(["registry-check", "--entities", str(corpus / "entities.toml")]) == 0 and "1 entities" in capsys.readouterr().out
    assert main(["registry-check", "--entities", str(corpus / "bad.toml")]) == 1
    assert main(["init", "--dir", str(corpus / "new")]) == 0 and main(["scaffold", "--topic", "Big Data", "--out", str(corpus / "t.toml")]) == 0
    assert build.registry_table(spark, str(corpus / "t.toml")).first()["id"] == "entity:big-data"


def test_conforming_and_dot(spark):
    entities = spark.createDataFrame([("a", "Technology"), ("d", "Document"), ("", "Concept"), ("c", "Concept")], "id string, type string")
    relations = spark.createDataFrame([("a", "Implements", "c"), ("a", "COVERS", "d"), ("a", "no", "c")], "src string, rel string, dst string")
    kept, rels = DEFAULT.conforming(entities, relations)
    assert {r.id for r in kept.collect()} == {"a", "c"} and [tuple(r) for r in rels.collect()] == [("a", "implements", "c")]
    dot = DEFAULT.to_dot()
    assert '"Topic" [shape=ellipse];' in dot and '"RadarEntry" -> "Document" [label="DOCUMENTED_IN", style=dashed];' in dot


@pytest.fixture
def served(spark):
    nodes = [("a", "Apache Spark", "Technology", ["Spark"], 0), ("b", "SQL", "Language", None, 1), ("c", "Page </script> & one", "Document", None, 2), ("d", "Far", "Concept", None, 3)]
    edges = [("a", "SUPPORTS", "b", 0.9, "c", "curated", 0), ("c", "COVERS", "a", 1.0, "c", "extracted", 1), ("b", "USES", "d", 0.5, None, "curated", 2)]
    return Graph(conform(spark.createDataFrame(nodes, "id string, label string, type string, aliases array<string>, ord long"), NODE), conform(spark.createDataFrame(edges, "src string, rel string, dst string, confidence double, doc string, tier string, ord long"), EDGE))


def test_http(served):
    server = servers.http_server(servers.Service(served, {"entity_types": ["Technology"]}), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def get(path, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, headers=headers)) as r:
                return r.status, r.headers, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.headers, e.read().decode()

    status, head, body = get("/")
    assert status == 200 and json.loads(body)["counts"] == {"nodes": 4, "edges": 3} and head["Access-Control-Allow-Origin"] == "*"
    assert get("/", **{"If-None-Match": head["ETag"]})[0] == 304
    assert json.loads(get("/stats")[2])["types"] == {"Technology": 1, "Language": 1, "Document": 1, "Concept": 1}
    assert [n["id"] for n in json.loads(get("/nodes?query=sPark")[2])] == ["a"] and [n["id"] for n in json.loads(get("/nodes?limit=2&offset=1")[2])] == ["b", "c"]
    one = json.loads(get("/nodes/a")[2])
    assert [e["dst"] for e in one["outbound"]] == ["b"] and [e["src"] for e in one["inbound"]] == ["c"]
    assert get("/nodes/zz")[0] == 404 and get("/nothing")[0] == 404 and get("/context")[0] == 400 and get("/nodes?limit=x")[0] == 400
    assert [e["rel"] for e in json.loads(get("/edges?src=a")[2])] == ["SUPPORTS"]
    assert {n["id"] for n in json.loads(get("/context?entity=spark&algorithm=bfs")[2] if False else get("/context?entity=SQL&algorithm=bfs")[2])["nodes"]} == {"a", "b", "d"}
    assert get("/context?entity=SQL&algorithm=bfs&format=markdown")[2].startswith("# Context: SQL") and get("/context?entity=none")[0] == 404
    assert json.loads(get("/audit")[2])["components"] == 1
    server.shutdown()


def test_tools(served):
    tools = servers.Tools(servers.Service(served))
    ask = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "nope"}]
    ask += [{"id": i, "method": "tools/call", "params": {"name": n, "arguments": a}} for i, (n, a) in enumerate([("search_nodes", {"query": "sql"}), ("traverse_subgraph", {"entity": "b"}), ("get_provenance", {"src": "a", "dst": "b"}), ("get_provenance", {"src": "b", "dst": "a"}), ("nope", {}), ("extract_context_ppr", {"entity": "a", "top_k": 2})], 10)]
    out = io.StringIO()
    tools.serve(io.StringIO("\n".join(json.dumps(m) for m in ask) + "\n\n{bad\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [m["id"] for m in got] == [1, 2, 3, 10, 11, 12, 13, 14, 15, None]
    assert len(got[1]["result"]["tools"]) == 5 and got[2]["error"]["code"] == -32601 and got[-1]["error"]["code"] == -32700
    said = [m["result"]["content"][0]["text"] for m in got[3:9]]
    assert json.loads(said[0])[0]["id"] == "b" and "Far" in said[1] and json.loads(said[2])[0]["tier"] == "curated" and said[3].startswith("No direct edges")
    assert got[7]["result"]["isError"] and "SQL" in said[5]


def test_pages(served, tmp_path, spark):
    nodes, edges = pages.drawn(served, 3)
    assert nodes.count() == 3
    root = ET.fromstring("\n".join(r.value for r in pages.svg_lines(*pages.drawn(served)).collect()))
    assert len(root.findall("{*}circle")) == 4 and len(root.findall("{*}line")) == 3
    page = pages.standalone_html(served)
    inner = page.split('id="graph">')[1].split("</script>")[0]
    assert {n["label"] for n in json.loads(inner)["nodes"]} == {"Apache Spark", "SQL", "Page </script> & one", "Far"}
    assert pages.NotebookView(served)._repr_html_().startswith("<iframe srcdoc=")
    pages.publish(served, str(tmp_path / "site"))
    assert sources.graph_json(spark, str(tmp_path / "site/graph.json")).nodes.count() == 4
    assert "customElements.define(\"lattica-graph\"" in pages.web_component()
    sinks.duckdb_file(served, str(tmp_path / "g.duckdb"))
    import duckdb

    assert duckdb.connect(str(tmp_path / "g.duckdb")).execute("SELECT count(*), max(confidence) FROM edges").fetchone() == (3, 1.0)


def test_more_commands(served, tmp_path, capsys):
    g = str(tmp_path / "g.json")
    sinks.graph_json(served, g)
    for args in (["publish", "--out-dir", str(tmp_path / "s")], ["export", "--format", "svg", "--out", str(tmp_path / "x.svg")], ["export", "--format", "duckdb", "--out", str(tmp_path / "x.db")], ["export-obsidian", "--canvas", str(tmp_path / "c.canvas"), "--vault", str(tmp_path / "v")], ["index-pagefind", "--out-dir", str(tmp_path / "p")]):
        assert main([args[0], "--graph", g, *args[1:]]) == 0
    assert main(["export-wc", "--out", str(tmp_path / "w.js")]) == 0
    assert ET.parse(tmp_path / "x.svg").getroot().tag.endswith("svg") and json.loads((tmp_path / "c.canvas").read_text())["nodes"]
    assert main(["rag", "--graph", g, "--query", "Spark"]) == 0 and "### Graph Relations" in capsys.readouterr().out
    assert main(["benchmark", "--quick"]) == 0 and '"result":200' in capsys.readouterr().out
