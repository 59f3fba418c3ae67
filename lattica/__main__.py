"""Command line: ``python -m lattica build --config lattica.toml --out graph.json``, then commands over the graph file."""

from __future__ import annotations

import argparse
import json
import sys
import time
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import build as building
from lattica import servers
from lattica.operators import analytics, derive, extract, filters, govern, layout, merge, search
from lattica.ontology import DEFAULT, Ontology
from lattica.plans import context, sparql
from lattica.schema import Graph
from lattica.session import session, ship
from lattica.sinks import files as sinks
from lattica.sinks import pages
from lattica.sources import files as sources
from lattica.sources import remote


def _show(df: DataFrame) -> None:
    for r in df.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
        print(r["line"])


def _toml(path: str) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def _put(graph: Graph, path: str) -> None:
    sinks.graph_json(graph, path)


STARTER = """# Every path is relative to this file.
[[sources]]
type = "obsidian"
path = "notes"

[ontology]
entities = "entities.toml"
"""
ENTITIES = """[[entity]]
id = "example"
name = "Example"
type = "Concept"
aliases = []
"""


def _build(spark, config: str, path: str | None) -> int:
    graph, head = building.build(spark, building.load_config(config))
    graph = Graph(graph.nodes.cache(), graph.edges.cache())
    nodes, edges = graph.nodes.count(), graph.edges.count()
    if not nodes:
        print("no documents found: check the paths in the config", file=sys.stderr)
        return 1
    if path:
        sinks.graph_json(graph, path, head | {"counts": {"nodes": nodes, "edges": edges}})
    print(f"{'wrote ' + path if path else 'would write'}: {nodes} nodes, {edges} edges")
    return 0


def benchmark(spark, quick: bool = False) -> DataFrame:
    """(name, size, seconds, result): a chain's transitive closure, and mentions of many forms in one long text."""
    chain, forms, words = (50, 200, 2_000) if quick else (150, 2000, 20_000)
    began, rows = time.time(), []
    edges = spark.range(chain).select(F.format_string("n%d", "id").alias("src"), F.lit("PART_OF").alias("rel"), F.format_string("n%d", F.col("id") + 1).alias("dst"), F.lit(1.0).alias("confidence"))
    rows.append(("transitive closure, 5 rounds", chain, time.time() - began, derive.infer(edges, [derive.Rule("transitive", "PART_OF")], 5).count()))
    rows[-1] = (*rows[-1][:2], time.time() - began, rows[-1][3])
    began = time.time()
    vocab = spark.range(forms).select(F.format_string("term%d", "id").alias("form"), F.format_string("entity:%d", "id").alias("entity"), F.lit(False).alias("exact"))
    text = spark.range(1).select(F.lit("d").alias("id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.concat(F.lit("term"), (i * 7 % (2 * forms)).cast("string"))), " ").alias("text"))
    rows.append(("mentions of many forms", forms, time.time() - began, extract.mentions(text, vocab).count()))
    rows[-1] = (*rows[-1][:2], time.time() - began, rows[-1][3])
    return spark.createDataFrame(rows, "name string, size int, seconds double, result long")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lattica")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *options: tuple[str, dict], graph: bool = True) -> None:
        c = sub.add_parser(name)
        if graph:
            c.add_argument("--graph", default="graph.json")
        for flag, more in options:
            c.add_argument(flag, **more)

    out = ("--out", {"required": True})
    add("stats")
    add("validate", ("--ontology", {}))
    add("diff", ("--old", {"required": True}), ("--new", {"required": True}), ("--fail-on-change", {"action": "store_true"}), graph=False)
    add("convert", ("--format", {"choices": ["graphml", "gexf", "csv", "neo4j", "turtle", "cypher", "parquet"], "required": True}), out)
    add("ontology-check", ("--schema", {"required": True}), ("--dot", {"action": "store_true"}), graph=False)
    add("context", ("--entity", {"required": True}), ("--algorithm", {"choices": ["ppr", "bfs", "hybrid"], "default": "ppr"}), ("--depth", {"type": int, "default": 1}), ("--top-k", {"type": int, "default": 20}), ("--alpha", {"type": float, "default": 0.15}))
    add("tile", ("--out-dir", {"required": True}), ("--max-zoom", {"type": int, "default": 3}))
    add("as-of", ("--date", {"required": True}), out)
    add("audit")
    add("analyze")
    add("migrate", ("--migration", {"required": True}), out)
    add("infer", ("--threshold", {"type": float, "default": 0.5}), ("--min-docs", {"type": int, "default": 2}))
    add("cluster", ("--resolution", {"type": float, "default": 1.0}))
    add("rag", ("--query", {"required": True}), ("--k-hops", {"type": int, "default": 2}), ("--token-budget", {"type": int, "default": 2000}))
    add("query", ("--ask", {"required": True}))
    add("sparql", ("--query", {"required": True}))
    add("lint", ("--rules", {}))
    add("redact", ("--role", {"required": True}), out)
    add("layout", ("--iterations", {"type": int, "default": 60}), ("--3d", {"action": "store_true", "dest": "three"}), ("--multiscale", {"action": "store_true"}), ("--theta", {"type": float, "default": 0.5}))
    add("extract-llm", ("input", {}), ("--endpoint", {"default": "http://localhost:11434/api/generate"}), ("--model", {"default": "llama3"}), ("--schema", {}), ("--out", {"default": "extracted-pack.toml"}), graph=False)
    port = ("--port", {"type": int, "default": 8080})
    add("build", ("--config", {"default": "lattica.toml"}), ("--out", {}), ("--dry-run", {"action": "store_true"}), graph=False)
    add("watch", ("--config", {"default": "lattica.toml"}), out, ("--poll-interval", {"type": float, "default": 0.5}), ("--once", {"action": "store_true"}), graph=False)
    add("init", ("--dir", {"default": "."}), graph=False)
    add("scaffold", ("--topic", {"required": True}), out, graph=False)
    add("registry-check", ("--entities", {"required": True}), ("--schema", {}), graph=False)
    add("serve-api", ("--host", {"default": "127.0.0.1"}), port)
    add("serve-mcp")
    add("publish", ("--out-dir", {"required": True}), ("--title", {"default": "Graph"}))
    add("export", ("--format", {"choices": ["cypher", "turtle", "duckdb", "svg"], "required": True}), out)
    add("export-obsidian", ("--canvas", {}), ("--vault", {}))
    add("export-wc", ("--out", {"default": "lattica-graph.js"}), graph=False)
    add("index-pagefind", ("--out-dir", {"default": "search_pages"}))
    add("benchmark", ("--quick", {"action": "store_true"}), graph=False)
    add("search", ("--query", {"required": True}), ("--limit", {"type": int, "default": 8}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "ontology-check":
        o = Ontology.from_toml(a.schema, DEFAULT)
        print(o.to_dot() if a.dot else f"{len(o.entity_types)} entity types, {len(o.relations)} relations")
        return 0
    if a.command == "init":
        at = Path(a.dir)
        at.mkdir(parents=True, exist_ok=True)
        for name, text in (("lattica.toml", STARTER), ("entities.toml", ENTITIES)):
            if not (at / name).exists():  # what is there stays
                (at / name).write_text(text, encoding="utf-8")
        return 0
    if a.command == "scaffold":
        slug = "-".join(a.topic.lower().split())
        Path(a.out).write_text(ENTITIES.replace("example", slug).replace("Example", a.topic), encoding="utf-8")
        return 0
    if a.command == "export-wc":
        Path(a.out).write_text(pages.web_component(), encoding="utf-8")
        return 0
    spark = session()
    ship(spark)
    if a.command == "registry-check":
        o = Ontology.from_toml(a.schema, DEFAULT) if a.schema else DEFAULT
        try:
            print(f"{building.registry_table(spark, a.entities, o).count()} entities")
        except extract.RegistryError as e:
            print(e, file=sys.stderr)
            return 1
        return 0
    if a.command == "build":
        if not a.out and not a.dry_run:
            print("build needs --out (or --dry-run)", file=sys.stderr)
            return 1
        return _build(spark, a.config, None if a.dry_run else a.out)
    if a.command == "watch":
        config, seen = building.load_config(a.config), None
        folders = [Path(s["path"]) for s in config.get("sources", []) if "path" in s and "://" not in s["path"]]
        while True:
            now = sorted((str(f), f.stat().st_mtime_ns, f.stat().st_size) for d in folders for f in ([d] if d.is_file() else d.rglob("*")) if f.is_file())
            if now != seen:
                seen = now
                _build(spark, a.config, a.out)
            if a.once:
                return 0
            time.sleep(a.poll_interval)
    if a.command == "extract-llm":
        o = Ontology.from_toml(a.schema, DEFAULT) if a.schema else DEFAULT
        texts = sources.whole(spark, a.input, "*").select(F.col("stem").alias("id"), F.col("raw").alias("text"))
        entities, relations = (Graph(*(x.cache() for x in remote.triples(texts, remote.asks(a.endpoint, a.model), o))).toPandas())
        Path(a.out).write_text(remote.pack_toml(entities.to_dict("records"), relations.to_dict("records")), encoding="utf-8")
        return 0
    if a.command == "benchmark":
        _show(benchmark(spark, a.quick))
        return 0
    if a.command == "diff":
        summary = govern.diff_summary(sources.graph_json(spark, a.old), sources.graph_json(spark, a.new))
        _show(summary)
        return int(a.fail_on_change and not summary.where("change <> 'same'").isEmpty())
    g = sources.graph_json(spark, a.graph)
    match a.command:
        case "stats":
            _show(analytics.counts(g.nodes, "type"))
            _show(analytics.counts(g.edges, "rel"))
            _show(analytics.top_hubs(g))
        case "validate":
            o = Ontology.from_toml(a.ontology, DEFAULT) if a.ontology else DEFAULT
            bad = merge.problems(g.nodes, g.edges, [*o.entity_types, *o.context_types], list(o.context_types), list(o.context_relations))
            _show(bad)
            return int(not bad.isEmpty())
        case "convert":
            if a.format in ("csv", "neo4j", "parquet"):
                {"csv": sinks.csv, "neo4j": sinks.neo4j_csv, "parquet": sinks.parquet}[a.format](g, a.out)
            else:
                lines = {"graphml": sinks.graphml_lines, "gexf": sinks.gexf_lines, "turtle": sinks.turtle_lines, "cypher": sinks.cypher_lines}[a.format](g)
                sinks.single_file(lines, a.out)
        case "context":
            if a.algorithm == "hybrid":
                _show(search.hybrid(g, a.entity, a.top_k)[0])
            elif (found := context.ego(g, a.entity, a.algorithm, a.top_k, a.depth, a.alpha)) is None:
                print(json.dumps({"error": f"no node {a.entity!r}"}))
                return 1
            else:
                _show(found.nodes.select("id", "label", "type"))
                _show(found.edges.select("src", "rel", "dst"))
        case "tile":
            placed = layout.circle(merge.with_degree(g.nodes, g.edges)).select("id", "px", "py", "degree")
            sinks.tiles(*layout.tiles(placed, g.edges, a.max_zoom), a.out_dir)
        case "as-of":
            _put(filters.as_of(g, a.date), a.out)
        case "audit":
            _show(analytics.audit(g))
        case "analyze":
            _show(analytics.topology(g))
        case "migrate":
            _put(filters.migrate(g, _toml(a.migration)["migration"]), a.out)
        case "infer":
            said = g.edges.select(F.col("dst").alias("entity"), "doc")
            _show(derive.cooccurrence(said, g.edges, a.threshold, a.min_docs))
        case "cluster":
            _show(analytics.cluster_summary(g, analytics.louvain(g, a.resolution)))
        case "rag":
            print(context.as_markdown(context.retrieve(g, a.query, a.k_hops, a.token_budget), a.token_budget))
        case "query":
            kind, rows = context.answer(g, a.ask)
            print(json.dumps({"intent": kind}))
            _show(rows)
        case "sparql":
            _show(sparql.execute(g, a.query))
        case "lint":
            r = _toml(a.rules) if a.rules else {}
            bad = govern.lint(g, [(x.get("source"), x.get("rel"), x.get("target")) for x in r.get("forbidden", [])], [(x["type"], x["attribute"]) for x in r.get("required", [])], r.get("acyclic", []), r.get("max_degree", 50))
            _show(bad)
            return int(not bad.where("severity = 'error'").isEmpty())
        case "redact":
            _put(filters.redact(g, a.role), a.out)
        case "layout":
            dims = 3 if a.three else 2
            _show(layout.multiscale(g, a.iterations, dims) if a.multiscale else layout.force(g, a.iterations, dimensions=dims, theta=a.theta))
        case "serve-api":
            servers.http_server(servers.Service(g), a.host, a.port).serve_forever()
        case "serve-mcp":
            servers.Tools(servers.Service(g)).serve()
        case "publish":
            pages.publish(g, a.out_dir, a.title)
        case "export":
            if a.format == "duckdb":
                sinks.duckdb_file(g, a.out)
            else:
                lines = pages.svg_lines(*pages.drawn(g)) if a.format == "svg" else {"turtle": sinks.turtle_lines, "cypher": sinks.cypher_lines}[a.format](g)
                sinks.single_file(lines, a.out)
        case "export-obsidian":
            if a.canvas:
                Path(a.canvas).write_text(json.dumps(sinks.canvas(g), ensure_ascii=False, indent=1), encoding="utf-8")
            if a.vault:
                sinks.write_notes(sinks.vault_notes(g), a.vault)
        case "index-pagefind":
            sinks.write_notes(sinks.page_html(g), a.out_dir)
        case "search":
            _show(search.viewer_search(g.nodes, a.query, a.limit))
    return 0


if __name__ == "__main__":
    sys.exit(main())
