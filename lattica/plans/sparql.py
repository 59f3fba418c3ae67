"""SPARQL basic graph patterns as a plan of joins.

The query is parsed on the driver; each pattern becomes a filter and a projection of
the triples, and shared variables become equi-joins, which Catalyst orders and pushes
down.  A variable used twice in one pattern must be equal in both places.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.schema import Graph


def triples(graph: Graph, colon_relations: bool = False) -> DataFrame:
    """(s, p, o): types, labels and edges; with ``colon_relations`` edges once more under ``:rel``."""
    n, e = graph.nodes, graph.edges
    parts = [
        n.select(F.col("id").alias("s"), F.lit("a").alias("p"), F.col("type").alias("o")),
        n.select("id", F.lit("rdf:type"), "type"),
        n.select("id", F.lit("rdfs:label"), "label"),
        e.select("src", "rel", "dst"),
    ]
    if colon_relations:
        parts.append(e.select("src", F.concat(F.lit(":"), F.col("rel")), "dst"))
    return reduce(DataFrame.union, parts).where("s is not null and p is not null and o is not null")


def parse(query: str) -> tuple[list[str], list[tuple[str, str, str]]]:
    """(variables, patterns); no variables stand for all of them."""
    m = re.search(r"select\s+(distinct\s+)?(?P<vars>.*?)\s*(where)?\s*\{(?P<body>.*)\}", query, re.I | re.S)
    if not m:
        raise ValueError("a query reads SELECT ?x ... WHERE { s p o . ... }")
    names = [v.lstrip("?") for v in m["vars"].split() if v != "*"]
    terms = re.compile(r"\"([^\"]*)\"|<([^>]*)>|([^\s\"<>]+?)(?=\s|$|\.\s|\.$)|(\.)")
    patterns: list[tuple[str, str, str]] = []
    row: list[str] = []
    for t in terms.finditer(m["body"].strip() + " "):
        value = next((g for g in t.groups()[:3] if g is not None), None)
        if value is None or value == ".":
            continue
        row.append(value)
        if len(row) == 3:
            patterns.append((row[0], row[1], row[2]))
            row = []
    if row:
        raise ValueError(f"incomplete pattern {' '.join(row)!r}")
    return names, patterns


def _constant(term: str) -> str:
    return term[1:] if term.startswith(":") else term


def execute(graph: Graph, query: str, colon_relations: bool = False) -> DataFrame:
    """Distinct bindings; variables that no pattern binds are left out."""
    names, patterns = parse(query)
    t = triples(graph, colon_relations)
    plans: list[DataFrame] = []
    # patterns with more constants first, so that small sides are joined early
    for pattern in sorted(patterns, key=lambda p: sum(x.startswith("?") for x in p)):
        cond, columns = F.lit(True), {}
        for place, term in zip(("s", "p", "o"), pattern):
            if not term.startswith("?"):
                cond = cond & (F.col(place) == _constant(term))
            elif term[1:] in columns:
                cond = cond & (F.col(place) == F.col(columns[term[1:]]))
            else:
                columns[term[1:]] = place
        plans.append(t.where(cond).select(*[F.col(c).alias(v) for v, c in columns.items()]).distinct())
    # join in an order that shares variables wherever possible; patterns of constants alone are tests, at the end
    plans.sort(key=lambda p: not p.columns)
    out = plans.pop(0)
    while plans:
        i = next((i for i, p in enumerate(plans) if set(p.columns) & set(out.columns)), 0)
        p = plans.pop(i)
        shared = [c for c in p.columns if c in out.columns]
        if shared:
            out = out.join(p, shared)
        elif not p.columns:  # a pattern of constants is a test
            out = out.withColumn("_k", F.lit(1)).join(p.select(F.lit(1).alias("_k")).limit(1), "_k").drop("_k")
        else:
            raise ValueError("patterns share no variable; the result would be a product of both")
    wanted = [n for n in names if n in out.columns] or out.columns
    return out.select(*wanted).distinct()
