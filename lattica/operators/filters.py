"""Row-level and subgraph operators: point in time, visibility, migration, lookups, viewer filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.merge import drop_dangling, drop_isolated
from lattica.schema import Graph, given


def valid_at(date: str, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Both ends count, a missing one is open; ISO dates compare as text."""
    return (given(start).isNull() | (given(start) <= date)) & (given(end).isNull() | (given(end) >= date))


def as_of(graph: Graph, date: str) -> Graph:
    nodes = graph.nodes.where(valid_at(date))
    return Graph(nodes, drop_dangling(graph.edges.where(valid_at(date)), nodes))


def visibility(col: str = "visibility", meta: bool = False) -> Column:
    found = F.coalesce(given(col), given(F.try_element_at("meta", F.lit("visibility")))) if meta else given(col)
    return F.lower(F.coalesce(found, F.lit("internal")))


@dataclass(frozen=True)
class Policy:
    """Role to (allowed visibilities, masked meta keys).  The roles are fixed values of the reference policy."""

    roles: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(
        default_factory=lambda: {
            "public": (("public",), ("email", "internal_url", "revenue", "owner_secret")),
            "internal": (("public", "internal"), ("owner_secret",)),
            "admin": (("public", "internal", "confidential", "restricted"), ()),
        }
    )

    def of(self, role: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        return self.roles.get(role, self.roles["public"])


def redact(graph: Graph, role: str, policy: Policy | None = None, drop_dangling_edges: bool = True) -> Graph:
    allowed, masked = (policy or Policy()).of(role)
    nodes = graph.nodes.where(visibility(meta=True).isin(*allowed))
    if masked:
        nodes = nodes.withColumn("meta", F.map_filter("meta", lambda k, _: ~k.isin(*masked)))
    edges = graph.edges.where(visibility().isin(*allowed))
    return Graph(nodes, drop_dangling(edges, nodes) if drop_dangling_edges else edges)


def redaction_audit(before: Graph, after: Graph) -> DataFrame:
    """(kind, initial, retained, redacted)."""
    rows = [
        df.select(F.lit(kind).alias("kind"), F.lit(i).alias("initial"), F.lit(1 - i).alias("retained"))
        for kind, a, b in (("edge", before.edges, after.edges), ("node", before.nodes, after.nodes))
        for df, i in ((a, 1), (b, 0))
    ]
    out = rows[0].union(rows[1]).union(rows[2]).union(rows[3]).groupBy("kind").agg(F.sum("initial").alias("initial"), F.sum("retained").alias("retained"))
    return out.withColumn("redacted", F.col("initial") - F.col("retained"))


def migrate(graph: Graph, steps: list[dict]) -> Graph:
    """Ordered steps: rename_type, rename_relation, drop_relation, drop_type, split_type; then isolated nodes go."""
    nodes, edges = graph.nodes, graph.edges
    for s in steps:
        op = s["op"]
        if op == "rename_type":
            nodes = nodes.withColumn("type", F.when(F.col("type") == s["from"], F.lit(s["to"])).otherwise(F.col("type")))
        elif op == "rename_relation":
            edges = edges.withColumn("rel", F.when(F.col("rel") == s["from"], F.lit(s["to"])).otherwise(F.col("rel")))
        elif op == "drop_relation":
            edges = edges.where(F.col("rel") != s["name"])
        elif op == "drop_type":
            nodes = nodes.where(F.col("type") != s["name"])
            edges = drop_dangling(edges, nodes)
        elif op == "split_type":
            pairs = [F.lit(x) for kv in s["map"].items() for x in kv]
            chosen = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("id")), F.lit(s["default"]))
            nodes = nodes.withColumn("type", F.when(F.col("type") == s["from"], chosen).otherwise(F.col("type")))
        else:
            raise ValueError(f"unknown migration step {op!r}; known: drop_relation, drop_type, rename_relation, rename_type, split_type")
    return Graph(drop_isolated(nodes, edges), edges)


def search_nodes(nodes: DataFrame, query: str, type_filter: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Nodes whose id, label or aliases hold the query, in node order."""
    q = query.lower()
    hit = F.lower("id").contains(q) | F.lower("label").contains(q) | F.lower(F.coalesce(F.array_join("aliases", " "), F.lit(""))).contains(q)
    found = nodes.where(hit)
    if type_filter:
        found = found.where(F.col("type") == type_filter)
    return found.orderBy("ord", "id").offset(offset).limit(limit)


def filter_edges(edges: DataFrame, src: str | None = None, dst: str | None = None, rel: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    for name, value in (("src", src), ("dst", dst), ("rel", rel)):
        if value is not None:
            edges = edges.where(F.col(name) == value)
    if limit is None:
        return edges
    return edges.orderBy("ord", "src", "rel", "dst").offset(offset).limit(limit)


def node_detail(graph: Graph, node: str) -> DataFrame:
    """(direction, rel, other) around a node."""
    out = graph.edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), "rel", F.col("dst").alias("other"))
    return out.union(graph.edges.where(F.col("dst") == node).select(F.lit("in"), "rel", "src"))


def viewer(graph: Graph, types=None, relations=None, tiers=None, least: float | None = None, cutoff: str | None = None, hide_orphans: bool = False) -> Graph:
    """The visible subgraph; a missing confidence passes, all tiers are shown by default."""
    nodes, edges = graph.nodes, graph.edges
    if types is not None:
        nodes = nodes.where(F.col("type").isin(*types))
    if cutoff is not None:
        nodes = nodes.where(given("valid_from").isNull() | (given("valid_from") <= cutoff))
    if relations is not None:
        edges = edges.where(F.col("rel").isin(*relations))
    if tiers is not None:
        edges = edges.where(F.col("tier").isin(*tiers))
    if least is not None:
        edges = edges.where(F.col("confidence").isNull() | (F.col("confidence") >= least))
    edges = drop_dangling(edges, nodes)
    return Graph(drop_isolated(nodes, edges) if hide_orphans else nodes, edges)


PRESETS = {
    "everything": {},
    "no comparisons": {"without": ("COMPARES_TO",)},
    "structure": {"group": "Structure"},
    "concepts": {"group": "Concepts"},
}


def neighbours(graph: Graph, inverse_labels: dict[str, str] | None = None) -> DataFrame:
    """(id, rel, other): each edge from both ends; at its far end it may have an inverse label."""
    edges = graph.edges
    label = F.col("rel")
    for rel, back in (inverse_labels or {}).items():
        label = F.when(F.col("rel") == rel, F.lit(back)).otherwise(label)
    return edges.select(F.col("src").alias("id"), "rel", F.col("dst").alias("other")).union(edges.select("dst", label, "src"))


def entity_evidence(graph: Graph, entity_types: tuple[str, ...]) -> DataFrame:
    """(entity, page, tier): edges with exactly one entity end; per page the best tier wins."""
    kinds = graph.nodes.select("id", F.col("type").isin(*entity_types).alias("is_entity"))
    e = graph.edges.join(kinds.select(F.col("id").alias("src"), F.col("is_entity").alias("se")), "src").join(kinds.select(F.col("id").alias("dst"), F.col("is_entity").alias("de")), "dst").where("se <> de")
    rank = F.when(F.col("tier") == "curated", 0).when(F.col("tier") == "deterministic", 1).otherwise(2)
    pairs = e.select(F.when(F.col("se"), F.col("src")).otherwise(F.col("dst")).alias("entity"), F.when(F.col("se"), F.col("dst")).otherwise(F.col("src")).alias("page"), F.struct(rank.alias("r"), "tier").alias("t"))
    return pairs.groupBy("entity", "page").agg(F.min("t")["tier"].alias("tier"))


def canonical_inverse(edges: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """X INVERSE Y is written as Y REL X."""
    rel, turned = F.col("rel"), F.col("rel").isin(*inverse) if inverse else F.lit(False)
    for name, plain in inverse.items():
        rel = F.when(F.col("rel") == name, F.lit(plain)).otherwise(rel)
    return edges.withColumns({"src": F.when(turned, F.col("dst")).otherwise(F.col("src")), "dst": F.when(turned, F.col("src")).otherwise(F.col("dst")), "rel": rel})


def canonical_symmetric(edges: DataFrame, symmetric: tuple[str, ...]) -> DataFrame:
    both = F.col("rel").isin(*symmetric)
    return edges.withColumns({"src": F.when(both, F.least("src", "dst")).otherwise(F.col("src")), "dst": F.when(both, F.greatest("src", "dst")).otherwise(F.col("dst"))})
