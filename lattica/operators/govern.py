"""Governance: shapes, lint, difference and delta of graphs, incremental upkeep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.analytics import nodes_in_cycles
from lattica.operators.merge import endpoints, with_degree
from lattica.schema import Graph, given


@dataclass(frozen=True)
class NodeShape:
    type: str
    required: tuple[str, ...] = ()
    least_degree: int | None = None
    most_degree: int | None = None
    patterns: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class EdgeShape:
    rel: str
    domain: tuple[str, ...] = ()
    range: tuple[str, ...] = ()
    least_confidence: float | None = None
    most_count: int | None = None
    least_count: int | None = None


def _value(name: str, columns: list[str]):
    return given(F.col(name).cast("string")) if name in columns else given(F.try_element_at("meta", F.lit(name)))


def validate_shapes(graph: Graph, nodes: list[NodeShape], edges: list[EdgeShape]) -> DataFrame:
    """(subject, problem) of every violation; a missing confidence passes."""
    n = with_degree(graph.nodes, graph.edges)
    found = graph.nodes.sparkSession.createDataFrame([], "subject string, problem string")
    for s in nodes:
        checks = [F.when(_value(r, n.columns).isNull(), F.lit(f"missing {r}")) for r in s.required]
        checks += [F.when(F.col("degree") < s.least_degree, F.lit("degree too small"))] if s.least_degree is not None else []
        checks += [F.when(F.col("degree") > s.most_degree, F.lit("degree too large"))] if s.most_degree is not None else []
        checks += [F.when(~_value(c, n.columns).rlike(p), F.lit(f"{c} does not match")) for c, p in s.patterns]
        if checks:
            found = found.unionByName(n.where(F.col("type") == s.type).select(F.col("id").alias("subject"), F.explode(F.array_compact(F.array(*checks))).alias("problem")))
    kinds = graph.nodes.select("id", "type")
    for s in edges:
        e = graph.edges.where(F.col("rel") == s.rel)
        ends = e.join(kinds.select(F.col("id").alias("src"), F.col("type").alias("st")), "src", "left").join(kinds.select(F.col("id").alias("dst"), F.col("type").alias("dt")), "dst", "left")
        checks = [F.when(~F.col("st").isin(*s.domain), F.lit("wrong domain"))] if s.domain else []
        checks += [F.when(~F.col("dt").isin(*s.range), F.lit("wrong range"))] if s.range else []
        checks += [F.when(F.col("confidence") < s.least_confidence, F.lit("low confidence"))] if s.least_confidence is not None else []
        if checks:
            found = found.unionByName(ends.select(F.concat_ws(" ", "src", "rel", "dst").alias("subject"), F.explode(F.array_compact(F.array(*checks))).alias("problem")))
        if s.most_count is not None or s.least_count is not None:
            per = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
            if s.most_count is not None:
                found = found.unionByName(per.where(F.col("n") > s.most_count).select(F.col("src").alias("subject"), F.lit(f"too many {s.rel}").alias("problem")))
            if s.least_count is not None and s.domain:
                own = kinds.where(F.col("type").isin(*s.domain)).join(per.withColumnRenamed("src", "id"), "id", "left")
                found = found.unionByName(own.where(F.coalesce("n", F.lit(0)) < s.least_count).select(F.col("id").alias("subject"), F.lit(f"too few {s.rel}").alias("problem")))
    return found


def lint(graph: Graph, forbidden: list[tuple[str | None, str | None, str | None]] = (), required: list[tuple[str, str]] = (), acyclic: list[str] = (), max_degree: int | None = 50) -> DataFrame:
    """(severity, rule, subject); in a forbidden edge (source type, relation, target type) None fits all."""
    out = graph.nodes.sparkSession.createDataFrame([], "severity string, rule string, subject string")
    kinds = graph.nodes.select("id", "type")
    ends = graph.edges.join(kinds.select(F.col("id").alias("src"), F.col("type").alias("st")), "src").join(kinds.select(F.col("id").alias("dst"), F.col("type").alias("dt")), "dst")
    for s, r, d in forbidden:
        hit = F.lit(True)
        for c, v in (("st", s), ("rel", r), ("dt", d)):
            hit = hit & (F.col(c) == v) if v is not None else hit
        out = out.unionByName(ends.where(hit).select(F.lit("error").alias("severity"), F.lit("forbidden edge").alias("rule"), F.concat_ws(" ", "src", "rel", "dst").alias("subject")))
    for kind, name in required:
        value = given(F.try_element_at("meta", F.lit(name)))
        value = F.coalesce(given(F.col(name).cast("string")), value) if name in graph.nodes.columns else value
        out = out.unionByName(graph.nodes.where((F.col("type") == kind) & value.isNull()).select(F.lit("error").alias("severity"), F.lit(f"required {name}").alias("rule"), F.col("id").alias("subject")))
    for rel in acyclic:
        out = out.unionByName(nodes_in_cycles(graph.edges.where(F.col("rel") == rel)).select(F.lit("error").alias("severity"), F.lit(f"cycle in {rel}").alias("rule"), F.col("id").alias("subject")))
    if max_degree is not None:
        out = out.unionByName(with_degree(graph.nodes, graph.edges).where(F.col("degree") > max_degree).select(F.lit("warning").alias("severity"), F.lit("degree").alias("rule"), F.col("id").alias("subject")))
    return out


def _signature(df: DataFrame, without: tuple[str, ...]) -> DataFrame:
    return df.withColumn("_sig", F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in without))), 256))


def diff_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): added, removed, changed or same; degree and order do not count."""
    a = _signature(old, ("degree", "ord")).select("id", F.col("_sig").alias("x"))
    b = _signature(new, ("degree", "ord")).select("id", F.col("_sig").alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed").otherwise("same")
    return a.join(b, "id", "full").select("id", change.alias("change"))


def diff_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(src, rel, dst, scope, change): by key; ``changed`` tells attribute changes apart from ``same``."""
    key = ["src", "rel", "dst", "scope"]
    keyed = lambda df: df.withColumn("scope", F.coalesce("scope", F.lit("")))
    a = _signature(keyed(old), ("ord",)).select(*key, F.col("_sig").alias("x"))
    b = _signature(keyed(new), ("ord",)).select(*key, F.col("_sig").alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") != F.col("y"), "changed").otherwise("same")
    return a.join(b, key, "full").select(*key, change.alias("change"))


def diff_summary(old: Graph, new: Graph) -> DataFrame:
    n = diff_nodes(old.nodes, new.nodes).groupBy(F.lit("node").alias("kind"), "change").agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(diff_edges(old.edges, new.edges).groupBy(F.lit("edge").alias("kind"), "change").agg(F.count(F.lit(1)).alias("n")))


def diff_view(old: Graph, new: Graph, mode: str = "changed") -> DataFrame:
    """Edges of a kind of change whose ends are both shown; ``changed`` holds added and removed as well."""
    shown = diff_nodes(old.nodes, new.nodes)
    keep = ("added", "removed", "changed") if mode == "changed" else (mode,)
    ids = shown.where(F.col("change").isin(*keep)).select("id")
    e = diff_edges(old.edges, new.edges).where(F.col("change").isin(*keep))
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def apply_delta(graph: Graph, removed_nodes: DataFrame, put_nodes: DataFrame, removed_edges: DataFrame, put_edges: DataFrame) -> Graph:
    """Remove, then put: rows of the same key are replaced."""
    nodes = graph.nodes.join(removed_nodes.select("id").union(put_nodes.select("id")), "id", "left_anti").select(*graph.nodes.columns).unionByName(put_nodes)
    key = ["src", "rel", "dst"]
    edges = graph.edges.join(removed_edges.select(*key).union(put_edges.select(*key)), key, "left_anti").select(*graph.edges.columns).unionByName(put_edges)
    return Graph(nodes, edges)


def updated_degrees(degrees: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(id, degree) after edges came and went; never below 0."""
    delta = endpoints(added).withColumn("d", F.lit(1)).union(endpoints(removed).withColumn("d", F.lit(-1))).groupBy("id").agg(F.sum("d").alias("d"))
    return degrees.join(delta, "id", "left").select("id", F.greatest(F.lit(0), F.col("degree") + F.coalesce("d", F.lit(0))).cast("bigint").alias("degree"))


def affected_communities(touched: DataFrame, assignment: DataFrame) -> DataFrame:
    return assignment.join(touched.select("id"), "id", "left_semi").select("community").distinct()
