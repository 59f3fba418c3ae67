"""Questions over a graph: intents, neighbourhood context, retrieval for generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lattica.functions import text as T
from lattica.operators.analytics import distances, pagerank, shortest_path_edges, undirected
from lattica.operators.merge import drop_dangling, with_degree
from lattica.schema import Graph

#: Keywords of each intent, in order of precedence (fixed values).
INTENTS = (
    ("path", ("path", "connect", "link between", "route")),
    ("comparison", ("compare", "versus", "vs", "difference")),
    ("dependencies", ("depend", "require", "uses")),
    ("hubs", ("hub", "central", "important", "most connected")),
)


def intent(question: str) -> str:
    q = question.lower()
    return next((name for name, words in INTENTS if any(w in q for w in words)), "connections")


def spotted(nodes: DataFrame, question: str) -> list[tuple[str, str]]:
    """(id, label) of entities named in the question: longest label first, a found label is blanked out."""
    q = question.lower()
    named = nodes.where(F.lit(q).contains(F.lower("label")) & (F.length("label") > 0)).select("id", "label").orderBy(F.desc(F.length("label")), "id")
    out = []
    for r in named.toLocalIterator():  # labels within one question
        if r["label"].lower() in q:
            out.append((r["id"], r["label"]))
            q = q.replace(r["label"].lower(), " ")
    return out


def neighbours_of(graph: Graph, node: str) -> DataFrame:
    e = graph.edges
    near = e.where(F.col("src") == node).select(F.col("dst").alias("id")).union(e.where(F.col("dst") == node).select("src")).distinct()
    return graph.nodes.select("id", "label", "type").join(near, "id", "left_semi")


def answer(graph: Graph, question: str) -> tuple[str, DataFrame]:
    """(intent, rows) of a question."""
    kind, found = intent(question), spotted(graph.nodes, question)
    if kind == "path" and len(found) >= 2:
        return kind, shortest_path_edges(graph, found[0][0], found[1][0])
    if kind == "comparison":
        e = graph.edges
        if len(found) >= 2:
            pair = [found[0][0], found[1][0]]
            return kind, e.where(F.col("src").isin(*pair) & F.col("dst").isin(*pair)).select("src", "rel", "dst")
        return kind, e.where(F.lower("rel").contains("compare")).select("src", "rel", "dst")
    if kind == "hubs":
        return kind, with_degree(graph.nodes, graph.edges).orderBy(F.desc("degree"), "id").limit(10).select("id", "label", "degree")
    if found:
        return kind, neighbours_of(graph, found[0][0])
    return kind, graph.nodes.orderBy("ord", "id").limit(5).select("id", "label", "type")


def lookup(nodes: DataFrame, entity: str) -> str | None:
    """A node by id, by ``entity:`` and id, or by label in any case; the first in node order."""
    rank = F.when(F.col("id") == entity, 0).when(F.col("id") == f"entity:{entity}", 1).otherwise(2)
    row = nodes.where((F.col("id") == entity) | (F.col("id") == f"entity:{entity}") | (F.lower("label") == entity.lower())).orderBy(rank, "ord", "id").select("id").first()
    return row["id"] if row else None


def ego(graph: Graph, entity: str, algorithm: str = "ppr", k: int = 20, depth: int = 1, alpha: float = 0.15) -> Graph | None:
    """The entity, its neighbours, and by ``ppr`` the ``k`` best others or by ``bfs`` a second ring; edges among them."""
    seed = lookup(graph.nodes, entity)
    if seed is None:
        return None
    spark = graph.nodes.sparkSession
    chosen = neighbours_of(graph, seed).select("id").union(spark.createDataFrame([(seed,)], "id string"))
    if algorithm == "ppr":
        best = pagerank(graph, [seed], alpha).where(F.col("id") != seed).orderBy(F.desc("score"), "id").limit(k)
        chosen = chosen.union(best.select("id"))
    elif depth >= 2:
        chosen = chosen.union(distances(undirected(graph.edges, graph.nodes), spark.createDataFrame([(seed, seed)], "source string, id string"), depth=2).select("id"))
    nodes = graph.nodes.join(chosen.distinct(), "id", "left_semi")
    return Graph(nodes, drop_dangling(graph.edges, nodes))


def evidence(edges: DataFrame) -> DataFrame:
    return edges.where("doc is not null").select("doc").distinct().orderBy("doc")


def seeds(nodes: DataFrame, question: str, k: int = 5) -> DataFrame:
    """Nodes by their best score over label, aliases and 0.7 of the description; above 0.1."""
    alias = F.aggregate(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: T.question_score(question, a)), F.lit(0.0), lambda m, x: F.greatest(m, x))
    score = F.greatest(T.question_score(question, F.col("label")), alias, 0.7 * T.question_score(question, F.try_element_at("meta", F.lit("description"))))
    return nodes.select("id", "label", score.alias("score")).where("score > 0.1").orderBy(F.desc("score"), "id").limit(k)


def within_budget(lines: DataFrame, room: Column, before: Column, by: tuple[str, ...], most: int) -> DataFrame:
    """Lines in order with ``used``, the characters in front of them, while they fit into ``room``; stops at the first that does not.

    ``most`` bounds how many lines can fit at all, so no more than that are ranked together.
    """
    size = F.length("line") + 1
    total = F.sum(size).over(W.orderBy(*by).rowsBetween(W.unboundedPreceding, W.currentRow))
    first = lines.orderBy(*by).limit(most)
    return first.withColumn("used", before + total - size).where(F.col("used") + F.length("line") <= room)


HEADINGS = ("### Relevant Entities", "\n### Graph Relations")


def retrieve(graph: Graph, question: str, hops: int = 2, budget: int = 2000) -> DataFrame:
    """(part, depth, id, line, used): node and edge lines around the question's seeds under a token budget.

    Four characters count as a token.  Headings and node lines may fill half of the
    budget; edge lines follow until nine tenths are full, so few nodes leave room for more edges.
    """
    spark = graph.nodes.sparkSession
    start = [(r["id"], r["id"]) for r in seeds(graph.nodes, question).collect()]  # five at most
    if not start:
        start = [(r["id"], r["id"]) for r in graph.nodes.orderBy("ord", "id").limit(1).collect()]
    adj = undirected(graph.edges, graph.nodes)
    near = distances(adj, spark.createDataFrame(start, "source string, id string"), hops).groupBy("id").agg(F.min("distance").alias("depth"))
    description = F.try_element_at("meta", F.lit("description"))
    line = F.concat(F.lit("- **"), F.coalesce("label", "id"), F.lit("** ("), F.coalesce("type", F.lit("Unknown")), F.lit(")"), F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(": "), description)).otherwise(""))
    nodes = graph.nodes.join(near, "id").select(F.lit("node").alias("part"), "depth", "id", line.alias("line"))
    inner = near.where(F.col("depth") < hops)
    touching = graph.edges.join(inner.select(F.col("id").alias("src"), F.col("depth").alias("ds")), "src", "left").join(inner.select(F.col("id").alias("dst"), F.col("depth").alias("dd")), "dst", "left").where("ds is not null or dd is not null")
    names = graph.nodes.select("id", F.coalesce("label", "id").alias("name"))
    for end in ("src", "dst"):
        touching = touching.join(names.withColumnsRenamed({"id": end, "name": f"{end}_name"}), end, "left")
    said = F.concat(F.lit("- `"), F.coalesce("src_name", "src"), F.lit("` --["), F.coalesce("rel", F.lit("related_to")), F.lit("]--> `"), F.coalesce("dst_name", "dst"), F.lit("`"))
    edges = touching.select(F.lit("edge").alias("part"), F.least("ds", "dd").alias("depth"), F.concat_ws(" ", "src", "rel", "dst").alias("id"), said.alias("line"))
    chars, by = 4 * budget, ("depth", "id")
    head = len(HEADINGS[0]) + 1
    kept = within_budget(nodes, F.lit(0.5 * chars), F.lit(head), by, chars)
    filled = F.broadcast(kept.agg((F.coalesce(F.max(F.col("used") + F.length("line") + 1), F.lit(head)) + len(HEADINGS[1]) + 1).alias("_filled")))  # one row
    more = within_budget(edges.join(filled), F.lit(0.9 * chars), F.col("_filled"), by, chars).drop("_filled")
    return kept.unionByName(more)


def as_markdown(rows: DataFrame, budget: int = 2000) -> str:
    """The lines of a retrieval, which its budget bounds."""
    got = rows.orderBy(F.desc("part"), "depth", "id").collect()
    part = lambda name: [r["line"] for r in got if r["part"] == name]
    text = "\n".join([HEADINGS[0], *part("node"), HEADINGS[1], *part("edge")])
    return text if len(text) <= 4 * budget else text[: 4 * budget] + "\n... (truncated for token budget)"
