"""Aggregates and graph analytics.

Components, distances, PageRank, communities and betweenness are loops of joins with a cut of
lineage in each round; articulation points, bridges and cycles are in ``connectivity``.  Only
``directed_cycles``, which lists cycles as depth-first search meets them, and
``label_propagation``, whose sweeps are sequential, run per connected component in groups of Arrow data;
these are meant for graphs whose components fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lattica.iterate import cut, numbered, table
from lattica.operators import connectivity
from lattica.operators.merge import endpoints, with_degree
from lattica.schema import Graph


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def top_hubs(graph: Graph, k: int = 10) -> DataFrame:
    return with_degree(graph.nodes, graph.edges).orderBy(F.desc("degree"), "id").limit(k).select("id", "label", "type", "degree")


def gini(values: DataFrame, column: str = "degree") -> DataFrame:
    """2 * sum(i * x_i) / (n * sum(x)) - (n + 1) / n over ascending x.

    Equal values share their ranks' sum, so only distinct values are ranked: as many rows as there are degrees.
    """
    by = values.groupBy(column).agg(F.count(F.lit(1)).cast("double").alias("c"))
    upto = F.sum("c").over(W.orderBy(column).rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = by.withColumn("hi", upto).withColumn("ranks", F.col("c") * (2 * F.col("hi") - F.col("c") + 1) / 2)
    n, total = F.sum("c"), F.sum(F.col(column) * F.col("c"))
    value = 2 * F.sum(F.col(column) * F.col("ranks")) / F.nullif(n * total, F.lit(0.0)) - (n + 1) / n
    return ranked.agg(F.coalesce(F.when(n > 1, value), F.lit(0.0)).alias("gini"))


def confidence_stats(edges: DataFrame, low: float = 0.7) -> DataFrame:
    c = F.coalesce("confidence", F.lit(1.0))
    return edges.agg(F.round(F.avg(c), 6).alias("mean"), F.count(F.when(c < low, 1)).alias("low"))


def contradictions(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.array_join(F.sort_array(F.collect_set("rel")), ",").alias("rels"), F.countDistinct("rel").alias("n")).where("n > 1")


def undirected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (u, v) in both directions, without loops."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src")).where("u <> v").distinct()
    if nodes is not None:
        ids = nodes.select("id")
        both = both.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi")
    return both.select("u", "v")


def weights(edges: DataFrame) -> DataFrame:
    """(u, v, w): confidences of parallel edges summed, in both directions; a loop counts twice."""
    src, dst = F.col("src"), F.col("dst")
    turned = F.coalesce(src > dst, dst.isNull() & src.isNotNull())
    # each pair is summed once, and then stands both ways
    pairs = edges.select(F.when(turned, dst).otherwise(src).alias("a"), F.when(turned, src).otherwise(dst).alias("b"), F.coalesce("confidence", F.lit(1.0)).alias("w"))
    pairs = pairs.groupBy("a", "b").agg(F.sum("w").alias("w"))
    way = lambda u, v, w: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), w.alias("w"))
    loop = F.col("a").eqNullSafe(F.col("b"))
    return pairs.select(F.inline(F.when(loop, F.array(way("a", "b", 2 * F.col("w")))).otherwise(F.array(way("a", "b", F.col("w")), way("b", "a", F.col("w"))))))


def components(graph: Graph) -> DataFrame:
    """(id, component): the least id that can be reached, by least neighbour and pointer jumping."""
    adj = cut(undirected(graph.edges, graph.nodes))
    labels = cut(graph.nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = adj.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("low"))
        moved = low.join(labels.select(F.col("id").alias("low"), F.col("component").alias("jump")), "low").select("id", "was", F.least("low", "jump").alias("component"))
        moved = cut(moved)
        labels = moved.select("id", "component")
        if moved.where("was <> component").isEmpty():
            return labels


def component_sizes(graph: Graph) -> DataFrame:
    return components(graph).groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def distances(adj: DataFrame, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """(source, id, distance) by frontier joins over (u, v), to ``depth`` or to the end; ``sources`` has (source, id).

    Each round is a table of its own, so what is found is never written again.
    """
    rings = [cut(sources.select("source", "id", F.lit(0).alias("distance")).distinct())]
    while depth is None or len(rings) <= depth:
        front = rings[-1]
        step = front.join(adj, front["id"] == adj["u"]).select("source", F.col("v").alias("id")).distinct()
        for ring in rings:
            step = step.join(ring.select("source", "id"), ["source", "id"], "left_anti")
        ring = cut(step.withColumn("distance", F.lit(len(rings))))
        if ring.isEmpty():
            break
        rings.append(ring)
    return reduce(DataFrame.unionByName, rings)


def shortest_path_edges(graph: Graph, start: str, end: str) -> DataFrame:
    """Undirected edges on any shortest path: d(start, u) + 1 + d(v, end) is the distance of the ends."""
    adj = cut(undirected(graph.edges, graph.nodes))
    spark = graph.nodes.sparkSession
    both = distances(adj, spark.createDataFrame([(start, start), (end, end)], "source string, id string"))
    a = both.where(F.col("source") == start).select(F.col("id").alias("u"), F.col("distance").alias("du"))
    b = both.where(F.col("source") == end).select(F.col("id").alias("v"), F.col("distance").alias("dv"))
    whole = both.where((F.col("source") == start) & (F.col("id") == end)).agg(F.min("distance").alias("hops"))
    return adj.join(a, "u").join(b, "v").join(F.broadcast(whole), F.col("du") + 1 + F.col("dv") == F.col("hops")).select("u", "v", "hops")


CUT_EVERY = 4


def pagerank(graph: Graph, seeds: list[str], alpha: float = 0.15, rounds: int = 40, tol: float = 1e-6) -> DataFrame:
    """(seed, id, score): personalised PageRank of all seeds at once; dangling mass goes back to the seed.

    Nodes of a single link to one neighbour always have the same shares of what they have together, so they go as one.
    """
    spark = graph.nodes.sparkSession
    ids = graph.nodes.select("id").distinct()
    adj = cut(weights(graph.edges))
    # nodes of one link hang on its other end in a bundle, named by the least of them: each has its share of the bundle's score
    alone = adj.groupBy("u").agg(F.count(F.lit(1)).alias("links"), F.min("v").alias("hub"), F.sum("w").alias("w")).where((F.col("links") == 1) & (F.col("w") > 0) & (F.col("hub") != F.col("u")) & ~F.col("u").isin(*seeds)).join(ids.withColumnRenamed("id", "u"), "u", "left_semi")
    bundles = alone.groupBy("hub").agg(F.min("u").alias("bundle"), F.sum("w").alias("all"), F.count(F.lit(1)).alias("held")).where("held > 1")
    leaves = cut(alone.join(bundles, "hub").select("u", "bundle", (F.col("w") / F.col("all")).alias("share")))
    strength = adj.groupBy("u").agg(F.sum("w").alias("total"))
    to = leaves.select("u", "bundle")
    every = adj.join(strength, "u").join(ids.withColumnRenamed("id", "v"), "v", "left_semi").select("u", "v", (F.col("w") / F.col("total")).alias("p"))
    named = every.join(to, "u", "left").where("bundle is null or bundle = u").drop("bundle").join(to.withColumnsRenamed({"u": "v"}), "v", "left")
    step = cut(named.groupBy("u", F.coalesce("bundle", "v").alias("v")).agg(F.sum("p").alias("p")))
    start = spark.createDataFrame([(s, s, 1.0) for s in seeds], "seed string, id string, score double").join(ids, "id", "left_semi").select("seed", "id", "score")
    moving = cut(strength.join(to.where("u <> bundle"), "u", "left_anti").select(F.col("u").alias("id")))
    score = cut(start)
    home = cut(start.select("seed", "id"))
    settled = score
    for n in range(1, rounds + 1):
        flow = score.join(step, score["id"] == step["u"]).groupBy("seed", F.col("v").alias("id")).agg(F.sum(F.col("score") * F.col("p") * (1 - alpha)).alias("score"))
        lost = score.join(moving, "id", "left_anti").groupBy("seed").agg(F.sum(F.col("score") * (1 - alpha)).alias("lost"))
        back = home.join(lost, "seed", "left").select("seed", "id", (F.coalesce("lost", F.lit(0.0)) + alpha).alias("score"))
        score = flow.unionByName(back).groupBy("seed", "id").agg(F.sum("score").alias("score"))
        if n % CUT_EVERY == 0 or n == rounds:  # a cut of lineage and a look at the change, once in several rounds
            score = cut(score)
            both = score.withColumnRenamed("score", "a").join(settled.withColumnRenamed("score", "b"), ["seed", "id"], "full")
            change = both.agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))).first()[0]
            if (change or 0.0) < tol:
                break
            settled = score
    spread = score.join(leaves.withColumnRenamed("bundle", "id"), "id", "left")
    return spread.select("seed", F.coalesce("u", "id").alias("id"), (F.col("score") * F.coalesce("share", F.lit(1.0))).alias("score"))


def density(graph: Graph) -> DataFrame:
    n, e = graph.nodes.agg(F.count(F.lit(1)).alias("n")), graph.edges.agg(F.count(F.lit(1)).alias("e"))
    both = n.withColumn("_k", F.lit(1)).join(e.withColumn("_k", F.lit(1)), "_k")
    pairs = F.col("n") * (F.col("n") - 1)
    return both.select(F.col("n").alias("nodes"), F.col("e").alias("edges"), F.round(F.coalesce(F.col("e") / F.nullif(pairs, F.lit(0)), F.lit(0.0)), 4).alias("density"), F.round(F.coalesce(2 * F.col("e") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)), 2).alias("avg_degree"))


def _grouped(graph: Graph, edges: DataFrame, function, schema: str) -> DataFrame:
    """``function`` over each connected component's edges (component, u, v, ...)."""
    comp = components(graph).withColumnRenamed("id", "u")
    return edges.join(comp, "u").groupBy("component").applyInPandas(function, schema)


def _adjacency(pdf: pd.DataFrame) -> dict[str, list[str]]:
    adj: dict[str, list[str]] = {}
    for u, v in sorted(set(zip(pdf["u"], pdf["v"]))):
        adj.setdefault(u, []).append(v)
    return adj


def with_numbers(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links (u, v) between longs, names (node, id)) of links between ids."""
    ids = links.select(F.col("u").alias("id")).union(links.select("v")).distinct()
    names = cut(ids.withColumn("node", F.monotonically_increasing_id()))
    at = lambda end: names.select(F.col("id").alias(end), F.col("node").alias(f"n{end}"))
    return cut(links.join(at("u"), "u").join(at("v"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))), names


def articulation_points(graph: Graph) -> DataFrame:
    """(id) of nodes without which their component falls apart."""
    links, names = with_numbers(undirected(graph.edges, graph.nodes))
    return connectivity.cut_points(links).join(names, "node").select("id")


def bridges(graph: Graph) -> DataFrame:
    """(a, b): unordered pairs without which their component falls apart; parallel edges count as one."""
    links, names = with_numbers(undirected(graph.edges, graph.nodes))
    at = lambda end, name: names.select(F.col("node").alias(end), F.col("id").alias(name))
    return connectivity.bridge_links(links).join(at("u", "x"), "u").join(at("v", "y"), "v").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def biconnected(graph: Graph) -> DataFrame:
    """(a, b, block): each link between distinct nodes and its biconnected component, named by a number."""
    links, names = with_numbers(undirected(graph.edges, graph.nodes))
    tree = connectivity.rooted(links)
    found = connectivity.blocks(links, tree)
    # a link is in the block of that of its nodes which comes later on the tour, or lies below the other
    place = tree.select("node", "first").join(found.select("node", "block"), "node")
    of = lambda end: place.select(F.col("node").alias(end), F.col("first").alias(f"{end}_first"), F.col("block").alias(f"{end}_block"))
    both = links.where("u < v").join(of("u"), "u", "left").join(of("v"), "v", "left")
    later = F.coalesce("u_first", F.lit(-1)) > F.coalesce("v_first", F.lit(-1))
    named = both.select("u", "v", F.when(later, F.col("u_block")).otherwise(F.col("v_block")).alias("block"))
    at = lambda end: names.select(F.col("node").alias(end), F.col("id").alias(f"i{end}"))
    return named.join(at("u"), "u").join(at("v"), "v").select(F.least("iu", "iv").alias("a"), F.greatest("iu", "iv").alias("b"), "block")


#: Relations that are read as a hierarchy (fixed values of the reference's audit).
HIERARCHY = ("TAXON_OF", "PART_OF", "SUBCLASS_OF", "COMPONENT_OF", "IMPLEMENTS", "EXTENDS", "DEPENDS_ON")


def directed_cycles(graph: Graph, relations: tuple[str, ...] = HIERARCHY) -> DataFrame:
    """(cycle): node lists of the back edges met by depth-first search in order of id."""
    chosen = graph.edges.where(F.col("rel").isin(*relations)).select(F.col("src").alias("u"), F.col("dst").alias("v"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adj = _adjacency(pdf)
        done: set[str] = set()
        found = []
        for root in sorted(adj):
            if root in done:
                continue
            path, place = [root], {root: 0}
            stack = [iter(adj[root])]
            while stack:
                v = next(stack[-1], None)
                if v is None:
                    stack.pop()
                    u = path.pop()
                    place.pop(u)
                    done.add(u)
                elif v in place:
                    found.append("->".join([*path[place[v] :], v]))
                elif v not in done:
                    place[v] = len(path)
                    path.append(v)
                    stack.append(iter(adj.get(v, ())))
        return pd.DataFrame({"cycle": found}, dtype="object")

    return _grouped(graph, chosen, run, "cycle string")


def cyclic_components(edges: DataFrame) -> DataFrame:
    """(id, component) of nodes on directed cycles (src, dst): nodes that reach each other share a component, named by the least id."""
    ends = edges.where("src is not null and dst is not null").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    links, names = with_numbers(ends)
    found = cut(connectivity.strong_components(links.toDF("src", "dst")).join(names, "node").select("id", "component"))
    return found.join(found.groupBy("component").agg(F.min("id").alias("least")), "component").select("id", F.col("least").alias("component"))


def nodes_in_cycles(edges: DataFrame) -> DataFrame:
    """(id) of nodes on a directed cycle."""
    return cyclic_components(edges).select("id")


def modularity(graph: Graph, assignment: DataFrame) -> DataFrame:
    """Over adjacent ordered pairs of one community: sum of w - d_u d_v / 2m, by 2m."""
    w = weights(graph.edges)
    d = w.groupBy("u").agg(F.sum("w").alias("d"))
    total = F.broadcast(w.agg(F.sum("w").alias("m2")))
    a = assignment.select(F.col("id"), F.col("community"))
    e = w.join(d, "u").join(d.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v").join(a.select(F.col("id").alias("u"), F.col("community").alias("cu")), "u").join(a.select(F.col("id").alias("v"), F.col("community").alias("cv")), "v").where("cu = cv").join(total)
    return e.agg(F.coalesce(F.sum((F.col("w") - F.col("d") * F.col("dv") / F.col("m2")) / F.col("m2")), F.lit(0.0)).alias("modularity"))


def _moves(w: DataFrame, state: DataFrame, m2: float, resolution: float, half: Column) -> DataFrame:
    """(node, degree, comm, moved) after the nodes of ``half`` have gone, all at once, to the community of the greatest gain.

    A node stays unless another gains more than its own; of equal gains the least community counts.
    """
    c = F.col
    state = state.hint("merge")  # each round would send a table to the driver to broadcast it
    totals = state.groupBy("comm").agg(F.sum("degree").alias("total")).hint("merge")
    near = w.where("u <> v").join(state.where(half).select(c("node").alias("u")).hint("merge"), "u", "left_semi").join(state.select(c("node").alias("v"), "comm").hint("merge"), "v").groupBy("u", "comm").agg(F.sum("w").alias("w"))
    own = state.where(half).select(c("node").alias("u"), "degree", c("comm").alias("own"))
    tried = near.unionByName(own.select("u", c("own").alias("comm"), F.lit(0.0).alias("w"))).groupBy("u", "comm").agg(F.sum("w").alias("w")).join(own.hint("merge"), "u").join(totals, "comm")
    gain = c("w") - resolution * c("degree") * (c("total") - F.when(c("comm") == c("own"), c("degree")).otherwise(0.0)) / m2
    best = tried.withColumn("gain", gain).groupBy("u").agg(F.max(F.when(c("comm") == c("own"), c("gain"))).alias("stay"), F.max(F.struct("gain", (-c("comm")).alias("least"))).alias("best"))
    goes = best.where(c("best.gain") > c("stay") + 1e-12).select(c("u").alias("node"), (-c("best.least")).alias("to"))
    return table(state.join(goes.hint("merge"), "node", "left").select("node", "degree", F.coalesce("to", "comm").alias("comm"), c("to").isNotNull().alias("moved")))


def _quality(w: DataFrame, state: DataFrame, m2: float, resolution: float) -> float:
    """Modularity by communities: their inner weight and the square of their total degree."""
    c = F.col
    at = lambda end: state.select(c("node").alias(end), c("comm").alias(f"c{end}")).hint("merge")
    inner = w.join(at("u"), "u").join(at("v"), "v").where("cu = cv").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    squares = state.groupBy("comm").agg(F.sum("degree").alias("t")).agg(F.coalesce(F.sum(c("t") * c("t")), F.lit(0.0))).first()[0]
    return inner / m2 - resolution * squares / (m2 * m2)


def louvain(graph: Graph, resolution: float = 1.0, sweeps: int = 10, levels: int = 10) -> DataFrame:
    """(id, community): modularity by local moves in alternating halves, then by contraction, until it no longer grows.

    Half of the nodes, drawn anew each time, decide at once from the communities of all; the other half
    follows.  When a sweep adds nothing, communities become nodes of a weighted graph and move
    in turn.  Communities are numbered by their first member's order.
    """
    c = F.col
    ids = table(graph.nodes.select("id", "ord").distinct().withColumn("node", F.monotonically_increasing_id()))
    at = lambda end: ids.select(c("id").alias(end), c("node").alias(f"n{end}")).hint("merge")
    w = table(weights(graph.edges).join(at("u"), "u").join(at("v"), "v").select(c("nu").alias("u"), c("nv").alias("v"), "w"))
    m2 = w.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    placed = ids.select("node", c("node").alias("comm"))
    for level in range(levels if m2 > 0 else 0):
        degree = w.groupBy(c("u").alias("node")).agg(F.sum("w").alias("degree"))
        own = placed.select(c("comm").alias("node")).distinct()
        state = table(own.join(degree.hint("merge"), "node", "left").select("node", F.coalesce("degree", F.lit(0.0)).alias("degree"), c("node").alias("comm")))
        best, before = state, _quality(w, state, m2, resolution)
        found = before
        for n in range(sweeps):
            side = F.pmod(F.xxhash64("node", F.lit(100 * level + n)), F.lit(2))
            first = _moves(w, state, m2, resolution, side == 0)
            second = _moves(w, first.drop("moved"), m2, resolution, side == 1)
            state = second.drop("moved")
            quality = _quality(w, state, m2, resolution)
            if quality <= found + 1e-9:
                break
            best, found = state, quality
        if found <= before + 1e-9:
            break
        to = best.select(c("node").alias("comm"), c("comm").alias("to")).hint("merge")
        placed = table(placed.join(to, "comm").select("node", c("to").alias("comm")))
        into = lambda end, to=to: to.select(c("comm").alias(end), c("to").alias(f"t{end}")).hint("merge")
        w = table(w.join(into("u"), "u").join(into("v"), "v").groupBy(c("tu").alias("u"), c("tv").alias("v")).agg(F.sum("w").alias("w")))
    named = placed.join(ids.hint("merge"), "node")
    firsts = named.groupBy("comm").agg(F.min(F.struct("ord", "id")).alias("first"))
    names = numbered(firsts, "first", name="community", start=0)
    return named.join(names.select("comm", "community").hint("merge"), "comm").select("id", F.col("community").cast("bigint").alias("community"))


def label_propagation(graph: Graph, sweeps: int = 4) -> DataFrame:
    """(id, community): sequential sweeps in node order, the most frequent neighbour label wins, ties to the first met."""
    order = graph.nodes.select(F.col("id").alias("u"), F.col("ord").alias("uo"))
    base = order.join(components(graph).withColumnRenamed("id", "u"), "u").join(undirected(graph.edges, graph.nodes), "u", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[["u", "uo"]].drop_duplicates().sort_values(["uo", "u"])["u"].tolist()
        near = {u: sorted(g["v"].dropna()) for u, g in pdf.groupby("u")}
        label = {u: u for u in nodes}
        for _ in range(sweeps):
            for u in nodes:
                tally: dict[str, int] = {}
                for v in near[u]:
                    tally[label[v]] = tally.get(label[v], 0) + 1
                if tally:
                    label[u] = max(tally, key=tally.get)
        return pd.DataFrame({"id": nodes, "community": [label[u] for u in nodes]})

    return base.groupBy("component").applyInPandas(run, "id string, community string")


#: Pairs of source and node that a batch of sources may reach.
PAIRS = 20_000_000


def betweenness(graph: Graph, pivots: int | None = None) -> DataFrame:
    """(id, score): unnormalised, each unordered pair counted twice; nodes without links are left out.

    Brandes by levels, for a batch of sources at once: counts of shortest paths go forward a ring at a time,
    dependencies come back.  With ``pivots`` only that many sources, drawn by hash, are taken, and scores are scaled to all.
    """
    c = F.col
    adj, names = with_numbers(undirected(graph.edges, graph.nodes))
    n = names.count()
    chosen = names if pivots is None or pivots >= n else names.orderBy(F.xxhash64("id"), "id").limit(pivots)
    count = n if pivots is None else min(n, pivots)
    # a source reaches its component, not all nodes
    comp = components(Graph(names.select(c("node").alias("id")), adj.toDF("src", "dst"))).withColumnRenamed("id", "node")
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    reached = chosen.join(comp, "node").groupBy("component").agg(F.count(F.lit(1)).alias("sources")).join(sizes, "component")
    pairs = reached.agg(F.coalesce(F.sum(c("sources") * c("size")), F.lit(0))).first()[0]
    batches = max(1, -(-pairs // PAIRS))
    chosen = table(chosen.select("node", F.pmod(F.xxhash64("node"), F.lit(batches)).alias("batch")))
    parts = []
    for batch in range(batches):
        rings = [table(chosen.where(c("batch") == batch).select(c("node").alias("s"), "node", F.lit(1.0).alias("paths")))]
        while True:
            front = rings[-1]
            step = front.join(adj, front["node"] == adj["u"]).groupBy("s", c("v").alias("node")).agg(F.sum("paths").alias("paths"))
            for ring in rings[-2:]:  # over undirected links a neighbour is in this ring, the one before or the next
                step = step.join(ring.select("s", "node"), ["s", "node"], "left_anti")
            step = table(step)
            if step.isEmpty():
                break
            rings.append(step)
        below = rings[-1].withColumn("share", F.lit(0.0))
        for ring in [*rings[-2::-1], None]:
            parts.append(below.where("s <> node").groupBy("node").agg(F.sum("share").alias("score")))
            if ring is None:
                break
            up = below.join(adj, below["node"] == adj["u"]).select("s", c("v").alias("node"), ((1 + c("share")) / c("paths")).alias("part")).groupBy("s", "node").agg(F.sum("part").alias("part"))
            below = table(ring.join(up, ["s", "node"], "left").select("s", "node", "paths", (c("paths") * F.coalesce("part", F.lit(0.0))).alias("share")))
    total = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("score").alias("score"))
    return names.join(total, "node", "left").select("id", (F.coalesce("score", F.lit(0.0)) * (n / count if count else 1.0)).alias("score"))


def cluster_summary(graph: Graph, assignment: DataFrame) -> DataFrame:
    """(community, size, top_types, hub): three commonest types, label of the member of the greatest weighted degree."""
    strength = weights(graph.edges).groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("d"))
    m = assignment.join(graph.nodes.select("id", "label", "type"), "id").join(strength, "id", "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    kinds = m.groupBy("community", "type").agg(F.count(F.lit(1)).alias("n"))
    ranked = kinds.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy(F.desc("n"), "type"))).where("r <= 3")
    tops = ranked.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "type"))), lambda x: x["type"]), ",").alias("top_types"))
    hubs = m.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("d")).alias("d"), "id", "label"))["label"].alias("hub"))
    return hubs.join(tops, "community")


def orphans(graph: Graph) -> DataFrame:
    return graph.nodes.select("id").join(endpoints(graph.edges), "id", "left_anti")


def health(orphan_share: Column, points: Column) -> Column:
    """100 less the share of orphans (to 40) and five for each articulation point (to 30)."""
    return F.floor(100 - F.least(F.lit(40.0), orphan_share * 100) - F.least(F.lit(30.0), 5.0 * points)).cast("bigint")


def topology(graph: Graph) -> DataFrame:
    """One row: sizes, density, components, orphans, articulation points, health."""
    one = lambda df, **named: df.agg(*[c.alias(k) for k, c in named.items()]).withColumn("_k", F.lit(1))
    parts = [
        density(graph).withColumn("_k", F.lit(1)),
        one(component_sizes(graph), components=F.count(F.lit(1)), largest=F.max("size")),
        one(orphans(graph), orphans=F.count(F.lit(1))),
        one(articulation_points(graph), points=F.count(F.lit(1))),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.join(p, "_k")
    share = F.coalesce(F.col("orphans") / F.nullif(F.col("nodes"), F.lit(0)), F.lit(0.0))
    return row.withColumn("health", health(share, F.col("points"))).drop("_k")


def audit(graph: Graph, relations: tuple[str, ...] = HIERARCHY) -> DataFrame:
    """One row: Gini, confidences, components, bridges, cycles, contradictions, health."""
    one = lambda df, **named: df.agg(*[c.alias(k) for k, c in named.items()]).withColumn("_k", F.lit(1))
    n = F.count(F.lit(1))
    parts = [
        gini(with_degree(graph.nodes, graph.edges)).select(F.round("gini", 3).alias("gini")).withColumn("_k", F.lit(1)),
        confidence_stats(graph.edges).select(F.round("mean", 3).alias("average_confidence"), F.col("low").alias("low_confidence"), F.lit(1).alias("_k")),
        one(component_sizes(graph), components=n, largest=F.coalesce(F.max("size"), F.lit(0))),
        one(bridges(graph), bridges=n),
        one(directed_cycles(graph, relations), cycles=n),
        one(contradictions(graph.edges), contradictions=n),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.join(p, "_k")
    least = lambda c, each, most: F.least(c * each, F.lit(most))
    penalty = least(F.col("cycles"), 10, 30) + F.when(F.col("components") > 1, least(F.col("components") - 1, 5, 20)).otherwise(0) + least(F.col("low_confidence"), 2, 20) + least(F.col("contradictions"), 5, 15)
    return row.withColumn("health", F.round(F.greatest(F.lit(0.0), 100.0 - penalty), 1)).drop("_k")


def centrality(graph: Graph, k: int = 7) -> DataFrame:
    """(measure, id, score): the first ``k`` by degree and by betweenness."""
    deg = with_degree(graph.nodes, graph.edges).select(F.lit("degree").alias("measure"), "id", F.col("degree").cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(k)
    mid = betweenness(graph).select(F.lit("betweenness").alias("measure"), "id", F.round("score", 1).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return deg.unionByName(mid)
