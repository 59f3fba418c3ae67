"""Ways through a graph: paths by waypoints, guided routes, playback in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lattica.iterate import cut
from lattica.operators.analytics import distances, undirected
from lattica.operators.filters import as_of
from lattica.operators.merge import with_degree
from lattica.schema import Graph


def by_waypoints(graph: Graph, stops: list[str]) -> DataFrame:
    """(leg, step, id): a shortest path through ``stops`` in their order; on ties the least ids.

    All legs are searched at once from their ends; a leg without a path gives no rows.
    """
    spark = graph.nodes.sparkSession
    adj = cut(undirected(graph.edges, graph.nodes))
    legs = list(zip(stops, stops[1:]))
    to_end = distances(adj, spark.createDataFrame([(str(i), b) for i, (_, b) in enumerate(legs)], "source string, id string"))
    left = {(r["source"], r["id"]): r["distance"] for r in to_end.join(spark.createDataFrame([(str(i), a) for i, (a, _) in enumerate(legs)], "source string, id string"), ["source", "id"]).collect()}
    at = spark.createDataFrame([(i, 0, a) for i, (a, _) in enumerate(legs) if (str(i), a) in left], "leg int, step int, id string")
    out, longest = [at], max(left.values(), default=0)
    ring = to_end.select(F.col("source").cast("int").alias("leg"), F.col("id").alias("v"), "distance")
    for step in range(1, longest + 1):
        goal = spark.createDataFrame([(int(i), d - step) for (i, _), d in left.items() if d >= step], "leg int, distance int")
        at = cut(at.select("leg", F.col("id").alias("u")).join(adj, "u").join(ring.join(goal, ["leg", "distance"]), ["leg", "v"]).groupBy("leg").agg(F.min("v").alias("id")).select("leg", F.lit(step).alias("step"), "id"))
        out.append(at)
    return reduce(DataFrame.unionByName, out)


def guided(graph: Graph, strategy: str = "centrality", start: str | None = None, relation: str | None = None, clusters: DataFrame | None = None, most: int = 30, hops: int = 40) -> DataFrame:
    """(step, id): a tour of a graph.

    ``centrality`` visits the best connected nodes; ``cluster`` the best connected
    of each cluster (id, community); ``edges`` and ``relation`` walk from ``start``, to the best
    connected neighbour not yet seen, over edges of ``relation`` where there are any, and from a
    dead end to the best connected node left.  Ties go to the least id.
    """
    hubs = with_degree(graph.nodes, graph.edges).select("id", "degree")
    if strategy in ("centrality", "cluster"):
        if strategy == "cluster":
            first = hubs.join(clusters, "id").groupBy("community").agg(F.min(F.struct((-F.col("degree")).alias("d"), "id")).alias("x")).select("x.id", (-F.col("x.d")).alias("degree"))
        else:
            first = hubs
        top = first.orderBy(F.desc("degree"), "id").limit(most if strategy == "centrality" else 1000)
        return top.withColumn("step", F.row_number().over(W.orderBy(F.desc("degree"), "id")) - 1).select("step", "id")  # at most ``most`` rows
    spark = graph.nodes.sparkSession
    named = graph.edges.where(F.col("rel") == relation) if strategy == "relation" and relation else None
    adj = cut(undirected(graph.edges, graph.nodes).join(hubs.withColumnsRenamed({"id": "v", "degree": "weight"}), "v"))
    preferred = cut(undirected(named, graph.nodes).select("u", "v")) if named is not None else None
    best = lambda df: (r := df.orderBy(F.desc("weight"), "id").first()) and r["id"]
    here = start or best(hubs.select("id", F.col("degree").alias("weight")))
    route = [] if here is None else [here]
    for _ in range(hops if here else 0):  # a tour has a few dozen stops
        near = adj.where((F.col("u") == here) & ~F.col("v").isin(*route)).select(F.col("v").alias("id"), "weight", "u")
        here = best(near.join(preferred.withColumnRenamed("v", "id"), ["u", "id"], "left_semi")) if preferred is not None else None
        here = here or best(near) or best(hubs.where(~F.col("id").isin(*route)).select("id", F.col("degree").alias("weight")))
        if here is None:
            break
        route.append(here)
    return spark.createDataFrame(list(enumerate(route)), "step int, id string")


def playback(graph: Graph, dates: list[str]) -> list[tuple[str, Graph]]:
    """The graph as of each date, in order: the frames of a timeline."""
    return [(d, as_of(graph, d)) for d in sorted(dates)]


def frame_changes(graph: Graph, dates: list[str]) -> DataFrame:
    """(date, kind, id, change): what comes and goes from one frame to the next; the first frame's rows come."""
    frames = playback(graph, dates)
    keyed = lambda g: g.nodes.select(F.lit("node").alias("kind"), "id").unionByName(g.edges.select(F.lit("edge").alias("kind"), F.concat_ws(" ", "src", "rel", "dst").alias("id"))).distinct()
    parts, before = [], None
    for date, g in frames:
        now = keyed(g)
        if before is None:
            parts.append(now.select(F.lit(date).alias("date"), "kind", "id", F.lit("added").alias("change")))
        else:
            parts.append(now.join(before, ["kind", "id"], "left_anti").select(F.lit(date).alias("date"), "kind", "id", F.lit("added").alias("change")))
            parts.append(before.join(now, ["kind", "id"], "left_anti").select(F.lit(date).alias("date"), "kind", "id", F.lit("removed").alias("change")))
        before = now
    return reduce(DataFrame.unionByName, parts)
