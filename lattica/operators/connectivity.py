"""Spanning forests, biconnectivity (articulation points, bridges, blocks) and strong components, as loops of joins.

Biconnectivity follows Tarjan and Vishkin, who need no depth-first order: any spanning forest
will do.  Its edges, taken both ways, are put on an Euler tour; list ranking by doubling gives
each arc its place, so a subtree is an interval of places.  The least and the greatest place that
an interval's nodes see over other edges decide which tree edges share a block, and blocks are the
components of that relation.

No step gathers a component or a node's neighbours in one task: neighbours are numbered over range
partitions, intervals are read from blocks of ``BLOCK`` places over as many levels as it takes.
Where only bridges or points are asked for, chains become single links and leaves go before that.
Rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.iterate import numbered
from lattica.iterate import table as cut

#: Places in a block of the interval tables.
BLOCK = 128


def _jumped(to: DataFrame) -> DataFrame:
    """(c, to) with ``to`` followed to its end; the map has no cycles."""
    while True:
        nxt = to.select(F.col("c").alias("to"), F.col("to").alias("beyond"))
        to = cut(to.join(nxt, "to", "left").select("c", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved")))
        if to.where("moved").isEmpty():
            return to.select("c", "to")
        to = to.select("c", "to")


def spanning_forest(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels (node, root), tree (u, v)) of undirected links (u, v); nodes are longs.

    In each round every component goes to its neighbour of the least random mark, if that is less than
    its own, and keeps the link as a tree edge; marks are new in each round.  What hangs together
    becomes one component, and of the links between two components one goes on.
    """
    c = F.col
    both = links.select("u", "v").union(links.select(c("v").alias("u"), c("u").alias("v"))).where("u <> v")
    left = cut(both.distinct().select(c("u").alias("cu"), c("v").alias("cv"), "u", "v"))
    labels = left.select(c("u").alias("node"), c("u").alias("root")).distinct()
    moves, trees, n = [], [], 0
    while not left.isEmpty():
        n += 1
        mark = lambda x, n=n: F.struct(F.xxhash64(x, F.lit(n)).alias("m"), F.col(x).alias("c"))
        least = left.groupBy("cu").agg(F.min(F.struct(mark("cv").alias("mark"), "u", "v")).alias("x"))
        hooks = cut(least.where(c("x.mark") < mark("cu")).select(c("cu").alias("c"), c("x.mark.c").alias("to"), "x.u", "x.v"))
        trees.append(hooks.select("u", "v"))
        to = _jumped(hooks.select("c", "to"))
        moves.append(to)
        at = lambda end, to=to: to.select(c("c").alias(end), c("to").alias(f"{end}_to"))
        moved = left.join(at("cu"), "cu", "left").join(at("cv"), "cv", "left").select(F.coalesce("cu_to", "cu").alias("cu"), F.coalesce("cv_to", "cv").alias("cv"), "u", "v")
        left = cut(moved.where("cu <> cv").groupBy("cu", "cv").agg(F.min(F.struct("u", "v")).alias("x")).select("cu", "cv", "x.u", "x.v"))
    for to in moves:
        labels = labels.join(to.select(c("c").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    empty = links.select("u", "v").limit(0)
    return cut(labels), cut(reduce(DataFrame.unionByName, trees, empty))


def _tour(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y, root, pos): arcs of a forest in the order of Euler tours from the roots, tour after tour."""
    c = F.col
    arcs = tree.select(c("u").alias("x"), c("v").alias("y")).union(tree.select("v", "u"))
    arcs = cut(numbered(arcs, "x", "y", name="n", start=0))
    ends = arcs.groupBy("x").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    # after (x, y) comes the arc behind (y, x) in the list of y
    twin = arcs.select(c("x").alias("y"), c("y").alias("x"), c("n").alias("t"))
    after = arcs.join(twin, ["x", "y"]).join(ends.withColumnRenamed("x", "y"), "y").join(labels.select(c("node").alias("y"), "root"), "y")
    succ = F.when(c("t") == c("last"), c("first")).otherwise(c("t") + 1)
    # the tour ends before it would come back to the root's first arc
    succ = F.when((c("y") == c("root")) & (succ == c("first")), F.lit(None)).otherwise(succ)
    ranked = cut(after.select("n", "x", "y", "root", succ.alias("to"), F.lit(1).cast("long").alias("d")))
    left = ranked.select("n", "to", "d")
    while not left.where("to is not null").isEmpty():
        ahead = left.select(c("n").alias("at"), c("to").alias("beyond"), c("d").alias("more"))
        # arcs that have reached the end have a key of their own, which nothing meets
        left = cut(left.join(ahead, F.coalesce("to", -c("n") - 1) == c("at"), "left").select("n", c("beyond").alias("to"), (c("d") + F.coalesce("more", F.lit(0))).alias("d")))
    return cut(numbered(ranked.select("n", "x", "y", "root").join(left.select("n", "d"), "n"), "root", F.desc("d"), name="pos", start=0).select("x", "y", "root", "pos"))


def interval_bounds(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """(q, lo, hi): least ``lo`` and greatest ``hi`` of points (pos, lo, hi) within intervals (q, l, r), ends included.

    An interval is two parts of blocks and whole blocks between, which are an interval of the next level's points.
    """
    c = F.col
    parts, block = [], lambda x: F.floor(c(x) / BLOCK)
    while True:
        held = points.groupBy(block("pos").alias("b")).agg(F.collect_list(F.struct("pos", "lo", "hi")).alias("ps"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        held = cut(held)  # a block has at most BLOCK points
        piece = lambda b, l, r: F.struct(b.cast("long").alias("b"), l.cast("long").alias("l"), r.cast("long").alias("r"))  # noqa: E731, E741
        one = F.array(piece(block("l"), c("l"), c("r")))
        two = F.array(piece(block("l"), c("l"), (block("l") + 1) * BLOCK - 1), piece(block("r"), block("r") * BLOCK, c("r")))
        cuts = intervals.select("q", F.explode(F.when(block("l") == block("r"), one).otherwise(two)).alias("p")).select("q", "p.*")
        inside = F.filter("ps", lambda p: (p["pos"] >= c("l")) & (p["pos"] <= c("r")))
        parts.append(cuts.join(held.select("b", "ps"), "b").select("q", F.array_min(F.transform(inside, lambda p: p["lo"])).alias("lo"), F.array_max(F.transform(inside, lambda p: p["hi"])).alias("hi")))
        intervals = cut(intervals.where(block("r") - block("l") > 1).select("q", (block("l") + 1).alias("l"), (block("r") - 1).alias("r")))
        if intervals.isEmpty():
            return reduce(DataFrame.unionByName, parts).groupBy("q").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        points = held.select(c("b").alias("pos"), "lo", "hi")


def rooted(links: DataFrame) -> DataFrame:
    """(node, parent, root, first, last, low, high) of each node of undirected links (u, v) but the roots.

    A subtree is the interval first .. last; low and high are the least and greatest places that its
    nodes see over edges outside the forest, or their own.
    """
    c = F.col
    labels, tree = spanning_forest(links)
    if tree.isEmpty():
        return tree.select(c("u").alias("node"), c("v").alias("parent"), c("u").alias("root"), *[c("u").alias(n) for n in ("first", "last", "low", "high")])
    tour = _tour(tree, labels)
    back = tour.select(c("x").alias("y"), c("y").alias("x"), c("pos").alias("last"))
    nodes = cut(tour.join(back, ["x", "y"]).where("pos < last").select(c("y").alias("node"), c("x").alias("parent"), "root", c("pos").alias("first"), "last"))
    roots = nodes.groupBy("root").agg(F.min("first").alias("first")).select(c("root").alias("node"), (c("first") - 1).alias("first"))
    place = cut(nodes.select("node", "first").unionByName(roots))
    others = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct().join(tree.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti")
    both = others.union(others.select("v", "u")).toDF("node", "other").join(place.select(c("node").alias("other"), c("first").alias("seen")), "other")
    seen = both.groupBy("node").agg(F.min("seen").alias("lo"), F.max("seen").alias("hi"))
    points = nodes.join(seen, "node", "left").select(c("first").alias("pos"), F.least("first", "lo").alias("lo"), F.greatest("first", "hi").alias("hi"))
    bounds = interval_bounds(cut(points), nodes.select(c("node").alias("q"), c("first").alias("l"), c("last").alias("r")))
    return cut(nodes.join(bounds.select(c("q").alias("node"), c("lo").alias("low"), c("hi").alias("high")), "node"))


def _leaves() -> Column:
    """Whether something in the subtree sees a node outside."""
    return (F.col("low") < F.col("first")) | (F.col("high") > F.col("last"))


def blocks(links: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(node, parent, block): the biconnected component of each edge of the spanning forest of ``links``; ``tree`` is their ``rooted``."""
    c = F.col
    tree = rooted(links) if tree is None else tree
    of = lambda end: tree.select(c("node").alias(end), c("parent").alias(f"{end}_up"), c("first").alias(f"{end}_first"), c("last").alias(f"{end}_last"))
    # a tree edge goes with its parent's edge if the subtree sees beyond the parent's interval
    above = tree.join(of("parent"), "parent").where((c("low") < c("parent_first")) | (c("high") > c("parent_last"))).select(c("node").alias("u"), c("parent").alias("v"))
    # and edges into nodes of which neither lies above the other go together
    pairs = links.where("u <> v").join(of("u"), "u").join(of("v"), "v")
    apart = ~((c("u_first") <= c("v_first")) & (c("v_last") <= c("u_last"))) & ~((c("v_first") <= c("u_first")) & (c("u_last") <= c("v_last")))
    labels, _ = spanning_forest(cut(above.unionByName(pairs.where(apart).select("u", "v"))))
    return tree.select("node", "parent").join(labels, "node", "left").select("node", "parent", F.coalesce("root", "node").alias("block"))


def bridge_nodes(tree: DataFrame) -> DataFrame:
    """(node, parent) of tree edges whose subtree sees nothing outside."""
    return tree.where(~_leaves()).select("node", "parent")


def cut_nodes(found: DataFrame) -> DataFrame:
    """(node) of nodes at edges of several ``blocks``."""
    ends = found.select("node", "block").union(found.select("parent", "block"))
    return ends.groupBy("node").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a <> b").select("node")


def _along(neighbours: DataFrame) -> DataFrame:
    """(node, n1, n2, e1, e2) of nodes with two neighbours n1 and n2: where the chain of such nodes ends either way; rings without an end are left out."""
    c = F.col
    # (x, node) is left towards y; the pointer is the arc last reached
    state = neighbours.select(F.explode(F.array(F.struct(c("n1").alias("x"), "node", c("n2").alias("y")), F.struct(c("n2").alias("x"), "node", c("n1").alias("y")))).alias("a"))
    state = cut(state.select("a.x", "a.node", c("a.node").alias("at"), c("a.y").alias("to"), F.lit(True).alias("open")))
    for _ in range(neighbours.count().bit_length() + 1):
        ahead = state.select(c("x").alias("at"), c("node").alias("to"), c("at").alias("at_"), c("to").alias("to_"))
        state = cut(state.join(ahead, ["at", "to"], "left").select("x", "node", F.coalesce("at_", "at").alias("at"), F.coalesce("to_", "to").alias("to"), c("to_").isNotNull().alias("open")))
        if state.where("open").isEmpty():
            break
    ends = state.where("not open").select("node", "x", c("to").alias("e"))
    both = neighbours.join(ends.select("node", c("x").alias("n2"), c("e").alias("e1")), ["node", "n2"]).join(ends.select("node", c("x").alias("n1"), c("e").alias("e2")), ["node", "n1"])
    return cut(both.select("node", "n1", "n2", "e1", "e2"))


@dataclass
class Reduced:
    """What is left of undirected links when chains are single links and leaves have gone.

    ``chained`` (node, n1, n2, e1, e2) are the nodes within chains, ``loops`` (node) those that a chain leaves and comes back to,
    ``gone`` (u, v, k, direct) the links of leaves, ``joints`` (node) the nodes they hung on beside others, ``core`` the other links;
    k counts parallel ways, and what has several is no bridge.
    """

    chained: DataFrame
    loops: DataFrame
    gone: DataFrame
    joints: DataFrame
    core: DataFrame


def reduced(links: DataFrame) -> Reduced:
    """Chains go in a logarithm of their length of rounds, then leaves, as long as a round takes a sixteenth of the links."""
    c = F.col
    every = cut(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    arcs = every.union(every.select("v", "u")).toDF("node", "other")
    two = cut(arcs.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("n1"), F.max("other").alias("n2")).where("n = 2").drop("n"))
    chained = _along(two)
    of = lambda end: two.select(c("node").alias(end))
    direct = every.join(of("u"), "u", "left_anti").join(of("v"), "v", "left_anti").select("u", "v", F.lit(1).alias("k"), F.lit(True).alias("direct"))
    loops = chained.where("e1 = e2").select(c("e1").alias("node")).distinct()
    # a chain is counted at the node next to its lesser end
    first = chained.where("(e1 = n1 and e1 < e2) or (e2 = n2 and e2 < e1)").select(F.least("e1", "e2").alias("u"), F.greatest("e1", "e2").alias("v"), F.lit(1).alias("k"), F.lit(False).alias("direct"))
    left = cut(direct.unionByName(first).groupBy("u", "v").agg(F.sum("k").alias("k"), F.max("direct").alias("direct")))
    gone, joints, size = [left.limit(0)], [loops.limit(0)], left.count()
    while size:
        degree = left.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        at = lambda end, degree=degree: degree.select(c("node").alias(end), c("n").alias(f"{end}_n"))
        seen = cut(left.join(at("u"), "u").join(at("v"), "v"))
        left = seen.where("u_n > 1 and v_n > 1").select(*left.columns)
        leaves = seen.where("u_n = 1 or v_n = 1")
        gone.append(leaves.select(*left.columns))
        joints.append(leaves.where("u_n > 1 or v_n > 1").select(F.when(c("u_n") > 1, c("u")).otherwise(c("v")).alias("node")))
        before, size = size, left.count()
        if (before - size) * 16 < before:
            break
    return Reduced(chained, loops, reduce(DataFrame.unionByName, gone), reduce(DataFrame.unionByName, joints), left)


def _bridged(parts: Reduced, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links (u, v) that are bridges between nodes outside chains, nodes of ``chained`` in chains that are)."""
    c = F.col
    of_core = bridge_nodes(tree).select(F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))
    found = cut(parts.gone.unionByName(parts.core.join(of_core, ["u", "v"], "left_semi")).where("k = 1"))
    ways = found.where("not direct").select(c("u").alias("lo"), c("v").alias("hi"))
    within = parts.chained.withColumns({"lo": F.least("e1", "e2"), "hi": F.greatest("e1", "e2")}).join(ways, ["lo", "hi"], "left_semi")
    return found.where("direct").select("u", "v"), within


def bridge_links(links: DataFrame) -> DataFrame:
    """(u, v), u < v: undirected links without which their component falls apart."""
    parts = reduced(links)
    direct, within = _bridged(parts, rooted(parts.core.select("u", "v")))
    steps = within.select("node", F.explode(F.array("n1", "n2")).alias("other"))
    return direct.union(steps.select(F.least("node", "other"), F.greatest("node", "other")).distinct())


def cut_points(links: DataFrame) -> DataFrame:
    """(node) of undirected links without which its component falls apart."""
    parts = reduced(links)
    core = parts.core.select("u", "v")
    tree = rooted(core)
    _, within = _bridged(parts, tree)
    found = [parts.loops, parts.joints, within.select("node")]
    if not tree.isEmpty():
        found.append(cut_nodes(blocks(core, tree)))
    return reduce(DataFrame.unionByName, found).distinct()


def _through(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(edges, chains (node, a, b), rings (node, component)): nodes with one way in and one out are taken out of chains a -> .. -> b.

    Ways double in each round and keep their least node.  A node that is the least of its own way has gone round a ring,
    and with it all nodes of the ring, so rounds grow with the logarithm of the longest chain or ring.  None without such nodes.
    """
    c = F.col
    single = edges.groupBy(c("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("a")).where("n = 1").select("node", "a")
    out = edges.groupBy(c("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("b")).where("n = 1").select("node", "b")
    inner = cut(single.join(out, "node"))
    if inner.isEmpty():
        return None
    way = lambda back, end: F.struct(F.lit(back).alias("back"), c(end).alias("to"), c(end).alias("low"))
    state = inner.select("node", F.inline(F.array(way(False, "b"), way(True, "a"))))
    rings = [inner.select("node", c("node").alias("component")).limit(0)]
    while True:
        ahead = state.select("back", c("node").alias("to"), c("to").alias("beyond"), c("low").alias("more"))
        moved = state.join(ahead, ["back", "to"], "left").select("node", "back", F.coalesce("beyond", "to").alias("to"), F.least("low", "more").alias("low"), c("beyond").isNotNull().alias("open"))
        state = cut(moved)
        closed = c("open") & ~c("back") & (c("low") == c("node"))
        still, ringed = state.agg(F.coalesce(F.max("open"), F.lit(False)), F.coalesce(F.max(closed), F.lit(False))).first()
        if ringed:
            least = state.where(closed).select(c("node").alias("low"))
            rings.append(cut(state.where("open and not back").join(least, "low").select("node", c("low").alias("component"))))
            state = cut(state.join(rings[-1].select("node"), "node", "left_anti"))
            still = not state.where("open").isEmpty()
        if not still:
            break
    chains = cut(state.where("back").select("node", c("to").alias("a")).join(state.where("not back").select("node", c("to").alias("b")), "node"))
    ids = inner.select("node")
    rest = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_anti").join(ids.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    return cut(rest.unionByName(chains.select(c("a").alias("src"), c("b").alias("dst"))).distinct()), chains, reduce(DataFrame.unionByName, rings)


def _coloured(left: DataFrame) -> DataFrame:
    """(node, component) of the nodes that reach, and are reached from, the greatest node that reaches them; components may be of one."""
    c = F.col
    colour = cut(left.select(c("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", c("node")))
    while True:
        over = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(c("dst").alias("node")).agg(F.max("colour").alias("over"))
        moved = cut(colour.join(over, "node", "left").select("node", F.greatest("colour", "over").alias("colour"), F.coalesce(c("over") > c("colour"), F.lit(False)).alias("moved")))
        colour = moved.select("node", "colour")
        if moved.where("moved").isEmpty():
            break
    same = cut(left.join(colour.select(c("node").alias("src"), c("colour").alias("a")), "src").join(colour.select(c("node").alias("dst"), c("colour").alias("b")), "dst").where("a = b").select("src", "dst"))
    front = colour.where("node = colour")
    members = [front]
    while True:  # backwards from the node that names the colour
        front = same.join(front.withColumnRenamed("node", "dst"), "dst").select(c("src").alias("node"), "colour").distinct()
        front = cut(front.join(reduce(DataFrame.unionByName, members), ["node", "colour"], "left_anti"))
        if front.isEmpty():
            break
        members.append(front)
    return cut(reduce(DataFrame.unionByName, members).select("node", c("colour").alias("component")))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of directed edges (src, dst) that lie on a cycle; the component is named by one of them.

    Nodes without a way in or out go, and chains of nodes with one way in and one out become single edges, in turns until
    neither is left; a ring of such nodes is a component.  Then colours: each node gets the greatest node that reaches it,
    and what reaches that node within its colour is its component.  These go, and the rest begins anew.
    Each round's rows are linear in the edges.
    """
    c = F.col
    loops = edges.where("src = dst").select(c("src").alias("node"), c("src").alias("component")).distinct()
    left = cut(edges.where("src <> dst").select("src", "dst").distinct())
    # what was found, in order: (components, chains); a chain's ends are nodes of later graphs, or components of one named by a way that came back
    steps: list[tuple[DataFrame, DataFrame | None, DataFrame | None]] = []
    size = left.count()
    while size:
        kept = cut(left.join(left.select(c("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(c("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, left, size = size, kept, kept.count()
        if not size:
            break
        shorter = _through(left)
        if shorter:
            left, chains, rings = shorter
            steps.append((rings, chains, left.where("src = dst").select(c("src").alias("node"), c("src").alias("component")).distinct()))
            left = cut(left.where("src <> dst"))
        elif size == before:
            members = _coloured(left)
            steps.append((members.join(members.groupBy("component").count().where("count > 1"), "component", "left_semi").select("node", "component"), None, None))
            gone = members.select("node")
            left = cut(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        size = left.count()
    whole = loops.limit(0)
    for named, chains, back in reversed(steps):
        if chains is not None:
            whole = cut(whole.unionByName(back.join(whole.select("node"), "node", "left_anti")))
            inner = chains.join(whole.select(c("node").alias("a"), "component"), "a").join(whole.select(c("node").alias("b"), c("component").alias("other")), "b").where("component = other").select("node", "component")
            whole = whole.unionByName(inner)
        whole = whole.unionByName(named)
    whole = cut(whole)
    return whole.unionByName(loops.join(whole.select("node"), "node", "left_anti"))
