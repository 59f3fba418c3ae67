"""Biconnectivity and strong components against removal and reachability, on random graphs and long paths."""

import collections
import itertools
import random

from pyspark.sql import functions as F

from lattica.operators import analytics, connectivity
from lattica.schema import EDGE, NODE, Graph, conform


def graph(spark, links):
    nodes = sorted({x for e in links for x in e})
    n = conform(spark.createDataFrame([(x, "T", i) for i, x in enumerate(nodes)], "id string, type string, ord long"), NODE)
    return Graph(n, conform(spark.createDataFrame([(a, "R", b) for a, b in links], "src string, rel string, dst string"), EDGE))


def pieces(nodes, links):
    near = {n: set() for n in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    seen, count = set(), 0
    for n in nodes:
        if n not in seen:
            count += 1
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += near[x]
    return count


def mesh(seed, n=60, m=72):
    rng = random.Random(seed)
    links = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    links |= {(x, x + 1) for x in range(100, 140)} | {(100, 110), (115, 140)}  # a path with two chords
    links |= {(200, x) for x in range(201, 230)} | {(201, 202)}  # a hub
    return {(f"n{a:03}", f"n{b:03}") for a, b in links}


def test_biconnectivity_by_removal(spark):
    links = mesh(1)
    nodes = {x for e in links for x in e}
    base = pieces(nodes, links)
    g = graph(spark, sorted(links))
    cut_links = {x for x in links if pieces(nodes, links - {x}) > base}
    assert {(r.a, r.b) for r in analytics.bridges(g).collect()} == cut_links
    points = {n for n in nodes if pieces(nodes - {n}, {x for x in links if n not in x}) > base}
    assert {r.id for r in analytics.articulation_points(g).collect()} == points
    got = analytics.biconnected(g).collect()
    assert {(r.a, r.b) for r in got} == links and len(got) == len(links)
    sizes = {}
    for r in got:
        sizes.setdefault(r.block, set()).add((r.a, r.b))
    assert {next(iter(b)) for b in sizes.values() if len(b) == 1} == cut_links
    ends = {}
    for b, es in sizes.items():
        for x in {x for e in es for x in e}:
            ends.setdefault(x, set()).add(b)
    assert {x for x, bs in ends.items() if len(bs) > 1} == points


def test_reduced(spark):
    """Chains and leaves go before the forest is built; parallel chains, loops, rings alone and pendant rings keep their cuts."""
    ring = lambda a, n: {(a + i, a + (i + 1) % n) for i in range(n)}
    path = lambda *xs: set(zip(xs, xs[1:]))
    links = ring(0, 12) | ring(20, 5) | ring(40, 7) | {(40, 60)} | ring(60, 4) | {(60, 90)} | path(*range(100, 117)) | {(120, 121)}
    links |= path(200, 201, 202, 203) | path(200, 204, 203) | {(203, 205), (200, 206), (200, 207), (205, 208), (205, 209)}  # parallel chains, leaves of leaves
    links |= path(300, 301, 302, 300) | path(300, 303, 304, 300)  # two loops at a node
    links |= path(400, 401, 402, 403) | {(400, 404), (400, 405), (403, 406), (403, 407), (404, 405), (406, 407)}  # a chain between triangles
    links = {tuple(sorted((f"n{a:03}", f"n{b:03}"))) for a, b in links}
    nodes = {x for e in links for x in e}
    g, base = graph(spark, sorted(links)), pieces(nodes, links)
    assert {(r.a, r.b) for r in analytics.bridges(g).collect()} == {x for x in links if pieces(nodes, links - {x}) > base}
    assert {r.id for r in analytics.articulation_points(g).collect()} == {n for n in nodes if pieces(nodes - {n}, {x for x in links if n not in x}) > base}
    numbers, _ = analytics.with_numbers(analytics.undirected(g.edges, g.nodes))
    assert connectivity.reduced(numbers).core.count() == 0


def test_intervals(spark):
    rng = random.Random(5)
    points = {p: (rng.randint(0, 10**6), rng.randint(0, 10**6)) for p in rng.sample(range(40_000), 20_000)}
    asked = [(q, *sorted(rng.sample(sorted(points), 2))) for q in range(60)] + [(60, p := min(points), p)]
    df = spark.createDataFrame([(p, a, b) for p, (a, b) in points.items()], "pos long, lo long, hi long")
    got = {r.q: (r.lo, r.hi) for r in connectivity.interval_bounds(df, spark.createDataFrame(asked, "q long, l long, r long")).collect()}
    want = {q: (min(points[p][0] for p in points if l <= p <= r), max(points[p][1] for p in points if l <= p <= r)) for q, l, r in asked}
    assert got == want


def strong_by_force(links):
    nodes = sorted({x for e in links for x in e})
    reach = {n: {b for a, b in links if a == n} for n in nodes}
    for k, i in itertools.product(nodes, nodes):
        if k in reach[i]:
            reach[i] |= reach[k]
    return {n: min(x for x in nodes if x == n or (x in reach[n] and n in reach[x])) for n in nodes if n in reach[n]}


def test_strong_components(spark):
    rng = random.Random(7)
    links = {tuple(rng.sample(range(40), 2)) for _ in range(55)}
    links |= {(100 + i, 100 + (i + 1) % 30) for i in range(30)} | {(99, 100), (101, 300)}  # a ring with ends
    links |= {(200 + i, 201 + i) for i in range(20)} | {(220, 205), (400, 400), (400, 401)} | {(500, 501), (501, 500)}
    links = {(f"n{a:03}", f"n{b:03}") for a, b in links}
    df = spark.createDataFrame(sorted(links) * 2, "src string, dst string")
    assert {r.id: r.component for r in analytics.cyclic_components(df).collect()} == strong_by_force(links)
    assert analytics.nodes_in_cycles(df.limit(0)).count() == 0
    assert analytics.nodes_in_cycles(df.where(F.col("src") < F.col("dst"))).count() == 0


def test_strong_components_by_turns(spark, monkeypatch):
    """A long ring behind trees that hang on it, rings on rings, and tails: no colours are needed, and rounds do not grow with the ring."""
    links = {(i, (i + 1) % 60) for i in range(60)} | {(100 + i, i % 60) for i in range(80)} | {(200 + i, 100 + i % 80) for i in range(160)}
    links |= {(400 + i, 400 + (i + 1) % 9) for i in range(9)} | {(403, 450), (450, 451), (451, 403), (451, 5), (30, 500), (500, 501)}
    tables, coloured = [], []
    made, colours = connectivity.cut, connectivity._coloured
    monkeypatch.setattr(connectivity, "cut", lambda df: (tables.append(1), made(df))[1])
    monkeypatch.setattr(connectivity, "_coloured", lambda df: (coloured.append(1), colours(df))[1])
    df = spark.createDataFrame(sorted(links), "src long, dst long")
    found = connectivity.strong_components(df).collect()
    groups = collections.defaultdict(set)
    for r in found:
        groups[r.component].add(r.node)
    want = collections.defaultdict(set)
    for n, k in strong_by_force(links).items():
        want[k].add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and len(found) == len(set(found))
    assert not coloured and len(tables) < 50
