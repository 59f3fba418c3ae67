"""Operators on small literal graphs, with brute force where no SQL tells the answer."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.ontology import DEFAULT, Ontology, OntologyError
from lattica.operators import analytics, derive, extract, filters, govern, layout, merge, search
from lattica.plans import context, sparql
from lattica.registry import QUERIES
from lattica.schema import EDGE, NODE, Graph, conform
from lattica.views import star_small


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, x[0], x[1], x[2] if len(x) > 2 else x[0]) for i, x in enumerate(nodes)], "ord long, id string, type string, label string")
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(edges)], "ord long, src string, rel string, dst string, confidence double")
    return Graph(conform(n, NODE), conform(e, EDGE))


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = random.Random(3)
    nodes = [(f"n{i:02}", "T") for i in range(24)]
    edges = [(f"n{a:02}", "R", f"n{b:02}", 1.0) for a, b in (rng.sample(range(24), 2) for _ in range(26))]
    return graph(spark, nodes, edges), {n for n, _ in nodes}, {tuple(sorted((a, b))) for a, _, b, _ in edges}


def pieces(nodes, links):
    left, count = set(nodes), 0
    while left:
        count += 1
        todo = [left.pop()]
        while todo:
            u = todo.pop()
            near = {b if a == u else a for a, b in links if u in (a, b)} & left
            left -= near
            todo += near
    return count


def test_bridges_and_points_by_removal(random_graph):
    g, nodes, links = random_graph
    base = pieces(nodes, links)
    want = {x for x in links if pieces(nodes, links - {x}) > base}
    assert {(r.a, r.b) for r in analytics.bridges(g).collect()} == want
    points = {n for n in nodes if pieces(nodes - {n}, {x for x in links if n not in x}) > base - (not any(n in x for x in links))}
    assert {r.id for r in analytics.articulation_points(g).collect()} == points
    assert analytics.component_sizes(g).count() == base


def test_louvain_two_clusters(spark):
    links = [(a, b) for part in ("abc", "xyz") for a, b in itertools.combinations(part, 2)] + [("c", "x")]
    g = graph(spark, [(c, "T") for c in "abcxyz"], [(a, "R", b, 1.0) for a, b in links])
    found = {r.id: r.community for r in analytics.louvain(g).collect()}
    assert found == {"a": 0, "b": 0, "c": 0, "x": 1, "y": 1, "z": 1}


def modularity_of(links, home, m2):
    degree = {}
    for a, b in links:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    total = {}
    for n, d in degree.items():
        total[home[n]] = total.get(home[n], 0) + d
    return sum(2 for a, b in links if home[a] == home[b]) / m2 - sum((t / m2) ** 2 for t in total.values())


def one_by_one(links, sweeps=30):
    """Local moves in node order: the modularity that the loops of joins are held against."""
    near, m2 = {}, 2 * len(links)
    for a, b in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    home, mass = {n: n for n in near}, {n: len(x) for n, x in near.items()}
    for _ in range(sweeps):
        moved = False
        for n in sorted(near):
            to = {}
            for v in near[n]:
                to[home[v]] = to.get(home[v], 0) + 1
            mass[home[n]] -= len(near[n])
            gain = lambda c, to=to, n=n: to.get(c, 0) - len(near[n]) * mass[c] / m2
            best = max([home[n], *sorted(to)], key=gain)
            moved |= best != home[n]
            home[n] = best
            mass[best] += len(near[n])
        if not moved:
            break
    return modularity_of(links, home, m2)


@pytest.mark.parametrize("kind", ["blocks", "grid", "random"])
def test_louvain_modularity(spark, kind):
    rng = random.Random(3)
    name = lambda i: f"n{i:03}"
    if kind == "blocks":
        links = {(a, b) for a, b in itertools.combinations(range(80), 2) if rng.random() < (0.5 if a // 10 == b // 10 else 0.02)}
    elif kind == "grid":
        links = {(i, i + 1) for i in range(100) if i % 10 < 9} | {(i, i + 10) for i in range(90)}
    else:
        links = {tuple(sorted(rng.sample(range(70), 2))) for _ in range(160)}
    links = sorted((name(a), name(b)) for a, b in links)
    g = graph(spark, [(n, "T") for n in sorted({x for e in links for x in e})], [(a, "R", b, 1.0) for a, b in links])
    home = {r.id: r.community for r in analytics.louvain(g).collect()}
    assert modularity_of(links, home, 2 * len(links)) >= 0.98 * one_by_one(links)


def test_betweenness_by_paths(spark):
    rng = random.Random(8)
    links = sorted({tuple(sorted(rng.sample([f"n{i:02}" for i in range(30)], 2))) for _ in range(42)} | {("x1", "x2"), ("x2", "x3")})
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        dist, count, order = {s: 0}, {s: 1}, [s]
        for u in order:
            for v in near[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    count[v] = count.get(v, 0) + count[u]
        share = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            for v in near[u]:
                if dist[v] == dist[u] - 1:
                    share[v] += count[v] / count[u] * (1 + share[u])
            if u != s:
                want[u] += share[u]
    g = graph(spark, [(n, "T") for n in sorted(near)], [(a, "R", b, 1.0) for a, b in links])
    got = {r.id: r.score for r in analytics.betweenness(g).collect()}
    assert got == pytest.approx(want)
    some = {r.id: r.score for r in analytics.betweenness(g, pivots=len(near) // 2).collect()}
    error = sum(abs(some[n] - want[n]) for n in want) / sum(want.values())
    assert set(some) == set(want) and error < 0.5


def test_rules_transitive_with_damping(spark):
    g = graph(spark, [(x, "T") for x in ("dog", "canine", "mammal", "animal")], [("dog", "is_a", "canine", 1.0), ("canine", "is_a", "mammal", 1.0), ("mammal", "is_a", "animal", 0.9)])
    got = {(r.src, r.dst): r.confidence for r in derive.infer(g.edges, [derive.Rule("transitive", "is_a", damping=0.9)]).where("round > 0").collect()}
    assert set(got) == {("dog", "mammal"), ("canine", "animal"), ("dog", "animal")}
    assert got["dog", "mammal"] == 0.9


def test_rules_like_naive_rounds(spark):
    """Every derivation of every round, in plain Python: facts, rounds and the confidence of the first derivation."""
    rng = random.Random(4)
    rules = [derive.Rule("transitive", "is_a", damping=0.9), derive.Rule("inverse", "part_of", "has_part"), derive.Rule("composition", "is_a", "inherits", "has_part", 0.8), derive.Rule("symmetric", "near", damping=1.0)]
    base = {(f"n{rng.randint(0, 11):02}", rng.choice(["is_a", "is_a", "part_of", "near"]), f"n{rng.randint(0, 11):02}"): rng.choice([0.5, 0.8, 1.0]) for _ in range(30)}
    known = {k: (c, 0) for k, c in base.items()}
    for n in range(1, 5):
        made = {}
        for i, r in enumerate(rules):
            for (s, rel, m), (c1, r1) in known.items():
                if rel != r.rel:
                    continue
                o1 = (r1, s, m)
                if r.kind in ("inverse", "symmetric"):
                    made.setdefault((m, r.head, s), []).append(((i, o1, o1), round(c1 * r.damping, 4)))
                    continue
                for (m2, rel2, d), (c2, r2) in known.items():
                    if rel2 == (r.second or r.rel) and m2 == m and s != d:
                        made.setdefault((s, r.head, d), []).append(((i, o1, (r2, m2, d)), round(c1 * c2 * r.damping, 4)))
        new = {k: (min(v)[1], n) for k, v in made.items() if k not in known}
        known |= new
    g = graph(spark, [(f"n{i:02}", "T") for i in range(12)], [(*k, c) for k, c in base.items()])
    got = {(r.src, r.rel, r.dst): (r.confidence, r.round) for r in derive.infer(g.edges, rules, rounds=4).collect()}
    assert got.keys() == known.keys()
    assert all(got[k][1] == known[k][1] and got[k][0] == pytest.approx(known[k][0], abs=2e-4) for k in known)


def test_cycles(spark):
    g = graph(spark, [(x, "T") for x in "abcd"], [("a", "PART_OF", "b", 1.0), ("b", "PART_OF", "c", 1.0), ("c", "PART_OF", "a", 1.0), ("c", "PART_OF", "d", 1.0)])
    assert [r.cycle for r in analytics.directed_cycles(g).collect()] == ["a->b->c->a"]
    assert {r.id for r in analytics.nodes_in_cycles(g.edges).collect()} == {"a", "b", "c"}


def test_nodes_of_a_long_cycle(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 80}") for i in range(80)]
    edges = spark.createDataFrame([*ring, ("n0", "tail"), ("head", "n0")], "src string, dst string")
    assert {r.id for r in analytics.nodes_in_cycles(edges).collect()} == {a for a, _ in ring}


def test_gini(spark):
    value = lambda xs: analytics.gini(spark.createDataFrame([(x,) for x in xs], "degree long")).first()[0]
    assert value([5, 5, 5, 5]) == pytest.approx(0)
    assert value([0, 0, 0, 10]) > 0.7
    assert value([3]) == 0


def test_sparql_repeats_and_tests(spark):
    g = graph(spark, [("a", "X"), ("b", "Y")], [("a", "likes", "a", 1.0), ("a", "likes", "b", 1.0)])
    assert [r.s for r in sparql.execute(g, "SELECT ?s WHERE { ?s :likes ?s }").collect()] == ["a"]
    assert {r.o for r in sparql.execute(g, "SELECT ?o WHERE { a a X . ?s :likes ?o }").collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        sparql.execute(g, "nonsense")


def test_as_of_and_redact(spark):
    n = spark.createDataFrame([("a", None, None, "public", 0), ("b", "0300", "0500", "restricted", 1), ("c", "0600", None, "", 2)], "id string, valid_from string, valid_to string, visibility string, ord long")
    e = spark.createDataFrame([("a", "r", "b"), ("a", "r", "c")], "source string, rel string, target string")
    g = Graph(conform(n, NODE), conform(e, EDGE))
    then = filters.as_of(g, "0400")
    assert {r.id for r in then.nodes.collect()} == {"a", "b"} and then.edges.count() == 1
    assert {r.id for r in filters.redact(g, "nobody").nodes.collect()} == {"a"}
    assert {r.id for r in filters.redact(g, "internal").nodes.collect()} == {"a", "c"}


def test_merge_is_idempotent_and_order_free(spark):
    n = spark.createDataFrame([("a", "A", "T", 1, ["x"]), ("a", "B", "T", 2, ["y", "x"]), ("a", "C", "Other", 3, ["no"]), ("b", "B", "T", 4, None)], "id string, label string, type string, ord long, aliases array<string>")
    e = spark.createDataFrame([("a", "r", "b", 1, "d1"), ("a", "r", "gone", 2, "d1"), ("b", "r", "a", 3, "dead")], "src string, rel string, dst string, ord long, doc string")
    live = spark.createDataFrame([("d1",)], "id string")
    g = merge.merge(conform(n, NODE), conform(e, EDGE), live)
    rows = {r.id: r for r in g.nodes.collect()}
    assert rows["a"].label == "A" and rows["a"].aliases == ["x", "y"]
    assert [(r.src, r.dst) for r in g.edges.collect()] == [("a", "b")]
    again = merge.merge(g.nodes, g.edges, live)
    assert sorted(map(str, again.nodes.collect())) == sorted(map(str, g.nodes.collect()))


def test_mentions_bars(spark):
    vocab = spark.createDataFrame([("emr", "e", False), ("amazon emr", "e", False), ("Kafka", "k", True)], "form string, entity string, exact boolean")
    docs = spark.createDataFrame([("1", "EMR once"), ("2", "EMR, EMR"), ("3", "Amazon EMR"), ("4", "Kafkaesque Kafka-like"), ("5", "Kafka kafka Kafka"), ("6", None), ("7", "")], "id string, text string")
    assert {(r.id, r.entity) for r in extract.mentions(docs, vocab).collect()} == {("2", "e"), ("3", "e"), ("5", "k")}


def test_ontology(spark):
    with pytest.raises(OntologyError):
        Ontology(entity_types=("A",), relations={"R": (("A",), ("B",))}, groups={"G": ("R",)})
    assert len(DEFAULT.relations) == 26 and DEFAULT.to_dot().startswith("digraph")
    g = graph(spark, [("t", "Technology"), ("c", "Company")], [("t", "PROVIDED_BY", "c", 0.5), ("c", "PROVIDED_BY", "t", 0.5), ("t", "NO", "c", 2.0)])
    assert [r.src for r in DEFAULT.typecheck(g.edges, g.nodes).collect()] == ["t"]
    assert {(r.rel, r.problem) for r in DEFAULT.edge_problems(g.edges, g.nodes).collect()} == {("PROVIDED_BY", "wrong signature"), ("NO", "unknown relation"), ("NO", "confidence out of range")}


def test_packs_refuse_bad_relations(spark):
    registry = spark.createDataFrame([], extract.REGISTRY)
    ents = spark.createDataFrame([("pack:p", "a", "A", "Technology", None, None, 1), ("pack:p", "b", "B", "Component", None, None, 2)], "doc string, id string, name string, type string, description string, aliases array<string>, ord long")
    rel = lambda r, x: spark.createDataFrame([("pack:p", "b", r, "a", 0.9, x, None, None, 1)], extract.PACK_RELATION)
    _, edges = extract.curated(ents, rel("COMPONENT_OF", "part"), registry)
    assert [(r.src, r.rel, r.dst) for r in edges.collect()] == [("a", "HAS_COMPONENT", "b")]
    with pytest.raises(extract.PackError):
        extract.curated(ents, rel("COMPONENT_OF", ""), registry)


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(1)
    vs = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(60)] + [[0.0] * 4]
    df = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if cos(vs[i], vs[j]) >= 0.8}
    assert {(r.a, r.b) for r in search.similar_pairs(df, 0.8).collect()} == want


def test_duplicates_and_disambiguation(spark):
    g = graph(spark, [("spark", "T", "Apache Spark engine"), ("spark_dup", "T", "apache spark Engine"), ("kafka", "T", "Kafka")], [("spark_dup", "r", "kafka", 1.0)])
    assert [(r.a, r.b) for r in search.duplicate_candidates(g.nodes, 0.55).collect()] == [("spark", "spark_dup")]
    m = search.merge_duplicates(g, spark.createDataFrame([("spark", "spark_dup")], "canonical string, duplicate string"))
    assert [(r.src, r.dst) for r in m.edges.collect()] == [("spark", "kafka")]
    profiles = spark.createDataFrame([("p1", "snake reptile"), ("p2", "language code")], "id string, profile string")
    asked = spark.createDataFrame([(1, "code in this language", ["p1", "p2"]), (2, "", ["p1", "p2"]), (3, "none", ["p2"]), (4, "unrelated words", ["p1", "p2"])], "mention long, text string, candidates array<string>")
    assert {r.mention: r.id for r in search.disambiguate(profiles, asked).collect()} == {1: "p2", 2: "p1", 3: "p2", 4: None}


def test_shapes_and_delta(spark):
    g = graph(spark, [("a", "T"), ("b", "T")], [("a", "r", "b", 0.2)])
    got = {(r.subject, r.problem) for r in govern.validate_shapes(g, [govern.NodeShape("T", required=("url",))], [govern.EdgeShape("r", least_confidence=0.5)]).collect()}
    assert got == {("a", "missing url"), ("b", "missing url"), ("a r b", "low confidence")}
    later = govern.apply_delta(g, g.nodes.where("id = 'b'"), g.nodes.limit(0), g.edges, g.edges.limit(0))
    assert {r.id: r.change for r in govern.diff_nodes(g.nodes, later.nodes).collect()} == {"a": "same", "b": "removed"}


def test_questions(spark):
    g = graph(spark, [("a", "T", "Spark"), ("b", "T", "Spark SQL"), ("c", "T", "Hive")], [("a", "r", "b", 1.0), ("b", "r", "c", 1.0)])
    assert [x[0] for x in context.spotted(g.nodes, "path from Spark SQL to Hive")] == ["b", "c"]
    assert context.answer(g, "path from Spark to Hive")[1].select("hops").distinct().collect()[0][0] == 2
    assert "Spark" in context.as_markdown(context.retrieve(g, "Spark"))


def test_layouts(spark):
    g = graph(spark, [(x, "T") for x in "abcd"], [("a", "r", "b", 1.0), ("b", "r", "c", 1.0)])
    p = layout.force(g, rounds=10).toPandas()
    assert len(p) == 4 and abs(p[["x", "y"]].mean()).max() < 0.1
    assert {r.id: r.depth for r in layout.layers(g).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}


def test_layout_and_duplicates_of_the_whole_star(spark):
    sf = "/root/testdata/sf0.001"
    nodes = star_small(spark, sf).nodes
    assert sorted(r.id for r in QUERIES["g12_layout"](spark, sf).collect()) == sorted(r.id for r in nodes.collect())
    sigs = sorted((r.id, r.sig) for r in nodes.select("id", T.minhash(F.concat_ws(" ", "label", F.array_join("aliases", " "))).alias("sig")).collect())
    same = lambda x, y: sum(p == q for p, q in zip(x, y)) / 64
    band = lambda x, y: any(x[i : i + 4] == y[i : i + 4] for i in range(0, 64, 4))
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(sigs, 2) if band(x, y) and same(x, y) >= 0.6}
    assert {(r.a, r.b) for r in search.duplicate_candidates(nodes).collect()} == want
    least = {i: i for i, _ in sigs}
    for _ in sigs:  # classes by force: the least id spreads over the pairs until nothing changes
        before = dict(least)
        for a, b in want:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    classes = {r.id: (r.class_id, r.class_size) for r in QUERIES["d6_duplicates"](spark, sf).collect()}
    assert classes == {i: (c, list(least.values()).count(c)) for i, c in least.items()}
    assert any(a.startswith("customer") for a, _ in want)


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE))
    assert analytics.component_sizes(g).count() == 0
    assert merge.merge(g.nodes, g.edges).nodes.count() == 0
    assert analytics.top_hubs(g).count() == 0
    assert analytics.gini(merge.with_degree(g.nodes, g.edges)).select(F.col("gini")).first()[0] == 0


def test_merkle_root_in_blocks(spark, monkeypatch):
    """Blocks fold to the root that pairing level by level gives, whatever the number of leaves."""
    import hashlib

    monkeypatch.setattr(merge, "MERKLE_BLOCK", 2)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for n in (0, 1, 2, 3, 4, 5, 7, 16, 17, 33):
        hs = [sha(f"k{i:03}:v{i}") for i in range(n)]
        while len(hs) > 1:
            hs = [sha(hs[i] + hs[min(i + 1, len(hs) - 1)]) for i in range(0, len(hs), 2)]
        df = spark.createDataFrame([(f"k{i:03}", f"v{i}") for i in range(n)], "key string, value string").repartition(3)
        assert merge.merkle_root(df).first()["root"] == (hs[0] if hs else None), n


def test_weights_sum_each_pair_once(spark):
    rows = [("a", "b", 0.5), ("b", "a", 0.25), ("a", "b", None), ("c", "c", 0.5), (None, "a", 1.0), ("a", None, 2.0), (None, None, 1.0)]
    got = analytics.weights(spark.createDataFrame(rows, "src string, dst string, confidence double"))
    assert {(r.u, r.v): r.w for r in got.collect()} == {("a", "b"): 1.75, ("b", "a"): 1.75, ("c", "c"): 1.0, (None, "a"): 3.0, ("a", None): 3.0, (None, None): 2.0}
    assert got.count() == 6
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan  # rows of an edge are not doubled before the sum
