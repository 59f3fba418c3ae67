"""Similarity joins: classes of near-duplicate nodes and co-occurring entities, against brute force."""

import collections
import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import analytics, derive, duplicates, merge, search
from lattica.schema import Graph


def classes_by_force(rows, threshold, bands=16, count=64):
    """{id: (least id, size)} of (id, signature)."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    step = count // bands
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        band = any(a[k : k + step] == b[k : k + step] for k in range(0, count, step))
        if band and sum(x == y for x, y in zip(a, b)) / count >= threshold:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    sizes = collections.Counter(map(find, root))
    return {i: (find(i), sizes[find(i)]) for i in root}


@pytest.mark.parametrize("turns,pairs", [(4, 4_000_000), (1, 9), (0, 4)])
def test_duplicate_classes(spark, monkeypatch, turns, pairs):
    """Many near copies, chains of texts that differ more and more, equal texts, empty ones and nulls; also with few turns and small cells."""
    monkeypatch.setattr(duplicates, "TURNS", turns)
    monkeypatch.setattr(duplicates, "CELL_PAIRS", pairs)
    rng = random.Random(3)
    rows = [(f"c{i:03}", f"Customer#{i:09}", None) for i in range(60)]
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    said = [word() for _ in range(8)]
    for i in range(30):
        said[i % 8] = word()
        rows.append((f"w{i:02}", " ".join(said), [word()]))
    rows += [("e1", "", None), ("e2", None, None), ("s1", "same label here", ["x"]), ("s2", "Same  label here", ["x"])]
    df = spark.createDataFrame(rows, "id string, label string, aliases array<string>")
    signed = df.select("id", T.minhash(F.concat_ws(" ", "label", F.array_join("aliases", " "))).alias("sig")).collect()
    got = {r.id: (r.class_id, r.class_size) for r in duplicates.duplicate_classes(df, 0.6).collect()}
    assert got == classes_by_force([(r.id, r.sig) for r in signed], 0.6)
    assert got["s1"] == got["s2"] and got["e1"] == got["e2"] and duplicates.duplicate_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("threshold,least", [(0.15, 2), (0.5, 1), (0.5, 3), (1.0, 2)])
def test_cooccurrence_against_all_pairs(spark, threshold, least):
    rng = random.Random(5)
    said = [(f"e{e}", f"d{int(rng.paretovariate(0.7)) % 40}") for e in range(40) for _ in range(rng.randint(1, 9))]
    said += [(f"e{e}", "everywhere") for e in range(40)] + [("alone", None), (None, "d1"), ("e1", "")]
    docs = collections.defaultdict(set)
    for e, d in said:
        if e and d:
            docs[e].add(d)
    want = {(a, b, len(docs[a] & docs[b])) for a, b in itertools.combinations(sorted(docs), 2) if len(docs[a] & docs[b]) >= least and len(docs[a] & docs[b]) / len(docs[a] | docs[b]) >= threshold}
    got = derive.cooccurrence(spark.createDataFrame(said, "entity string, doc string"), threshold=threshold, least=least).collect()
    assert (want or threshold == 1) and {(r.a, r.b, r.shared) for r in got} == want and len(got) == len(want)


def test_nearest_of_many(spark):
    rng = random.Random(7)
    vs = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(80)] + [(100, [0.0] * 5), (101, None), (120, [rng.gauss(0, 1) for _ in range(5)])]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 if any(a) and any(b) else 0.0
    known = [(i, v) for i, v in vs if v is not None]
    want = set()
    for q, v in known:
        if q % 20 == 0:
            scored = sorted((-cos(v, w), i) for i, w in known if cos(v, w) >= 0)[:10]
            want |= {(q, i, n + 1) for n, (_, i) in enumerate(scored)}
    got = search.nearest_of_many(df, df.where("vec_id % 20 = 0"), 10, block_rows=2).collect()
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want


def test_nearest_holds_few_scores_at_a_time():
    """Two full blocks: what a task holds beside them does not grow with their pairs."""
    rng = np.random.default_rng(5)
    b = rng.normal(size=(search.BLOCK_ROWS, 8))
    keys = pa.array(np.arange(len(b)))
    tracemalloc.start()
    rows = sum(len(x) for x in search._best(keys.slice(0, 512), b[:512], keys, b, 10, -1.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 5120 and peak < 64e6


@pytest.mark.parametrize("light", [1, 3, 8])
def test_cooccurrence_of_light_and_heavy_documents(spark, light):
    """Pairs that meet in small documents, in large ones, and in both; three entities in nearly all."""
    rng = random.Random(11)
    said = {(f"e{e}", f"d{int(rng.paretovariate(0.6)) % 50}") for e in range(45) for _ in range(rng.randint(1, 12))}
    said |= {(f"e{e}", f"d{d}") for e in range(3) for d in range(50) if d % 7}
    docs = collections.defaultdict(set)
    for e, d in said:
        docs[e].add(d)
    want = {(a, b, len(docs[a] & docs[b])) for a, b in itertools.combinations(sorted(docs), 2) if len(docs[a] & docs[b]) >= 2 and len(docs[a] & docs[b]) / len(docs[a] | docs[b]) >= 0.3}
    got = derive.cooccurrence(spark.createDataFrame(sorted(said), "entity string, doc string"), threshold=0.3, light=light).collect()
    assert want and {(r.a, r.b, r.shared) for r in got} == want and len(got) == len(want)


def test_cooccurrence_holds_no_pair_that_cannot_share_enough(spark, monkeypatch):
    """Four hundred entities of a hundred documents each: nearly all pairs meet, few share enough."""
    rows = []
    kept = derive.table
    monkeypatch.setattr(derive, "table", lambda df: (rows.append((made := kept(df)).count()), made)[1])
    said = spark.range(40_000).select(F.concat(F.lit("e"), F.col("id") % 400).alias("entity"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("string").alias("doc"))
    assert derive.cooccurrence(said, threshold=0.3).count() == 0
    assert max(rows) <= 40_000


def test_similar_pairs_against_all_pairs(spark):
    """Null components count as 0, as in the query's SQL; copies, zero and null vectors; blocks of two and one block for all."""
    rng = random.Random(13)
    vs = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    vs += [(50, list(vs[3][1])), (51, list(vs[3][1])), (52, [0.0] * 4), (53, None), (54, [1.0, None, 2.0, None]), (55, [1.0, 0.0, 2.0, 0.1])]
    full = [(i, [x or 0.0 for x in v]) for i, v in vs if v is not None and any(v)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)
    want = {(i, j) for (i, v), (j, w) in itertools.combinations(full, 2) if cos(v, w) >= 0.4}
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>")
    for rows in (2, 1000):
        got = search.similar_pairs(df, 0.4, block_rows=rows).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and (54, 55) in want and (3, 50) in want


def test_nearest_of_vectors_of_two_lengths(spark, monkeypatch):
    """Shorter vectors end in zeros, and queries are scored a few at a time."""
    vs = [(20, [1.0, 0.0, 0.0]), (1, [1.0, 0.5]), (2, [0.0, 0.0, 1.0]), (3, [2.0, 1.0, 0.0]), (40, [0.0, 0.0, 3.0])]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id, r["rank"]) for r in search.nearest_of_many(df, df.where("vec_id % 20 = 0"), 3).collect()}
    assert got == {(20, 20, 1), (20, 1, 2), (20, 3, 3), (40, 2, 1), (40, 40, 2), (40, 1, 3)}


def test_betweenness_batches_by_component(spark, monkeypatch):
    """Sixty chains of three nodes: sources reach their chain, so few batches do."""
    made = []
    kept = analytics.table
    monkeypatch.setattr(analytics, "PAIRS", 100)
    monkeypatch.setattr(analytics, "table", lambda df: (made.append(1), kept(df))[1])
    edges = spark.createDataFrame([(f"{i}:{j}", f"{i}:{j + 1}") for i in range(60) for j in range(2)], "src string, dst string")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    got = {r.id: r.score for r in analytics.betweenness(Graph(nodes, edges)).collect()}
    assert got == {f"{i}:{j}": 2.0 * (j == 1) for i in range(60) for j in range(3)} and len(made) < 60


def test_pagerank_bundles_leaves(spark, monkeypatch):
    """Two hubs with many leaves, one of them the seed: scores as by plain rounds, which carry one row for all other leaves of a hub."""
    held = []
    kept = analytics.cut
    monkeypatch.setattr(analytics, "cut", lambda df: (held.append((made := kept(df)).count()), made)[1])
    pairs = [("h0", "h1", 1.0), ("h1", "h2", 0.5), ("h2", "h0", 1.0)] + [(f"l{i:03}", f"h{i % 2}", 1.0 + i % 3) for i in range(60)]
    nodes = sorted({x for a, b, _ in pairs for x in (a, b)})
    graph = Graph(spark.createDataFrame([(x,) for x in nodes], "id string"), spark.createDataFrame(pairs, "src string, dst string, confidence double"))
    got = {r.id: r.score for r in analytics.pagerank(graph, ["l000"], rounds=8).collect()}
    near = collections.defaultdict(dict)
    for a, b, w in pairs:
        near[a][b] = near[b][a] = w
    want = {"l000": 1.0}
    for _ in range(8):
        nxt = collections.Counter({"l000": 0.15})
        for u, x in want.items():
            for v, w in near[u].items():
                nxt[v] += 0.85 * x * w / sum(near[u].values())
        want = dict(nxt)
    assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    assert max(held[-2:]) <= 6


def test_louvain_sends_no_table_to_the_driver(spark, monkeypatch):
    plans = []
    kept = analytics.table
    monkeypatch.setattr(analytics, "table", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    edges = spark.createDataFrame([(f"{i}:{j}", f"{i}:{j + 1}", 1.0) for i in range(3) for j in range(3)], "src string, dst string, confidence double")
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("ord", F.xxhash64("id"))
    analytics.louvain(Graph(ids, edges), sweeps=1, levels=1).collect()
    assert plans and not any("BroadcastExchange" in p for p in plans)


@pytest.mark.parametrize("hot", [0, 2, 100])
def test_retract_of_documents_of_many_edges(spark, hot):
    docs = ["a"] * 5 + ["b"] * 4 + ["c", "d", None, None]
    edges = spark.createDataFrame([(f"s{i}", "R", f"t{i}", d) for i, d in enumerate(docs)], "src string, rel string, dst string, doc string")
    live = spark.createDataFrame([("a",), ("a",), ("c",), ("z",)], "id string")
    kept = merge.retract(edges, live, hot=hot)
    assert sorted(r.src for r in kept.collect()) == sorted(f"s{i}" for i, d in enumerate(docs) if d in ("a", "c", None)) and kept.columns == edges.columns


def test_problems_join_no_edges_that_are_fine(spark):
    """All kinds of problems, null ends and ids included; edges themselves are not shuffled."""
    nodes = spark.createDataFrame([("a", "T"), ("b", "T"), ("b", "T"), ("c", "X"), ("d", "T"), ("e", None), (None, "T")], "id string, type string")
    edges = spark.createDataFrame([("a", "R", "b", "d1", "curated"), ("a", "R", "zz", "d1", "curated"), ("c", "R", "a", None, "odd"), (None, "R", "a", "d1", "curated"), ("e", "R", "a", "d1", None)], "src string, rel string, dst string, doc string, tier string")
    found = merge.problems(nodes, edges, ["T"])
    want = [("dangling edge", "R a"), ("dangling edge", "a R zz"), ("dangling edge", "e R a"), ("duplicate id", "b"), ("isolated node", None), ("isolated node", "d"), ("no document", "c R a"), ("unknown tier", "c R a"), ("unknown tier", "e R a"), ("unknown type", "c")]
    assert sorted(((r.problem, r.subject) for r in found.collect()), key=str) == sorted(want, key=str)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_duplicate_classes_spread_and_compare_little(spark, monkeypatch):
    """A table of one task is signed by several, and near copies are not compared once for each band."""
    compared = []
    made = duplicates._linked
    monkeypatch.setattr(duplicates, "_linked", lambda pairs, *rest: (compared.append(pairs.distinct().count()), made(pairs, *rest))[1])
    monkeypatch.setattr(duplicates, "SIGNED", 100)
    tasks = []
    kept = duplicates.table
    monkeypatch.setattr(duplicates, "table", lambda df: (tasks.append(df.rdd.getNumPartitions() if "sig" in df.columns and "id" in df.columns else 0), kept(df))[1])
    df = spark.range(400).coalesce(1).select(F.concat(F.lit("c"), "id").alias("id"), F.format_string("Customer#%09d", "id").alias("label"), F.lit(None).cast("array<string>").alias("aliases"))
    assert duplicates.duplicate_classes(df, 0.6).count() == 400
    assert tasks[0] == 4 and sum(compared) < 1600
