"""The store of claims: changes, deletions, replays and failed runs against full builds."""

import pytest
from pyspark.sql import functions as F

from lattica.iterate import cut
from lattica.operators import extract
from lattica.schema import DOCUMENT, conform
from lattica.streaming.store import ClaimStore, stated


def documents(spark, rows):
    """(id, tags, links, ord) as articles."""
    return conform(spark.createDataFrame([(i, f"Title {i}", "article", t, ls, n) for i, t, ls, n in rows], "id string, title string, kind string, tags array<string>, links array<string>, ord long"), DOCUMENT)


def shown(graph):
    nodes = sorted((r.id, r.label, r.type) for r in graph.nodes.collect())
    return nodes, sorted((r.src, r.rel, r.dst, r.doc) for r in graph.edges.collect())


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([], extract.REGISTRY)


def rows(n):
    return [(f"d{i}", [f"t{i % 3}", f"own-{i}"], [f"d{(i + 1) % n}"], i) for i in range(n)]


def test_store_rewrites_what_changed(spark, registry, tmp_path):
    seen = []
    claims = stated(registry)

    def counting(docs):
        seen.append(docs.count())
        return claims(docs)

    store = ClaimStore(spark, str(tmp_path / "s"), buckets=16)
    full = lambda docs, name: (lambda s: (s.sync(docs, claims), shown(s.graph()))[1])(ClaimStore(spark, str(tmp_path / name), buckets=3))
    first = rows(20)
    docs = documents(spark, first)
    store.sync(docs, counting, batch=0)
    nodes, edges = map(cut, extract.deterministic(docs, registry))
    from lattica.operators.merge import merge

    assert shown(store.graph()) == shown(merge(nodes, edges, docs.select("id"))) and seen == [20]

    # two changed, one added, two removed, and one of the removed is linked to
    later = [r for r in first if r[0] not in ("d4", "d9")]
    later = [(i, ["changed"], ls, n) if i in ("d2", "d7") else (i, t, ls, n) for i, t, ls, n in later] + [("new", ["t1"], ["d0"], 50)]
    now = documents(spark, later)
    assert {(r.doc, r.change) for r in store.changes(now).collect()} == {("d2", "changed"), ("d7", "changed"), ("new", "added"), ("d4", "removed"), ("d9", "removed")}
    was = store.manifest()
    touched = store.sync(now, counting, batch=1)
    places = {r.b for r in spark.createDataFrame([(x,) for x in ("d2", "d7", "new", "d4", "d9")], "doc string").select(F.pmod(F.xxhash64("doc"), F.lit(16)).alias("b")).collect()}
    assert set(touched) == places and seen == [20, 3]
    is_ = store.manifest()
    assert all(is_["files"][k].get(b) == v for k in was["files"] for b, v in was["files"][k].items() if int(b) not in places)
    want = full(now, "f")
    assert shown(store.graph()) == want

    # a batch that comes again, and no change at all
    assert store.sync(documents(spark, first), counting, batch=1) == [] and store.sync(now, counting, batch=2) == []
    assert shown(store.graph()) == want and store.manifest()["batch"] == 2

    # a run that failed before its manifest leaves nothing behind that is read, and does not hinder the next
    def broken(docs):
        nodes, edges = claims(docs)
        return nodes, edges.withColumn("explanation", F.raise_error(F.lit("lost")))

    with pytest.raises(Exception, match="lost"):
        store.sync(documents(spark, first), broken, batch=3)
    assert shown(store.graph()) == want
    store.sync(documents(spark, first), claims, batch=3)
    assert shown(store.graph()) == full(documents(spark, first), "g")
    assert store.compact() and shown(store.graph()) == full(documents(spark, first), "h")


def test_store_odd_documents(spark, registry, tmp_path):
    """Null ids are left out, of equal ids the first counts, a new stamp renews all, and an empty table empties the store."""
    store = ClaimStore(spark, str(tmp_path / "o"), buckets=4)
    docs = documents(spark, [("a", ["x"], [], 1), ("a", ["y"], [], 2), (None, ["z"], [], 3), ("b", None, None, 4)])
    store.sync(docs, stated(registry), stamp="1")
    assert {r.id for r in store.graph().nodes.collect()} == {"a", "topic:x"}
    assert store.changes(docs, "1").count() == 0 and {r.change for r in store.changes(docs, "2").collect()} == {"changed"}
    assert store.sync(docs, stated(registry), stamp="2") and store.changes(docs, "2").count() == 0
    store.sync(docs.limit(0), stated(registry), stamp="2")
    assert store.graph().nodes.count() == 0 and store.read("docs").count() == 0
