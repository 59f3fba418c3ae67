"""Pages, entries and triples from other machines (never over the network), routes, playback, tree layouts."""

import json
import random

import numpy as np
import pytest

from lattica.operators import layout
from lattica.plans import routes
from lattica.schema import EDGE, NODE, Graph, conform
from lattica.sources import remote


@pytest.fixture
def site():
    def answer(url, headers):
        """A made-up network; a function of its request alone, as it runs in workers."""
        if url.endswith("/robots.txt"):
            return (200, {}, "User-agent: *\nDisallow: /private\n") if "one.org" in url else (404, {}, "")
        if "gone" in url:
            return 404, {}, ""
        if "down" in url:
            raise OSError("no route")
        if headers.get("If-None-Match") == "v1":
            return 304, {}, ""
        return 200, {"etag": "v1"}, f"<p>{url}</p>"

    return answer


def test_pages(spark, site):
    urls = ["http://one.org/a", "http://one.org/private/x", "http://two.org/private/x", "http://two.org/gone", "http://down.org/", "ftp://x/y", "http://one.org/a", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    first = remote.pages(df, fetch=site, backoff=0.0).cache()
    got = {r.url: (r.status, r.html) for r in first.collect()}
    assert got == {
        "http://one.org/a": ("fetched", "<p>http://one.org/a</p>"), "http://one.org/private/x": ("disallowed", None), "http://two.org/private/x": ("fetched", "<p>http://two.org/private/x</p>"),
        "http://two.org/gone": ("failed: status 404", None), "http://down.org/": ("failed: no route", None),
    }
    again = {r.url: (r.status, r.html) for r in remote.pages(df, first, site, backoff=0.0).collect()}
    assert again["http://one.org/a"] == ("unchanged", "<p>http://one.org/a</p>") and again["http://two.org/gone"][0] == "failed: status 404"
    assert "http://one.org/private/x" in {r.url for r in remote.pages(df, fetch=site, respect_robots=False).where("status = 'fetched'").collect()}


def test_retries_and_delay():
    tries = []

    def flaky(url, headers):
        tries.append(url)
        if len(tries) < 3:
            raise OSError("reset")
        return 200, {}, "ok"

    host = remote.Host("http://x", lambda u, h: (404, {}, ""))
    assert remote.page("http://x/a", {}, host, flaky, 2, 0.0)[:2] == ("fetched", "ok") and len(tries) == 3
    tries.clear()
    assert remote.page("http://x/a", {}, host, flaky, 1, 0.0)[0] == "failed: reset" and len(tries) == 2
    assert remote.Host("http://x", lambda u, h: (200, {}, "User-agent: *\nCrawl-delay: 2\n")).delay == 2.0


@pytest.fixture
def ring(spark):
    """A ring of eight, a tail on it, and one node by itself."""
    names = [f"r{i}" for i in range(8)] + ["t1", "t2", "alone"]
    edges = [(f"r{i}", f"r{(i + 1) % 8}") for i in range(8)] + [("r0", "t1"), ("t1", "t2")]
    nodes = spark.createDataFrame([(n, n.upper(), "Concept", f"202{i % 3}-01-01", i) for i, n in enumerate(names)], "id string, label string, type string, valid_from string, ord long")
    rows = [(a, "NEXT" if a[0] == b[0] else "TAIL", b, i) for i, (a, b) in enumerate(edges)]
    return Graph(conform(nodes, NODE), conform(spark.createDataFrame(rows, "src string, rel string, dst string, ord long"), EDGE))


def test_linked(ring):
    find = lambda label: [{"id": f"Q{label}", "description": "about"}] if label.startswith("R") else []
    got = {r.id: r for r in remote.linked(ring, find, 9).nodes.collect()}
    assert got["r1"].urls == {"wikidata": "http://www.wikidata.org/entity/QR1"} and got["r1"].meta["wikidata_id"] == "QR1"
    assert got["t1"].urls is None and len(got) == 11


def test_triples(spark):
    def ask(said):
        if "Spark" not in said.split("Text:")[1]:
            return "sorry"
        return "Here:\n```json\n" + json.dumps({"entities": [{"id": "spark", "label": "Spark", "type": "Technology"}, {"id": "sql", "type": "Language"}, {"id": "x", "type": "Nope"}], "relations": [{"src": "spark", "rel": "Supports", "dst": "sql"}, {"src": "spark", "rel": "USES", "dst": "x"}]}) + "\n```"

    docs = spark.createDataFrame([("a", "Spark does SQL"), ("b", "nothing"), ("c", None)], "id string, text string")
    entities, relations = remote.triples(docs, ask)
    assert {tuple(r) for r in entities.collect()} == {("a", "spark", "Spark", "Technology"), ("a", "sql", "sql", "Language")}
    assert [tuple(r)[:4] for r in relations.collect()] == [("a", "spark", "supports", "sql")]
    import tomllib

    assert tomllib.loads(remote.pack_toml([r.asDict() for r in entities.collect()], []))["entity"][0]["doc"] == "a"


def test_waypoints(spark, ring):
    got = sorted(map(tuple, routes.by_waypoints(ring, ["t2", "r2", "r1", "r1", "alone"]).collect()))
    assert got == [(0, 0, "t2"), (0, 1, "t1"), (0, 2, "r0"), (0, 3, "r1"), (0, 4, "r2"), (1, 0, "r2"), (1, 1, "r1"), (2, 0, "r1")]


def test_guided(spark, ring):
    tour = lambda *a, **k: [r.id for r in routes.guided(ring, *a, **k).orderBy("step").collect()]
    assert tour(most=3) == ["r0", "r1", "r2"]
    assert tour("edges", start="t2", hops=3) == ["t2", "t1", "r0", "r1"]
    assert tour("relation", start="t1", relation="NEXT", hops=2) == ["t1", "t2", "r0"] and len(set(tour("edges", hops=20))) == 11
    clusters = spark.createDataFrame([("r3", 1), ("r0", 1), ("t1", 2), ("t2", 2)], "id string, community int")
    assert tour("cluster", clusters=clusters) == ["r0", "t1"]


def test_playback(ring):
    changes = routes.frame_changes(ring, ["2020-06-01", "2022-06-01"]).where("kind = 'node'").collect()
    assert {r.id for r in changes if r.date == "2020-06-01"} == {"r0", "r3", "r6", "t2"} and sum(r.date == "2022-06-01" for r in changes) == 7


def test_tree_forces():
    rng = np.random.default_rng(random.Random(1).randint(0, 99))
    points = np.concatenate([rng.normal(0, 1, (300, 2)), rng.normal(8, 0.2, (200, 2)), np.zeros((20, 2))])
    gap = points[:, None] - points[None]
    exact = (gap / np.maximum((gap**2).sum(2), 1e-9)[:, :, None]).sum(1)
    assert np.allclose(layout.tree_forces(points, 0.0), exact)
    near = layout.tree_forces(points, 0.6)
    assert np.linalg.norm(near - exact) < 0.05 * np.linalg.norm(exact)


def test_layouts(spark, ring):
    assert layout.force(ring, 20, theta=0.7).count() == 11
    assert {r.lod for r in layout.multiscale(ring, 5).collect()} == {0, 1, 2}
    n = spark.createDataFrame([("a", {"quadrant": "Tools", "ring": "Hold"}), ("b", None)], "id string, meta map<string,string>")
    a, b = sorted(layout.radar(n).collect(), key=lambda r: r.id)
    assert a.px < 0 < a.py and 580 <= np.hypot(a.px, a.py) <= 680 and 300 <= np.hypot(b.px, b.py) <= 400
    vectors = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.0, 0.0, 1.0])], "id string, embedding array<double>")
    assert layout.semantic(n, vectors).where("px is not null").count() == 2
