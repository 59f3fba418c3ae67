"""Sources on files, sinks read back, streams, and the command line."""

import json
import xml.etree.ElementTree as ET

import pytest

from lattica.__main__ import main
from lattica.schema import EDGE, NODE, Graph, conform
from lattica.sinks import files as sinks
from lattica.sources import files as sources
from lattica.streaming import incremental


@pytest.fixture
def put(tmp_path):
    def write(files):
        for name, text in files.items():
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path)

    return write


def rows(df):
    return {r.id: r for r in df.collect()}


def test_obsidian(spark, put):
    d = put(
        {
            "A.md": "---\ntitle: First note\ntags: [x, '#y']\ndate: 2024-01-02\n---\n# Head\nSee [[sub/B|the b]], [[missing]] and [[A]] with `[[C]]` #inline\n```\n[[C]]\n```",
            "sub/B.md": "---\ntags:\n- one\n- two\n---\nBack to [[a#part]]",
            "C.md": "plain",
        }
    )
    got = rows(sources.obsidian(spark, d))
    assert got["A"].title == "First note" and got["A"].tags == ["x", "y", "inline"] and got["A"].links == ["B"] and got["A"].date == "2024-01-02"
    assert got["B"].tags == ["one", "two"] and got["B"].links == ["A"] and got["C"].links == []
    assert "the b" in got["A"].text and "[[" not in got["A"].text


def test_logseq(spark, put):
    got = rows(sources.logseq(spark, put({"P.md": "title:: Page one\ntags:: a, b\n- see [[Q]]\n", "Q.md": "- text"})))
    assert got["P"].title == "Page one" and got["P"].tags == ["a", "b"] and got["P"].links == ["Q"] and got["P"].text == "see Q"


def test_blog_and_wiki(spark, put):
    d = put(
        {
            "one.html": '<meta property="article:published_time" content="2023-05-06T00:00"><h1>One</h1><div class="article-content"><p>Hi <a href="two.html">two</a> <a href="http://x/y.html">out</a></p></div>',
            "two.html": '<h1>Two</h1><div class="article-content">x</div>',
            "index.html": '<li data-tags="a,b"><a href="one.html">One</a></li>',
        }
    )
    got = rows(sources.html_blog(spark, d))
    assert set(got) == {"one", "two"} and got["one"].links == ["two"] and got["one"].tags == ["a", "b"] and got["one"].date == "2023-05-06"


def test_github_cursor(spark, put):
    items = [{"number": 1, "title": "t", "body": "b", "created_at": "2024-01-01T00", "updated_at": "2024-02-01", "labels": [{"name": "bug"}]}, {"number": 2, "title": "p", "updated_at": "2024-01-01", "pull_request": {}}]
    d = put({"a.json": json.dumps({"items": items})})
    docs, cursor = sources.github(spark, d + "/a.json")
    got = rows(docs)
    assert cursor == "2024-02-01" and got["github:repo#1"].kind == "issue" and got["github:repo#2"].kind == "pull-request" and got["github:repo#1"].tags == ["bug"]
    assert sources.github(spark, d + "/a.json", since="2024-02-01")[0].count() == 1


def test_radar_and_packs(spark, put):
    d = put(
        {
            "s.json": json.dumps({"assessments": {"k": {"title": "K", "platforms": {"Spark": [1.0], "Flink": [2.0]}}}}),
            "e.json": json.dumps({"entries": [{"id": "r1", "name": "R", "url": "http://h/x", "history": [{"date": "2020", "event": "moved"}, {"date": "2021", "event": "added"}]}]}),
            "packs/p.json": json.dumps({"subject": {"id": "s", "name": "S"}, "entities": [{"id": "a", "name": "A", "type": "Technology"}], "relationships": []}),
        }
    )
    assert sorted(rows(sources.radar_scorecards(spark, d + "/s.json"))["assessment:k"].platforms) == ["Flink", "Spark"]
    e = rows(sources.radar_entries(spark, d + "/e.json", {"http://h/": "doc:"}))["radar:r1"]
    assert e.date == "2021" and e.documented_in == "doc:x"
    docs, entities, relations = sources.entity_packs(spark, d + "/packs")
    assert [r.id for r in docs.collect()] == ["pack:p"] and entities.count() == 1 and relations.count() == 0


def test_rss_slugs(spark, put):
    d = put({"f.xml": "<rss><item><title>Same</title><link>u1</link><pubDate>Mon, 06 May 2024 10:00:00 GMT</pubDate></item><item><title>Same</title></item></rss>"})
    got = rows(sources.rss(spark, d + "/f.xml"))
    assert set(got) == {"same", "same-2"} and got["same"].date == "2024-05-06"
    with pytest.raises(ValueError, match="known"):
        sources.open_source(spark, "nothing", d)


@pytest.fixture
def small(spark):
    n = spark.createDataFrame([("a:1", 'A "x" & <y>', "T", 1), ("b", "B", "U", 2)], "id string, label string, type string, ord long")
    e = spark.createDataFrame([("a:1", "REL", "b", 0.5, 1)], "src string, rel string, dst string, confidence double, ord long")
    return Graph(conform(n, NODE), conform(e, EDGE))


def test_sinks(spark, small, tmp_path):
    sinks.graph_json(small, str(tmp_path / "g.json"))
    doc = json.loads((tmp_path / "g.json").read_text())
    assert [n["degree"] for n in doc["nodes"]] == [1, 1] and doc["edges"][0]["confidence"] == 0.5 and "url" not in doc["nodes"][0]
    back = sources.graph_json(spark, str(tmp_path / "g.json"))
    assert {r.id for r in back.nodes.collect()} == {"a:1", "b"} and back.edges.count() == 1
    for name, lines in (("x.graphml", sinks.graphml_lines(small)), ("x.gexf", sinks.gexf_lines(small))):
        sinks.single_file(lines, str(tmp_path / name))
        ET.parse(tmp_path / name)
    turtle = "\n".join(r.value for r in sinks.turtle_lines(small).collect())
    assert "ex:a_1 ex:REL ex:b ." in turtle and "_:stmt0 a rdf:Statement" in turtle
    sinks.csv(small, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv/edges")).first()["rel"] == "REL"
    sinks.parquet(small, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq/nodes")).count() == 2
    assert "[[B]]" in {r.name: r.value for r in sinks.vault_notes(small).collect()}["A -x- & -y-"]
    assert len(sinks.canvas(small)["nodes"]) == 2


def test_watch_and_delta(spark, put, tmp_path):
    d = put({"in/a.md": "x"})
    old = spark.createDataFrame(incremental.listing(spark, d + "/in").collect())
    put({"in/b.md": "y"})
    assert [r.change for r in incremental.listing_delta(old, incremental.listing(spark, d + "/in")).collect()] == ["added"]
    seen = []
    q = incremental.watch(spark, d + "/in", lambda batch, _: seen.append(batch.count()), d + "/ck")
    q.awaitTermination()
    assert sum(seen) == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = incremental.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("w").select("start", "event_type", "n").collect())) == sorted(map(str, incremental.windowed(events).select("start", "event_type", "n").collect()))


def test_command_line(small, tmp_path, capsys):
    g = str(tmp_path / "g.json")
    sinks.graph_json(small, g)
    assert main(["stats", "--graph", g]) == 0 and '"REL"' in capsys.readouterr().out
    assert main(["validate", "--graph", g]) == 1
    assert main(["sparql", "--graph", g, "--query", "SELECT ?x WHERE { ?x REL b }"]) == 0 and "a:1" in capsys.readouterr().out
    assert main(["diff", "--old", g, "--new", g, "--fail-on-change"]) == 0
    assert main(["convert", "--graph", g, "--format", "cypher", "--out", str(tmp_path / "c.txt")]) == 0
    assert main(["context", "--graph", g, "--entity", "nobody"]) == 1
