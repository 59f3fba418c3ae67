"""What lives on other machines: web pages, a knowledge base's entries, a language model's triples.

Executors fetch, by partitions of hosts, so one host is asked from one task and its
crawl delay holds.  Every function takes the caller's own ``fetch`` in place of the
network.  A page that cannot be had is a row with a status, never the end of a job.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.ontology import DEFAULT, Ontology
from lattica.schema import Graph
from lattica.session import ship

AGENT = "lattica/0.2"
#: (status, headers in lower case, text) of a request with headers.
Fetch = Callable[[str, dict[str, str]], tuple[int, dict[str, str], str]]


def get(url: str, headers: dict[str, str], timeout: float = 10.0) -> tuple[int, dict[str, str], str]:
    """One HTTP request; a status of the server's is an answer, too."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": AGENT} | headers), timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, ""


class Host:
    """One host's rules, read once: what may be fetched, and how long to wait between requests."""

    def __init__(self, root: str, fetch: Fetch, respect_robots: bool = True):
        self.rules, self.last = RobotFileParser(), 0.0
        lines: list[str] = []
        if respect_robots:
            try:
                status, _, text = fetch(f"{root}/robots.txt", {})
                lines = text.splitlines() if status == 200 else []
            except OSError:
                pass  # a host without reachable rules allows everything
        self.rules.parse(lines)
        self.delay = float(self.rules.crawl_delay(AGENT) or 0)

    def allows(self, url: str) -> bool:
        return self.rules.can_fetch(AGENT, url)

    def wait(self) -> None:
        time.sleep(max(0.0, self.last + self.delay - time.monotonic()))
        self.last = time.monotonic()


def page(url: str, known: dict[str, str], host: Host, fetch: Fetch, retries: int = 2, backoff: float = 0.5) -> tuple[str, str | None, str | None, str | None]:
    """(status, html, etag, last_modified): ``fetched``, ``unchanged``, ``disallowed``, or the failure."""
    if not host.allows(url):
        return "disallowed", None, None, None
    headers = {name: known[key] for name, key in (("If-None-Match", "etag"), ("If-Modified-Since", "last_modified")) if known.get(key)}
    failure = ""
    for attempt in range(retries + 1):
        if attempt:
            time.sleep(backoff * 2 ** (attempt - 1))
        host.wait()
        try:
            status, head, text = fetch(url, headers)
        except OSError as e:
            failure = f"failed: {e}"
            continue
        if status == 304:
            return "unchanged", known.get("html"), known.get("etag"), known.get("last_modified")
        if status == 200:
            return "fetched", text, head.get("etag"), head.get("last-modified")
        failure = f"failed: status {status}"
        if status < 500 and status != 429:
            break
    return failure, None, None, None


PAGE = "url string, status string, html string, etag string, last_modified string"


def pages(urls: DataFrame, cache: DataFrame | None = None, fetch: Fetch = get, respect_robots: bool = True, retries: int = 2, backoff: float = 0.5) -> DataFrame:
    """``PAGE`` rows of distinct urls; ``cache`` holds rows of an earlier run, whose pages are only asked whether they changed.

    The result is the next run's cache; ``files.web_pages`` makes Documents of it.
    Materialise it: a row computed twice is fetched twice.
    """
    ship(urls.sparkSession)
    asked = urls.select("url").where("url rlike '^https?://'").distinct()
    kept = cache.where("html is not null").select("url", "html", "etag", "last_modified") if cache is not None else asked.limit(0).selectExpr("url", *[f"cast(null as string) as {c}" for c in ("html", "etag", "last_modified")])
    joined = asked.join(kept, "url", "left").withColumn("host", F.regexp_extract("url", r"^(https?://[^/?#]+)", 1))

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hosts: dict[str, Host] = {}
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                if r["host"] not in hosts:
                    hosts[r["host"]] = Host(r["host"], fetch, respect_robots)
                known = {k: v for k, v in r.items() if isinstance(v, str)}
                out.append((r["url"], *page(r["url"], known, hosts[r["host"]], fetch, retries, backoff)))
            yield pd.DataFrame(out, columns=["url", "status", "html", "etag", "last_modified"])

    return joined.repartition("host").mapInPandas(rows, PAGE)


def wikidata(label: str, fetch: Fetch = get, limit: int = 3) -> list[dict]:
    """Entries that a label finds; none if the service cannot be reached."""
    ask = urlencode({"action": "wbsearchentities", "search": label, "language": "en", "format": "json", "limit": limit})
    try:
        status, _, text = fetch(f"https://www.wikidata.org/w/api.php?{ask}", {})
        return json.loads(text).get("search", []) if status == 200 else []
    except (OSError, ValueError):
        return []


def linked(graph: Graph, find: Callable[[str], list[dict]] = wikidata, most: int = 100) -> Graph:
    """The graph with a ``wikidata`` url, id and description on the first ``most`` nodes for which an entry is found."""
    ship(graph.nodes.sparkSession)
    asked = graph.nodes.orderBy("ord", "id").limit(most).select("id", F.coalesce("label", "id").alias("label"))

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(i, *((top[0]["id"], top[0].get("description", "")) if label and (top := find(label)) and top[0].get("id") else (None, None))) for i, label in zip(part["id"], part["label"])]
            yield pd.DataFrame(found, columns=["id", "qid", "about"], dtype="object")

    hits = asked.mapInPandas(rows, "id string, qid string, about string").where("qid is not null")
    n = graph.nodes.join(hits, "id", "left")
    text = lambda c: F.coalesce(c, F.create_map().cast("map<string,string>"))
    put = lambda c, new: F.when(F.col("qid").isNotNull(), F.map_concat(F.map_filter(text(c), lambda k, _: ~k.isin(*new)), F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)]))).otherwise(F.col(c))
    nodes = n.withColumns({"urls": put("urls", {"wikidata": F.concat(F.lit("http://www.wikidata.org/entity/"), "qid")}), "meta": put("meta", {"wikidata_id": F.col("qid"), "wikidata_desc": F.col("about")})})
    return Graph(nodes.select(*graph.nodes.columns), graph.edges)


def prompt(text: str, ontology: Ontology = DEFAULT) -> str:
    """What a model is asked: the vocabulary, the shape of the answer, the text."""
    shape = {"entities": [{"id": "kebab-case-id", "label": "Full Name", "type": "one of the types"}], "relations": [{"src": "entity id", "rel": "one of the relations", "dst": "entity id", "explanation": "why"}]}
    return f"Read the text and name the entities and relations it states, as one JSON object and nothing else.\nTypes: {', '.join(sorted(ontology.entity_types))}\nRelations: {', '.join(sorted(ontology.relations))}\nShape: {json.dumps(shape)}\nText:\n{text}\n"


def answer_of(raw: str) -> dict[str, list[dict]]:
    """The JSON object within a model's answer, fenced or bare; empty lists where there is none."""
    found = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", raw, re.S) or re.search(r"(\{.*\})", raw, re.S)
    try:
        data = json.loads(found[1]) if found else {}
    except ValueError:
        data = {}
    return {k: [x for x in (data.get(k) or []) if isinstance(x, dict)] for k in ("entities", "relations")}


def asks(endpoint: str = "http://localhost:11434/api/generate", model: str = "llama3", timeout: float = 45.0) -> Callable[[str], str]:
    """A model behind an HTTP endpoint, as a function from prompt to answer; empty if it cannot be reached."""

    def ask(said: str) -> str:
        body = json.dumps({"model": model, "prompt": said, "stream": False, "format": "json"}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(endpoint, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
                got = json.loads(r.read())
                return got.get("response") or got.get("content") or ""
        except (OSError, ValueError):
            return ""

    return ask


def triples(docs: DataFrame, ask: Callable[[str], str], ontology: Ontology = DEFAULT, key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(entities (doc, id, label, type), relations (doc, src, rel, dst, explanation)) that a model states and the ontology allows, by document."""
    ship(docs.sparkSession)

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, said in zip(part["doc"], part["text"]):
                got = answer_of(ask(prompt(said, ontology))) if said else {"entities": [], "relations": []}
                known = {str(e["id"]) for e in got["entities"] if e.get("id") and e.get("type") in ontology.entity_types}
                out += [(doc, "entity", str(e["id"]), str(e.get("label") or e["id"]), e["type"], None, None) for e in got["entities"] if str(e.get("id")) in known and e.get("type") in ontology.entity_types]
                names = {r.lower() for r in ontology.relations}
                out += [(doc, "relation", str(r["src"]), None, str(r["rel"]).lower(), str(r["dst"]), r.get("explanation")) for r in got["relations"] if str(r.get("rel", "")).lower() in names and str(r.get("src")) in known and str(r.get("dst")) in known]
            yield pd.DataFrame(out, columns=["doc", "kind", "id", "label", "type", "dst", "explanation"], dtype="object")

    said = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).mapInPandas(rows, "doc string, kind string, id string, label string, type string, dst string, explanation string")
    return said.where("kind = 'entity'").select("doc", "id", "label", "type"), said.where("kind = 'relation'").select("doc", F.col("id").alias("src"), F.col("type").alias("rel"), "dst", "explanation")


def pack_toml(entities: list[dict], relations: list[dict]) -> str:
    """A pack of one document's triples, for review by hand."""
    lines = ["# Extracted by a language model: review before use.", ""]
    for name, rows in (("entity", entities), ("relation", relations)):
        for r in rows:
            lines += [f"[[{name}]]", *(f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in r.items() if v is not None), ""]
    return "\n".join(lines)


