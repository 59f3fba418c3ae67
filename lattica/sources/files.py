"""File sources, each a DataFrame of Documents: markdown vaults, blogs, wiki exports, JSON feeds.

Files are read whole by Spark's own readers, so any file system that Spark knows
will do; parsing is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lattica.functions import text as T
from lattica.schema import DOCUMENT, EDGE, NODE, Graph, conform, given
from lattica.sources.html import page_text



def _none() -> Column:
    return F.array().cast("array<string>")


def whole(spark: SparkSession, path: str, glob: str, recursive: bool = True) -> DataFrame:
    """(path, stem, raw) of all files below a folder."""
    df = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return df.select(name.alias("path"), F.regexp_extract(F.url_decode(name), r"([^/]+)\.[^./]+$", 1).alias("stem"), F.regexp_replace("value", "\r\n", "\n").alias("raw"))


def front_matter(raw: Column) -> tuple[Column, Column]:
    """(block between the first ``---`` lines or empty, body after it)."""
    block = F.regexp_extract(raw, r"(?s)\A---\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    return block, F.regexp_replace(raw, r"(?s)\A---\n.*?\n---[ \t]*(?:\n|\z)", "")


def front_value(block: Column, key: str) -> Column:
    """A plain value of ``key: value``, without quotes; null if absent."""
    return given(F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*([^\n\[]*)$", 1), r"^[\"']|[\"']\s*$", "")))


def front_list(block: Column, key: str) -> Column:
    """``key: [a, b]``, ``key:`` with ``- item`` lines, or a single value, as an array."""
    flow = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\[([^\]]*)\]", 1)
    lines = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[ \t]+[^\n]*(?:\n|\z))+)", 1)
    clean = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[ \t]*-[ \t]+", "")), r"^[\"']|[\"']$", "")
    parts = F.when(flow != "", F.split(flow, ",")).when(lines != "", F.split(lines, "\n")).otherwise(F.array(F.coalesce(front_value(block, key), F.lit(""))))
    return F.filter(F.transform(parts, clean), lambda x: x != "")


def wikilinks(body: Column) -> Column:
    """Targets of ``[[target#heading|alias]]``."""
    return F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def plain_text(body: Column) -> Column:
    """Prose of markdown: no fences, inline code, headings or emphasis; links as shown."""
    t = F.regexp_replace(body, r"(?s)```.*?```|~~~.*?~~~", " ")
    t = F.regexp_replace(t, r"`[^`\n]*`", " ")
    t = F.regexp_replace(t, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1")
    t = F.regexp_replace(t, r"\[\[([^\]#|]*)(?:#[^\]|]*)?\]\]", "$1")
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(?m)^[ \t]*#{1,6}[ \t]+|[*_]{1,3}", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def _linked(notes: DataFrame) -> DataFrame:
    """``targets`` to ids of notes, by full name then by last part, in any case; no loops, sorted."""
    wanted = notes.select("id", F.explode("targets").alias("target"))
    keys = notes.select(F.lower("id").alias("key"), F.col("id").alias("to")).groupBy("key").agg(F.min("to").alias("to"))
    by_name = wanted.withColumn("key", F.lower("target")).join(keys, "key", "left").withColumn("key", F.lower(F.regexp_extract("target", r"([^/]+)$", 1))).withColumnRenamed("to", "full")
    found = by_name.join(keys, "key", "left").select("id", F.coalesce("full", "to").alias("to")).where("to is not null and to <> id")
    links = found.groupBy("id").agg(F.sort_array(F.collect_set("to")).alias("links"))
    return notes.join(links, "id", "left").withColumn("links", F.coalesce("links", _none()))


def _numbered(docs: DataFrame) -> DataFrame:
    """``ord`` by path: a global order of file names, as few as there are files."""
    return conform(docs.withColumn("ord", F.row_number().over(W.orderBy("path")).cast("bigint")), DOCUMENT)


def obsidian(spark: SparkSession, path: str, url_base: str = "/vault/", recursive: bool = True) -> DataFrame:
    raw = whole(spark, path, "*.md", recursive)
    block, body = front_matter(F.col("raw"))
    n = raw.select("path", F.col("stem").alias("id"), block.alias("fm"), body.alias("body"))
    prose = F.regexp_replace(F.regexp_replace("body", r"(?s)```.*?```", " "), r"`[^`\n]*`", " ")
    inline = F.regexp_extract_all(prose, F.lit(r"(?:^|\s)#([\p{L}][\p{L}\p{N}_/-]*)"), F.lit(1))
    tags = F.array_distinct(F.concat(F.transform(front_list(F.col("fm"), "tags"), lambda x: F.regexp_replace(x, "^#", "")), inline))
    title = F.coalesce(front_value(F.col("fm"), "title"), F.col("id"))
    n = n.select("path", "id", title.alias("title"), F.concat(F.lit(url_base), T.slug(title)).alias("url"), F.lit("article").alias("kind"), F.coalesce(front_value(F.col("fm"), "date"), front_value(F.col("fm"), "created")).alias("date"), plain_text(F.col("body")).alias("text"), tags.alias("tags"), wikilinks(prose).alias("targets"))
    return _numbered(_linked(n))


def logseq(spark: SparkSession, path: str, url_base: str = "/notes/", recursive: bool = True) -> DataFrame:
    """As a vault, with ``key:: value`` lines at the head and bullets in the text."""
    raw = whole(spark, path, "*.md", recursive)
    value = lambda key: given(F.trim(F.regexp_extract("raw", rf"(?m)^[ \t]*(?:-[ \t]+)?{key}::[ \t]*([^\n]*)$", 1)))
    body = F.regexp_replace(F.regexp_replace("raw", r"(?m)^[ \t]*(?:-[ \t]+)?[A-Za-z_-]+::[^\n]*\n?", ""), r"(?m)^[ \t]*-[ \t]+", "")
    listed = F.filter(F.transform(F.split(F.coalesce(value("tags"), F.lit("")), ","), lambda x: F.regexp_replace(F.trim(x), r"^#|\[\[|\]\]", "")), lambda x: x != "")
    inline = F.regexp_extract_all(body, F.lit(r"(?:^|\s)#([\p{L}][\p{L}\p{N}_/-]*)"), F.lit(1))
    title = F.coalesce(value("title"), F.col("stem"))
    n = raw.select("path", F.col("stem").alias("id"), title.alias("title"), F.concat(F.lit(url_base), T.slug(title)).alias("url"), F.lit("article").alias("kind"), value("date").alias("date"), plain_text(body).alias("text"), F.array_distinct(F.concat(listed, inline)).alias("tags"), wikilinks(body).alias("targets"))
    return _numbered(_linked(n))


def visible_html(c: Column) -> Column:
    """Text of a fragment, such as a title or a line, with the commonest references decoded; whole pages go by ``page_text``."""
    t = F.regexp_replace(c, r"(?is)<(script|style|nav|header|footer|noscript|template)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(ch))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def html_blog(spark: SparkSession, path: str, url_base: str = "/blog/", index: str = "index") -> DataFrame:
    """Pages but index, topics and start-here; links to sibling pages, tags from the index page."""
    raw = whole(spark, path, "*.html", False)
    body = F.regexp_extract("raw", r"(?s)class=\"article-content\"[^>]*>(.*)", 1)
    pages = raw.where(~F.col("stem").isin("index", "topics", "start-here"))
    links = F.array_distinct(F.regexp_extract_all(body, F.lit(r"href=\"(?:\./)?([^\"/:#?]+)\.html"), F.lit(1)))
    tagged = raw.where(F.col("stem") == index).select(F.explode(F.regexp_extract_all("raw", F.lit(r"(?s)<[^>]*data-tags=\"[^\"]*\"[^>]*>.*?href=\"(?:\./)?[^\"/]+\.html"), F.lit(0))).alias("x"))
    tags = tagged.select(F.regexp_extract("x", r"href=\"(?:\./)?([^\"/]+)\.html$", 1).alias("id"), F.filter(F.transform(F.split(F.regexp_extract("x", r"data-tags=\"([^\"]*)\"", 1), r"[,\s]+"), lambda t: F.trim(t)), lambda t: t != "").alias("tags")).dropDuplicates(["id"])
    n = pages.select("path", F.col("stem").alias("id"), F.coalesce(given(visible_html(F.regexp_extract("raw", r"(?is)<h1[^>]*>(.*?)</h1>", 1))), F.col("stem")).alias("title"), F.concat(F.lit(url_base), "stem").alias("url"), F.lit("article").alias("kind"), given(F.substr(F.regexp_extract("raw", r"article:published_time\"\s+content=\"([^\"]*)\"", 1), F.lit(1), F.lit(10))).alias("date"), page_text(body).alias("text"), links.alias("targets"))
    return _numbered(_linked(n).join(tags, "id", "left").withColumn("tags", F.coalesce("tags", _none())))


def web_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Fetched pages as Documents: the first spelling of a URL, links within the batch."""
    n = pages.where(F.col(url).isNotNull()).select(F.col(key).alias("k"), F.col(url).alias("url"), T.normal_url(F.col(url)).alias("norm"), F.col(html).alias("html"))
    first = n.groupBy("norm").agg(F.min_by(F.struct("k", "url", "html"), "k").alias("p")).select("norm", "p.*")
    wanted = first.select("norm", F.explode(F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*\bhref=[\"']([^\"']+)"), F.lit(1))).alias("href"))
    host = F.regexp_extract("norm", r"^([a-z][a-z0-9+.-]*://[^/?]*)", 1)
    full = T.normal_url(F.when(F.col("href").startswith("/"), F.concat(host, "href")).otherwise(F.col("href")))
    links = wanted.select("norm", full.alias("to")).where("to <> norm").join(first.select(F.col("norm").alias("to")), "to", "left_semi").groupBy("norm").agg(F.sort_array(F.collect_set("to")).alias("links"))
    title = F.coalesce(given(visible_html(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))), F.col("url"))
    body = F.regexp_replace("html", r"(?is)<head\b.*?</head\s*>", " ")
    return conform(first.join(links, "norm", "left").select(F.col("norm").alias("id"), title.alias("title"), "url", F.lit("article").alias("kind"), page_text(body).alias("text"), _none().alias("tags"), F.coalesce("links", _none()).alias("links"), F.col("k").cast("bigint").alias("ord")), DOCUMENT)


GITHUB = "number int, title string, html_url string, body string, created_at string, updated_at string, state string, user struct<login:string>, labels array<struct<name:string>>, pull_request string"


def github(spark: SparkSession, path: str, repo: str = "repo", since: str | None = None) -> tuple[DataFrame, str | None]:
    """(Documents, new cursor) of an issue list or of its ``items``; strictly older rows are left out."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json(F.coalesce(F.get_json_object("value", "$.items"), "value"), f"array<struct<{_struct(GITHUB)}>>")).alias("r")).select("r.*")
    if since:
        rows = rows.where(F.col("updated_at").isNull() | (F.col("updated_at") >= since))
    kind = F.when(F.col("pull_request").isNotNull(), "pull-request").otherwise("issue")
    docs = rows.select(F.concat(F.lit(f"github:{repo}#"), "number").alias("id"), "title", F.col("html_url").alias("url"), kind.alias("kind"), F.substr("created_at", F.lit(1), F.lit(10)).alias("date"), F.concat_ws("\n\n", "title", given("body")).alias("text"), F.coalesce(F.transform("labels", lambda x: x["name"]), _none()).alias("tags"), _none().alias("links"), F.col("number").cast("bigint").alias("ord"))
    return conform(docs, DOCUMENT), rows.agg(F.max("updated_at")).first()[0]


def _struct(ddl: str) -> str:
    from lattica.schema import fields

    return ",".join(f"{n}:{t}" for n, t in fields(ddl))


def notion(spark: SparkSession, path: str, workspace: str = "notion") -> DataFrame:
    raw = whole(spark, path, "*.md")
    block, body = front_matter(F.col("raw"))
    n = raw.select("path", "stem", block.alias("fm"), body.alias("body"))
    bare = F.trim(F.regexp_replace("stem", r"\s*[0-9a-f]{32}$", ""))
    title = F.coalesce(front_value(F.col("fm"), "title"), given(F.trim(F.regexp_extract("body", r"(?m)^#[ \t]+(.+)$", 1))), bare)
    return _numbered(n.select("path", F.concat(F.lit("notion:"), T.slug(F.col("stem"))).alias("id"), title.alias("title"), F.concat(F.lit(f"/{workspace}/"), T.slug(title)).alias("url"), F.lit("notion-page").alias("kind"), front_value(F.col("fm"), "date").alias("date"), plain_text(F.col("body")).alias("text"), front_list(F.col("fm"), "tags").alias("tags"), _none().alias("links")))


def confluence(spark: SparkSession, path: str, space: str = "SPACE") -> DataFrame:
    raw = whole(spark, path, "*.{html,htm,md}")
    title = F.coalesce(given(F.regexp_replace(visible_html(F.regexp_extract("raw", r"(?is)<title[^>]*>(.*?)</title>", 1)), r" - Confluence$", "")), F.col("stem"))
    body = F.regexp_replace("raw", r"(?is)<head\b.*?</head\s*>", " ")
    lines = F.split(F.regexp_replace(body, r"(?i)</?(p|div|br|li|h[1-6]|tr|table|ul|ol)\b[^>]*>", "\n"), "\n")
    text = F.array_join(F.filter(F.transform(lines, visible_html), lambda x: x != ""), "\n")
    return _numbered(raw.select("path", F.concat(F.lit(f"confluence:{space}:"), T.slug(F.col("stem"))).alias("id"), title.alias("title"), F.concat(F.lit(f"/{space}/"), T.slug(title)).alias("url"), F.lit("confluence-page").alias("kind"), text.alias("text"), _none().alias("tags"), _none().alias("links")))


PACK = "subject struct<id:string,name:string,type:string>, entities array<struct<id:string,name:string,type:string,short_description:string,aliases:array<string>,wikipedia_url:string,canonical_url:string,blog_url:string,related_blog_urls:array<string>,architecture_radar_url:string>>, relationships array<struct<source_id:string,relationship:string,target_id:string,confidence:double,explanation:string,scope:string,sources:array<string>>>"


def entity_packs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(Documents, entities, relations) of curated packs, one file each."""
    raw = whole(spark, path, "*.json", False).where(~F.col("stem").endswith(".schema"))
    p = raw.select("path", F.concat(F.lit("pack:"), "stem").alias("id"), F.from_json("raw", f"struct<{_struct(PACK)}>").alias("p")).withColumn("ord", F.row_number().over(W.orderBy("path")).cast("bigint"))
    docs = conform(p.select("id", F.coalesce("p.subject.name", "id").alias("title"), F.lit("entity-pack").alias("kind"), "ord"), DOCUMENT)
    place = lambda: (F.col("ord") * (1 << 20) + F.col("place")).alias("ord")
    entities = p.select("id", "ord", F.posexplode("p.entities").alias("place", "e")).select(F.col("id").alias("doc"), F.col("e.id").alias("id"), "e.name", "e.type", F.col("e.short_description").alias("description"), "e.aliases", "e.blog_url", "e.related_blog_urls", "e.architecture_radar_url", place())
    relations = p.select("id", "ord", F.posexplode("p.relationships").alias("place", "r")).select(F.col("id").alias("doc"), "r.source_id", "r.relationship", "r.target_id", "r.confidence", "r.explanation", "r.scope", "r.sources", place())
    return docs, entities, relations


def radar_scorecards(spark: SparkSession, path: str) -> DataFrame:
    card = "struct<title:string,url:string,published:string,use_case:string,platforms:map<string,array<double>>,category:string,verdict:string>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<assessments:map<string,{card}>>")["assessments"]).alias("key", "c"))
    return conform(rows.select(F.concat(F.lit("assessment:"), "key").alias("id"), F.coalesce("c.title", "key").alias("title"), "c.url", F.lit("assessment").alias("kind"), F.col("c.published").alias("date"), F.concat_ws("\n", "c.use_case", "c.verdict").alias("text"), _none().alias("tags"), _none().alias("links"), F.map_keys("c.platforms").alias("platforms"), F.row_number().over(W.orderBy("key")).cast("bigint").alias("ord")), DOCUMENT)


def radar_entries(spark: SparkSession, path: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    entry = "struct<id:string,name:string,url:string,quadrant:string,ring:string,category:string,scorecard:struct<assessment:string,options:array<string>>,history:array<struct<date:string,event:string,ring:string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"struct<entries:array<{entry}>>")["entries"]).alias("place", "e"))
    to = F.lit(None).cast("string")
    for prefix, start in (prefixes or {}).items():
        to = F.when(F.col("e.url").startswith(prefix), F.concat(F.lit(start), F.substr("e.url", F.lit(len(prefix) + 1)))).otherwise(to)
    added = F.filter("e.history", lambda h: h["event"] == "added")
    return conform(rows.select(F.concat(F.lit("radar:"), "e.id").alias("id"), F.col("e.name").alias("title"), "e.url", F.lit("radar").alias("kind"), F.get(added, F.lit(0))["date"].alias("date"), F.concat_ws(" ", "e.quadrant", "e.ring").alias("text"), _none().alias("tags"), _none().alias("links"), F.coalesce("e.scorecard.options", _none()).alias("options"), F.col("e.id").alias("entry"), F.when(F.col("e.scorecard.assessment").isNotNull(), F.concat(F.lit("assessment:"), "e.scorecard.assessment")).alias("assessment"), to.alias("documented_in"), F.col("place").cast("bigint").alias("ord")), DOCUMENT)


def tabular(nodes: DataFrame | None = None, edges: DataFrame | None = None, name: str = "table") -> Graph:
    """Rows as a graph: type ``Concept``, relation ``relates_to``, confidence 1 and the table as document where none is given."""
    spark = (nodes if nodes is not None else edges).sparkSession
    n = conform(nodes, NODE) if nodes is not None else spark.createDataFrame([], NODE)
    e = conform(edges, EDGE) if edges is not None else spark.createDataFrame([], EDGE)
    n = n.withColumns({"type": F.coalesce(given("type"), F.lit("Concept")), "label": F.coalesce(given("label"), F.col("id"))})
    e = e.withColumns({"rel": F.coalesce(given("rel"), F.lit("relates_to")), "confidence": F.coalesce("confidence", F.lit(1.0)), "doc": F.coalesce("doc", F.lit(f"doc:{name}"))})
    return Graph(n, e)


def graph_json(spark: SparkSession, path: str) -> Graph:
    """A published graph file; missing types are ``Concept``, missing confidences 1."""
    node = "struct<id:string,label:string,type:string,url:string,meta:map<string,string>,aliases:array<string>,urls:map<string,string>,valid_from:string,valid_to:string,visibility:string>"
    edge = "struct<src:string,rel:string,dst:string,source:string,target:string,scope:string,confidence:double,explanation:string,doc:string,prov:struct<doc:string,tier:string>,tier:string,valid_from:string,valid_to:string,visibility:string>"
    g = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<nodes:array<{node}>,edges:array<{edge}>>").alias("g"))
    n = g.select(F.posexplode("g.nodes").alias("ord", "n")).select("n.*", F.col("ord").cast("bigint").alias("ord"))
    e = g.select(F.posexplode("g.edges").alias("ord", "e")).select("e.*", F.col("ord").cast("bigint").alias("ord"))
    e = e.withColumns({"src": F.coalesce("src", "source"), "dst": F.coalesce("dst", "target"), "doc": F.coalesce("doc", "prov.doc"), "tier": F.coalesce("tier", "prov.tier")}).drop("source", "target", "prov")
    return tabular(n, e)


def rss(spark: SparkSession, path: str, url_base: str = "/feed/") -> DataFrame:
    """Items of RSS and Atom feeds; equal title slugs get ``-2``, ``-3`` in feed order."""
    raw = spark.read.text(path, wholetext=True)
    items = raw.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?is)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))).alias("place", "x"))
    tag = lambda names: given(visible_html(F.regexp_replace(F.regexp_extract("x", rf"(?is)<(?:{names})\b[^>]*>(.*?)</(?:{names})>", 1), r"<!\[CDATA\[|\]\]>", "")))
    link = F.coalesce(tag("link"), given(F.regexp_extract("x", r"(?i)<link\b[^>]*href=\"([^\"]*)\"", 1)))
    said = tag("pubDate|published|updated")
    day = F.coalesce(F.date_format(F.try_to_timestamp(F.regexp_extract(said, r"(\d{1,2} [A-Za-z]{3} \d{4})", 1), F.lit("d MMM yyyy")), "yyyy-MM-dd"), given(F.regexp_extract(said, r"^(\d{4}-\d\d-\d\d)", 1)))
    n = items.select("place", tag("title").alias("title"), link.alias("url"), day.alias("date"), tag("description|summary|content").alias("text")).withColumn("slug", T.slug(F.coalesce("title", F.lit("item"))))
    nth = F.row_number().over(W.partitionBy("slug").orderBy("place"))
    key = F.when(nth == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), nth))
    return conform(n.select(key.alias("id"), "title", F.coalesce("url", F.concat(F.lit(url_base), key)).alias("url"), F.lit("article").alias("kind"), "date", F.coalesce("text", F.lit("")).alias("text"), _none().alias("tags"), _none().alias("links"), F.col("place").cast("bigint").alias("ord")), DOCUMENT)


_SOURCES: dict[str, Callable] = {
    "obsidian": obsidian,
    "logseq": logseq,
    "html_blog": html_blog,
    "github": github,
    "notion": notion,
    "confluence": confluence,
    "entity_packs": entity_packs,
    "radar_scorecards": radar_scorecards,
    "radar_entries": radar_entries,
    "rss": rss,
}


def register(name: str, source: Callable) -> None:
    """A source of one's own; built-in names stay."""
    _SOURCES.setdefault(name, source)


def installed() -> None:
    """Sources that other packages offer under the entry point group ``lattica.sources``; built-in names stay."""
    from importlib.metadata import entry_points

    for point in entry_points(group="lattica.sources"):
        if point.name not in _SOURCES:
            register(point.name, point.load())


def open_source(spark: SparkSession, name: str, path: str, **options):
    if name not in _SOURCES:
        installed()
    if name not in _SOURCES:
        raise ValueError(f"unknown source {name!r}; known: {', '.join(sorted(_SOURCES))}")
    return _SOURCES[name](spark, path, **options)
