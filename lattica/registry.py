"""Queries over the driver's tables, by operator of the survey, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import views
from lattica.functions import text as T
from lattica.iterate import numbered
from lattica.operators import analytics, derive, duplicates, filters, govern, merge, search
from lattica.plans import context, sparql
from lattica.schema import EDGE, NODE, Graph, conform
from lattica.views import DIALOG_SQL, STAR_SMALL_SQL, STAR_SQL, dialog, star, star_small, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


DEGREE_SQL = """degree AS (
  SELECT n.id, n.label, n.type, count(e.id) AS degree FROM nodes n LEFT JOIN (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) e ON e.id = n.id GROUP BY ALL
)"""
SPACES = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


# --- aggregates -----------------------------------------------------------------


@query(f"WITH {STAR_SQL}, {DEGREE_SQL} SELECT * FROM degree ORDER BY degree DESC, id LIMIT 10")
def a1_top_hubs(spark: SparkSession, d: str) -> DataFrame:
    return analytics.top_hubs(star(spark, d))


@query(f"WITH {STAR_SQL} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def a1_nodes_by_type(spark: SparkSession, d: str) -> DataFrame:
    return analytics.counts(star(spark, d).nodes, "type")


@query(f"WITH {STAR_SQL} SELECT rel, count(*) AS n FROM edges GROUP BY rel")
def a1_edges_by_relation(spark: SparkSession, d: str) -> DataFrame:
    return analytics.counts(star(spark, d).edges, "rel")


@query(
    f"""WITH {STAR_SQL}, {DEGREE_SQL}, r AS (SELECT CAST(degree AS DOUBLE) AS x, row_number() OVER (ORDER BY degree) AS i, count(*) OVER () AS n FROM degree)
SELECT round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1.0) / max(n), 6) AS gini FROM r"""
)
def a4_gini(spark: SparkSession, d: str) -> DataFrame:
    g = star(spark, d)
    return analytics.gini(merge.with_degree(g.nodes, g.edges)).select(F.round("gini", 6).alias("gini"))


@query(f"WITH {STAR_SQL} SELECT round(avg(coalesce(confidence, 1.0)), 4) AS mean, count(*) FILTER (coalesce(confidence, 1.0) < 0.92) AS low FROM edges")
def a5_confidence(spark: SparkSession, d: str) -> DataFrame:
    return analytics.confidence_stats(star(spark, d).edges, 0.92).select(F.round("mean", 4).alias("mean"), "low")


@query(
    """WITH e AS (SELECT user_id AS src, 'etype:' || event_type AS rel, CAST(ts AS DATE) AS dst FROM events)
SELECT src, strftime(dst, '%Y-%m-%d') AS dst, string_agg(DISTINCT rel, ',' ORDER BY rel) AS rels, count(DISTINCT rel) AS n FROM e GROUP BY ALL HAVING count(DISTINCT rel) > 1"""
)
def a6_contradictions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("src"), F.concat(F.lit("etype:"), "event_type").alias("rel"), F.date_format("ts", "yyyy-MM-dd").alias("dst"))
    return analytics.contradictions(e)


@query(f"WITH {STAR_SQL} SELECT n AS nodes, e AS edges, round(e / (n * (n - 1.0)), 4) AS density, round(2.0 * e / n, 2) AS avg_degree FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS e FROM edges)")
def a8_density(spark: SparkSession, d: str) -> DataFrame:
    return analytics.density(star(spark, d))


@query(f"WITH {STAR_SQL}, both_ways AS (SELECT src AS u, dst AS v, confidence AS w FROM edges UNION ALL SELECT dst, src, confidence FROM edges) SELECT u, v, round(sum(w), 4) AS w FROM both_ways GROUP BY u, v")
def a17_pair_weights(spark: SparkSession, d: str) -> DataFrame:
    return analytics.weights(star(spark, d).edges).select("u", "v", F.round("w", 4).alias("w"))


@query(f"WITH {STAR_SQL} SELECT n.type, e.tier, count(*) AS n FROM nodes n JOIN edges e ON e.src = n.id GROUP BY CUBE (n.type, e.tier)")
def a1_type_tier_cube(spark: SparkSession, d: str) -> DataFrame:
    g = star(spark, d)
    return g.nodes.select(F.col("id").alias("src"), "type").join(g.edges.select("src", "tier"), "src").cube("type", "tier").agg(F.count(F.lit(1)).alias("n"))


# --- filters and subgraphs ------------------------------------------------------------


@query(
    f"""WITH {STAR_SQL}, n AS (SELECT * FROM nodes WHERE valid_from IS NULL OR valid_from <= '1997-01-01'),
e AS (SELECT * FROM edges WHERE (valid_from IS NULL OR valid_from <= '1997-01-01') AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))
SELECT 'node' AS kind, type AS name, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'edge', rel, count(*) FROM e GROUP BY ALL"""
)
def p9_as_of(spark: SparkSession, d: str) -> DataFrame:
    g = filters.as_of(star(spark, d), "1997-01-01")
    n = g.nodes.groupBy(F.lit("node").alias("kind"), F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(g.edges.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("name")).agg(F.count(F.lit(1)).alias("n")))


@query(
    f"""WITH {STAR_SMALL_SQL}, n AS (SELECT * FROM nodes WHERE coalesce(visibility, 'internal') = 'public')
SELECT id, type, segment FROM n"""
)
def p11_redact_nodes(spark: SparkSession, d: str) -> DataFrame:
    g = filters.redact(star_small(spark, d), "public")
    return g.nodes.select("id", "type", F.try_element_at("meta", F.lit("segment")).alias("segment"))


@query(
    f"""WITH {STAR_SMALL_SQL}, n AS (SELECT id FROM nodes WHERE coalesce(visibility, 'internal') IN ('public', 'internal')),
e AS (SELECT * FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))
SELECT 'node' AS kind, a AS initial, b AS retained, a - b AS redacted FROM (SELECT count(*) AS a FROM nodes), (SELECT count(*) AS b FROM n)
UNION ALL SELECT 'edge', a, b, a - b FROM (SELECT count(*) AS a FROM edges), (SELECT count(*) AS b FROM e)"""
)
def p11_redaction_audit(spark: SparkSession, d: str) -> DataFrame:
    g = star_small(spark, d)
    return filters.redaction_audit(g, filters.redact(g, "internal")).select("kind", "initial", "retained", "redacted")


@query(
    f"""WITH {STAR_SMALL_SQL}, n AS (SELECT id, CASE WHEN type = 'Customer' THEN 'Client' WHEN type = 'Region' THEN CASE id WHEN 'region:0' THEN 'Home' ELSE 'Abroad' END ELSE type END AS type FROM nodes WHERE type <> 'Supplier'),
e AS (SELECT src, CASE rel WHEN 'IN_NATION' THEN 'LIVES_IN' ELSE rel END AS rel, dst FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))
SELECT n.id, n.type, count(e.src) AS degree FROM n JOIN (SELECT src AS id, src FROM e UNION ALL SELECT dst, src FROM e) e ON e.id = n.id GROUP BY ALL"""
)
def p12_migrate(spark: SparkSession, d: str) -> DataFrame:
    steps = [
        {"op": "rename_type", "from": "Customer", "to": "Client"},
        {"op": "rename_relation", "from": "IN_NATION", "to": "LIVES_IN"},
        {"op": "drop_type", "name": "Supplier"},
        {"op": "split_type", "from": "Region", "map": {"region:0": "Home"}, "default": "Abroad"},
    ]
    g = filters.migrate(star_small(spark, d), steps)
    return merge.with_degree(g.nodes, g.edges).select("id", "type", "degree")


@query("SELECT 'part:' || p_partkey AS id, p_name AS label FROM part WHERE contains(lower('part:' || p_partkey), '1') OR contains(lower(p_name), '1') ORDER BY p_partkey LIMIT 20 OFFSET 10")
def p13_search_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = star(spark, d).nodes.where("type = 'Part'")
    return filters.search_nodes(nodes, "1", limit=20, offset=10).select("id", "label")


@query(f"WITH {STAR_SQL} SELECT src, rel, dst FROM edges WHERE rel = 'PLACED' AND src = 'customer:1'")
def p14_filter_edges(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_edges(star(spark, d).edges, src="customer:1", rel="PLACED").select("src", "rel", "dst")


@query(f"WITH {STAR_SMALL_SQL} SELECT 'out' AS direction, rel, dst AS other FROM edges WHERE src = 'nation:3' UNION ALL SELECT 'in', rel, src FROM edges WHERE dst = 'nation:3'")
def p16_node_detail(spark: SparkSession, d: str) -> DataFrame:
    return filters.node_detail(star_small(spark, d), "nation:3")


@query(f"WITH {STAR_SQL} SELECT rel, count(*) AS n FROM edges WHERE tier IN ('curated', 'extracted') AND confidence >= 0.95 GROUP BY rel")
def p17_viewer_filter(spark: SparkSession, d: str) -> DataFrame:
    return analytics.counts(filters.viewer(star(spark, d), tiers=("curated", "extracted"), least=0.95).edges, "rel")


@query(f"WITH {STAR_SMALL_SQL} SELECT src AS id, rel, dst AS other FROM edges UNION ALL SELECT dst, CASE rel WHEN 'IN_NATION' THEN 'HOME_OF' ELSE rel END, src FROM edges")
def q14_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return filters.neighbours(star_small(spark, d), {"IN_NATION": "HOME_OF"})


@query(r"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) AS head, regexp_replace(trim(regexp_replace(lower(url), '[^\p{L}\p{N}]+', '-', 'g'), '-'), '^-+|-+$', '', 'g') AS slug FROM pages")
def x4_slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract(T.normal_url(F.col("url")), r"^([a-z]+://[^/?#]*)", 1).alias("head"), T.slug(F.col("url")).alias("slug"))


@query(
    """SELECT conv_id, turn, CASE WHEN lower(trim(text)) = 'the' THEN 1.0 WHEN trim(text) = '' THEN 0.0 WHEN contains(lower(trim(text)), 'the') OR contains('the', lower(trim(text))) THEN 0.8
ELSE 0.5 * len(list_intersect(string_split_regex(lower(trim(text)), '\\s+'), ['the'])) END AS score FROM conversations"""
)
def p20_question_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.question_score("the", F.col("text")).alias("score"))


# --- joins, sets, windows -------------------------------------------------------------


@query(f"WITH {STAR_SMALL_SQL}, e AS (SELECT * FROM edges WHERE rel = 'IN_REGION' OR ord % 3 = 0) SELECT o.id FROM nodes o WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = o.id OR e.dst = o.id)")
def j6_orphans(spark: SparkSession, d: str) -> DataFrame:
    g = star_small(spark, d)
    return analytics.orphans(Graph(g.nodes, g.edges.where("rel = 'IN_REGION' or ord % 3 = 0")))


@query(
    f"""WITH {STAR_SQL}, live AS (SELECT 'order:' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'tables'),
doc AS (SELECT *, CASE rel WHEN 'PLACED' THEN dst WHEN 'CONTAINS' THEN src ELSE 'tables' END AS doc FROM edges)
SELECT rel, count(*) AS n FROM doc WHERE doc IN (SELECT id FROM live) GROUP BY rel"""
)
def j4_retract(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("order:"), "o_orderkey").alias("id")).union(spark.createDataFrame([("tables",)], "id string"))
    return analytics.counts(merge.retract(star(spark, d).edges, live), "rel")


@query(
    f"""WITH {STAR_SMALL_SQL}, twice AS (SELECT src, rel, dst, confidence, ord FROM edges UNION ALL SELECT src, rel, dst, 0.5, ord + 1000000 FROM edges WHERE ord % 3 = 0
UNION ALL SELECT src, rel, dst, 0.25, ord - 1000000 FROM edges WHERE ord % 5 = 0)
SELECT src, rel, dst, CAST(arg_min(confidence, ord) AS DOUBLE) AS confidence FROM twice GROUP BY ALL"""
)
def x6_first_edges(spark: SparkSession, d: str) -> DataFrame:
    e = star_small(spark, d).edges
    late = e.where("ord % 3 = 0").withColumns({"confidence": F.lit(0.5), "ord": F.col("ord") + 1000000})
    early = e.where("ord % 5 = 0").withColumns({"confidence": F.lit(0.25), "ord": F.col("ord") - 1000000})
    return merge.first_edges(e.unionByName(late).unionByName(early)).select("src", "rel", "dst", "confidence")


@query(
    f"""WITH {STAR_SMALL_SQL}, later AS (SELECT id, upper(label) AS alias FROM nodes WHERE type = 'Nation')
SELECT n.id, n.label, n.type, coalesce(n.segment, CASE WHEN n.type = 'Nation' THEN 'none' END) AS segment, a.alias AS alias FROM nodes n LEFT JOIN later a ON a.id = n.id"""
)
def x6_merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = star_small(spark, d).nodes
    again = n.where("type = 'Nation'").withColumns({"aliases": F.array(F.upper("label")), "label": F.lit("later"), "meta": F.create_map(F.lit("segment"), F.lit("none")), "ord": F.col("ord") + 1000000})
    other = n.where("type = 'Nation'").withColumns({"aliases": F.array(F.lit("ignored")), "type": F.lit("Other"), "ord": F.col("ord") + 2000000})
    m = merge.merge_nodes(n.unionByName(again).unionByName(other))
    return m.select("id", "label", "type", F.try_element_at("meta", F.lit("segment")).alias("segment"), F.array_join("aliases", ",").alias("alias"))


@query(f"WITH {STAR_SQL}, {DEGREE_SQL} SELECT id, degree FROM degree")
def x8_degree(spark: SparkSession, d: str) -> DataFrame:
    g = star(spark, d)
    return merge.with_degree(g.nodes, g.edges).select("id", "degree")


@query(
    f"""WITH {STAR_SQL} SELECT 'unknown type' AS problem, count(*) AS n FROM nodes WHERE type NOT IN ('Region', 'Nation', 'Customer', 'Supplier', 'Part')
UNION ALL SELECT 'isolated node', count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges) HAVING count(*) > 0"""
)
def x10_validate(spark: SparkSession, d: str) -> DataFrame:
    g = star(spark, d)
    return analytics.counts(merge.problems(g.nodes, g.edges, ["Region", "Nation", "Customer", "Supplier", "Part"]), "problem")


@query(
    f"""WITH {STAR_SMALL_SQL}, new AS (SELECT id, CASE WHEN ord % 7 = 0 THEN label || '!' ELSE label END AS label FROM nodes WHERE ord % 11 <> 1 UNION ALL SELECT 'extra:1', 'extra')
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.label <> n.label THEN 'changed' ELSE 'same' END AS change FROM nodes o FULL JOIN new n ON o.id = n.id"""
)
def r3_diff_nodes(spark: SparkSession, d: str) -> DataFrame:
    old = star_small(spark, d).nodes
    new = old.where("ord % 11 <> 1").withColumn("label", F.when(F.col("ord") % 7 == 0, F.concat("label", F.lit("!"))).otherwise(F.col("label")))
    extra = spark.createDataFrame([("extra:1", "extra")], "id string, label string")
    return govern.diff_nodes(old, new.unionByName(extra, allowMissingColumns=True))


@query(
    f"""WITH {STAR_SMALL_SQL}, new AS (SELECT src, rel, dst FROM edges WHERE ord % 4 <> 1)
SELECT change, count(*) AS n FROM (SELECT CASE WHEN n.src IS NULL THEN 'removed' ELSE 'same' END AS change FROM edges o LEFT JOIN new n ON o.src = n.src AND o.rel = n.rel AND o.dst = n.dst) GROUP BY change"""
)
def a21_diff_summary(spark: SparkSession, d: str) -> DataFrame:
    g = star_small(spark, d)
    return govern.diff_summary(g, Graph(g.nodes, g.edges.where("ord % 4 <> 1"))).where("kind = 'edge'").select("change", "n")


@query(
    f"""WITH {STAR_SMALL_SQL}, {DEGREE_SQL}, delta AS (SELECT id, sum(d) AS d FROM (SELECT src AS id, 1 AS d FROM edges WHERE ord % 2 = 0 UNION ALL SELECT dst, 1 FROM edges WHERE ord % 2 = 0
UNION ALL SELECT src, -1 FROM edges WHERE ord % 3 = 0 UNION ALL SELECT dst, -1 FROM edges WHERE ord % 3 = 0) GROUP BY id)
SELECT g.id, CAST(greatest(0, g.degree + coalesce(delta.d, 0)) AS BIGINT) AS degree FROM degree g LEFT JOIN delta ON delta.id = g.id"""
)
def g18_degree_delta(spark: SparkSession, d: str) -> DataFrame:
    g = star_small(spark, d)
    return govern.updated_degrees(merge.with_degree(g.nodes, g.edges), g.edges.where("ord % 2 = 0"), g.edges.where("ord % 3 = 0"))


@query(
    f"""WITH {STAR_SMALL_SQL}, {DEGREE_SQL}, r AS (SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) AS r, count(*) OVER () AS n FROM degree)
SELECT id, CASE WHEN r <= greatest(1, CAST(floor(0.15 * n) AS INT)) THEN 0 WHEN r <= greatest(greatest(1, CAST(floor(0.15 * n) AS INT)) + 1, CAST(floor(0.5 * n) AS INT)) THEN 1 ELSE 2 END AS lod FROM r"""
)
def w4_lod(spark: SparkSession, d: str) -> DataFrame:
    from lattica.operators import layout

    g = star_small(spark, d)
    return layout.lod(merge.with_degree(g.nodes, g.edges)).select("id", "lod")


# --- graph queries ---------------------------------------------------------------------


@query(
    """SELECT DISTINCT 'customer:' || c_custkey AS c, 'nation:' || n_nationkey AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
)
def q1_sparql(spark: SparkSession, d: str) -> DataFrame:
    return sparql.execute(star_small(spark, d), "SELECT ?c ?n ?r WHERE { ?c a :Customer . ?c :IN_NATION ?n . ?n :IN_REGION ?g . ?g rdfs:label ?r . }")


@query("SELECT DISTINCT 'order:' || o_orderkey AS o, 'supplier:' || l_suppkey AS s FROM orders JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS k FROM lineitem) x ON x.p = l.l_partkey WHERE o_custkey = 7 AND x.k = l_suppkey UNION SELECT DISTINCT 'order:' || o_orderkey, 'supplier:' || x.l_suppkey FROM orders JOIN lineitem l ON l.l_orderkey = o_orderkey JOIN lineitem x ON x.l_partkey = l.l_partkey WHERE o_custkey = 7")
def q1_sparql_star(spark: SparkSession, d: str) -> DataFrame:
    return sparql.execute(star(spark, d), "SELECT ?o ?s WHERE { :customer:7 PLACED ?o . ?o CONTAINS ?p . ?p SUPPLIED_BY ?s }")


@query(f"WITH {STAR_SMALL_SQL} SELECT id, label, type FROM nodes WHERE id IN (SELECT dst FROM edges WHERE src = 'nation:5' UNION SELECT src FROM edges WHERE dst = 'nation:5')")
def q5_neighbours_of(spark: SparkSession, d: str) -> DataFrame:
    return context.neighbours_of(star_small(spark, d), "nation:5")


@query(
    f"""WITH RECURSIVE {STAR_SMALL_SQL}, adj AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges), walk(id, distance) AS (
SELECT 'customer:1', 0 UNION SELECT v, distance + 1 FROM walk JOIN adj ON id = u WHERE distance < 4) SELECT id, min(distance) AS distance FROM walk GROUP BY id"""
)
def q9_distances(spark: SparkSession, d: str) -> DataFrame:
    adj = analytics.undirected(star_small(spark, d).edges)
    return analytics.distances(adj, spark.createDataFrame([("c", "customer:1")], "source string, id string"), 4).select("id", "distance")


@query(
    """WITH c AS (SELECT c_nationkey AS n1, n_regionkey AS r FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 1),
s AS (SELECT s_suppkey AS s, s_nationkey AS n2, n1, r FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN c ON n_regionkey = r AND s_nationkey <> n1 ORDER BY s_suppkey LIMIT 1)
SELECT 'customer:1' AS u, 'nation:' || n1 AS v, 4 AS hops FROM s UNION ALL SELECT 'nation:' || n1, 'region:' || r, 4 FROM s UNION ALL SELECT 'region:' || r, 'nation:' || n2, 4 FROM s UNION ALL SELECT 'nation:' || n2, 'supplier:' || s, 4 FROM s"""
)
def q9_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """To the first supplier of another nation in the region of the first customer."""
    nation, home = table(spark, d, "nation"), table(spark, d, "customer").where("c_custkey = 1")
    region = home.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_nationkey", F.col("n_regionkey").alias("r"))
    there = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, (F.col("n_regionkey") == F.col("r")) & (F.col("s_nationkey") != F.col("c_nationkey")))
    return analytics.shortest_path_edges(star_small(spark, d), "customer:1", f"supplier:{there.agg(F.min('s_suppkey')).first()[0]}")


def _pagerank_sql(rounds: int) -> str:
    steps = ["p0 AS (SELECT 'nation:1' AS id, CAST(1.0 AS DOUBLE) AS score)"]
    for k in range(1, rounds + 1):
        steps.append(f"p{k} AS (SELECT id, sum(score) AS score FROM (SELECT v AS id, score * p * 0.85 AS score FROM p{k - 1} JOIN step ON id = u UNION ALL SELECT 'nation:1', 0.15) GROUP BY id)")
    body = ", ".join(steps)
    return f"""WITH {STAR_SMALL_SQL}, both_ways AS (SELECT src AS u, dst AS v FROM edges UNION ALL SELECT dst, src FROM edges), step AS (SELECT u, v, 1.0 / count(*) OVER (PARTITION BY u) AS p FROM both_ways), {body}
SELECT id, round(score, 6) AS score FROM p{rounds}"""


@query(_pagerank_sql(40))
def q10_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return analytics.pagerank(star_small(spark, d), ["nation:1"]).select("id", F.round("score", 6).alias("score"))


BM25_SQL = f"""WITH toks AS (SELECT doc_id AS id, {SPACES} AS ws FROM documents), st AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM toks),
tf AS (SELECT id, len(ws) AS l, w, count(*) AS tf FROM (SELECT id, ws, unnest(ws) AS w FROM toks) WHERE w IN ('energy', 'the', 'licensed', 'under') GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
s AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean)) * CASE w WHEN 'licensed' THEN 2 ELSE 1 END) AS score FROM tf JOIN df USING (w), st GROUP BY id)
"""


@query(BM25_SQL + "SELECT id, round(score, 5) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, id LIMIT 100")
def q11_bm25(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return search.bm25(docs, "Licensed under the energy licensed", limit=100).select("id", F.round("score", 5).alias("score"))


@query(
    """WITH a AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), b AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders)
SELECT id, round(sum(1.0 / (60 + r)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id"""
)
def q12_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    ranks = [numbered(o.select(F.col("o_orderkey").alias("id"), c), F.desc(c), F.col("id"), name="rank") for c in ("o_totalprice", "o_orderdate")]
    return search.fuse(ranks).select("id", F.round("score", 8).alias("score"))


@query()
def q13_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(star_small(spark, d), "supplier FRANCE")[0]


@query()
def q6_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return context.retrieve(star_small(spark, d), "FRANCE", hops=2, budget=200)


@query()
def q7_ego(spark: SparkSession, d: str) -> DataFrame:
    return context.ego(star_small(spark, d), "nation:2").edges.select("src", "rel", "dst")


@query(
    f"""WITH {STAR_SMALL_SQL}, adj AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges), one AS (SELECT v FROM adj WHERE u = 'region:1'), two AS (SELECT 'region:1' AS id UNION SELECT v FROM one UNION SELECT adj.v FROM one JOIN adj ON one.v = adj.u)
SELECT src, rel, dst FROM edges WHERE src IN (SELECT id FROM two) AND dst IN (SELECT id FROM two)"""
)
def q7_ego_rings(spark: SparkSession, d: str) -> DataFrame:
    return context.ego(star_small(spark, d), "region:1", "bfs", depth=2).edges.select("src", "rel", "dst")


# --- analytics -----------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {DIALOG_SQL}, adj AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges), reach(u, v) AS (
SELECT id, id FROM nodes UNION SELECT reach.u, adj.v FROM reach JOIN adj ON reach.v = adj.u) SELECT u AS id, min(v) AS component FROM reach GROUP BY u"""
)
def g4_components(spark: SparkSession, d: str) -> DataFrame:
    return analytics.components(dialog(spark, d))


@query(f"WITH {DIALOG_SQL}, n AS (SELECT src AS id FROM edges INTERSECT SELECT dst FROM edges) SELECT id FROM n")
def g1_articulation(spark: SparkSession, d: str) -> DataFrame:
    return analytics.articulation_points(dialog(spark, d))


@query(f"WITH {DIALOG_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM edges")
def g3_bridges(spark: SparkSession, d: str) -> DataFrame:
    return analytics.bridges(dialog(spark, d))


@query("SELECT 'nation:' || n_nationkey AS id FROM nation UNION SELECT 'region:' || n_regionkey FROM nation WHERE n_nationkey % 2 = 0")
def g5_cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Regions point back to even nations, and odd nations stand in a ring: cycles of two and of twelve, with customers hanging on."""
    e = star_small(spark, d).edges.select("src", "dst")
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), c.cast("string"))
    key = F.col("n_nationkey")
    back = nation.where(key % 2 == 0).select(name("region", F.col("n_regionkey")).alias("src"), name("nation", key).alias("dst"))
    ring = nation.where(key % 2 == 1).select(name("nation", key).alias("src"), name("nation", F.when(key < 23, key + 2).otherwise(F.lit(1))).alias("dst"))
    return analytics.nodes_in_cycles(e.unionByName(back).unionByName(ring))


MESH_SQL = """nodes(id) AS (SELECT 'region:' || r_regionkey FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation),
edges(src, dst) AS (SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL SELECT 'nation:' || n_nationkey, 'nation:' || (n_nationkey + 1) FROM nation WHERE n_nationkey % 8 IN (0, 1, 2) AND n_nationkey < 24),
adj(u, v) AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"""


def _mesh(spark: SparkSession, d: str) -> Graph:
    """Nations and regions, some nations also linked to the next: cycles, bridges and points of articulation."""
    g = star_small(spark, d)
    e = g.edges.where("rel = 'IN_REGION'")
    more = table(spark, d, "nation").where("n_nationkey % 8 in (0, 1, 2) and n_nationkey < 24").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("src"), F.lit("NEXT").alias("rel"), F.concat(F.lit("nation:"), (F.col("n_nationkey") + 1).cast("string")).alias("dst"), F.lit(1.0).alias("confidence"))
    return Graph(g.nodes.where("type in ('Region', 'Nation')"), e.unionByName(more, allowMissingColumns=True))


@query(
    f"""WITH RECURSIVE {MESH_SQL}, reach(x, u, v) AS (SELECT x.id, a.u, a.v FROM nodes x JOIN adj a ON a.u <> x.id AND a.v <> x.id UNION SELECT r.x, r.u, a.v FROM reach r JOIN adj a ON r.v = a.u AND a.v <> r.x)
SELECT DISTINCT a.u AS id FROM adj a JOIN adj b ON a.u = b.u AND a.v < b.v WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.x = a.u AND r.u = a.v AND r.v = b.v)"""
)
def g1_articulation_mesh(spark: SparkSession, d: str) -> DataFrame:
    return analytics.articulation_points(_mesh(spark, d))


@query(
    f"""WITH RECURSIVE {MESH_SQL}, reach(a, b, w) AS (SELECT u, v, u FROM adj WHERE u < v UNION SELECT r.a, r.b, x.v FROM reach r JOIN adj x ON r.w = x.u AND NOT (x.u = r.a AND x.v = r.b) AND NOT (x.u = r.b AND x.v = r.a))
SELECT u AS a, v AS b FROM adj WHERE u < v AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.a = u AND r.b = v AND r.w = v)"""
)
def g3_bridges_mesh(spark: SparkSession, d: str) -> DataFrame:
    return analytics.bridges(_mesh(spark, d))


@query(
    f"""WITH RECURSIVE {MESH_SQL}, walk(s, v, k) AS (SELECT id, id, 0 FROM nodes UNION SELECT s, adj.v, k + 1 FROM walk JOIN adj ON walk.v = adj.u WHERE k < 29), dist AS (SELECT s, v, min(k) AS k FROM walk GROUP BY s, v),
paths(s, v, k, p) AS (SELECT id, id, 0, [id] FROM nodes UNION ALL SELECT x.s, a.v, x.k + 1, list_append(p, a.v) FROM paths x JOIN adj a ON a.u = x.v JOIN dist y ON y.s = x.s AND y.v = a.v AND y.k = x.k + 1),
many AS (SELECT s, v, count(*) AS n FROM paths GROUP BY s, v), inner_ AS (SELECT s, v, unnest(p[2:-2]) AS id FROM paths WHERE k > 1), part AS (SELECT i.id, sum(1.0 / n) AS score FROM inner_ i JOIN many m ON m.s = i.s AND m.v = i.v GROUP BY i.id)
SELECT nodes.id, round(coalesce(score, 0), 6) AS score FROM nodes LEFT JOIN part ON part.id = nodes.id"""
)
def g10_betweenness_mesh(spark: SparkSession, d: str) -> DataFrame:
    return analytics.betweenness(_mesh(spark, d)).select("id", F.round("score", 6).alias("score"))


RINGS_SQL = """ring(id, k, g, i) AS (SELECT 'part:' || p_partkey, p_partkey, (p_partkey - 1) // 10, (p_partkey - 1) % 10 FROM part),
size(g, n, first, least) AS (SELECT g, count(*), min(k), min(id) FROM ring GROUP BY g),
hubs(s, n) AS (SELECT s_suppkey, 'nation:' || s_nationkey FROM supplier),
spoke(g, s) AS (SELECT g, 1 + g % (SELECT count(*) FROM supplier) FROM size)"""


def _rings(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): parts in rings of ten, each hung on a supplier; suppliers and customers on nations; nations in a ring and on regions.

    One component, which grows with the tables.
    """
    t = lambda n: table(spark, d, n)
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.expr(c).cast("string"))
    link = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"))
    part = t("part").select(F.col("p_partkey").alias("k"), F.expr("(p_partkey - 1) div 10").alias("g"), F.expr("(p_partkey - 1) % 10").alias("i"))
    least = part.groupBy("g").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"))
    step = F.when((F.col("i") == 9) | (F.col("k") + 1 == F.col("first") + F.col("n")), F.col("first")).otherwise(F.col("k") + 1)
    around = part.join(least, "g").withColumn("next", step).where("n > 1")
    suppliers = t("supplier")
    n = suppliers.count()
    return reduce(
        DataFrame.unionByName,
        [
            link(around, name("part", "k"), name("part", "next")),
            link(least, name("part", "first"), name("supplier", f"1 + g % {n}")),
            link(suppliers, name("supplier", "s_suppkey"), name("nation", "s_nationkey")),
            link(t("customer"), name("customer", "c_custkey"), name("nation", "c_nationkey")),
            link(t("nation"), name("nation", "n_nationkey"), name("region", "n_regionkey")),
            link(t("nation"), name("nation", "n_nationkey"), name("nation", "(n_nationkey + 1) % 25")),
        ],
    )


def _rings_graph(spark: SparkSession, d: str) -> Graph:
    e = _rings(spark, d).withColumn("rel", F.lit("NEXT"))
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return Graph(conform(nodes, NODE), conform(e, EDGE))


@query(
    f"""WITH {RINGS_SQL} SELECT 'part:' || first AS id FROM size WHERE n > 1 UNION SELECT 'supplier:' || s FROM spoke
UNION SELECT n FROM hubs UNION SELECT 'nation:' || c_nationkey FROM customer"""
)
def g1_articulation_rings(spark: SparkSession, d: str) -> DataFrame:
    return analytics.articulation_points(_rings_graph(spark, d))


@query(
    f"""WITH {RINGS_SQL}, b AS (SELECT 'part:' || first AS a, 'supplier:' || s AS b FROM size JOIN spoke USING (g) UNION ALL SELECT 'supplier:' || s, n FROM hubs
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'part:' || first, 'part:' || (first + 1) FROM size WHERE n = 2)
SELECT least(a, b) AS a, greatest(a, b) AS b FROM b"""
)
def g3_bridges_rings(spark: SparkSession, d: str) -> DataFrame:
    return analytics.bridges(_rings_graph(spark, d))


@query(f"WITH {RINGS_SQL} SELECT id, least AS component FROM ring JOIN size USING (g) WHERE n > 1 UNION ALL SELECT 'nation:' || n_nationkey, 'nation:0' FROM nation")
def g5_cyclic_components(spark: SparkSession, d: str) -> DataFrame:
    """Rings of parts and the ring of nations, all linked one way."""
    return analytics.cyclic_components(_rings(spark, d))


RUNS_SQL = """runs AS (SELECT conv_id, count(*) AS n FROM (SELECT conv_id, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM turns) GROUP BY conv_id, g)"""


@query(
    f"""WITH {DIALOG_SQL}, {RUNS_SQL}, t AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM runs) AS components, (SELECT max(n) FROM runs) AS largest,
(SELECT count(*) FROM runs WHERE n = 1) AS orphans, (SELECT sum(greatest(n - 2, 0)) FROM runs) AS points)
SELECT nodes, edges, round(edges / (nodes * (nodes - 1.0)), 4) AS density, round(2.0 * edges / nodes, 2) AS avg_degree, components, largest, orphans, CAST(points AS BIGINT) AS points,
CAST(floor(100 - least(40.0, 100.0 * orphans / nodes) - least(30.0, 5.0 * points)) AS BIGINT) AS health FROM t"""
)
def g2_topology(spark: SparkSession, d: str) -> DataFrame:
    return analytics.topology(dialog(spark, d))


@query(
    f"""WITH {DIALOG_SQL}, {RUNS_SQL}, {DEGREE_SQL}, r AS (SELECT CAST(degree AS DOUBLE) AS x, row_number() OVER (ORDER BY degree) AS i, count(*) OVER () AS n FROM degree), t AS (SELECT count(*) AS components, max(n) AS largest FROM runs)
SELECT (SELECT round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1.0) / max(n), 3) FROM r) AS gini, CAST(0.9 AS DOUBLE) AS average_confidence, CAST(0 AS BIGINT) AS low_confidence, components, largest, (SELECT count(*) FROM edges) AS bridges,
CAST(0 AS BIGINT) AS cycles, CAST(0 AS BIGINT) AS contradictions, CAST(round(100.0 - CASE WHEN components > 1 THEN least((components - 1) * 5, 20) ELSE 0 END, 1) AS DOUBLE) AS health FROM t"""
)
def g6_audit(spark: SparkSession, d: str) -> DataFrame:
    return analytics.audit(dialog(spark, d))


@query(
    f"""WITH {STAR_SMALL_SQL}, w AS (SELECT u, v, sum(c) AS w FROM (SELECT src AS u, dst AS v, confidence AS c FROM edges UNION ALL SELECT dst, src, confidence FROM edges) GROUP BY ALL), dg AS (SELECT u, sum(w) AS d FROM w GROUP BY u), m AS (SELECT sum(w) AS m2 FROM w),
a AS (SELECT id, type AS community FROM nodes)
SELECT round(coalesce(sum((w.w - x.d * y.d / m2) / m2), 0), 6) AS modularity FROM w JOIN dg x ON x.u = w.u JOIN dg y ON y.u = w.v JOIN a p ON p.id = w.u JOIN a q ON q.id = w.v AND p.community = q.community, m"""
)
def g7_modularity(spark: SparkSession, d: str) -> DataFrame:
    g = star_small(spark, d)
    return analytics.modularity(g, g.nodes.select("id", F.col("type").alias("community"))).select(F.round("modularity", 6).alias("modularity"))


@query()
def g8_louvain(spark: SparkSession, d: str) -> DataFrame:
    return analytics.louvain(dialog(spark, d))


@query()
def g9_label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return analytics.label_propagation(dialog(spark, d))


@query(
    f"""WITH {DIALOG_SQL}, c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, g ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id, g) AS n FROM (SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM turns))
SELECT 'turn:' || conv_id || ':' || turn AS id, CAST(2 * (i - 1) * (n - i) AS DOUBLE) AS score FROM c WHERE n > 1"""
)
def g10_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return analytics.betweenness(dialog(spark, d))


# --- derivation and similarity ----------------------------------------------------------


@query(
    f"""WITH RECURSIVE {DIALOG_SQL}, reach(s, t) AS (SELECT src, dst FROM edges UNION SELECT reach.s, edges.dst FROM reach JOIN edges ON reach.t = edges.src) SELECT s AS src, 'REPLIES_TO' AS rel, t AS dst FROM reach WHERE s <> t"""
)
def d1_transitive(spark: SparkSession, d: str) -> DataFrame:
    return derive.infer(dialog(spark, d).edges, [derive.Rule("transitive", "REPLIES_TO")]).select("src", "rel", "dst")


@query(
    f"""WITH {STAR_SMALL_SQL} SELECT src, rel, dst, CAST(confidence AS DOUBLE) AS confidence FROM edges UNION ALL SELECT dst, 'HAS_NATION', src, 0.9 FROM edges WHERE rel = 'IN_REGION'
UNION ALL SELECT a.src, 'LIVES_IN_REGION', b.dst, 0.8 FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel = 'IN_NATION' AND b.rel = 'IN_REGION'"""
)
def d1_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = [derive.Rule("inverse", "IN_REGION", "HAS_NATION"), derive.Rule("composition", "IN_NATION", "LIVES_IN_REGION", "IN_REGION", 0.8)]
    return derive.infer(star_small(spark, d).edges, rules).select("src", "rel", "dst", "confidence")


@query(
    """WITH m AS (SELECT DISTINCT 'supplier:' || l_suppkey AS entity, l_partkey AS doc FROM lineitem), n AS (SELECT entity, count(*) AS n FROM m GROUP BY entity),
s AS (SELECT a.entity AS a, b.entity AS b, count(*) AS shared FROM m a JOIN m b ON a.doc = b.doc AND a.entity < b.entity GROUP BY ALL HAVING count(*) >= 2)
SELECT a, b, shared, round(shared / (x.n + y.n - shared), 2) AS confidence FROM s JOIN n x ON x.entity = a JOIN n y ON y.entity = b WHERE shared / (x.n + y.n - shared) >= 0.15"""
)
def d2_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.concat(F.lit("supplier:"), "l_suppkey").alias("entity"), F.col("l_partkey").cast("string").alias("doc"))
    return derive.cooccurrence(li, threshold=0.15)


COSINE = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (sqrt(list_sum(list_transform(x.embedding, lambda p: CAST(p AS DOUBLE) * p))) * sqrt(list_sum(list_transform(y.embedding, lambda p: CAST(p AS DOUBLE) * p))))"


@query(
    f"""WITH s AS (SELECT x.vec_id AS query_id, y.vec_id, {COSINE} AS score FROM embeddings x, embeddings y WHERE x.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank FROM s WHERE score >= 0)
SELECT query_id, vec_id, rank, round(score, 5) AS score FROM r WHERE rank <= 10"""
)
def d3_nearest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    found = search.nearest_of_many(e, e.where("vec_id % 20 = 0"), 10)
    return found.select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


@query(f"SELECT x.vec_id AS a, y.vec_id AS b, round({COSINE}, 4) AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {COSINE} >= 0.4")
def d4_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return search.similar_pairs(table(spark, d, "embeddings"), 0.4)


@query()
def d5_minhash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(T.minhash(F.col("p_name")).cast("array<string>"), ",").alias("signature"))


@query()
def d6_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.duplicate_classes(star_small(spark, d).nodes)


@query(
    f"""WITH {STAR_SMALL_SQL}, t AS (SELECT id, CASE WHEN type = 'Nation' AND ord % 2 = 1 THEN 'nation:' || (ord - 1) ELSE id END AS into_ FROM nodes)
SELECT DISTINCT a.into_ AS src, rel, b.into_ AS dst FROM edges JOIN t a ON a.id = src JOIN t b ON b.id = dst WHERE a.into_ <> b.into_"""
)
def d7_merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    g = star_small(spark, d)
    pairs = g.nodes.where("type = 'Nation' and ord % 2 = 1").select(F.concat(F.lit("nation:"), F.col("ord") - 1).alias("canonical"), F.col("id").alias("duplicate"))
    return search.merge_duplicates(g, pairs).edges.select("src", "rel", "dst")


# --- governance -------------------------------------------------------------------------


@query(
    f"""WITH {STAR_SMALL_SQL} SELECT src || ' IN_NATION ' || dst AS subject, 'wrong domain' AS problem FROM edges WHERE rel = 'IN_NATION' AND src LIKE 'supplier:%'
UNION ALL SELECT id, 'label does not match' FROM nodes WHERE type = 'Nation' AND NOT regexp_matches(label, '^[A-Z]+$') UNION ALL SELECT dst, 'degree too large' FROM edges WHERE dst LIKE 'nation:%' GROUP BY dst HAVING count(*) + 1 > 60"""
)
def r1_shapes(spark: SparkSession, d: str) -> DataFrame:
    return govern.validate_shapes(
        star_small(spark, d),
        [govern.NodeShape("Nation", required=("label",), most_degree=60, patterns=(("label", "^[A-Z]+$"),))],
        [govern.EdgeShape("IN_NATION", domain=("Customer",), range=("Nation",), least_confidence=0.5, most_count=1)],
    )


@query(
    f"""WITH {STAR_SMALL_SQL}, {DEGREE_SQL} SELECT 'error' AS severity, 'forbidden edge' AS rule, src || ' ' || rel || ' ' || dst AS subject FROM edges WHERE src LIKE 'supplier:%' AND rel = 'IN_NATION'
UNION ALL SELECT 'error', 'required segment', id FROM nodes WHERE type = 'Supplier' UNION ALL SELECT 'warning', 'degree', id FROM degree WHERE degree > 50"""
)
def r2_lint(spark: SparkSession, d: str) -> DataFrame:
    return govern.lint(star_small(spark, d), forbidden=[("Supplier", "IN_NATION", None)], required=[("Supplier", "segment")], acyclic=["IN_REGION"], max_degree=50)


# --- extraction -------------------------------------------------------------------------

BENCH_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_-]+')"
VOCAB_SQL = f"""bt AS (SELECT DISTINCT item_id, unnest({BENCH_TOKENS}) AS w FROM benchmark),
vocab AS (SELECT w FROM bt WHERE length(w) >= 5 AND regexp_matches(w, '^[\\p{{L}}\\p{{N}}_]+$') GROUP BY w)"""


def _benchmark_registry(spark: SparkSession, d: str) -> DataFrame:
    """Every longer word of the test items as a concept."""
    from lattica.operators import extract

    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1)))
    words = table(spark, d, "benchmark").select(F.explode(tokens).alias("w")).where((F.length("w") >= 5) & F.col("w").rlike(r"^[\p{L}\p{N}_]+$"))
    rows = merge.ordered(words.distinct().select(F.concat(F.lit("entity:"), "w").alias("id"), F.col("w").alias("name"), F.lit("Concept").alias("type"), F.array("w").alias("mention_forms")), "id")
    from lattica.schema import conform

    return conform(rows, extract.REGISTRY)


@query(
    f"""WITH {VOCAB_SQL}, hits AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({BENCH_TOKENS}) AS w FROM documents) JOIN vocab USING (w) GROUP BY ALL)
SELECT 'doc:' || doc_id AS id, 'entity:' || w AS entity FROM hits WHERE n >= 2 OR length(w) >= 10"""
)
def x3_mentions(spark: SparkSession, d: str) -> DataFrame:
    from lattica.operators import extract

    docs = views.source_documents(spark, d)
    registry = _benchmark_registry(spark, d)
    vocab = extract.vocabulary(extract.registry_nodes(registry), registry)
    return extract.mentions(docs.where("kind = 'article'"), vocab)


@query(
    f"""WITH {VOCAB_SQL}, hits AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({BENCH_TOKENS}) AS w FROM documents) JOIN vocab USING (w) GROUP BY ALL),
edges AS (SELECT 'COVERS' AS rel, doc_id FROM hits WHERE n >= 2 OR length(w) >= 10 UNION ALL SELECT 'ABOUT', doc_id FROM documents UNION ALL SELECT 'ABOUT', doc_id FROM documents
UNION ALL SELECT 'REFERENCES', doc_id FROM (SELECT doc_id, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM documents) WHERE nxt IS NOT NULL)
SELECT rel, count(*) AS n FROM edges GROUP BY rel"""
)
def x1_build(spark: SparkSession, d: str) -> DataFrame:
    from lattica.operators import extract

    g = extract.build(views.source_documents(spark, d), _benchmark_registry(spark, d))
    return analytics.counts(g.edges, "rel")


@query()
def s4_web_pages(spark: SparkSession, d: str) -> DataFrame:
    from lattica.sources import files

    return files.web_pages(table(spark, d, "pages")).select("id", "title", F.length("text").alias("n_chars"))


# --- sinks ---------------------------------------------------------------------------------


@query(
    f"""WITH {STAR_SMALL_SQL} SELECT 'CREATE CONSTRAINT node_id IF NOT EXISTS FOR (n:Node) REQUIRE n.id IS UNIQUE;' AS value
UNION ALL SELECT 'MERGE (n:' || type || ' {{id: \'\'' || id || '\'\'}}) SET n.label = \'\'' || label || '\'\';' FROM nodes
UNION ALL SELECT 'MATCH (a {{id: \'\'' || src || '\'\'}}), (b {{id: \'\'' || dst || '\'\'}}) MERGE (a)-[:' || rel || ' {{confidence: 1.0000}}]->(b);' FROM edges"""
)
def k7_cypher(spark: SparkSession, d: str) -> DataFrame:
    from lattica.sinks import files

    return files.cypher_lines(star_small(spark, d))


GRAPHML_HEAD = "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\">' || chr(10) || " + " || chr(10) || ".join(
    f"'<key id=\"{k}\" for=\"{on}\" attr.name=\"{k}\" attr.type=\"{t}\"/>'" for k, on, t in (("label", "node", "string"), ("type", "node", "string"), ("degree", "node", "int"), ("url", "node", "string"), ("rel", "edge", "string"), ("confidence", "edge", "double"), ("explanation", "edge", "string"), ("scope", "edge", "string"))
) + " || chr(10) || '<graph edgedefault=\"directed\">'"


@query(
    f"""WITH {STAR_SMALL_SQL}, {DEGREE_SQL} SELECT {GRAPHML_HEAD} AS value UNION ALL SELECT '</graph>' || chr(10) || '</graphml>'
UNION ALL SELECT '<node id="' || id || '"><data key="label">' || label || '</data><data key="type">' || type || '</data><data key="degree">' || degree || '</data></node>' FROM degree
UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"><data key="rel">' || rel || '</data><data key="confidence">1.0</data></edge>' FROM edges"""
)
def k4_graphml(spark: SparkSession, d: str) -> DataFrame:
    from lattica.sinks import files

    return files.graphml_lines(star_small(spark, d))


@query()
def k5_turtle(spark: SparkSession, d: str) -> DataFrame:
    from lattica.sinks import files

    return files.turtle_lines(star_small(spark, d))


@query(f"WITH {STAR_SMALL_SQL} SELECT id, coalesce(segment, '') AS segment FROM nodes")
def k12_columnar(spark: SparkSession, d: str) -> DataFrame:
    from lattica.sinks import files

    n, _ = files.columnar(star_small(spark, d))
    return n.select("id", F.coalesce(F.get_json_object("meta_json", "$.segment"), F.lit("")).alias("segment"))


# --- time ----------------------------------------------------------------------------------


@query(
    f"""WITH {STAR_SQL}, ds AS (SELECT DISTINCT valid_from AS date FROM nodes WHERE valid_from IS NOT NULL)
SELECT date, (SELECT count(*) FROM nodes n WHERE n.valid_from IS NULL OR n.valid_from <= date) AS nodes, (SELECT count(*) FROM edges e WHERE e.valid_from IS NULL OR e.valid_from <= date) AS edges FROM ds"""
)
def t2_timeline(spark: SparkSession, d: str) -> DataFrame:
    from lattica.streaming import incremental

    return incremental.timeline(star(spark, d))


@query("SELECT event_id, event_type FROM events WHERE strftime(ts, '%Y-%m-%d %H:%M:%S') >= '2024-01-15 00:00:00'")
def t3_cursor(spark: SparkSession, d: str) -> DataFrame:
    from lattica.streaming import incremental

    e = table(spark, d, "events").withColumn("updated_at", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return incremental.after_cursor(e, "2024-01-15 00:00:00")[0].select("event_id", "event_type")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def t_windows(spark: SparkSession, d: str) -> DataFrame:
    from lattica.streaming import incremental

    w = incremental.windowed(table(spark, d, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER u < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM r GROUP BY user_id, k"""
)
def t_sessions(spark: SparkSession, d: str) -> DataFrame:
    from lattica.streaming import incremental

    return incremental.sessions(table(spark, d, "events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(
    f"""WITH {STAR_SMALL_SQL}, degree AS (SELECT id, count(e.id2) AS degree FROM nodes LEFT JOIN (SELECT src AS id2 FROM edges UNION ALL SELECT dst FROM edges) e ON id = e.id2 GROUP BY id),
turn AS (SELECT id, degree, 2 * pi() * (row_number() OVER (ORDER BY id) - 1) / count(*) OVER () AS t FROM degree),
placed AS (SELECT id, degree, round(500 * cos(t), 2) AS px, round(500 * sin(t), 2) AS py FROM turn),
box AS (SELECT min(px) AS x0, greatest(max(px) - min(px), 1.0) AS wx, min(py) AS y0, greatest(max(py) - min(py), 1.0) AS wy FROM placed),
cells AS (SELECT z, id, least(floor((px - (x0 - 0.05 * wx)) / (1.1 * wx) * 2 ** z), 2 ** z - 1) AS x, least(floor((py - (y0 - 0.05 * wy)) / (1.1 * wy) * 2 ** z), 2 ** z - 1) AS y
FROM placed, box, (SELECT unnest([0, 1, 2, 3]) AS z) WHERE z > 0 OR degree >= 2)
SELECT z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, count(*) AS n FROM cells GROUP BY ALL"""
)
def g17_tiles(spark: SparkSession, d: str) -> DataFrame:
    from lattica.operators import layout

    g = star_small(spark, d)
    placed = layout.circle(merge.with_degree(g.nodes, g.edges)).select("id", "px", "py", "degree")
    n, _ = layout.tiles(placed, g.edges)
    return n.groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@query()
def g12_layout(spark: SparkSession, d: str) -> DataFrame:
    from lattica.operators import layout

    return layout.force(star_small(spark, d))


@query()
def g13_barnes_hut(spark: SparkSession, d: str) -> DataFrame:
    from lattica.operators import layout

    return layout.force(star_small(spark, d), theta=0.8)


@query(
    f"""WITH RECURSIVE {STAR_SMALL_SQL}, walk(id, depth) AS (SELECT id, 0 FROM nodes WHERE id NOT IN (SELECT dst FROM edges) UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = id WHERE depth < 8),
deep AS (SELECT n.id, coalesce(min(w.depth), 0) AS depth FROM nodes n LEFT JOIN walk w ON n.id = w.id GROUP BY n.id)
SELECT id, depth, (row_number() OVER (PARTITION BY depth ORDER BY id) - 1 - count(*) OVER (PARTITION BY depth) / 2) * 140.0 AS x, CAST(depth * 180.0 AS DOUBLE) AS y FROM deep"""
)
def g15_layers(spark: SparkSession, d: str) -> DataFrame:
    from lattica.operators import layout

    return layout.layers(star_small(spark, d))


@query()
def g16_project(spark: SparkSession, d: str) -> DataFrame:
    from lattica.operators import layout

    return layout.project(table(spark, d, "embeddings"))
