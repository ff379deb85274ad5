"""Graph operators on a derived graph: regions, nations, customers, suppliers."""

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..operators import graph
from ..session import Workspace
from .base import TOKENS, WORDS, q, t

_G = """ent AS (
  SELECT 'r' || r_regionkey AS id, r_name AS name, 'Region' AS type, 'region ' || r_name AS description FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'Nation', 'nation ' || n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'Organization', 'customer in ' || c_mktsegment FROM customer
  UNION ALL SELECT 's' || s_suppkey, s_name, 'Person', 'supplier' FROM supplier),
edg AS (
  SELECT 'n' || n_nationkey AS src_id, 'r' || n_regionkey AS dst_id, 'IN' AS type FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'IN' FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'IN' FROM supplier)"""


def _graph(spark, sf):
    """Entities and edges of all regions, nations, customers and suppliers."""
    k = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r, n, c, s = (t(spark, sf, x) for x in ("region", "nation", "customer", "supplier"))
    ent = (
        r.select(k("r", "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("Region").alias("type"), F.concat(F.lit("region "), "r_name").alias("description"))
        .unionByName(n.select(k("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("Nation").alias("type"), F.concat(F.lit("nation "), "n_name").alias("description")))
        .unionByName(c.select(k("c", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("Organization").alias("type"), F.concat(F.lit("customer in "), "c_mktsegment").alias("description")))
        .unionByName(s.select(k("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("Person").alias("type"), F.lit("supplier").alias("description")))
    )
    edge = lambda df, a, b: df.select(a.alias("src_id"), b.alias("dst_id"), F.lit("IN").alias("type"))
    edges = edge(n, k("n", "n_nationkey"), k("r", "n_regionkey")).unionByName(edge(c, k("c", "c_custkey"), k("n", "c_nationkey"))).unionByName(edge(s, k("s", "s_suppkey"), k("n", "s_nationkey")))
    return ent, edges


@q(f"WITH {_G} SELECT e.n AS entities, d.n AS edges, round(2 * d.n / e.n, 6) AS avg_degree FROM (SELECT count(*) AS n FROM ent) e, (SELECT count(*) AS n FROM edg) d")
def a12_graph_stats(spark, sf):
    return graph.stats(*_graph(spark, sf)).select("entities", "edges", F.round("avg_degree", 6).alias("avg_degree"))


@q(f"WITH {_G} SELECT type, count(*) AS n FROM ent GROUP BY 1")
def a12_type_histogram(spark, sf):
    return graph.type_histogram(_graph(spark, sf)[0])


@q("""SELECT lower(c_mktsegment) AS name_key, lower(c_nationkey::VARCHAR) AS type_key, min_by(c_mktsegment, c_custkey) AS name, count(*) AS mentions, max_by(c_name, [length(c_name), -c_custkey]) AS description,
array_to_string(list_sort(list_distinct(list(c_custkey % 10)))::VARCHAR[], ',') AS chunks FROM customer GROUP BY 1, 2""")
def a9_merge_entities(spark, sf):
    rows = t(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").cast("string").alias("type"), F.col("c_name").alias("description"), F.array(F.col("c_custkey") % 10).alias("chunks"), F.col("c_custkey").alias("ord"))
    out = graph.merge_entities(rows)
    return out.select("name_key", "type_key", "name", "mentions", "description", F.array_join(F.transform("chunks", lambda x: x.cast("string")), ",").alias("chunks"))


@q("SELECT lower(c_mktsegment) AS name_key, min_by(c_mktsegment, c_custkey) AS name, count(*) AS mentions FROM customer GROUP BY 1")
def a11_merge_by_name(spark, sf):
    rows = t(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("x").alias("type"), F.col("c_name").alias("description"), F.array(F.lit(1)).alias("chunks"), F.col("c_custkey").alias("ord"))
    return graph.merge_entities(rows, by_type=False).select("name_key", "name", "mentions")


@q("""SELECT lower(o_orderpriority) AS src_key, lower(o_orderstatus) AS dst_key, 'p' AS type_key, round(min_by(o_totalprice, o_orderkey) + count(*) - 1, 6) AS weight FROM orders GROUP BY 1, 2""")
def a10_merge_edges(spark, sf):
    rows = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("src"), F.col("o_orderstatus").alias("dst"), F.lit("P").alias("type"), F.col("o_totalprice").alias("weight"), F.array(F.col("o_orderkey") % 5).alias("chunks"), F.col("o_orderkey").alias("ord"))
    return graph.merge_edges(rows).select("src_key", "dst_key", "type_key", F.round("weight", 6).alias("weight"))


@q("""SELECT 's' || s_suppkey AS src, n_name AS dst, 's' || s_suppkey AS src_id, 'n' || n_nationkey AS dst_id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey <> 3""")
def j7_resolve(spark, sf):
    """Edges by name find their ends; those of an unknown nation are dropped."""
    s, n = t(spark, sf, "supplier"), t(spark, sf, "nation")
    sid = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    edges = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(sid.alias("src"), F.col("n_name").alias("dst"))
    ent = s.select(F.upper(sid).alias("name"), sid.alias("id")).unionByName(n.where("n_nationkey <> 3").select(F.lower("n_name").alias("name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")))
    return graph.resolve(edges, ent)


@q(f"""WITH RECURSIVE {_G}, und AS (SELECT src_id AS a, dst_id AS b FROM edg UNION SELECT dst_id, src_id FROM edg),
walk AS (SELECT id AS seed, id AS node, 0 AS distance FROM ent WHERE type = 'Region' UNION SELECT seed, b, distance + 1 FROM walk JOIN und ON node = a WHERE distance < 2)
SELECT seed, node, CAST(min(distance) AS BIGINT) AS distance FROM walk GROUP BY 1, 2 HAVING min(distance) > 0""")
def j10_neighbours(spark, sf):
    ent, edges = _graph(spark, sf)
    return graph.neighbours(edges, ent.where("type = 'Region'"), 2).select("seed", "node", F.col("distance").cast("long").alias("distance"))


@q(f"WITH {_G}, pick AS (SELECT id FROM ent WHERE type IN ('Region', 'Nation')) SELECT src_id, dst_id, type FROM edg WHERE src_id IN (FROM pick) AND dst_id IN (FROM pick)")
def j11_induced(spark, sf):
    ent, edges = _graph(spark, sf)
    return graph.induced(edges, ent.where("type in ('Region', 'Nation')")).select("src_id", "dst_id", "type")


@q(f"WITH {_G}, n AS (SELECT id FROM ent WHERE type = 'Nation') SELECT node, count(*) AS degree FROM (SELECT src_id AS node FROM edg WHERE src_id IN (FROM n) UNION ALL SELECT dst_id FROM edg WHERE dst_id IN (FROM n)) GROUP BY 1")
def j9_incident(spark, sf):
    ent, edges = _graph(spark, sf)
    return graph.incident(edges, ent.where("type = 'Nation'")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


_CUT = f"{_G}, cut AS (SELECT * FROM edg WHERE dst_id NOT LIKE 'r%'), und AS (SELECT src_id AS a, dst_id AS b FROM cut UNION SELECT dst_id, src_id FROM cut), reach AS (SELECT id AS a, id AS b FROM ent UNION SELECT r.a, u.b FROM reach r JOIN und u ON r.b = u.a), comp AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY 1)"


@q(f"WITH RECURSIVE {_CUT} SELECT id, component FROM comp WHERE component IN (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= 2)")
def a13_components(spark, sf):
    """Connected components of two nodes or more, without the regions' edges."""
    ent, edges = _graph(spark, sf)
    return graph.components(edges.where("dst_id not like 'r%'"), ent, Workspace(spark, "components"), 2)


@q()
def a13_modularity(spark, sf):
    """Communities by modularity moves among customers and the parts they order."""
    li, o = t(spark, sf, "lineitem"), t(spark, sf, "orders")
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("src_id"), (F.col("l_partkey") + 10_000_000).alias("dst_id")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    nodes = e.select(F.col("src_id").alias("id")).unionByName(e.select(F.col("dst_id").alias("id"))).distinct()
    return graph.modularity_communities(e, nodes, Workspace(spark, "modularity"), 4)


@q("""SELECT 0 AS level, n_nationkey::BIGINT AS community, n_nationkey::BIGINT // 2 AS parent FROM nation
UNION ALL SELECT DISTINCT 1, n_nationkey::BIGINT // 2, n_nationkey::BIGINT // 4 FROM nation UNION ALL SELECT DISTINCT 2, n_nationkey::BIGINT // 4, n_nationkey::BIGINT // 8 FROM nation""")
def a14_hierarchy(spark, sf):
    n = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("idx"))
    return graph.hierarchy(n)


@q(f"""WITH {_G}, m AS (SELECT c.id, n.dst_id AS component FROM ent c JOIN edg n ON n.src_id = c.id), x AS (
  SELECT component, name, row_number() OVER (PARTITION BY component ORDER BY CASE type WHEN 'Concept' THEN 0 WHEN 'Organization' THEN 1 WHEN 'Person' THEN 2 WHEN 'Technology' THEN 3 ELSE 5 END, length(description) DESC, name) AS r FROM m JOIN ent USING (id))
SELECT component, string_agg(name, ', ' ORDER BY r) AS title FROM x WHERE r <= 3 GROUP BY 1""")
def a15_titles(spark, sf):
    ent, edges = _graph(spark, sf)
    return graph.titles(ent.join(edges.select(F.col("src_id").alias("id"), F.col("dst_id").alias("component")), "id"))


@q(f"WITH {_G} SELECT id, score FROM (SELECT id, 2 * CAST(contains(lower(name), 'at') AS INT) + CAST(contains(lower(description), 'at') AS INT) AS score FROM ent) WHERE score > 0 ORDER BY score DESC, id LIMIT 10")
def f51_entity_search(spark, sf):
    return graph.search(_graph(spark, sf)[0], "at").select("id", "score")


@q(f"""WITH {_G}, hit AS (SELECT id, name, 2 * CAST(contains(lower(name), 'asia') AS INT) + CAST(contains(lower(description), 'asia') AS INT) AS score FROM ent),
seed AS (SELECT id, name FROM hit WHERE score > 0 ORDER BY score DESC, id LIMIT 5), und AS (SELECT src_id AS a, dst_id AS b FROM edg UNION SELECT dst_id, src_id FROM edg),
near AS (SELECT * FROM (SELECT s.id AS seed, b AS node, row_number() OVER (PARTITION BY s.id ORDER BY b) AS n FROM seed s JOIN und ON a = s.id WHERE b <> s.id) WHERE n <= 10),
ids AS (SELECT id FROM seed UNION SELECT node FROM near), comm AS (SELECT DISTINCT dst_id AS c FROM edg WHERE src_id IN (FROM ids) ORDER BY 1 LIMIT 5)
SELECT 'seed' AS kind, id AS key, name AS detail FROM seed UNION ALL SELECT 'neighbour', node, seed FROM near
UNION ALL SELECT DISTINCT 'relation', src_id || '->' || dst_id, type FROM edg WHERE src_id IN (FROM ids) AND dst_id IN (FROM ids) UNION ALL SELECT 'community', c, NULL FROM comm""")
def q11_local_search(spark, sf):
    ent, edges = _graph(spark, sf)
    return graph.local_search(ent, edges, edges.select(F.col("src_id").alias("id"), F.col("dst_id").alias("component")), "asia")


@q("""SELECT DISTINCT 'n' || c_nationkey AS component, 'c' || c_custkey AS src_id, 'n' || c_nationkey AS dst_id, 'IN' AS type FROM customer
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'n' || s_nationkey, 'IN' FROM supplier""")
def j13_internal_edges(spark, sf):
    """Nations, their customers and suppliers are a community; edges to regions leave it."""
    ent, edges = _graph(spark, sf)
    inside = edges.where("dst_id like 'n%'").select(F.col("src_id").alias("id"), F.col("dst_id").alias("component"))
    nations = ent.where("type = 'Nation'").select("id", F.col("id").alias("component"))
    return graph.internal_edges(edges, inside.unionByName(nations)).select("component", "src_id", "dst_id", "type")


@q("SELECT c_nationkey::BIGINT AS id, min(c_custkey) AS component, count(*) AS n FROM customer GROUP BY 1")
def j12_communities_of(spark, sf):
    """The communities that an entity's members belong to, with their sizes."""
    c = t(spark, sf, "customer")
    members = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("component")).join(c, "c_nationkey").select(F.col("c_custkey").alias("id"), "component")
    found = graph.communities_of(members, c.select(F.col("c_custkey").alias("id")))
    return found.join(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("nation")), "id").groupBy(F.col("nation").alias("id"), "component").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 1 AND s_suppkey % 2 = 0")
def j8_validate(spark, sf):
    """Edges of a chunk (here: a nation) stay if both ends were extracted from that chunk."""
    s, n = t(spark, sf, "supplier"), t(spark, sf, "nation")
    names = s.where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("chunk_id"), F.col("s_name").alias("name")).unionByName(n.where("n_regionkey <> 1").select(F.col("n_nationkey").alias("chunk_id"), F.col("n_name").alias("name")))
    edges = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("chunk_id"), F.upper("s_name").alias("src"), F.lower("n_name").alias("dst"), "s_suppkey", "n_name")
    return graph.validate(edges, names).select("s_suppkey", "n_name")


_NAMES = f"names AS (SELECT DISTINCT w AS name, CASE length(w) % 2 WHEN 0 THEN 'Concept' ELSE 'Other' END AS type FROM (SELECT unnest({TOKENS('text')}) AS w FROM benchmark) WHERE length(w) >= 8)"


@q(f"WITH {_NAMES}, d AS (SELECT doc_id, unnest({TOKENS('text')}) AS w FROM documents) SELECT doc_id, name, type, count(*) AS mentions FROM d JOIN names ON w = name GROUP BY 1, 2, 3")
def x14_dictionary_entities(spark, sf):
    """Names of a dictionary (here: long words of the benchmark) found in every document."""
    name = t(spark, sf, "benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("name")).where(F.length("name") >= 8).distinct()
    dictionary = name.withColumn("type", F.when(F.length("name") % 2 == 0, "Concept").otherwise("Other"))
    return graph.dictionary_entities(t(spark, sf, "documents"), dictionary)


@q("""SELECT event_id, 'N' || user_id AS name, CASE WHEN event_id % 3 = 0 THEN 'Person' ELSE 'Other' END AS type, event_type AS description FROM events WHERE event_id % 5 <> 4""")
def x14_parsed_entities(spark, sf):
    """Entities in a model's JSON; unknown types become Other, what is no JSON gives none."""
    e = t(spark, sf, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "Person").otherwise("Gadget")
    body = F.concat(F.lit('Found: {"entities": [{"name": "N'), F.col("user_id").cast("string"), F.lit('", "type": "'), kind, F.lit('", "description": "'), "event_type", F.lit('"}], "relationships": []}'))
    rows = e.select("event_id", F.when(F.col("event_id") % 5 == 4, "no json here").otherwise(body).alias("response"))
    return graph.parsed_entities(rows, "event_id").select("event_id", "name", "type", "description")


@q(f"WITH {_G} SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM edg) AS edges, (SELECT count(*) FROM nation) AS communities, (SELECT md5(string_agg(id || name, ',' ORDER BY id)) FROM ent) AS m")
def s18_graph_store(spark, sf):
    """A graph saved as tables and loaded again."""
    from ..sources.graph_store import load_graph, save_graph

    ent, edges = _graph(spark, sf)
    communities = ent.where("type = 'Nation'").select(F.col("id").alias("component"), F.col("name").alias("title"))
    path = f"{Workspace(spark, 'graph').base}/saved"
    save_graph(path, ent, edges, communities)
    e, d, c = load_graph(spark, path)
    m = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: F.concat(x["id"], x["name"])), ","))
    return e.agg(F.count(F.lit(1)).alias("entities"), m.alias("m")).crossJoin(d.agg(F.count(F.lit(1)).alias("edges"))).crossJoin(c.agg(F.count(F.lit(1)).alias("communities")))


@q(f"""SELECT item_id AS query_id, CASE WHEN text ILIKE '%overall%' OR text ILIKE '%summary%' OR text ILIKE '%summarize%' OR text ILIKE '%main themes%' OR text ILIKE '%in general%' OR len({WORDS('text')}) > 60 THEN 'global' ELSE 'local' END AS scope
FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'Overall, ' || text ELSE text END AS text FROM benchmark)""")
def q13_scope(spark, sf):
    """Q13: whether a question is about entities (local) or the whole collection (global)."""
    text = F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("Overall, "), "text")).otherwise(F.col("text"))
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), rules.scope(text, 60).alias("scope"))


@q("SELECT string_agg('region ' || r_name, chr(10) || chr(10) ORDER BY r_regionkey) AS context FROM region")
def q12_global_context(spark, sf):
    r = t(spark, sf, "region").select(F.lit(0).alias("level"), F.col("r_regionkey").alias("community"), F.concat(F.lit("region "), "r_name").alias("summary"))
    return graph.global_context(r, 2)
