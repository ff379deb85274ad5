"""Pages, limits, streams and general relational coverage on the star schema (S4, S6, S9-S14, T1, T5, T6, T9, T10, rel_*)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics
from ..session import Workspace
from ..sources import files
from ..streaming import streams
from .base import q, t

_STRIP = r"regexp_replace(regexp_replace({0}, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g')".format
_UNESC = "replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')".format
_TAGS = lambda x: f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', chr(10), 'g')"
_LINES = lambda x: f"array_to_string(list_filter(list_transform(regexp_split_to_array({x}, '\\n|  '), lambda s: trim(s, ' ')), lambda s: s <> ''), chr(10))"


@q(f"SELECT page_id, md5({_LINES(_UNESC(_TAGS(_STRIP('html'))))}) AS m FROM pages")
def s4_html_text(spark, sf):
    from ..functions import text as tx

    return t(spark, sf, "pages").select("page_id", F.md5(tx.strip_html(F.col("html"))).alias("m"))


@q(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def s6_page_title(spark, sf):
    return files.pages(t(spark, sf, "pages")).select("page_id", "title")


@q("""SELECT event_id, CAST(seen AS BIGINT) AS seen, seen <= 2 AS allowed FROM (
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW) AS seen FROM events)""")
def t5_sliding_limit(spark, sf):
    return metrics.sliding_limit(t(spark, sf, "events"), "user_id", "ts", 7200, 2).select("event_id", "seen", "allowed")


@q("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT user_id, n, t, 2.0::DOUBLE AS tokens, 1 AS ok FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.t, CASE WHEN least(3, tokens + (e.t - b.t) / 7200) >= 1 THEN least(3, tokens + (e.t - b.t) / 7200) - 1 ELSE least(3, tokens + (e.t - b.t) / 7200) END, ok + CASE WHEN least(3, tokens + (e.t - b.t) / 7200) >= 1 THEN 1 ELSE 0 END
  FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
SELECT user_id, max(ok)::BIGINT AS accepted, max(n) AS events, max(n) - max(ok) AS refused FROM b GROUP BY 1""")
def t6_token_bucket(spark, sf):
    return metrics.token_bucket(t(spark, sf, "events"), "user_id", "ts", 1 / 7200, 3.0)


@q("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t10_tumbling(spark, sf):
    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.tumbling(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@q("""SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n FROM events, range(4) r(k) GROUP BY 1, 2""")
def t10_sliding(spark, sf):
    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sliding(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@q("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def t10_sessions(spark, sf):
    e = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(e).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@q("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -value ELSE value END AS v FROM events WHERE (event_id % 3 > 0 OR event_id % 5 = 0) AND event_id % 7 <> 2")
def s11_upsert(spark, sf):
    """Create, replace and insert, delete and scan."""
    from ..sources.vector_table import VectorTable

    e = t(spark, sf, "events").select(F.col("event_id").alias("chunk_id"), F.array("value").alias("embedding"))
    v = VectorTable(spark, f"{Workspace(spark, 'collection').base}/events")
    v.create(e.where("chunk_id % 3 > 0"))
    v.upsert(e.where("chunk_id % 5 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    v.delete(e.where("chunk_id % 7 = 2"))
    return v.scan().select(F.col("chunk_id").alias("event_id"), F.get("embedding", F.lit(0)).alias("v"))


@q("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def rel_pricing_summary(spark, sf):
    x = t(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@q("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def rel_local_supplier(spark, sf):
    c, o, li, s, n = (t(spark, sf, x) for x in ("customer", "orders", "lineitem", "supplier", "nation"))
    j = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@q("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def rel_anti_join(spark, sf):
    o = t(spark, sf, "orders").where("o_totalprice > 300000")
    return t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@q("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def rel_semi_join(spark, sf):
    return t(spark, sf, "orders").join(t(spark, sf, "lineitem").where("l_quantity > 45"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@q("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000 GROUP BY 1")
def rel_outer_join(spark, sf):
    o = t(spark, sf, "orders").where("o_totalprice > 200000")
    return t(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@q("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def rel_cube(spark, sf):
    return t(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rel_rollup(spark, sf):
    return t(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@q("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0")
def rel_intersect(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, sf, "supplier").where("s_suppkey % 3 = 0").select("s_nationkey"))


@q("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 = 0")
def rel_except(spark, sf):
    return t(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).exceptAll(t(spark, sf, "supplier").where("s_suppkey % 5 = 0").select("s_nationkey").distinct())


@q("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS recent, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS d FROM orders")
def rel_windows(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    v = Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return t(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("recent"), F.rank().over(v).cast("long").alias("r"), F.dense_rank().over(v).cast("long").alias("d"))
