"""Rollups, statistics and documents over the budget-shaped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quaestor.operators import relational as R

from .registry import Tables, query


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


@query("""
SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, count(*) AS n_customers,
       sum(CAST(round(c_acctbal * 100) AS BIGINT))::BIGINT AS balance_cents
FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey
GROUP BY 1, 2, 3""")
def hierarchy_leaf_totals(t: Tables) -> DataFrame:
    """Totals by account, section and item; the customers are summed before the small tables are joined."""
    sums = t.customer.groupBy("c_nationkey", F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n_customers"), F.sum(cents("c_acctbal")).alias("balance_cents"))
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return sums.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), "segment", "n_customers", "balance_cents")


@query("""
WITH leaf AS (SELECT r_name, n_name, c_mktsegment, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL),
mid AS (SELECT r_name, n_name, sum(n)::BIGINT AS n, string_agg(c_mktsegment || '=' || n, ',' ORDER BY c_mktsegment) AS s FROM leaf GROUP BY ALL)
SELECT r_name AS region, sum(n)::BIGINT AS n_customers, string_agg(n_name || '(' || n || ':' || s || ')', ';' ORDER BY n_name) AS tree FROM mid GROUP BY 1""")
def hierarchy_tree(t: Tables) -> DataFrame:
    """The nested tree of each account, level by level."""
    leaf = hierarchy_leaf_totals(t)
    joined = lambda c, key, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, c.alias("s")))), lambda x: x["s"]), sep)
    mid = leaf.groupBy("region", "nation").agg(F.sum("n_customers").alias("n"), joined(F.concat("segment", F.lit("="), "n_customers"), "segment", ",").alias("s"))
    entry = F.concat("nation", F.lit("("), "n", F.lit(":"), "s", F.lit(")"))
    return mid.groupBy("region").agg(F.sum("n").alias("n_customers"), joined(entry, "nation", ";").alias("tree"))


@query("""
WITH c AS (SELECT c_nationkey AS k, count(*) AS n, sum(CAST(round(c_acctbal * 100) AS BIGINT))::BIGINT AS s FROM customer GROUP BY 1),
s AS (SELECT s_nationkey AS k, count(*) AS n, sum(CAST(round(s_acctbal * 100) AS BIGINT))::BIGINT AS s FROM supplier GROUP BY 1),
k AS (SELECT k FROM c UNION SELECT k FROM s)
SELECT k.k AS nationkey, coalesce(c.n, 0) AS n_customers, coalesce(c.s, 0) AS customer_cents, coalesce(s.n, 0) AS n_suppliers, coalesce(s.s, 0) AS supplier_cents
FROM k LEFT JOIN c ON k.k = c.k LEFT JOIN s ON k.k = s.k""")
def account_overview(t: Tables) -> DataFrame:
    """Both sides of each account, aggregated apart and joined on the union of accounts."""
    c = t.customer.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"), F.sum(cents("c_acctbal")).alias("customer_cents"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"), F.sum(cents("s_acctbal")).alias("supplier_cents"))
    keys = c.select("nationkey").union(s.select("nationkey")).distinct()
    return keys.join(c, "nationkey", "left").join(s, "nationkey", "left").na.fill(0)


@query("""
WITH m AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS u, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1)
SELECT count(*) AS n_sessions, count(*) FILTER (u > 0) AS n_answered, sum(n)::BIGINT AS n_messages, round(avg(n), 2) AS avg_messages,
       CAST(round(quantile_cont(n, 0.5)) AS BIGINT) AS median_messages, CAST(round(quantile_cont(chars, 0.5)) AS BIGINT) AS median_chars, max(n) AS most_messages FROM m""")
def session_statistics(t: Tables) -> DataFrame:
    """One row of counts, means and exact medians over sessions."""
    m = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("u"), F.sum(F.length("text").cast("long")).alias("chars"))
    median = lambda c: F.round(F.percentile(c, F.lit(0.5))).cast("long")
    return m.agg(F.count("*").alias("n_sessions"), F.count_if(F.col("u") > 0).alias("n_answered"), F.sum("n").alias("n_messages"), F.round(F.avg("n"), 2).alias("avg_messages"), median("n").alias("median_messages"), median("chars").alias("median_chars"), F.max("n").alias("most_messages"))


@query("""
SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) AS total
FROM events GROUP BY 1""")
def stance_slots(t: Tables) -> DataFrame:
    """Counts in fixed slots; the total counts other kinds and nulls too."""
    slots = [F.count_if(F.col("event_type") == k).alias(f"{k}s") for k in ("click", "view", "purchase")]
    return t.events.groupBy("user_id").agg(*slots, F.count("*").alias("total"))


@query("""
WITH g AS (SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
SELECT event_type, n, users, CASE WHEN sum(n) OVER () > 0 THEN round(100.0 * n / sum(n) OVER (), 1) END AS share FROM g""")
def kind_rates(t: Tables) -> DataFrame:
    """Counts, distinct respondents and rates, guarded against an empty whole."""
    g = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return g.withColumn("share", F.round(F.try_divide(100.0 * F.col("n"), F.sum("n").over(W.partitionBy())), 1))


@query("""
SELECT o_custkey, arg_min(o_orderpriority, (-o_totalprice, o_orderkey)) AS top_priority, max(o_totalprice) AS top_price, count(*) AS n
FROM orders GROUP BY 1 HAVING count(*) >= 2""")
def best_field(t: Tables) -> DataFrame:
    """The field of the best score, ties by key, of groups of two or more."""
    best = F.min_by("o_orderpriority", F.struct(-F.col("o_totalprice"), "o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(best.alias("top_priority"), F.max("o_totalprice").alias("top_price"), F.count("*").alias("n")).where("n >= 2")


@query("""
SELECT p_brand, list_aggregate(list_sort(list(DISTINCT p_size)), 'string_agg', ',') AS sizes, count(DISTINCT p_type) AS n_types FROM part GROUP BY 1""")
def distinct_lists(t: Tables) -> DataFrame:
    """Ordered lists of distinct values."""
    return t.part.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("p_size")).cast("array<string>"), ",").alias("sizes"), F.countDistinct("p_type").alias("n_types"))


@query("""
SELECT r_name, n_name, grouping_id(r_name, n_name)::BIGINT AS level, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey
GROUP BY ROLLUP (r_name, n_name)""")
def topic_rollup(t: Tables) -> DataFrame:
    """Per topic, per category and in all."""
    base = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return base.rollup("r_name", "n_name").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


@query("""
SELECT s.s_suppkey AS suppkey, count(l.l_orderkey) AS n_lines FROM supplier s LEFT JOIN lineitem l ON s.s_suppkey = l.l_suppkey GROUP BY 1""")
def counts_with_zeros(t: Tables) -> DataFrame:
    """A count for every id, those without rows included; counted before the join."""
    n = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return t.supplier.join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("suppkey"), F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"))


@query("""
SELECT r_name AS tag, count(DISTINCT c_custkey) AS n FROM (SELECT unnest([r_name, n_name[1:1], r_name]) AS r_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1""")
def tag_availability(t: Tables) -> DataFrame:
    """Bills by tag; a tag twice on a bill counts once, so the tags are made distinct before they are exploded."""
    base = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    tags = F.array_distinct(F.array("r_name", F.substring("n_name", 1, 1), "r_name"))
    return base.select("c_custkey", F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("""
SELECT CAST(date_trunc('day', ts + INTERVAL 9 HOUR) AS DATE) AS day, user_id, count(*) AS n_events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2""")
def daily_usage(t: Tables) -> DataFrame:
    """Cost and events of each user's days in Japan, nine hours ahead."""
    day = F.to_date(F.col("ts") + F.expr("interval 9 hours"))
    return t.events.groupBy(day.alias("day"), "user_id").agg(F.count("*").alias("n_events"), F.sum(cents("value")).alias("cents"))


@query("""
WITH b AS (SELECT p_brand, p_partkey, p_retailprice, list_sort(list(p_retailprice) OVER (PARTITION BY p_brand)) AS a FROM part)
SELECT p_brand, p_partkey, CASE WHEN p_retailprice <= a[CAST(floor((len(a) - 1) / 3.0) AS INT) + 1] THEN 1 WHEN p_retailprice <= a[CAST(floor((len(a) - 1) * 2 / 3.0) AS INT) + 1] THEN 2 ELSE 3 END AS tier FROM b""")
def amount_tiers(t: Tables) -> DataFrame:
    """Amount tiers within each group."""
    return R.tercile(t.part, ["p_brand"], "p_retailprice").select("p_brand", "p_partkey", "tier")


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS sum_qty, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS sum_base_cents, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t: Tables) -> DataFrame:
    """Global sums under a date filter that reaches the scan."""
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.sum(cents("l_extendedprice")).alias("sum_base_cents"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


@query("""
SELECT c_custkey, c_name, coalesce(o.n, 0) AS n_orders, coalesce(o.keys, '') AS last_orders FROM customer LEFT JOIN (
  SELECT o_custkey, max(n) AS n, string_agg(o_orderkey, ',' ORDER BY o_orderdate DESC, o_orderkey) AS keys
  FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3 GROUP BY 1) o ON c_custkey = o_custkey""")
def detail_documents(t: Tables) -> DataFrame:
    """A document for each row with its newest three children as a list."""
    w = W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    top = t.orders.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count("*").over(W.partitionBy("o_custkey"))).where("rn <= 3")
    lists = top.groupBy("o_custkey").agg(F.max("n").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))
    return t.customer.join(lists, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.coalesce("keys", F.lit("")).alias("last_orders"))
