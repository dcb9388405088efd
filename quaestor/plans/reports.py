"""Statistics, grouped lists and nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.operators import reports as O

from .registry import Tables, query
from .rollups import cents


@query("""
WITH m AS (SELECT l_orderkey, count(*) AS n, max(l_shipdate) AS last, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cost, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
s AS (SELECT o_orderkey, o_custkey, o_orderstatus AS st, o_orderpriority AS pr, o_orderdate AS began, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 2 HOUR END AS ended,
        CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 5 + 1 AS BIGINT) END AS rating, coalesce(n, 0) AS n, last, coalesce(cost, 0) AS cost, coalesce(r, 0) AS r FROM orders LEFT JOIN m ON o_orderkey = l_orderkey)
SELECT count(*) AS total_sessions, count(DISTINCT o_custkey) AS respondents, count(*) FILTER (st = 'F') AS completed, count(*) FILTER (st = 'O') AS in_progress, count(*) FILTER (st = 'P') AS archived,
  round(100.0 * count(*) FILTER (st = 'F') / nullif(count(*), 0), 1) AS completion_rate, sum(n)::BIGINT AS total_messages, round(avg(n), 2) AS avg_messages, CAST(round(quantile_cont(n, 0.5)) AS BIGINT) AS median_messages, max(n) AS most_messages,
  sum(date_diff('second', began, coalesce(ended, last)))::BIGINT AS total_seconds, count(coalesce(ended, last)) AS timed_sessions, CAST(round(quantile_cont(date_diff('second', began, coalesce(ended, last)), 0.5)) AS BIGINT) AS median_seconds,
  count(rating) AS rated, round(avg(rating), 1) AS avg_rating, count(*) FILTER (rating = 1) AS rating_1, count(*) FILTER (rating = 2) AS rating_2, count(*) FILTER (rating = 3) AS rating_3, count(*) FILTER (rating = 4) AS rating_4, count(*) FILTER (rating = 5) AS rating_5,
  sum(r)::BIGINT AS helpful, sum(cost)::BIGINT AS cost_cents FROM s""")
def interview_statistics(t: Tables) -> DataFrame:
    """One row of 22 statistics over sessions; a session without an end lasts up to its last message, one without either isn't timed."""
    m = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last"), F.sum(cents("l_extendedprice")).alias("cost"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    ended = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 2 hours"))
    rating = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 5 + 1)
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("archived")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = t.orders.join(m, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_custkey").alias("respondent"), status.alias("status"), F.col("o_orderdate").alias("began"), ended.alias("ended"), "last", rating.alias("rating"), zero("n").alias("messages"), zero("cost").alias("cost_cents"), zero("r").alias("helpful"))
    return O.session_statistics(rows)


@query("SELECT o_custkey % 5 AS config, count(*) AS n FROM orders WHERE o_custkey % 5 IN (1, 3) GROUP BY 1")
def counts_by_config(t: Tables) -> DataFrame:
    """Counts of a list of configurations; the list filters before the shuffle."""
    return t.orders.where((F.col("o_custkey") % 5).isin(1, 3)).groupBy((F.col("o_custkey") % 5).alias("config")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN event_type <> 'error' THEN event_type END AS stance, count(*) AS n FROM events GROUP BY 1")
def counts_by_stance(t: Tables) -> DataFrame:
    """Counts by a key that may be null, which is a group of its own."""
    return t.events.groupBy(F.when(F.col("event_type") != "error", F.col("event_type")).alias("stance")).agg(F.count("*").alias("n"))


@query("""
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT ref)), ',') AS refs FROM (SELECT o_custkey, o_orderpriority || ':' || o_orderstatus AS ref FROM orders UNION ALL SELECT o_custkey, 'part:' || l_partkey % 3 FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1""")
def reference_union(t: Tables) -> DataFrame:
    """Each key's distinct references of two kinds, sorted by their text."""
    own = t.orders.select("o_custkey", F.concat_ws(":", "o_orderpriority", "o_orderstatus").alias("ref"))
    parts = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.concat(F.lit("part:"), (F.col("l_partkey") % 3).cast("string")).alias("ref"))
    return own.unionByName(parts).groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("ref")), ",").alias("refs"))


@query("SELECT n_regionkey, length(string_agg(n_name, ' ')) AS n_chars, count(*) AS n FROM nation GROUP BY 1")
def joined_texts(t: Tables) -> DataFrame:
    """Texts of a group joined in any order; what doesn't depend on the order is compared."""
    joined = t.nation.groupBy("n_regionkey").agg(F.array_join(F.collect_list("n_name"), " ").alias("s"), F.count("*").alias("n"))
    return joined.select("n_regionkey", F.length("s").cast("long").alias("n_chars"), "n")


@query("""
WITH x(category, place) AS (VALUES ('LARGE', 0), ('nothing', 1), ('SMALL', 2), ('PROMO', 3)) SELECT place, category, count(*) AS n FROM x JOIN part ON p_type = category GROUP BY 1, 2""")
def taxonomy_counts(t: Tables) -> DataFrame:
    """Counts in a taxonomy's order; categories without rows are left out."""
    return O.taxonomy_counts(t.part, "p_type", ["LARGE", "nothing", "SMALL", "PROMO"])


@query("""
SELECT CASE WHEN event_id % 7 > 0 THEN 'id ' || user_id ELSE 'name ' || event_type END AS who, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, who LIMIT 25""")
def statements_by_member(t: Tables) -> DataFrame:
    """Counts by id, or by name where there is no id; the most first, then by name."""
    who = F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("id "), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("name "), F.col("event_type")))
    return t.events.groupBy(who.alias("who")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "who").limit(25)


@query("""
WITH g AS (SELECT p_brand || '/' || p_size AS kind, min(p_partkey) AS first, list(p_partkey ORDER BY p_partkey) AS items FROM part GROUP BY 1)
SELECT kind, row_number() OVER (ORDER BY first) AS place, array_to_string(items, ',') AS items FROM g""")
def first_seen_groups(t: Tables) -> DataFrame:
    """Groups in the order in which they first come up."""
    return O.first_seen_groups(t.part.select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("kind"), "p_partkey"), "kind", "p_partkey").withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query("""
WITH d AS (SELECT CASE WHEN label % 4 = 0 THEN 'budget' WHEN label % 4 = 1 THEN 'tax' ELSE 'rest' END AS category, vec_id % 10 AS id FROM embeddings),
x(category, place) AS (VALUES ('tax', 0), ('budget', 1), ('none', 2)) SELECT x.category, place, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM x JOIN d USING (category) GROUP BY ALL""")
def category_groups(t: Tables) -> DataFrame:
    """Items by category, each id once, in a fixed order of categories; empty ones go."""
    rows = t.embeddings.select(F.when(F.col("label") % 4 == 0, "budget").when(F.col("label") % 4 == 1, "tax").otherwise("rest").alias("category"), (F.col("vec_id") % 10).alias("id"))
    return O.category_groups(rows, "category", "id", ["tax", "budget", "none"]).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("""
WITH h AS (SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')) SELECT conv_id, row_number() OVER (ORDER BY max(turn) DESC, conv_id) AS place, array_to_string(list(turn ORDER BY turn), ',') AS turns FROM h GROUP BY 1""")
def matches_by_session(t: Tables) -> DataFrame:
    """Messages that match, by session: the session with the newest hit first, messages in order."""
    hits = t.conversations.where(F.lower("text").contains("the"))
    return O.hits_by_session(hits, "conv_id", "turn").select("conv_id", "place", F.array_join(F.col("turns").cast("array<string>"), ",").alias("turns"))


@query("""
SELECT round(avg(CASE WHEN quality = 1 OR toxic = 1 THEN quality + 2 * toxic END), 1) AS mean, count(*) FILTER (quality = 1 AND toxic = 0) AS n_1, count(*) FILTER (quality = 0 AND toxic = 1) AS n_2, count(*) FILTER (quality = 1 AND toxic = 1) AS n_3, count(*) FILTER (quality = 1 OR toxic = 1) AS n FROM labels""")
def score_distribution(t: Tables) -> DataFrame:
    """Mean of scores to one decimal and how often each stands; nulls are left out."""
    value = F.when((F.col("quality") == 1) | (F.col("toxic") == 1), F.col("quality") + 2 * F.col("toxic"))
    return O.distribution(t.labels.select(value.alias("v")), "v", [1, 2, 3])


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority AS name, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS amount FROM orders GROUP BY ALL)
SELECT s_suppkey, s_name, coalesce((SELECT to_json(list({'name': name, 'amount': amount} ORDER BY amount DESC, name)) FROM c WHERE o_custkey = s_suppkey), '[]')::VARCHAR AS sections,
 coalesce((SELECT to_json(list({'partkey': p_partkey, 'size': p_size} ORDER BY p_partkey)) FROM part WHERE p_partkey % 10 = s_suppkey), '[]')::VARCHAR AS related,
 coalesce((SELECT to_json(list(DISTINCT o_orderstatus ORDER BY o_orderstatus)) FROM orders WHERE o_custkey = s_suppkey), '[]')::VARCHAR AS documents FROM supplier""")
def revenue_documents(t: Tables) -> DataFrame:
    """A document for each item: its identity, its sections by amount, the programmes related to it, the documents it cites."""
    c = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("name")).agg(F.sum(cents("o_totalprice")).alias("amount"))
    sections = O.nested(c.withColumn("by", -F.col("amount")), "o_custkey", ["by", "name"], ["name", "amount"], "sections")
    related = O.nested(t.part.select((F.col("p_partkey") % 10).alias("k"), F.col("p_partkey").alias("partkey"), F.col("p_size").alias("size")), "k", ["partkey"], ["partkey", "size"], "related")
    cited = t.orders.groupBy("o_custkey").agg(F.to_json(F.sort_array(F.collect_set("o_orderstatus"))).alias("documents"))
    return O.assembled(t.supplier.select("s_suppkey", "s_name"), "s_suppkey", sections, related, cited)


@query("""
WITH i AS (SELECT n_nationkey, list({'custkey': c_custkey, 'cents': CAST(round(c_acctbal * 100) AS BIGINT)} ORDER BY c_custkey) AS l, sum(CAST(round(c_acctbal * 100) AS BIGINT))::BIGINT AS s FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
SELECT r_name AS category, to_json(list({'name': n_name, 'total': s, 'items': l} ORDER BY n_name))::VARCHAR AS topics, sum(s)::BIGINT AS total, sum(len(l))::BIGINT AS n_items FROM region JOIN nation ON n_regionkey = r_regionkey JOIN i USING (n_nationkey) GROUP BY 1""")
def exploration_graph(t: Tables) -> DataFrame:
    """Categories, their topics and these' items as one nested document a category, summed on every level."""
    items = t.customer.select("c_nationkey", F.struct(F.col("c_custkey").alias("custkey"), cents("c_acctbal").alias("cents")).alias("x"))
    topics = items.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("x")).alias("items"), F.sum("x.cents").alias("total"))
    named = topics.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy(F.col("r_name").alias("category")).agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("name"), "total", "items")))).alias("topics"), F.sum("total").alias("total"), F.sum(F.size("items")).alias("n_items"))


@query("""
SELECT r_name, n_name, count(*) AS n_rows, count(DISTINCT c_mktsegment) AS n_segments, min(c_mktsegment) AS first_segment FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def directory(t: Tables) -> DataFrame:
    """A directory's entries from flat rows."""
    c = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n_rows"), F.countDistinct("c_mktsegment").alias("n_segments"), F.min("c_mktsegment").alias("first_segment"))
    return c.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_rows", "n_segments", "first_segment")


@query("""
SELECT 'account' AS level, r_name AS option FROM region UNION ALL SELECT 'section', n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
UNION ALL SELECT 'item', c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND n_name = (SELECT min(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'))""")
def filter_options(t: Tables) -> DataFrame:
    """What can be chosen on each level of a hierarchy, below what has been chosen above."""
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA'")
    chosen = places.agg(F.min("n_name").alias("n_name"))
    rows = t.customer.join(places.join(F.broadcast(chosen), "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment").distinct()
    level = lambda df, name, c: df.select(F.lit(name).alias("level"), F.col(c).alias("option"))
    return level(t.region, "account", "r_name").unionByName(level(places, "section", "n_name")).unionByName(level(rows, "item", "c_mktsegment"))


@query("""
SELECT p_type AS tag, to_json(list(p_partkey ORDER BY p_partkey DESC)[1:3])::VARCHAR AS newest FROM part WHERE p_type IN ('LARGE', 'PROMO') GROUP BY 1""")
def featured_tags(t: Tables) -> DataFrame:
    """Featured tags with their three newest items."""
    return O.newest_items(t.part.where(F.col("p_type").isin("LARGE", "PROMO")), "p_type", "p_partkey", 3).select(F.col("p_type").alias("tag"), F.to_json("items").alias("newest"))


@query("""
SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n, to_json(list({'event_id': event_id, 'event_type': event_type} ORDER BY event_id))::VARCHAR AS items FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2""")
def digest_groups(t: Tables) -> DataFrame:
    """A day's items of each member, in order."""
    rows = t.events.where(F.col("event_type").isin("click", "view"))
    return rows.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"), F.to_json(F.sort_array(F.collect_list(F.struct("event_id", "event_type")))).alias("items"))


@query("SELECT o_orderkey, count(*) AS n_opinions FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def completed_reports(t: Tables) -> DataFrame:
    """Finished reports that hold an opinion."""
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_opinions"))
    return t.orders.where("o_orderstatus = 'F'").join(n, "o_orderkey").select("o_orderkey", "n_opinions")


@query("""
SELECT d.doc_id, '' AS body, left(text, 20) AS title, coalesce(l.tags, '[]')::VARCHAR AS tags, EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id) AS has_interview
FROM documents d LEFT JOIN (SELECT doc_id, to_json(list_sort(list(DISTINCT tag))) AS tags FROM (SELECT doc_id, 'quality ' || quality AS tag FROM labels UNION ALL SELECT doc_id, 'toxic' FROM labels WHERE toxic = 1) GROUP BY 1) l USING (doc_id)""")
def bill_list(t: Tables) -> DataFrame:
    """A list's entries: title, a body left blank, tags and whether there is an interview; whole bodies aren't shuffled."""
    tags = F.explode(F.array_compact(F.array(F.concat(F.lit("quality "), F.col("quality").cast("string")), F.when(F.col("toxic") == 1, "toxic"))))
    tagged = t.labels.select("doc_id", tags.alias("tag")).groupBy("doc_id").agg(F.to_json(F.sort_array(F.collect_set("tag"))).alias("tags"))
    asked = t.benchmark.select(F.col("item_id").alias("doc_id"), F.lit(True).alias("asked")).distinct()
    rows = t.documents.select("doc_id", F.lit("").alias("body"), F.substring("text", 1, 20).alias("title"))
    return rows.join(tagged, "doc_id", "left").join(asked, "doc_id", "left").select("doc_id", "body", "title", F.coalesce("tags", F.lit("[]")).alias("tags"), F.coalesce("asked", F.lit(False)).alias("has_interview"))


@query("""
SELECT 'list_orders' AS tool, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'list_respondents', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'get_order', count(*) FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 'search_parts', count(*) FROM part WHERE contains(lower(p_name), 'red')""")
def tool_reads(t: Tables) -> DataFrame:
    """How many rows each read of a tool surface gives; a read is a DataFrame by its name."""
    return O.read_sizes(O.reads(t.orders, t.part, "F", 7, "Red"))


@query("SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS n FROM documents")
def inline_lengths(t: Tables) -> DataFrame:
    """Texts on one line, in code points."""
    return t.documents.select("doc_id", F.length(X.inline(F.col("text"))).cast("long").alias("n"))
