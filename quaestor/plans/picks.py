"""Joins, picks, pages, sets, checks and state over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quaestor.operators import relational as R

from .registry import Tables, query


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_event(t: Tables) -> DataFrame:
    """The latest row of each key, by a maximum that is combined before the shuffle."""
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""
SELECT conv_id, turn, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS total, lag(turn) OVER w AS previous, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def locate_turn(t: Tables) -> DataFrame:
    """Position, total, previous and next."""
    return R.neighbours(t.conversations, ["conv_id"], [F.col("turn")], "turn").select("conv_id", "turn", F.col("position").cast("long").alias("position"), "total", "previous", "next")


@query("SELECT source, max(doc_id) AS last_id, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def last_wins(t: Tables) -> DataFrame:
    """Of repeated keys, the last row at the first one's place."""
    rows = t.documents.select("source", "doc_id", F.col("doc_id").alias("last_id"))
    return R.keep_last(rows, "source", "doc_id").select("source", "last_id", "doc_id")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
def directory_page(t: Tables) -> DataFrame:
    """The third page of 20 in a total order."""
    return R.page(t.orders, [F.col("o_orderpriority"), F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], 3, 20).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, length(CAST(event_id AS VARCHAR)) DESC, CAST(event_id AS VARCHAR) DESC LIMIT 50")
def newest_fifty(t: Tables) -> DataFrame:
    """The newest fifty; numeric strings tie longer first."""
    text = F.col("event_id").cast("string")
    return t.events.orderBy(F.col("ts").desc(), F.length(text).desc(), text.desc()).limit(50).select("event_id", "ts")


@query("""
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1), c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(n, 0) AS n FROM c LEFT JOIN n USING (conv_id) ORDER BY n DESC NULLS LAST, conv_id LIMIT 100""")
def sessions_by_messages(t: Tables) -> DataFrame:
    """Sessions by their number of messages, those without any last."""
    n = t.conversations.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("n"))
    return n.orderBy(F.col("n").desc(), "conv_id").limit(100)


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_final FROM customer")
def exists_flag(t: Tables) -> DataFrame:
    """EXISTS as a column."""
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("f")).distinct()
    return t.customer.join(done, "c_custkey", "left").select("c_custkey", F.coalesce("f", F.lit(False)).alias("has_final"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def without_orders(t: Tables) -> DataFrame:
    """NOT EXISTS."""
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT a.p_partkey, count(b.p_partkey) AS n_siblings FROM part a LEFT JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey <> b.p_partkey GROUP BY 1")
def siblings(t: Tables) -> DataFrame:
    """How many others share an item: groups are counted before the join, no pairs."""
    n = t.part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return t.part.join(n, ["p_brand", "p_type"]).select("p_partkey", (F.col("n") - 1).alias("n_siblings"))


@query("""
SELECT k.piece, p_partkey FROM (SELECT DISTINCT lower(split_part(p_name, ' ', 2))[1:3] AS piece FROM part) k JOIN part ON contains(lower(p_name), k.piece) WHERE length(k.piece) = 3""")
def name_mentions(t: Tables) -> DataFrame:
    """A theta join by containment of three-letter names: every three-letter piece is exploded, so it is an equal join."""
    names = t.part.select(F.lower(F.substring(F.split("p_name", " ")[1], 1, 3)).alias("piece")).where(F.length("piece") == 3).distinct()
    pieces = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("p_name") - 2, F.lit(1))), lambda i: F.lower(F.substring("p_name", i, F.lit(3))))))
    return t.part.select("p_partkey", pieces.alias("piece")).join(names, "piece").select("piece", "p_partkey")


@query("""
WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role <> 'user')
SELECT u.conv_id, u.n, length(u.text) AS n_chars, a.turn AS answer FROM u LEFT JOIN a ON u.conv_id = a.conv_id AND u.n = a.n""")
def positional_zip(t: Tables) -> DataFrame:
    """The n-th rows of two lists side by side."""
    w = W.partitionBy("conv_id").orderBy("turn")
    numbered = lambda cond: t.conversations.where(cond).withColumn("n", F.row_number().over(w).cast("long"))
    u, a = numbered("role = 'user'"), numbered("role <> 'user'").select("conv_id", "n", F.col("turn").alias("answer"))
    return u.join(a, ["conv_id", "n"], "left").select("conv_id", "n", F.length("text").cast("long").alias("n_chars"), "answer")


@query("""
SELECT doc_id, 'added' AS change FROM labels WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = doc_id)
UNION ALL SELECT vec_id, 'removed' FROM embeddings WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = vec_id)""")
def tag_difference(t: Tables) -> DataFrame:
    """What was added and what was removed."""
    return R.set_difference(t.embeddings.select(F.col("vec_id").alias("doc_id")), t.labels.select("doc_id"), "doc_id")


@query("""
SELECT 'order' AS rule, count(*) AS violations FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'part', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)
UNION ALL SELECT 'supplier', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)""")
def reference_checks(t: Tables) -> DataFrame:
    """Rows whose reference is missing, by rule."""
    return R.orphans(t.lineitem, [("order", "l_orderkey", t.orders, "o_orderkey"), ("part", "l_partkey", t.part, "p_partkey"), ("supplier", "l_suppkey", t.supplier, "s_suppkey")])


MANIFEST = '{"counts": {"region": 5, "nation": 25, "supplier": 7}, "year": 2026}'


@query(f"""
WITH a AS (SELECT 'region' AS k, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier),
e AS (SELECT unnest(json_keys('{MANIFEST}', '$.counts')) AS k), f AS (SELECT k, CAST(json_extract('{MANIFEST}', '$.counts.' || k) AS BIGINT) AS n FROM e)
SELECT coalesce(a.k, f.k) AS k, a.n AS actual, f.n AS expected FROM a FULL JOIN f ON a.k = f.k WHERE a.n IS DISTINCT FROM f.n""")
def count_checks(t: Tables) -> DataFrame:
    """Tables whose counts aren't those that a JSON manifest states."""
    actual = R.table_counts({k: getattr(t, k) for k in ("region", "nation", "supplier")})
    stated = F.explode(F.from_json(F.get_json_object(F.lit(MANIFEST), "$.counts"), "map<string,bigint>"))
    return R.mismatches(actual, t.spark.range(1).select(stated.alias("k", "n")), "k", "n")


@query("SELECT md5(text) AS digest, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(t: Tables) -> DataFrame:
    """Keys that aren't unique."""
    return R.duplicates(t.documents.select(F.md5("text").alias("digest")), ["digest"])


@query("""
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 10 MINUTE, ts) ORDER BY ts, event_id) AS count,
       row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 10 MINUTE, ts) ORDER BY ts, event_id) <= 2 AS allowed FROM events""")
def rate_limit(t: Tables) -> DataFrame:
    """Two events a user and tumbling window of ten minutes."""
    return R.within_limit(t.events, ["user_id"], "ts", "event_id", "10 minutes", 2).select("event_id", "user_id", F.col("count").cast("long").alias("count"), "allowed")


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def not_yet_labelled(t: Tables) -> DataFrame:
    """Incremental work: what has no result yet."""
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_anti")


@query("""
SELECT coalesce(d.doc_id, e.vec_id) AS id, CASE WHEN e.vec_id IS NULL THEN 'insert' WHEN d.doc_id IS NULL THEN 'delete' WHEN d.n_chars % 10 <> e.label % 10 THEN 'update' ELSE 'keep' END AS action
FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id""")
def index_sync(t: Tables) -> DataFrame:
    """What an index has to insert, update and delete, by digests."""
    drafts = t.documents.select(F.col("doc_id").alias("id"), (F.col("n_chars") % 10).alias("digest"))
    return R.sync_plan(drafts, t.embeddings.select(F.col("vec_id").alias("id"), (F.col("label") % 10).cast("long").alias("digest")), "id", "digest")


@query("""
SELECT d.doc_id, a.label AS topic FROM documents d LEFT JOIN (SELECT vec_id, min(label) AS label FROM embeddings GROUP BY 1) a ON d.doc_id = a.vec_id""")
def carry_assignments(t: Tables) -> DataFrame:
    """Old assignments of documents that are still there."""
    old = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"), F.lit(0).alias("position"))
    return R.carried(old, t.documents, "doc_id", "topic", "position")


@query("""
SELECT job_id, attempts, CASE WHEN attempts >= 5 THEN 'failed' ELSE 'pending' END AS status, CAST(least(60, pow(2, attempts - 1)) AS INT) AS wait_minutes
FROM (SELECT o_orderkey AS job_id, CAST(o_orderkey % 8 + 1 AS INT) AS attempts FROM orders)""")
def retry_jobs(t: Tables) -> DataFrame:
    """Back-off after failures."""
    jobs = t.orders.select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 8 + 1).cast("int").alias("attempts"))
    return jobs.withColumn("r", R.retried(F.col("attempts"))).select("job_id", "attempts", "r.status", "r.wait_minutes")


@query("SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 25")
def claim_jobs(t: Tables) -> DataFrame:
    """The oldest jobs that are due."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done")
    jobs = t.orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("due_at"), status.alias("status"), F.lit(None).cast("timestamp_ntz").alias("locked_at"))
    return R.claimed(jobs, F.lit("1997-01-01").cast("timestamp_ntz"), 25).select("job_id")


@query("SELECT event_id, error_at FROM (SELECT event_id, ts FROM events) e ASOF JOIN (SELECT DISTINCT ts AS error_at FROM events WHERE event_type = 'error') s ON e.ts >= s.error_at")
def last_error(t: Tables) -> DataFrame:
    """The latest error at or before each event."""
    return R.as_of(t.events.select("event_id", "ts"), t.events.where("event_type = 'error'").select("ts"), "ts").select("event_id", F.col("start").alias("error_at"))


@query("SELECT p_partkey, CASE WHEN p_size <= 14 THEN 'approved' WHEN p_size >= 35 THEN 'rejected' ELSE 'pending' END AS moderation, p_size <= 14 AND p_retailprice >= 1200 AS auto_publish FROM part")
def moderation_bands(t: Tables) -> DataFrame:
    """Moderation bands and the rule for publishing at once; nulls fail it."""
    band = F.when(F.col("p_size") <= 14, "approved").when(F.col("p_size") >= 35, "rejected").otherwise("pending")
    return t.part.select("p_partkey", band.alias("moderation"), ((F.col("p_size") <= 14) & (F.col("p_retailprice") >= 1200)).alias("auto_publish"))


@query("""
SELECT p_brand, p_partkey, p_size = max(p_size) OVER (PARTITION BY p_brand) AND row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1 AS is_published FROM part""")
def publish_version(t: Tables) -> DataFrame:
    """One published version of each, the highest; it is combined before the shuffle."""
    best = t.part.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(-F.col("p_size"), "p_partkey")).alias("best"))
    return t.part.join(best, "p_brand").select("p_brand", "p_partkey", (F.col("p_partkey") == F.col("best")).alias("is_published"))


@query("SELECT l.l_orderkey, l.l_linenumber FROM lineitem l SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') o ON l.l_orderkey = o.o_orderkey")
def visible_rows(t: Tables) -> DataFrame:
    """Rows of what is published only."""
    return t.lineitem.join(t.orders.where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")
