"""Queues, incremental work and versioned state over snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import parsing as P
from quaestor.operators import queues as Q
from quaestor.operators import relational as R
from quaestor.operators import versions as V

from .registry import Tables, query

_OLD = "SELECT p_partkey AS id, p_name AS title, p_size AS size, p_retailprice AS price FROM part WHERE p_partkey % 10 > 0"
_NEW = "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN p_name || ' new' ELSE p_name END AS title, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS size, p_retailprice + 1 AS price FROM part WHERE p_partkey % 11 > 0"


def _versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    new = p.withColumns({"title": F.when(F.col("id") % 6 == 0, F.concat("title", F.lit(" new"))).otherwise(F.col("title")), "size": F.when(F.col("id") % 9 > 0, F.col("size")), "price": F.col("price") + 1})
    return p.where("id % 10 > 0"), new.where("id % 11 > 0")


@query(f"SELECT n.id FROM ({_NEW}) n LEFT JOIN ({_OLD}) o ON n.id = o.id WHERE o.id IS NULL OR n.title IS DISTINCT FROM o.title OR n.size IS DISTINCT FROM o.size")
def changed_rows(t: Tables) -> DataFrame:
    """What has to be indexed anew: only a change of an indexed column counts, a price isn't one."""
    return R.changed(*_versions(t), "id", ["title", "size"])


@query(f"""
WITH c AS (SELECT n.id FROM ({_NEW}) n LEFT JOIN ({_OLD}) o ON n.id = o.id WHERE o.id IS NULL OR n.title IS DISTINCT FROM o.title),
r AS (SELECT l_partkey AS id FROM lineitem WHERE l_quantity > 48 UNION SELECT doc_id FROM labels WHERE toxic = 1) SELECT id FROM c UNION SELECT id FROM r WHERE id IN (SELECT id FROM ({_NEW}) x)""")
def captured_changes(t: Tables) -> DataFrame:
    """Rows to index after changes of their own, of related rows or of their tags, each once."""
    old, new = _versions(t)
    related = [t.lineitem.where("l_quantity > 48").select(F.col("l_partkey").alias("id")), t.labels.where("toxic = 1").select(F.col("doc_id").alias("id"))]
    return Q.captured(R.changed(old, new, "id", ["title"]), related, new.select("id"), "id")


@query(f"SELECT * FROM (SELECT id, 'pending' AS status, 0 AS attempts FROM ({_NEW}) n WHERE id % 4 = 0 UNION ALL SELECT id, CASE WHEN id % 3 = 0 THEN 'failed' ELSE 'done' END, CAST(id % 5 AS INT) FROM ({_OLD}) o WHERE NOT (id % 4 = 0 AND id IN (SELECT id FROM ({_NEW}) z)))")
def enqueued(t: Tables) -> DataFrame:
    """Jobs enqueued: a job that is there is reset, one for a row that isn't there isn't made."""
    old, new = _versions(t)
    queue = old.select("id", F.when(F.col("id") % 3 == 0, "failed").otherwise("done").alias("status"), (F.col("id") % 5).cast("int").alias("attempts"))
    asked = t.part.select(F.col("p_partkey").alias("id")).where("id % 4 = 0")
    return Q.enqueued(queue, asked, new.select("id"), "id")


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) GROUP BY 1")
def daily_claims(t: Tables) -> DataFrame:
    """Subscriptions to serve on a date: each once, those that were served go."""
    last = t.events.agg(F.max(F.to_date("ts")).alias("d"))
    due = t.events.join(F.broadcast(last), F.to_date("ts") == F.col("d")).groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return Q.unclaimed(due, t.customer.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("user_id")), "user_id")


@query("""
WITH c AS (SELECT o_custkey % 30 AS config, count(*) FILTER (o_orderstatus = 'F') AS targets, max(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS newest, max(CASE WHEN o_orderstatus = 'O' THEN o_orderdate END) AS done_at, bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS running FROM orders GROUP BY 1)
SELECT config, CASE WHEN targets = 0 THEN 'no_targets' WHEN running THEN 'already_running' WHEN done_at >= newest THEN 'nothing_new' ELSE 'run' END AS action FROM c""")
def analysis_skips(t: Tables) -> DataFrame:
    """Which analyses run: none without targets, while one is running, or with nothing new since the last."""
    when = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderdate")))
    c = t.orders.groupBy((F.col("o_custkey") % 30).alias("config")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("targets"), when("F").alias("newest"), when("O").alias("done_at"), F.bool_or((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("running"))
    return c.select("config", Q.skip_rule(F.col("targets"), F.col("running"), F.col("done_at"), F.col("newest")).alias("action"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 30 AS chunk FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def backfill_chunks(t: Tables) -> DataFrame:
    """What is missing, in chunks of 30 by id."""
    return Q.in_chunks(t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti"), "doc_id", 30)


@query("""
WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, min(event_id) AS oldest, count(*) AS n FROM events GROUP BY 1, 2), f AS (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 1 OFFSET 49)
SELECT user_id, day, oldest FROM p WHERE oldest > (SELECT event_id FROM f) OR n < 2""")
def bootstrap_continues(t: Tables) -> DataFrame:
    """Accounts (a user's day) to read on: their oldest post is newer than the fiftieth of all, or they have just one."""
    p = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("oldest"), F.count("*").alias("n"))
    return Q.behind(p, t.events, "event_id", 50).select("user_id", "day", "oldest")


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN user_id + 1000 ELSE user_id END AS user_id FROM events WHERE user_id % 7 > 0")
def moved_subscriptions(t: Tables) -> DataFrame:
    """One snapshot with some users' history gone and others' rows under a new key."""
    gone = t.customer.select(F.col("c_custkey").alias("user_id")).where("user_id % 7 = 0").unionByName(t.events.select("user_id").where("user_id % 7 = 0")).distinct()
    moves = t.events.select("user_id").where("user_id % 5 = 0").distinct().withColumn("to", F.col("user_id") + 1000)
    return Q.moved(t.events.select("event_id", "user_id"), gone, moves, "user_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 'new' ELSE 'old' END AS note FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE NOT (l_orderkey % 2 = 0 AND l_linenumber > 2) AND (l_orderkey % 2 = 0 OR true) AND NOT (l_orderkey % 2 = 1 AND l_linenumber <= 2) UNION ALL SELECT DISTINCT l_orderkey, l_linenumber, 'old' FROM lineitem WHERE l_orderkey % 2 = 1 AND l_linenumber <= 2")
def pruned_tail(t: Tables) -> DataFrame:
    """A list written anew over an old one that was longer: its rows are replaced by index, the tail goes."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber").distinct()
    new = lines.where("l_orderkey % 2 = 0 and l_linenumber <= 2").withColumn("note", F.lit("new"))
    return Q.rewritten(lines.withColumn("note", F.lit("old")), new, "l_orderkey", "l_linenumber", t.lineitem.where("l_orderkey % 2 = 0").select("l_orderkey"))


@query("SELECT n, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n BETWEEN 101 AND 160 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def ordinal_batch(t: Tables) -> DataFrame:
    """A batch by ordinal range, without what the journal has as done."""
    return Q.ordinal_range(t.orders.select("o_orderkey"), "o_orderkey", 101, 160, t.lineitem.where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))).select("n", "o_orderkey")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error' AS active FROM events")
def one_active_session(t: Tables) -> DataFrame:
    """Of a user's sessions the newest alone is active; an ended one isn't."""
    return Q.one_active(t.events, "user_id", ["ts", "event_id"], F.col("event_type") != "error").select("event_id", "user_id", "active")


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'archived' WHEN p_size > 25 THEN 'published' ELSE 'draft' END AS status FROM part")
def archived_topics(t: Tables) -> DataFrame:
    """A topic archived; the others' states stay."""
    status = F.when(F.col("p_size") > 25, "published").otherwise("draft")
    return Q.set_status(t.part.withColumn("status", status), F.col("p_brand") == "Brand#11", "archived").select("p_partkey", "status")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 1 AND o_orderstatus = 'F' THEN 'unpublished' WHEN o_orderstatus = 'F' THEN 'published' ELSE 'private' END AS status FROM orders")
def unpublished_config(t: Tables) -> DataFrame:
    """All published reports of one configuration taken back."""
    status = F.when(F.col("o_orderstatus") == "F", "published").otherwise("private")
    return Q.set_status(t.orders.withColumn("status", status), (F.col("o_custkey") % 4 == 1) & (F.col("status") == "published"), "unpublished").select("o_orderkey", "status")


@query("SELECT count(*) FILTER (p_size <= 14 AND p_retailprice >= 1200) AS publish, count(*) FILTER (p_size >= 35) AS reject, count(*) FILTER (NOT (p_size <= 14 AND p_retailprice >= 1200) AND p_size < 35) AS leave FROM part")
def publish_preview(t: Tables) -> DataFrame:
    """How many rows a bulk publication would change, before it is made."""
    publish, reject = (F.col("p_size") <= 14) & (F.col("p_retailprice") >= 1200), F.col("p_size") >= 35
    return t.part.agg(F.count_if(publish).alias("publish"), F.count_if(reject).alias("reject"), F.count_if(~publish & ~reject).alias("leave"))


@query("SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey = 4 THEN 'active' WHEN n_nationkey = 2 THEN 'archived' ELSE 'staging' END AS status FROM nation")
def activated_dataset(t: Tables) -> DataFrame:
    """A valid dataset becomes the active one and the one before it is archived."""
    reg = t.nation.select(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("n_nationkey") == 2, "active").otherwise("staging").alias("status"), "n_regionkey")
    return V.activated(reg, "4", F.col("n_regionkey") >= 0).select("id", "status")


@query("""
WITH c AS (SELECT l_partkey % 20 AS topic, l_suppkey AS item, 'old' AS note FROM lineitem GROUP BY 1, 2), r AS (SELECT topic, item, CASE item % 3 WHEN 0 THEN 'exclude' WHEN 1 THEN 'approve' ELSE 'revise' END AS decision FROM c WHERE topic < 10 UNION ALL SELECT 99, 1, 'approve')
SELECT topic, item, note FROM c WHERE (topic, item) NOT IN (SELECT (topic, item) FROM r) UNION ALL SELECT topic, item, 'reviewed' FROM r WHERE decision <> 'exclude'""")
def published_review(t: Tables) -> DataFrame:
    """Relations after a review: what it excludes is gone, what it approves or revises is written anew, others stay."""
    c = t.lineitem.select((F.col("l_partkey") % 20).alias("topic"), F.col("l_suppkey").alias("item")).distinct().withColumn("note", F.lit("old"))
    kind = F.when(F.col("item") % 3 == 0, "exclude").when(F.col("item") % 3 == 1, "approve").otherwise("revise")
    more = t.spark.range(1).select(F.lit(99).cast("long").alias("topic"), F.lit(1).cast("long").alias("item"), F.lit("approve").alias("decision"))
    r = c.where("topic < 10").select("topic", "item", kind.alias("decision")).unionByName(more).withColumn("note", F.lit("reviewed"))
    return V.published_relations(c, r, ["topic", "item"])


@query("""
WITH s AS (SELECT user_id AS account, 'n' || user_id % 3 AS name, max(event_id) AS mark FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id AS account, 'n' || CASE WHEN user_id % 5 = 0 THEN 9 ELSE user_id % 3 END AS name, max(event_id) AS mark FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(s.account, n.account) AS account, coalesce(n.name, s.name) AS name, CASE WHEN n.name IS NULL OR s.name IS NOT DISTINCT FROM n.name THEN greatest(s.mark, n.mark) ELSE n.mark END AS mark FROM s FULL JOIN n ON s.account = n.account""")
def sync_state(t: Tables) -> DataFrame:
    """Each account's high-water mark; one under a new name starts over."""
    def side(odd: int, name):
        return t.events.where(F.col("event_id") % 2 == odd).groupBy(F.col("user_id").alias("account"), F.concat(F.lit("n"), name.cast("string")).alias("name")).agg(F.max("event_id").alias("mark"))

    third = F.col("user_id") % 3
    return V.high_water(side(0, third), side(1, F.when(F.col("user_id") % 5 == 0, 9).otherwise(third)), "account", "mark")


@query("""
WITH o AS (SELECT c_custkey AS k, c_mktsegment AS tags, 1 + c_custkey % 4 AS version FROM customer WHERE c_custkey % 3 > 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END AS tags FROM customer WHERE c_custkey % 7 > 0)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.tags, o.tags) AS tags, CASE WHEN n.k IS NULL THEN o.version WHEN o.k IS NULL THEN 1 WHEN o.tags = n.tags THEN o.version ELSE o.version + 1 END AS version FROM o FULL JOIN n ON o.k = n.k""")
def preference_versions(t: Tables) -> DataFrame:
    """Preferences written again: the version rises where they changed."""
    c = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("tags"))
    old = c.where("k % 3 > 0").withColumn("version", 1 + F.col("k") % 4)
    return V.bumped(old, c.where("k % 7 > 0").withColumn("tags", F.when(F.col("k") % 5 == 0, "OTHER").otherwise(F.col("tags"))), "k", ["tags"])


@query("""
WITH s AS (SELECT p_type AS topic, count(*) AS n FROM part WHERE p_size > 30 GROUP BY 1) SELECT topic, n, row_number() OVER (ORDER BY n DESC, topic) - 1 AS sort_order FROM s""")
def numbered_topics(t: Tables) -> DataFrame:
    """Topics by their number of opinions, from 0; empty ones go."""
    topics = t.part.select(F.col("p_type").alias("topic")).distinct()
    ordered, _ = V.numbered_pairs(topics, t.part.where("p_size > 30").select(F.col("p_type").alias("topic"), "p_partkey"))
    return ordered.select("topic", "n", F.col("sort_order").cast("long").alias("sort_order"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN TIMESTAMP '1997-01-01' > o_orderdate + INTERVAL 5 MINUTE WHEN 'O' THEN TIMESTAMP '1997-01-01' > o_orderdate + INTERVAL 70 MINUTE ELSE false END AS stale FROM orders")
def stale_runs(t: Tables) -> DataFrame:
    """Runs that have been pending or running for too long."""
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("done")
    return t.orders.select("o_orderkey", P.stale(status, F.col("o_orderdate"), F.lit(None).cast("timestamp_ntz"), F.lit("1997-01-01").cast("timestamp_ntz")).alias("stale"))


@query("SELECT doc_id, coalesce(quality, 100 + doc_id) AS score FROM documents LEFT JOIN labels USING (doc_id)")
def created_once(t: Tables) -> DataFrame:
    """Get or create: results that exist stay, the others are computed."""
    have = t.labels.select("doc_id", F.col("quality").cast("long").alias("score"))
    return V.ensured(have, t.documents.select("doc_id"), ["doc_id"], lambda d: d.withColumn("score", 100 + F.col("doc_id")))
