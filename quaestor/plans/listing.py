"""Filters, orders and pages of lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.operators import listing as L
from quaestor.operators import relational as R

from .registry import Tables, query

ORDERS = ("o_orderkey", "o_totalprice", "o_orderdate")
_HELPFUL = "(SELECT l_orderkey, count(*) AS helpful FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"


@query(r"SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%d w%' ESCAPE '\' ORDER BY p_partkey DESC LIMIT 30")
def name_like(t: Tables) -> DataFrame:
    """A substring search, case aside; wildcards in the term stand for themselves."""
    return t.part.where(L.like(F.col("p_name"), "D w")).orderBy(F.desc("p_partkey")).limit(30).select("p_partkey", "p_name")


@query(r"SELECT event_id FROM events WHERE props || '50%_a' ILIKE '%50\%\_A%' ESCAPE '\' AND props ILIKE '%{\"k\": 1%'".replace('\\"', '"'))
def escaped_wildcards(t: Tables) -> DataFrame:
    """Per cent and underline in a term match themselves alone."""
    return t.events.where(L.like(F.concat("props", F.lit("50%_a")), "50%_A") & L.like(F.col("props"), '{"k": 1')).select("event_id")


@query("SELECT page_id, url FROM pages WHERE url ILIKE '%/es/%' ORDER BY page_id DESC LIMIT 20")
def committee_items(t: Tables) -> DataFrame:
    """Rows whose note names a committee, the newest first."""
    return t.pages.where(L.like(F.col("url"), "/ES/")).orderBy(F.desc("page_id")).limit(20).select("page_id", "url")


@query("SELECT o_orderkey FROM orders WHERE (NULL IS NULL OR o_custkey = NULL) AND ('F' IS NULL OR o_orderstatus = 'F') AND (1000.0 IS NULL OR o_totalprice >= 1000.0)")
def optional_filters(t: Tables) -> DataFrame:
    """Parameters that are left out don't filter, and reach no plan."""
    return L.optional(t.orders, o_custkey=None, o_orderstatus="F").where(F.col("o_totalprice") >= 1000.0).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'archived' WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'in_progress' END AS status FROM orders")
def session_status(t: Tables) -> DataFrame:
    """A status from an archive mark and an end."""
    ended = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    archived = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate"))
    return t.orders.select("o_orderkey", L.status(archived, ended).alias("status"))


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderstatus = 'F' AND l_returnflag = 'R' AND coalesce(CASE WHEN l_tax > 0.07 THEN 'rejected' WHEN l_tax > 0.03 THEN 'approved' END, 'none') <> 'rejected'""")
def displayable(t: Tables) -> DataFrame:
    """Rows that both sides have made public and that moderation hasn't rejected; not being moderated is no rejection."""
    band = F.when(F.col("l_tax") > 0.07, "rejected").when(F.col("l_tax") > 0.03, "approved")
    public = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.where((F.col("l_returnflag") == "R") & ~F.coalesce(band == "rejected", F.lit(False))).join(public, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, CAST(CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 END AS INT) AS rank FROM part")
def ordinal_ranks(t: Tables) -> DataFrame:
    """An enumeration's place, null beyond it."""
    return t.part.select("p_partkey", L.rank(F.col("p_type"), "SMALL", "MEDIUM", "LARGE").alias("rank"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.quality = 1)")
def by_attribute(t: Tables) -> DataFrame:
    """Rows by their own attribute and one of a related row."""
    return t.documents.where("lang = 'en'").join(t.labels.where("quality = 1"), "doc_id", "left_semi").select("doc_id")


@query("""
SELECT event_id, CASE WHEN event_type = 'view' THEN 'quote' ELSE 'original' END AS form FROM events
WHERE event_id > 0 AND ts IS NOT NULL AND event_type NOT IN ('click', 'error')""")
def eligible_posts(t: Tables) -> DataFrame:
    """Posts with an id and a date that answer and repeat no other; quotes apart from originals."""
    posts = t.events.select(F.col("event_id").cast("string").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.when(F.col("event_type") == "click", "1").alias("reply_to"), F.when(F.col("event_type") == "error", "1").alias("repost_of"), F.when(F.col("event_type") == "view", "1").alias("quote_of"))
    return L.eligible(posts).select(F.col("id").cast("long").alias("event_id"), "form")


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 'resident' WHEN 'purchase' THEN 'business' ELSE 'other' END AS category, CASE event_type WHEN 'view' THEN 'neutral' WHEN 'click' THEN 'positive' WHEN 'error' THEN 'negative' END AS sentiment FROM events")
def mapped_roles(t: Tables) -> DataFrame:
    """Roles to categories, with a rest; stances to sentiments, without."""
    return t.events.select("event_id", F.coalesce(L.mapped(F.col("event_type"), signup="resident", purchase="business"), F.lit("other")).alias("category"), L.mapped(F.col("event_type"), view="neutral", click="positive", error="negative").alias("sentiment"))


def _order(name: str, sql: str, key: str, column: Callable[[], Column], ascending: bool) -> None:
    def f(t: Tables) -> DataFrame:
        n = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("helpful"))
        rows = t.orders.join(n, "o_orderkey", "left").withColumn("key", column())
        return L.switched(rows, "key", ascending, ["o_orderdate", "o_orderkey"]).limit(40).select("o_orderkey", F.col("key").alias(key))

    f.__name__ = name
    query(sql)(f)


_RICH = "CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 101 END"


def _rich() -> Column:
    return F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 101)


for way, ascending in (("asc", True), ("desc", False)):
    _order(f"sessions_by_messages_{way}", f"SELECT o_orderkey, coalesce(helpful, 0)::BIGINT AS n FROM orders LEFT JOIN {_HELPFUL} ON o_orderkey = l_orderkey ORDER BY n {way}, o_orderdate DESC, o_orderkey DESC LIMIT 40", "n", lambda: F.coalesce("helpful", F.lit(0)), ascending)
    _order(f"sessions_by_richness_{way}", f"SELECT o_orderkey, {_RICH} AS richness FROM orders ORDER BY richness {way} NULLS LAST, o_orderdate DESC, o_orderkey DESC LIMIT 40", "richness", _rich, ascending)
    _order(f"sessions_by_score_{way}", f"SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 37 END AS score FROM orders ORDER BY score {way} NULLS LAST, o_orderdate DESC, o_orderkey DESC LIMIT 40", "score", lambda: F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey") % 37), ascending)


@query(f"""
SELECT o_orderkey, 10 * coalesce(helpful, 0)::BIGINT + coalesce({_RICH}, 0) AS weight FROM orders LEFT JOIN {_HELPFUL} ON o_orderkey = l_orderkey
ORDER BY weight DESC, o_orderdate DESC, o_orderkey DESC LIMIT 21""")
def recommended_first(t: Tables) -> DataFrame:
    """Ordered by a weighted sum; one row more than the page tells whether there are more."""
    n = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("helpful"))
    rows = t.orders.join(n, "o_orderkey", "left").withColumn("weight", 10 * F.coalesce("helpful", F.lit(0)) + F.coalesce(_rich(), F.lit(0)))
    return L.switched(rows, "weight", False, ["o_orderdate", "o_orderkey"]).limit(21).select("o_orderkey", "weight")


@query("""
WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders ORDER BY n LIMIT 11 OFFSET 20)
SELECT o_orderkey, (SELECT count(*) FROM p) > 10 AS has_more FROM p WHERE n <= 30""")
def page_with_more(t: Tables) -> DataFrame:
    """A page and whether another follows, from one row more than the page."""
    return L.paged(t.orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, 10).select("o_orderkey", "has_more")


@query("SELECT o_orderkey, count(*) OVER () AS total_count FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 15")
def page_with_total(t: Tables) -> DataFrame:
    """A page beside the number of all rows, which is counted apart."""
    rows = t.orders.where("o_orderstatus = 'P'")
    return L.with_total(rows, R.page(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 2, 15)).select("o_orderkey", "total_count")


@query("""
WITH n AS (SELECT count(*) AS total FROM supplier), c AS (SELECT total, least(greatest(999, 1), greatest(CAST(ceil(total / 4.0) AS BIGINT), 1)) AS page FROM n),
r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier)
SELECT s_suppkey, page, (page - 1) * 4 + 1 AS start_number, least(page * 4, total) AS end_number, total FROM r, c WHERE k > (page - 1) * 4 AND k <= page * 4""")
def clamped_page(t: Tables) -> DataFrame:
    """A page number beyond the last gives the last page, with its first and last numbers."""
    return L.clamped(t.supplier.select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), F.col("s_suppkey")], 999, 4).select("s_suppkey", "page", "start_number", "end_number", "total")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 10 OFFSET 10")
def admin_sessions(t: Tables) -> DataFrame:
    """Rows 11 to 20 by a chosen column and direction."""
    return R.page(t.orders, [L.by("o_totalprice", True), F.col("o_orderkey")], 2, 10).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN l_orderkey % 11 END AS richness FROM lineitem ORDER BY coalesce(richness, -1) DESC, l_orderkey, l_linenumber LIMIT 50")
def opinions_by_richness(t: Tables) -> DataFrame:
    """By a score, those without one last, in the order they had."""
    rich = F.when(F.col("l_linenumber") > 1, F.col("l_orderkey") % 11)
    return t.lineitem.select("l_orderkey", "l_linenumber", rich.alias("richness")).orderBy(F.coalesce("richness", F.lit(-1)).desc(), "l_orderkey", "l_linenumber").limit(50)


@query("""
SELECT p_partkey FROM part ORDER BY CASE p_type WHEN 'LARGE' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, CASE p_brand WHEN 'Brand#11' THEN 0 WHEN 'Brand#12' THEN 1 ELSE 2 END, p_retailprice DESC, p_partkey LIMIT 60""")
def candidate_order(t: Tables) -> DataFrame:
    """By rank of evidence, rank of confidence, amount and id."""
    rank = lambda c, *v: F.coalesce(L.rank(F.col(c), *v), F.lit(2))
    return t.part.orderBy(rank("p_type", "LARGE", "MEDIUM"), rank("p_brand", "Brand#11", "Brand#12"), F.desc("p_retailprice"), "p_partkey").limit(60).select("p_partkey")


@query("SELECT n_nationkey, row_number() OVER (ORDER BY CASE WHEN n_nationkey = 7 THEN 0 ELSE 1 END, n_name) AS place FROM nation")
def focused_first(t: Tables) -> DataFrame:
    """An ordered list with the item in focus moved to its front: everything before it moves down by one."""
    numbered = R.numbered(t.nation, [F.col("n_name")], "place")
    at = numbered.where("n_nationkey = 7").select(F.col("place").alias("at"))
    place = F.when(F.col("n_nationkey") == 7, 1).when(F.col("place") < F.col("at"), F.col("place") + 1).otherwise(F.col("place"))
    return numbered.join(F.broadcast(at)).select("n_nationkey", place.alias("place"))


@query("SELECT DISTINCT year(o_orderdate) AS year FROM orders ORDER BY year DESC")
def years(t: Tables) -> DataFrame:
    """Distinct years, the last first."""
    return t.orders.select(F.year("o_orderdate").cast("long").alias("year")).distinct().orderBy(F.desc("year"))


@query("""
WITH y AS (SELECT max(year(o_orderdate)) AS y FROM orders) SELECT o_orderkey, year(o_orderdate) AS year FROM orders, y
WHERE year(o_orderdate) = CASE WHEN EXISTS (SELECT 1 FROM orders WHERE year(o_orderdate) = 1850) THEN 1850 ELSE y END""")
def year_archive(t: Tables) -> DataFrame:
    """A year's entries; of a year that has none, the last year's."""
    return L.in_year(t.orders, "o_orderdate", 1850).select("o_orderkey", "year")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-03-01'")
def month_range(t: Tables) -> DataFrame:
    """A half-open range of dates, from a month's text."""
    return L.in_month(t.orders, "o_orderdate", "1996-02").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 3) ORDER BY 1, 2 LIMIT 500")
def keyset_page(t: Tables) -> DataFrame:
    """The 500 rows after a key of two columns; the leading one prunes the scan."""
    return L.after(t.lineitem, ["l_orderkey", "l_linenumber"], [100, 3], 500).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT doc_id FROM labels)")
def rows_by_ids(t: Tables) -> DataFrame:
    """Rows of a list of ids: a semi-join, whatever the list's length, where a service asks for a hundred at a time."""
    return t.part.join(t.labels.select(F.col("doc_id").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("SELECT c.c_custkey, s.n_suppliers, s.best FROM customer c LEFT JOIN (SELECT count(*) AS n_suppliers, max(s_acctbal) AS best FROM supplier) s ON true")
def beside_one_row(t: Tables) -> DataFrame:
    """Every row beside an aggregate of one row."""
    return t.customer.select("c_custkey").join(F.broadcast(t.supplier.agg(F.count("*").alias("n_suppliers"), F.max("s_acctbal").alias("best"))), how="left")


@query("SELECT d.doc_id, l.quality FROM (SELECT CAST(doc_id AS VARCHAR) AS k, doc_id FROM documents) d JOIN labels l ON d.k = CAST(l.doc_id AS VARCHAR)")
def cast_key_join(t: Tables) -> DataFrame:
    """A join of a text key to a number: the text is cast, so that the number's statistics serve."""
    d = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("k"))
    return d.join(t.labels.select(F.col("doc_id").alias("id"), "quality"), F.col("k").try_cast("long") == F.col("id")).select("doc_id", "quality")


@query("SELECT n_nationkey, q.n, q.question FROM nation, (VALUES (1, 'What changes for you?'), (2, 'What is missing?'), (3, 'Anything else?')) q(n, question)")
def template_questions(t: Tables) -> DataFrame:
    """Each row with every question of a template, by exploding it; nothing is shuffled."""
    return L.with_each(t.nation, ["What changes for you?", "What is missing?", "Anything else?"]).select("n_nationkey", "n", "question")


@query("SELECT s.s_suppkey, m.code FROM supplier s JOIN (VALUES ('Supplier#000000001', 'a-1'), ('Supplier#000000003', 'a-3'), ('nobody', 'x')) m(name, code) ON s.s_name = m.name")
def mapped_by_name(t: Tables) -> DataFrame:
    """Rows by a mapping of names that is given with the query."""
    code = L.mapped(F.col("s_name"), **{"Supplier#000000001": "a-1", "Supplier#000000003": "a-3", "nobody": "x"})
    return t.supplier.select("s_suppkey", code.alias("code")).where("code is not null")
