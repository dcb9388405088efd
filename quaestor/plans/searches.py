"""Searches for a table of queries (the rows whose id is divisible by 100) over all rows, and sessions around points in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators import fuzzy as Z
from quaestor.operators import intervals as I
from quaestor.operators import keywords as K
from quaestor.operators import vectors as V

from .registry import Tables, query
from .texts import _DOT, _TRI

TOP = 10


def _fuzzy(name: str, table: str, key: str) -> str:
    return f"""
WITH c AS (SELECT {key} AS id, lower({name}) AS name FROM {table}), g AS (SELECT name, {_TRI.format('name')} AS g FROM (SELECT DISTINCT name FROM c)),
p AS (SELECT a.name AS asked, b.name AS name, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 9) AS similarity FROM g a, g b WHERE len(a.g) > 0 AND len(b.g) > 0 AND a.name IN (SELECT name FROM c WHERE id % 100 = 0)),
r AS (SELECT a.id AS asked_id, b.id, b.name, similarity, row_number() OVER (PARTITION BY a.id ORDER BY similarity DESC, b.id)::INT AS rank FROM c a JOIN p ON a.name = p.asked JOIN c b ON b.name = p.name WHERE a.id % 100 = 0 AND similarity >= 0.22)
SELECT * FROM r WHERE rank <= {TOP}"""


_PART = "p_name || ' ' || p_type"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(_fuzzy(_PART, "part", "p_partkey"))
def fuzzy_parts(t: Tables) -> DataFrame:
    """The ten rows whose names are most like each asked one's, by an inverted index of trigrams."""
    rows = t.part.select(F.col("p_partkey").alias("id"), F.expr(_PART).alias("name"))
    return Z.most_similar(rows.where("id % 100 = 0"), rows, TOP)


@query(_fuzzy(_TITLE, "pages", "page_id"))
def fuzzy_titles(t: Tables) -> DataFrame:
    """The ten pages whose titles are most like each asked one's."""
    rows = t.pages.select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"))
    return Z.most_similar(rows.where("id % 100 = 0"), rows, TOP)


_VECTORS = "SELECT vec_id, embedding, sqrt({0}) AS norm FROM embeddings".format(_DOT.format("embedding", "embedding"))


@query(f"""
WITH v AS ({_VECTORS}), s AS (SELECT a.vec_id AS asked_id, b.vec_id AS id, round({_DOT.format("a.embedding", "b.embedding")} / (a.norm * b.norm), 9) AS similarity FROM v a, v b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY similarity DESC, id)::INT AS rank FROM s WHERE similarity >= 0)
SELECT asked_id, id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= {TOP}""")
def semantic_neighbours(t: Tables) -> DataFrame:
    """The ten nearest vectors of each asked one, exactly."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = V.nearest(rows.where("id % 100 = 0"), rows, TOP, 0.0)
    return found.withColumn("similarity", F.round("similarity", 6))


@query()
def semantic_recall(t: Tables) -> DataFrame:
    """How many of the ten nearest vectors the coarse index finds, against the exact search, and the share of centres that it looks at."""
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked, index = rows.where("id % 100 = 0"), V.centres(rows, "id", "vector")
    # These vectors lie in all directions alike, so that a centre tells little: two thirds of them hold nine of ten neighbours.
    probes = max(1, -(-2 * len(index) // 3))
    found = V.recall(V.nearest(asked, rows, TOP, index=index, probes=probes), V.nearest(asked, rows, TOP))
    return found.withColumns({"centres": F.lit(len(index)), "probes": F.lit(probes)})


# The weights of a field that equals a term, and of one that contains it.
WEIGHTS = {"title": (28, 18), "name": (24, 14), "tags": (12, 12), "category": (11, 11), "note": (10, 10), "statements": (9, 9), "summary": (6, 6), "body": (3, 3)}
_FIELDS = {"title": "CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END", "name": "CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_type END", "tags": "p_brand", "category": "CASE WHEN p_size > 25 THEN 'wide' ELSE 'red' END", "note": "p_type || ' wing'", "statements": "CASE WHEN p_retailprice > 1200 THEN p_name || ' said' END", "summary": "p_brand || ' red'", "body": "p_name || ' ' || p_type || '  ' || p_brand"}
_BEST = ", ".join(f"CASE WHEN lower({_FIELDS[f]}) = term THEN {e} WHEN contains(lower({_FIELDS[f]}), term) THEN {i} ELSE 0 END" for f, (e, i) in WEIGHTS.items())


@query(f"""
WITH q AS (SELECT p_partkey AS asked_id, unnest(list_distinct([lower(split_part(p_name, ' ', 1)), lower(split_part(p_name, ' ', 2)), lower(p_type), lower(p_brand), lower(left(p_type, 2)), 'x'])) AS term FROM part WHERE p_partkey % 100 = 0),
s AS (SELECT asked_id, p_partkey AS id, sum(greatest({_BEST}))::BIGINT AS keyword_score FROM q, part WHERE length(term) >= 2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY keyword_score DESC, id)::INT AS rank FROM s WHERE keyword_score > 0)
SELECT * FROM r WHERE rank <= 20""")
def keyword_table(t: Tables) -> DataFrame:
    """The twenty best rows of each asked one's terms, by postings of eight fields with their equal and contained weights."""
    words = F.split("p_name", " ")
    asked = t.part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("id"), F.array(words[0], words[1], F.col("p_type"), F.col("p_brand"), F.substring("p_type", 1, 2), F.lit("x")).alias("terms"))
    docs = t.part.select("p_partkey", *[F.expr(e).alias(f) for f, e in _FIELDS.items()])
    return K.keyword_table(asked, docs, "p_partkey", WEIGHTS, 20)


@query("""
WITH s AS (SELECT o_orderkey AS session, CAST(o_orderdate AS DATE) AS opened, CASE WHEN o_orderkey % 50 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INT) END AS closed FROM orders),
d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem),
b AS (SELECT day, arg_max(session, (opened, session)) AS session, max(opened) AS opened FROM d JOIN s ON opened <= day AND (closed IS NULL OR day <= closed) GROUP BY 1)
SELECT l_orderkey, l_linenumber, session, opened FROM lineitem LEFT JOIN b ON CAST(l_shipdate AS DATE) = day""")
def session_of_date(t: Tables) -> DataFrame:
    """The session that holds each date, the latest start first, ends included and some of them open."""
    day = F.col("o_orderdate").cast("date")
    sessions = t.orders.select(F.col("o_orderkey").alias("session"), day.alias("opened"), F.when(F.col("o_orderkey") % 50 > 0, F.date_add(day, (F.col("o_orderkey") % 45).cast("int"))).alias("closed"))
    points = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"))
    return I.holding(points, sessions, "day", "opened", "closed", "session").drop("day")


@query("""
WITH s AS (SELECT event_id AS session, ts AS opened, ts + to_seconds(CAST(floor(value * 30) AS BIGINT)) AS closed FROM events WHERE event_type = 'click')
SELECT e.event_id, arg_max(session, (opened, session)) AS session, max(opened) AS opened FROM events e LEFT JOIN s ON opened <= ts AND ts <= closed GROUP BY 1""")
def session_of_event(t: Tables) -> DataFrame:
    """The same by timestamps: sessions of minutes that overlap and leave gaps; events in none have none."""
    opened = F.col("ts").cast("timestamp")
    sessions = t.events.where("event_type = 'click'").select(F.col("event_id").alias("session"), F.col("ts").alias("opened"), F.timestamp_micros(F.unix_micros(opened) + F.floor(F.col("value") * 30) * 1000000).cast(dict(t.events.dtypes)["ts"]).alias("closed"))
    return I.holding(t.events.select("event_id", "ts"), sessions, "ts", "opened", "closed", "session").drop("ts")


@query("""
WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS opened FROM orders WHERE o_orderkey % 40 = 0), d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem),
p AS (SELECT day, opened AS previous FROM d ASOF LEFT JOIN s ON day > opened), n AS (SELECT day, opened AS next FROM d ASOF LEFT JOIN s ON day < opened)
SELECT l_orderkey, l_linenumber, previous, next FROM lineitem JOIN p ON p.day = CAST(l_shipdate AS DATE) JOIN n ON n.day = p.day""")
def sessions_beside_date(t: Tables) -> DataFrame:
    """The last session that began before each date, and the first one after it."""
    sessions = t.orders.where("o_orderkey % 40 = 0").select(F.col("o_orderdate").cast("date").alias("opened"))
    points = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"))
    return I.neighbours_in_time(points, sessions, "day", "opened").drop("day")
