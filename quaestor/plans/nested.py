"""Details with nested lists, a hierarchy of four levels, curation and amounts in words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import text as X
from quaestor.operators import curation as K
from quaestor.operators import nesting as N

from .registry import Tables, query
from .rollups import cents


@query("""
WITH p AS (SELECT *, p_brand || '/' || p_type || '/' || p_size AS item FROM part), c AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
members AS (SELECT l_partkey AS k, list({'program': l_orderkey, 'line': l_linenumber, 'cents': cents, 'zero': cents = 0} ORDER BY l_orderkey, l_linenumber, cents) AS l, list({'kind': 'program', 'file': l_orderkey::VARCHAR, 'row': l_linenumber}) AS refs FROM c WHERE l_linestatus = 'O' GROUP BY 1),
revenue AS (SELECT l_partkey AS k, list({'detail': l_suppkey, 'name': s_name, 'allocation': l_orderkey, 'line': l_linenumber, 'cents': cents} ORDER BY s_name, l_suppkey, l_orderkey, l_linenumber, cents) AS l,
  list({'kind': 'allocation', 'file': l_orderkey::VARCHAR, 'row': l_linenumber}) AS refs, list(DISTINCT {'kind': 'detail', 'file': s_name, 'row': 0}) AS refs2 FROM c JOIN supplier ON s_suppkey = l_suppkey WHERE l_linestatus = 'F' GROUP BY 1),
sections AS (SELECT item AS i, list({'code': f, 'cents': cents, 'n': n} ORDER BY f) AS l, list({'kind': 'section', 'file': item, 'row': ascii(f)}) AS refs FROM (SELECT item, l_returnflag AS f, sum(cents)::BIGINT AS cents, count(*) AS n FROM c JOIN p ON p_partkey = l_partkey GROUP BY ALL) GROUP BY 1),
items AS (SELECT item AS i, sum(CAST(round(p_retailprice * 100) AS BIGINT))::BIGINT AS cents, count(*) AS n, list({'identity': p_partkey, 'name': p_name} ORDER BY p_name, p_partkey) AS l FROM p GROUP BY 1),
topics AS (SELECT k, list({'topic': n_nationkey, 'name': n_name, 'evidence': n, 'categories': [{'name': a.r_name, 'primary': true}, {'name': b.r_name, 'primary': false}]} ORDER BY n_name, n_nationkey) AS l
  FROM (SELECT l_partkey AS k, s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL) JOIN nation ON n_nationkey = s_nationkey JOIN region a ON a.r_regionkey = n_regionkey JOIN region b ON b.r_regionkey = (n_regionkey + 1) % 5
  WHERE n_nationkey % 5 > 0 GROUP BY 1),
refs AS (SELECT p_partkey AS k, list_distinct(list_concat(coalesce(m.refs, []), [{'kind': 'item', 'file': p.item, 'row': 0}], coalesce(s.refs, []), coalesce(r.refs, []), coalesce(r.refs2, []))) AS l FROM p LEFT JOIN members m ON m.k = p_partkey LEFT JOIN revenue r ON r.k = p_partkey LEFT JOIN sections s ON s.i = p.item)
SELECT p_partkey, to_json({'key': p.item, 'cents': items.cents, 'n': items.n})::VARCHAR AS budget_item, coalesce(to_json(m.l)::VARCHAR, '[]') AS member_programs, to_json(list_filter(items.l, lambda x: x.identity <> p_partkey))::VARCHAR AS other_programs,
  coalesce(to_json(s.l)::VARCHAR, '[]') AS sections, coalesce(to_json(r.l)::VARCHAR, '[]') AS related_revenue_details, coalesce(to_json(t.l)::VARCHAR, '[]') AS published_topics,
  (SELECT '[' || string_agg(j, ',' ORDER BY j) || ']' FROM (SELECT unnest(list_transform(refs.l, lambda x: to_json(x)::VARCHAR)) AS j)) AS source_references
FROM p JOIN items ON items.i = p.item JOIN refs ON refs.k = p_partkey LEFT JOIN members m ON m.k = p_partkey LEFT JOIN revenue r ON r.k = p_partkey LEFT JOIN sections s ON s.i = p.item LEFT JOIN topics t ON t.k = p_partkey""")
def program_details(t: Tables) -> DataFrame:
    """A document for each part with six lists: its members, its item's other parts and sections, revenue, published topics with their categories, and all references once.

    An item is a brand, a type and a size. Members are open lines, revenue closed ones; topics are the
    suppliers' nations, where these are published, under a first and a second region.
    """
    text = lambda c: F.col(c).cast("string")
    ref = lambda kind, file, row: F.struct(F.lit(kind).alias("kind"), file.alias("file"), row.cast("long").alias("row"))
    item = F.concat_ws("/", "p_brand", "p_type", text("p_size"))
    parts = t.part.select("p_partkey", item.alias("item"), "p_name", cents("p_retailprice").alias("price"))
    lines = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), "l_returnflag", "l_linestatus", cents("l_extendedprice").alias("cents"))
    sold = lines.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey"), "l_suppkey", "left")

    is_open, closed = F.col("l_linestatus") == "O", (F.col("l_linestatus") == "F") & F.col("s_name").isNotNull()
    member = F.struct(F.col("order").alias("program"), "line", "cents", (F.col("cents") == 0).alias("zero"))
    detail = F.struct(F.col("l_suppkey").alias("detail"), F.col("s_name").alias("name"), F.col("order").alias("allocation"), "line", "cents")
    of_part = N.lists_of(sold, "p_partkey", {
        "member_programs": (is_open, [F.col("order"), F.col("line")], member),
        "related_revenue_details": (closed, [F.col("s_name"), F.col("l_suppkey"), F.col("order"), F.col("line")], detail),
    })

    flags = lines.join(parts.select("p_partkey", "item"), "p_partkey").groupBy("item", "l_returnflag").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
    sections = N.lists_of(flags, "item", {"sections": (F.lit(True), [F.col("l_returnflag")], F.struct(F.col("l_returnflag").alias("code"), "cents", "n"))})
    # An item's parts are listed once and each takes itself out.
    items = parts.groupBy("item").agg(F.sum("price").alias("cents"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("p_name", "p_partkey"))).alias("all"))

    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(t.region.select((F.col("r_regionkey")).alias("_second"), F.col("r_name").alias("second")), (F.col("n_regionkey") + 1) % 5 == F.col("_second"))
    category = lambda c, first: F.struct(F.col(c).alias("name"), F.lit(first).alias("primary"))
    published = places.where("n_nationkey % 5 > 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", F.array(category("r_name", True), category("second", False)).alias("categories"))
    evidence = sold.groupBy("p_partkey", "s_nationkey").agg(F.count("*").alias("n")).join(published, "s_nationkey")
    topic = F.struct(F.col("s_nationkey").alias("topic"), F.col("n_name").alias("name"), F.col("n").alias("evidence"), "categories")
    topics = N.lists_of(evidence, "p_partkey", {"published_topics": (F.lit(True), [F.col("n_name"), F.col("s_nationkey")], topic)})

    whole = N.with_lists(N.with_lists(parts, "p_partkey", of_part, topics), "item", sections).join(items, "item")
    others = F.transform(F.filter("all", lambda x: x["p_partkey"] != F.col("p_partkey")), lambda x: F.struct(x["p_partkey"].alias("identity"), x["p_name"].alias("name")))
    cited = N.references(
        F.transform("member_programs", lambda x: ref("program", x["program"].cast("string"), x["line"])),
        F.array(ref("item", F.col("item"), F.lit(0))),
        F.transform("sections", lambda x: ref("section", F.col("item"), F.ascii(x["code"]))),
        F.transform("related_revenue_details", lambda x: ref("detail", x["name"], F.lit(0))),
        F.transform("related_revenue_details", lambda x: ref("allocation", x["allocation"].cast("string"), x["line"])),
    )
    lists = [F.to_json(c).alias(c) for c in ("member_programs", "sections", "related_revenue_details", "published_topics")]
    return whole.select("p_partkey", F.to_json(F.struct(F.col("item").alias("key"), "cents", "n")).alias("budget_item"), *lists, F.to_json(others).alias("other_programs"), F.to_json(cited).alias("source_references"))


def _leaves(t: Tables) -> DataFrame:
    """Suppliers' lines as programmes under a region, a nation, a flag and a supplier."""
    lines = t.lineitem.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.sum(cents("l_extendedprice")).alias("cents"))
    rows = lines.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.withColumn("program", F.struct(F.col("l_linestatus").alias("name"), F.col("cents").alias("amount"), (F.col("cents") == 0).alias("zero")))


_LEAVES = """
leaves AS (SELECT r_regionkey AS a, r_name, n_nationkey AS b, n_name, l_returnflag AS c, s_suppkey AS d, s_name, l_linestatus AS st, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""


@query(f"""
WITH {_LEAVES},
moku AS (SELECT a, b, c, d, min(r_name) AS rn, min(n_name) AS nn, min(s_name) AS sn, sum(cents)::BIGINT AS cents, list({{'name': st, 'amount': cents, 'zero': cents = 0}} ORDER BY st) AS l FROM leaves GROUP BY a, b, c, d),
kou AS (SELECT a, b, c, min(rn) AS rn, min(nn) AS nn, sum(cents)::BIGINT AS cents, list({{'code': d, 'name': sn, 'amount': cents, 'programs': l}} ORDER BY d) AS l FROM moku GROUP BY a, b, c),
kan AS (SELECT a, b, min(rn) AS rn, min(nn) AS nn, sum(cents)::BIGINT AS cents, list({{'code': c, 'name': c, 'amount': cents, 'mokus': l}} ORDER BY c) AS l FROM kou GROUP BY a, b)
SELECT a AS code, min(rn) AS name, sum(cents)::BIGINT AS amount, to_json(list({{'code': b, 'name': nn, 'amount': cents, 'kous': l}} ORDER BY b))::VARCHAR AS kans FROM kan GROUP BY a""")
def official_hierarchy(t: Tables) -> DataFrame:
    """Each account with its kans, their kous, these' mokus and the programmes under them, summed on every level."""
    rows = _leaves(t).withColumn("kou_name", F.col("l_returnflag"))
    levels = [("r_regionkey", "r_name", "kans"), ("n_nationkey", "n_name", "kous"), ("l_returnflag", "kou_name", "mokus"), ("s_suppkey", "s_name", "programs")]
    return N.tree(rows, levels, "cents", "program").select("code", "name", "amount", F.to_json("kans").alias("kans"))


@query(f"""
WITH {_LEAVES}
SELECT 1 AS depth, a || '' AS path, min(r_name) AS name, sum(cents)::BIGINT AS amount, count(*) AS leaves FROM leaves GROUP BY a
UNION ALL SELECT 2, a || '/' || b, min(n_name), sum(cents)::BIGINT, count(*) FROM leaves GROUP BY a, b
UNION ALL SELECT 3, a || '/' || b || '/' || c, min(c), sum(cents)::BIGINT, count(*) FROM leaves GROUP BY a, b, c
UNION ALL SELECT 4, a || '/' || b || '/' || c || '/' || d, min(s_name), sum(cents)::BIGINT, count(*) FROM leaves GROUP BY a, b, c, d""")
def hierarchy_nodes(t: Tables) -> DataFrame:
    """The same hierarchy as one row for each node, which holds at any size."""
    rows = _leaves(t).withColumn("kou_name", F.col("l_returnflag"))
    made = N.nodes(rows, [("r_regionkey", "r_name"), ("n_nationkey", "n_name"), ("l_returnflag", "kou_name"), ("s_suppkey", "s_name")], "cents")
    return made.withColumn("path", F.array_join("path", "/"))


_TERMS = {1: ["cold", "widget"], 2: ["small", "PROMO", "L"]}


@query("""
WITH r AS (SELECT p_partkey, p_brand AS topic, p_name, p_type, p_brand, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, ['', 'approve', 'revise', 'reject', 'pending'][p_size % 5 + 1] AS old, p_size % 2 = 0 AS by_policy, p_size % 3 > 0 AND p_size > 5 AS sound,
    CASE CAST(substring(p_brand, 7) AS INT) % 3 WHEN 1 THEN ['cold', 'widget'] WHEN 2 THEN ['small', 'PROMO', 'L'] ELSE [] END AS terms FROM part),
s AS (SELECT *, CASE WHEN len(terms) = 0 THEN 0 ELSE list_sum(list_transform(terms, lambda t: (contains(p_name, t))::INT * 16 + (contains(p_type, t))::INT * 6 + (contains(p_brand, t))::INT)) END AS score, regexp_matches(p_name, '^(hot|old)') OR (topic LIKE '%3' AND regexp_matches(p_name, 'small')) AS peripheral FROM r),
f AS (SELECT *, topic <> 'Brand#7' AND (old IN ('', 'approve', 'revise') OR by_policy) AND sound AND cents > 0 AND NOT peripheral AND (len(terms) = 0 OR score > 0) AS fits FROM s),
c AS (SELECT *, fits AND row_number() OVER (PARTITION BY topic, fits ORDER BY score DESC, cents DESC, p_partkey) <= 12 AS chosen FROM f)
SELECT p_partkey, CASE WHEN NOT chosen THEN 'reject' WHEN old = 'revise' THEN 'revise' ELSE 'approve' END AS decision,
  CASE WHEN topic = 'Brand#7' THEN 'archived' WHEN chosen THEN 'direct' WHEN old = 'reject' AND NOT by_policy THEN 'by_hand' WHEN peripheral THEN 'peripheral' ELSE 'less_direct' END AS reason FROM c""")
def curated_candidates(t: Tables) -> DataFrame:
    """Every part's decision in its brand's review: the twelve most direct ones are approved, what a person has rejected stays."""
    decisions = F.array(*map(F.lit, ["", "approve", "revise", "reject", "pending"]))
    rows = t.part.select("p_partkey", F.col("p_brand").alias("topic"), "p_name", "p_type", "p_brand", cents("p_retailprice").alias("cents"), F.get(decisions, F.col("p_size") % 5).alias("decision"), (F.col("p_size") % 2 == 0).alias("by_policy"), "p_size")
    of = F.substring("p_brand", 7, 9).cast("int") % 3
    terms = F.when(of == 1, F.array(*map(F.lit, _TERMS[1]))).when(of == 2, F.array(*map(F.lit, _TERMS[2])))
    topics = t.part.select(F.col("p_brand").alias("topic"), terms.alias("terms"), F.when(F.col("p_brand").endswith("3"), "small").alias("excluded"), (F.col("p_brand") == "Brand#7").alias("archived")).distinct()
    sound = (F.col("p_size") % 3 > 0) & (F.col("p_size") > 5)
    made = K.curated(rows, topics, "p_partkey", "p_name", "cents", [(F.col("p_name"), 16), (F.col("p_type"), 6), (F.col("p_brand"), 1)], sound, "^(hot|old)")
    return made.select("p_partkey", "decision", "reason")


_GROUPED = "regexp_replace(reverse(regexp_replace(reverse(({0})::VARCHAR), '(...)', '\\1,', 'g')), '^,', '')"


@query(f"""
WITH v AS (SELECT o_orderkey, CAST(floor(o_totalprice * 997) AS BIGINT) * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS v, year(o_orderdate) + o_orderkey % 30 AS y FROM orders), a AS (SELECT *, abs(v) AS a FROM v)
SELECT o_orderkey, CASE WHEN v < 0 THEN '−' ELSE '' END || CASE WHEN a = 0 THEN '0' ELSE CASE WHEN a // 100000 > 0 THEN {_GROUPED.format('a // 100000')} || '億' ELSE '' END || CASE WHEN a % 100000 // 10 > 0 THEN {_GROUPED.format('a % 100000 // 10')} || '万' ELSE '' END || CASE WHEN a % 10 > 0 THEN a % 10 || '千' ELSE '' END END || '円' AS amount,
  CASE WHEN v > 0 THEN '+' WHEN v < 0 THEN '−' ELSE '' END || {_GROUPED.format('a')} || ' 千円' AS difference, CASE WHEN y >= 2019 THEN '令和' || (y - 2018) ELSE y || '' END || '年度' AS fiscal_year FROM a""")
def amounts_in_words(t: Tables) -> DataFrame:
    """Amounts and differences in yen, and fiscal years by era."""
    factor = F.when(F.col("o_orderkey") % 11 == 0, 0).when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)
    v = F.floor(F.col("o_totalprice") * 997) * factor
    return t.orders.select("o_orderkey", X.yen(v).alias("amount"), X.yen_difference(v).alias("difference"), X.fiscal_year(F.year("o_orderdate") + F.col("o_orderkey") % 30).alias("fiscal_year"))
