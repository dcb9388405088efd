"""Daily recommendations of every customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators import recommend as R

from .registry import Tables, query

_DAY = "2026-05-01"


def _hash(*parts: str) -> str:
    """FNV-1a of an ASCII text in DuckDB."""
    text = " || ':' || ".join((f"'{_DAY}'", "c", *parts))
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (xor(h, x) * 16777619::HUGEINT % 4294967296)::BIGINT)"


@query(f"""
WITH RECURSIVE tagged AS (SELECT p_partkey AS item, p_brand || '/' || p_size AS tag FROM part UNION SELECT p_partkey, p_brand || '/' || (p_size % 50 + 1) FROM part),
wished AS (SELECT c_custkey AS c, 'Brand#' || (c_custkey * 7 % 25 + 1) || '/' || ((c_custkey * 3 + j) % 50 + 1) AS tag, j AS place FROM customer, range(4) r(j)),
below AS (SELECT c_custkey AS c, 'Brand#' || (c_custkey * 7 % 25 + 1) || '/' || (c_nationkey % 10 + 10 * j + 1) AS tag FROM customer, range(5) r(j)),
shown AS (SELECT DISTINCT o_custkey AS c, l_partkey AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
own AS (SELECT c, tag, place, item FROM wished JOIN tagged USING (tag) ANTI JOIN shown USING (c, item)),
under AS (SELECT c, tag, item FROM below JOIN tagged USING (tag) ANTI JOIN shown USING (c, item)),
wants AS (SELECT c, tag, place, list(item ORDER BY {_hash("'tag'", "tag", "item")}, item) AS items FROM own GROUP BY ALL),
walk AS (
  SELECT c, list(items ORDER BY {_hash("'tag-priority'", "tag")}, place) AS options, 1::BIGINT AS root, [1::BIGINT] AS stack, []::BIGINT[] AS path, []::BIGINT[] AS seen, list_transform(list(1), lambda x: NULL::BIGINT) AS held FROM wants GROUP BY c
  UNION ALL
  SELECT c, options, CASE WHEN ended THEN root + 1 ELSE root END, CASE WHEN ended THEN [root + 1] WHEN item IS NULL THEN stack[:-2] ELSE list_append(stack, holder) END,
    CASE WHEN ended THEN [] WHEN item IS NULL THEN path[:-2] ELSE list_append(path, item) END, CASE WHEN ended THEN [] WHEN item IS NULL THEN seen ELSE list_append(seen, item) END,
    CASE WHEN item IS NOT NULL AND holder IS NULL THEN list_transform(held, lambda h, i: coalesce(list_append(path, item)[list_position(stack, i)], h)) ELSE held END
  FROM (SELECT *, CASE WHEN item IS NULL THEN len(stack) = 1 ELSE holder IS NULL END AS ended
    FROM (SELECT *, nullif(list_position(held, item), 0)::BIGINT AS holder FROM (SELECT *, list_filter(options[stack[-1]], lambda x: NOT list_contains(seen, x))[1] AS item FROM walk WHERE root <= len(options))))),
matched AS (SELECT c, list_filter(held, lambda h: h IS NOT NULL) AS l FROM walk WHERE root > len(options)),
fill1 AS (SELECT c, list(item ORDER BY {_hash("'selected-fill'", "item")}, item) AS l FROM (SELECT DISTINCT c, item FROM own) GROUP BY c),
fill2 AS (SELECT c, list(item ORDER BY {_hash("'parent-unselected'", "item")}, item) AS l FROM (SELECT DISTINCT c, item FROM under ANTI JOIN wished USING (c, tag)) GROUP BY c),
fill3 AS (SELECT c, list(item ORDER BY {_hash("'parent-all'", "item")}, item) AS l FROM (SELECT DISTINCT c, item FROM under) GROUP BY c),
s1 AS (SELECT c_custkey AS c, list_concat(coalesce(m.l, []), list_filter(coalesce(fill1.l, []), lambda x: NOT list_contains(coalesce(m.l, []), x))[:greatest(3 - len(coalesce(m.l, [])), 0)]) AS own, fill2.l AS l2, fill3.l AS l3
  FROM customer LEFT JOIN matched m ON m.c = c_custkey LEFT JOIN fill1 ON fill1.c = c_custkey LEFT JOIN fill2 ON fill2.c = c_custkey LEFT JOIN fill3 ON fill3.c = c_custkey),
s2 AS (SELECT c, own, l3, list_concat(own, list_filter(coalesce(l2, []), lambda x: NOT list_contains(own, x))[:greatest(5 - len(own), 0)]) AS most FROM s1),
s3 AS (SELECT c, own, list_concat(most, list_filter(coalesce(l3, []), lambda x: NOT list_contains(most, x))[:greatest(5 - len(most), 0)])[:5] AS most FROM s2),
picks AS (SELECT c, len(own) AS n_own, unnest(most) AS item, generate_subscripts(most, 1) AS pos FROM s3)
SELECT c AS profile, row_number() OVER (PARTITION BY c ORDER BY {_hash("'final'", "item")}, pos) AS place, item, CASE WHEN pos <= n_own THEN 'selected-subcategory' ELSE 'parent-category' END AS source FROM picks""")
def daily_recommendations(t: Tables) -> DataFrame:
    """Every customer's five parts of a day.

    Wishes are four neighbouring sizes of a brand, the categories above them a tenth of
    its sizes; a part fits its own size and the next. What has been ordered doesn't come again.
    """
    tag = lambda brand, size: F.concat_ws("/", brand, size.cast("string"))
    tagged = t.part.select(F.col("p_partkey").alias("item"), F.explode(F.array(tag(F.col("p_brand"), F.col("p_size")), tag(F.col("p_brand"), F.col("p_size") % 50 + 1))).alias("tag"))
    brand = F.concat(F.lit("Brand#"), F.col("c_custkey") * 7 % 25 + 1)
    of = t.customer.select(F.col("c_custkey").alias("profile"), "c_custkey", "c_nationkey")
    wishes = of.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("profile", tag(brand, (F.col("c_custkey") * 3 + F.col("place")) % 50 + 1).alias("tag"), "place")
    parents = of.withColumn("tens", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("profile", tag(brand, F.col("c_nationkey") % 10 + F.col("tens") * 10 + 1).alias("tag"))
    shown = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("profile"), F.col("l_partkey").alias("item"))
    return R.daily(wishes, parents, tagged, shown, _DAY)
