"""Validation of datasets, imports and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators import catalogue as K
from quaestor.operators import checks as C

from .registry import Tables, query
from .rollups import cents


@query("""
WITH e AS (SELECT 'count region' AS name, count(*)::BIGINT AS actual, 5::BIGINT AS expected FROM region UNION ALL SELECT 'count supplier', count(*), 7 FROM supplier
UNION ALL SELECT 'sum customer', sum(CAST(round(c_acctbal * 100) AS BIGINT))::BIGINT, 0 FROM customer UNION ALL SELECT 'count nation', count(*), 25 FROM nation)
SELECT name, actual, expected, CASE WHEN actual IS NOT DISTINCT FROM expected THEN 'PASS' ELSE 'FAIL' END AS result FROM e""")
def import_checks(t: Tables) -> DataFrame:
    """Counts and totals after an import, each against what was expected."""
    expected = {"count region": (C.size(t.region), 5), "count supplier": (C.size(t.supplier), 7), "sum customer": (t.customer.agg(F.sum(cents("c_acctbal"))), 0), "count nation": (C.size(t.nation), 25)}
    return C.compared(expected)


@query("""
WITH c AS (SELECT count(*) AS n FROM region), s AS (SELECT count(*) AS n FROM supplier)
SELECT CASE WHEN c.n = 5 AND s.n = 7 THEN 'PASS' ELSE 'FAIL' END AS result, (CASE WHEN c.n <> 5 THEN 1 ELSE 0 END + CASE WHEN s.n <> 7 THEN 1 ELSE 0 END)::BIGINT AS n_errors, 2::BIGINT AS n_checks FROM c, s""")
def import_verdict(t: Tables) -> DataFrame:
    """One row: whether all checks pass, and how many don't."""
    return C.verdict(C.compared({"count region": (C.size(t.region), 5), "count supplier": (C.size(t.supplier), 7)})).select("result", "n_errors", "n_checks")


@query("""
SELECT 'duplicate key' AS rule, count(*) AS violations FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
UNION ALL SELECT 'year', count(*) FROM lineitem WHERE year(l_shipdate) NOT BETWEEN 1992 AND 1998 UNION ALL SELECT 'amount', count(*) FROM lineitem WHERE l_extendedprice <= 0 OR l_extendedprice IS NULL
UNION ALL SELECT 'reference', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'total', count(*) FROM (SELECT l_returnflag, sum(l_linenumber) AS s FROM lineitem GROUP BY 1) WHERE s < 100""")
def dataset_rules(t: Tables) -> DataFrame:
    """A file's rules: unique keys, years, amounts, references and totals; row rules are counted in one pass."""
    keys = C.violations("duplicate key", t.lineitem.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"))
    rows = C.row_rules(t.lineitem, {"year": ~F.year("l_shipdate").between(1992, 1998), "amount": (F.col("l_extendedprice") <= 0) | F.col("l_extendedprice").isNull()})
    orphans = C.violations("reference", t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left_anti"))
    totals = C.violations("total", t.lineitem.groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("s")).where("s < 100"))
    return keys.unionByName(rows).unionByName(orphans).unionByName(totals)


@query("""
WITH p AS (SELECT DISTINCT l_partkey % 50 AS topic, l_suppkey AS item FROM lineitem WHERE l_quantity > 40), r AS (SELECT DISTINCT l_partkey % 50 AS topic, l_suppkey AS item FROM lineitem WHERE l_quantity > 42 OR l_linenumber = 7)
SELECT topic, item, 'unreviewed' AS difference FROM (FROM p EXCEPT FROM r) UNION ALL SELECT topic, item, 'unpublished' FROM (FROM r EXCEPT FROM p)""")
def reviewed_relations(t: Tables) -> DataFrame:
    """Published relations against the reviewed ones, both ways; no row means that they are equal."""
    pairs = lambda cond: t.lineitem.where(cond).select((F.col("l_partkey") % 50).alias("topic"), F.col("l_suppkey").alias("item")).distinct()
    return C.set_differences(pairs("l_quantity > 40"), pairs("l_quantity > 42 or l_linenumber = 7"), "unreviewed", "unpublished")


@query("""
WITH r AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'revise' WHEN 2 THEN 'exclude' ELSE 'pending' END AS decision, CASE WHEN p_partkey % 3 > 0 THEN 'note' ELSE '' END AS note, p_name AS before, CASE WHEN p_partkey % 5 = 0 THEN p_name || '!' ELSE p_name END AS after FROM part)
SELECT id, CASE WHEN decision IN ('revise', 'exclude') AND trim(note) = '' THEN 'note_required' WHEN decision <> 'revise' AND before <> after THEN 'changed_without_revise' WHEN decision = 'revise' AND before = after THEN 'revise_without_change' END AS issue FROM r WHERE issue IS NOT NULL""")
def review_changes(t: Tables) -> DataFrame:
    """Rules of review changes: the first that a row breaks."""
    kind = F.col("p_size") % 4
    decision = F.when(kind == 0, "approve").when(kind == 1, "revise").when(kind == 2, "exclude").otherwise("pending")
    rows = t.part.select(F.col("p_partkey").alias("id"), decision.alias("decision"), F.when(F.col("p_partkey") % 3 > 0, "note").otherwise("").alias("note"), F.col("p_name").alias("before"), F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("after"))
    return C.review_issues(rows, "before", "after").select("id", "issue")


@query("""
WITH r AS (SELECT p_brand AS topic, p_type AS category, CASE WHEN p_size = 50 THEN 'pending' ELSE 'approve' END AS decision FROM part),
g AS (SELECT topic, count(*) AS n, count(*) FILTER (decision = 'pending') AS pending, max(k) AS most FROM (SELECT *, count(*) OVER (PARTITION BY topic, category) AS k FROM r) GROUP BY 1)
SELECT topic, CASE WHEN length(topic) > 8 THEN 'name_too_long' WHEN pending > 0 THEN 'pending_rows' WHEN n NOT BETWEEN 1 AND 12 THEN 'rows_out_of_range' WHEN most > 3 THEN 'category_cap' END AS issue FROM g""")
def publication_policy(t: Tables) -> DataFrame:
    """What stands against a topic's publication, null where nothing does."""
    rows = t.part.select(F.col("p_brand").alias("topic"), F.col("p_type").alias("category"), F.when(F.col("p_size") == 50, "pending").otherwise("approve").alias("decision"))
    return C.policy(rows, longest=8, most=12, cap=3)


@query("SELECT count(*) AS n_files, sha256(string_agg(md5(s_name), '' ORDER BY s_suppkey)) AS revision FROM supplier")
def revision(t: Tables) -> DataFrame:
    """One hash over all review files in the order of their names: a writer who has seen another one is too late."""
    return C.revision(t.supplier, "s_suppkey", F.md5("s_name"))


@query("""
WITH d AS (SELECT left(text, 12) AS title, source AS summary, doc_id FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY title) AS k FROM (SELECT doc_id, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS title, trim(summary) AS summary FROM d))
SELECT doc_id, array_to_string(list_filter([CASE WHEN title = '' THEN 'missing_title' END, CASE WHEN summary = '' THEN 'missing_summary' END, CASE WHEN length(title) > 11 THEN 'title_too_long' END, CASE WHEN length(summary) < 5 AND summary <> '' THEN 'summary_too_short' END, CASE WHEN k > 1 AND title <> '' THEN 'duplicate_title' END], lambda x: x IS NOT NULL), ',') AS issues FROM n""")
def seo_audit(t: Tables) -> DataFrame:
    """Missing, long, short and doubled titles and summaries."""
    from quaestor.operators.versions import title_audit

    rows = t.documents.select("doc_id", F.substring("text", 1, 12).alias("title"), F.col("source").alias("summary"))
    return title_audit(rows, 11, 5).select("doc_id", F.array_join("issues", ",").alias("issues"))


#: Each reference of the tables, under its own type.
_REFERENCES = [('line_part', 'lineitem', 'l_partkey', 'part', 'p_partkey'), ('line_supplier', 'lineitem', 'l_suppkey', 'supplier', 's_suppkey'), ('line_order', 'lineitem', 'l_orderkey', 'orders', 'o_orderkey'), ('order_customer', 'orders', 'o_custkey', 'customer', 'c_custkey'), ('customer_nation', 'customer', 'c_nationkey', 'nation', 'n_nationkey'), ('supplier_nation', 'supplier', 's_nationkey', 'nation', 'n_nationkey'), ('nation_region', 'nation', 'n_regionkey', 'region', 'r_regionkey'), ('label_document', 'labels', 'doc_id', 'documents', 'doc_id'), ('event_customer', 'events', 'user_id', 'customer', 'c_custkey'), ('item_document', 'benchmark', 'item_id', 'documents', 'doc_id'), ('segment_type', 'customer', 'c_mktsegment', 'part', 'p_type')]
_UNIQUE = [('part_id', 'part', ('p_partkey',)), ('order_id', 'orders', ('o_orderkey',)), ('line_id', 'lineitem', ('l_orderkey', 'l_linenumber')), ('customer_id', 'customer', ('c_custkey',)), ('supplier_name', 'supplier', ('s_name',)), ('document_id', 'documents', ('doc_id',)), ('part_name', 'part', ('p_name', 'p_brand'))]


def _rule_sql() -> str:
    row = "SELECT '{}' AS code, CAST({} AS BIGINT) AS actual, {}::BIGINT AS expected, {}::VARCHAR AS first FROM {}".format
    parts = [row(code, "count(*)", 0, f"min(c.{column}::VARCHAR)", f"{table} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{column})") for code, table, column, parent, key in _REFERENCES]
    for code, table, columns in _UNIQUE:
        name = " || '/' || ".join(f"coalesce({c}::VARCHAR, 'null')" for c in columns)
        parts.append(row(code, "count(*)", 0, f"min({name})", f"(SELECT {', '.join(columns)} FROM {table} GROUP BY ALL HAVING count(*) > 1)"))
    cents = "CAST(round({} * 100) AS BIGINT)".format
    values = [("regions", "count(*)", 5, "region"), ("orders", "count(*)", 15000, "orders"), ("balance", f"sum({cents('c_acctbal')})", 0, "customer"), ("years", "count(*) FILTER (year(l_shipdate) NOT BETWEEN 1992 AND 1998)", 0, "lineitem"), ("open_returns", "count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R')", 0, "lineitem"), ("no_price", "count(*) FILTER (l_extendedprice IS NULL)", 0, "lineitem")]
    values += [(f"total:{g}", f"coalesce(sum({cents('l_extendedprice')}) FILTER (l_returnflag = '{g}'), 0)", 0, "lineitem") for g in "AN"] + [("total:other", "count(*) FILTER (l_returnflag NOT IN ('A', 'N'))", 0, "lineitem")]
    parts += [row(code, found, expected, "NULL", table) for code, found, expected, table in values]
    return f"SELECT *, CASE WHEN actual IS NOT DISTINCT FROM expected THEN 'PASS' ELSE 'FAIL' END AS result FROM ({' UNION ALL '.join(parts)})"


@query(_rule_sql())
def rule_catalogue(t: Tables) -> DataFrame:
    """A dataset's rules at once: eleven references, seven unique keys, counts, totals by group and rules on rows."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels"]
    rules = [K.Reference(*r) for r in _REFERENCES] + [K.Unique(*u) for u in _UNIQUE]
    rules += [K.rows_of("regions", "region", 5), K.rows_of("orders", "orders", 15000), K.Value("balance", "customer", F.sum(cents("c_acctbal")), 0)]
    rules += [K.never("years", "lineitem", ~F.year("l_shipdate").between(1992, 1998)), K.never("open_returns", "lineitem", (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")), K.never("no_price", "lineitem", F.col("l_extendedprice").isNull())]
    rules += K.totals("total", "lineitem", "l_returnflag", cents("l_extendedprice"), {"A": 0, "N": 0})
    return K.checked({n: getattr(t, n) for n in names}, rules)
