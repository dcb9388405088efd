"""Search, sampling and text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quaestor.functions import text as X
from quaestor.operators import search as S

from .registry import Tables, query

_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((xor(h, c)) * 16777619::HUGEINT % 4294967296)::BIGINT)"
_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
TERMS = ["tion", "and", "the"]
FIELDS = {"source": 24, "lang": 11, "text": 3}


def _keyword(t: Tables) -> DataFrame:
    return S.keyword_scores(t.documents, "doc_id", FIELDS, TERMS)


_KEYWORD = "SELECT doc_id, " + " + ".join("CASE WHEN contains(lower(source), '{0}') THEN 24 WHEN contains(lower(lang), '{0}') THEN 11 WHEN contains(lower(text), '{0}') THEN 3 ELSE 0 END".format(x) for x in TERMS) + " AS keyword_score FROM documents"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
_ONES = "[" + ", ".join("1.0" if i % 2 else "0.5" for i in range(64)) + "]"


@query(f"SELECT doc_id, keyword_score::BIGINT AS keyword_score FROM ({_KEYWORD}) WHERE keyword_score > 0")
def keyword_search(t: Tables) -> DataFrame:
    """The best field of each term, summed."""
    return _keyword(t)


def _semantic(t: Tables) -> DataFrame:
    vector = [1.0 if i % 2 else 0.5 for i in range(64)]
    return S.semantic_scores(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", vector, 0.0)


_SEMANTIC = f"SELECT vec_id AS doc_id, max(round({_DOT.format('embedding', _ONES)} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format(_ONES, _ONES)})), 9)) AS semantic_score FROM embeddings GROUP BY 1"


@query(f"SELECT doc_id, round(semantic_score, 6) AS semantic_score FROM ({_SEMANTIC}) WHERE semantic_score >= 0")
def semantic_search(t: Tables) -> DataFrame:
    """The best cosine of each document, exactly."""
    return _semantic(t).select("doc_id", F.round("semantic_score", 6).alias("semantic_score"))


@query(f"""
WITH k AS (SELECT doc_id, row_number() OVER (ORDER BY keyword_score DESC, doc_id) AS keyword_rank FROM ({_KEYWORD}) WHERE keyword_score > 0 QUALIFY keyword_rank <= 200),
s AS (SELECT doc_id, row_number() OVER (ORDER BY semantic_score DESC, doc_id) AS semantic_rank FROM ({_SEMANTIC}) WHERE semantic_score >= 0 QUALIFY semantic_rank <= 200)
SELECT doc_id, keyword_rank::INT AS keyword_rank, semantic_rank::INT AS semantic_rank, round(coalesce(1.4 / (60 + keyword_rank), 0) + coalesce(1.0 / (60 + semantic_rank), 0), 9)::DOUBLE AS score
FROM k FULL JOIN s USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20""")
def hybrid_search(t: Tables) -> DataFrame:
    """Keyword and vector ranks fused; the flagship query."""
    return S.fused(_keyword(t), _semantic(t), "doc_id", 20)


@query(f"""
WITH n AS (SELECT p_partkey, p_name, lower(p_name) AS n, {_TRI.format('p_name')} AS g, {_TRI.format("'red widgets'")} AS q FROM part),
s AS (SELECT *, round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))), 9) AS sim FROM n),
k AS (SELECT *, CASE WHEN n = 'red widgets' THEN 'exact' WHEN starts_with(n, 'red widgets') THEN 'prefix' WHEN contains(n, 'red widgets') THEN 'inside' WHEN sim >= 0.22 THEN 'fuzzy' END AS kind FROM s)
SELECT p_partkey, p_name, kind, CASE kind WHEN 'exact' THEN 120.0 WHEN 'prefix' THEN 100.0 WHEN 'inside' THEN 80.0 ELSE round(sim * 60, 6) END::DOUBLE AS score FROM k WHERE kind IS NOT NULL""")
def lexical_search(t: Tables) -> DataFrame:
    """Equal, prefix, substring and trigram matches."""
    return S.lexical_fuzzy(t.part, "p_partkey", "p_name", "red widgets")


@query(f"SELECT p_partkey, {_FNV.format("'2026-04-01:' || p_partkey")} AS draw FROM part")
def seeded_shuffle(t: Tables) -> DataFrame:
    """The hash by which a date orders the rows."""
    return S.seeded(t.part, "p_partkey", "2026-04-01").select("p_partkey", "draw")


@query(f"""
WITH d AS (SELECT p_partkey, p_brand, {_FNV.format("'2026-04-01:' || p_partkey")} AS draw FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY draw, p_partkey) AS turn FROM d)
SELECT p_partkey, p_brand FROM r ORDER BY CASE WHEN turn = 1 THEN 0 ELSE 1 END, draw, p_partkey LIMIT 12""")
def daily_rotation(t: Tables) -> DataFrame:
    """Twelve rows a day, one of each group first."""
    return S.rotated(t.part, "p_partkey", "p_brand", "2026-04-01", 12).select("p_partkey", "p_brand")


@query("SELECT p_partkey, CASE WHEN p_size >= 45 AND p_retailprice > 1500 THEN 'large' WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'brass') THEN 'metal' WHEN NOT p_brand IN ('Brand#1', 'Brand#2') THEN 'other' END AS rule FROM part WHERE rule IS NOT NULL")
def rule_candidates(t: Tables) -> DataFrame:
    """The first rule of all, any and none that holds."""
    kind = F.lower("p_type")
    rules = [("large", (F.col("p_size") >= 45) & (F.col("p_retailprice") > 1500)), ("metal", kind.contains("steel") | kind.contains("brass")), ("other", ~F.col("p_brand").isin("Brand#1", "Brand#2"))]
    return S.first_rule(t.part, rules).select("p_partkey", "rule")


@query()
def tag_matching(t: Tables) -> DataFrame:
    """A largest matching of types to parts in each brand and size; tested against brute force."""
    edges = t.part.select(F.concat("p_brand", F.lit("/"), "p_size").alias("profile"), F.substring("p_type", 1, 3).alias("tag"), "p_partkey")
    return S.tag_cover(edges, "profile", "tag", "p_partkey")


@query("""
SELECT doc_id, i AS chunk, substring(text, i * 1080 + 1, 1200) AS content FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 120) / 1080.0) AS BIGINT), 1))) AS i FROM documents WHERE length(text) > 0)""")
def document_chunks(t: Tables) -> DataFrame:
    """Chunks of 1,200 characters that overlap by 120."""
    return t.documents.select("doc_id", F.posexplode(X.text_chunks(F.col("text"))).alias("chunk", "content")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "content")


@query("""
SELECT doc_id, CASE WHEN p > 41 THEN '…' ELSE '' END || substring(text, greatest(p - 40, 1), 3 + p - greatest(p - 40, 1) + 40) || CASE WHEN greatest(p - 40, 1) + 3 + p - greatest(p - 40, 1) + 40 <= length(text) THEN '…' ELSE '' END AS snippet
FROM (SELECT doc_id, text, instr(lower(text), 'the') AS p FROM documents) WHERE p > 0""")
def snippets(t: Tables) -> DataFrame:
    """The text around the first match."""
    return t.documents.where(F.lower("text").contains("the")).select("doc_id", X.snippet(F.col("text"), F.lit("the")).alias("snippet"))


@query("SELECT doc_id, sha256(coalesce(lang, '') || chr(0) || coalesce(source, '') || chr(0) || coalesce(text, '')) AS digest FROM documents")
def content_hashes(t: Tables) -> DataFrame:
    """Digests over parts that are told apart."""
    return t.documents.select("doc_id", X.content_hash("lang", "source", "text").alias("digest"))


_ODD_JSON = "CASE event_id % 6 WHEN 1 THEN '[' || event_id || ']' WHEN 2 THEN '\"' || event_type || '\"' WHEN 3 THEN '{\"k\": \"99999999999\"}' WHEN 4 THEN '{broken' WHEN 5 THEN CAST(event_id AS VARCHAR) ELSE props END"


@query(f"""
WITH e AS (SELECT event_id, {_ODD_JSON} AS j FROM events)
SELECT event_id, CASE WHEN json_valid(j) AND regexp_full_match(json_extract_string(j, '$.k'), '[0-9]+') THEN try_cast(json_extract_string(j, '$.k') AS INT) END AS k,
       CASE WHEN json_valid(j) THEN CASE json_type(j) WHEN 'UBIGINT' THEN 'NUMBER' WHEN 'VARCHAR' THEN 'STRING' ELSE json_type(j) END END AS kind FROM e""")
def message_fields(t: Tables) -> DataFrame:
    """Fields and kinds of JSON texts: objects, arrays, strings, numbers and broken ones."""
    case = F.expr(_ODD_JSON.replace("VARCHAR", "STRING"))
    return t.events.select("event_id", case.alias("j")).select("event_id", X.leading_int(F.get_json_object("j", "$.k")).alias("k"), X.json_kind(F.col("j")).alias("kind"))


@query("""
SELECT o_orderkey, CASE WHEN v < 0 THEN '-' ELSE '' END || CASE WHEN v = 0 THEN '0' ELSE CASE WHEN abs(v) // 100000 > 0 THEN abs(v) // 100000 || '億' ELSE '' END || CASE WHEN abs(v) % 100000 // 10 > 0 THEN abs(v) % 100000 // 10 || '万' ELSE '' END || CASE WHEN abs(v) % 10 > 0 THEN abs(v) % 10 || '千' ELSE '' END END AS amount
FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) - 100000 AS v FROM orders)""")
def amounts(t: Tables) -> DataFrame:
    """Amounts in Japanese units."""
    return t.orders.select("o_orderkey", X.amount(F.floor("o_totalprice") - 100000).alias("amount"))


@query("SELECT doc_id, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, doc_id) AS place FROM (SELECT doc_id, source, " + " + ".join(f"CASE WHEN contains(lower(text), '{x}') THEN {w} ELSE 0 END" for x, w in (("the", 16), ("tion", 6), ("and", 3))) + " AS n FROM documents) QUALIFY place <= 12")
def curated_top(t: Tables) -> DataFrame:
    """The twelve most direct documents of each topic."""
    body = F.lower("text")
    score = sum((F.when(body.contains(x), w).otherwise(0) for x, w in (("the", 16), ("tion", 6), ("and", 3))), F.lit(0))
    place = F.row_number().over(W.partitionBy("source").orderBy(F.col("n").desc(), "doc_id"))
    return t.documents.select("doc_id", "source", score.alias("n")).withColumn("place", place.cast("long")).where("place <= 12").drop("source")
