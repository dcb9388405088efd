"""Functions on texts, numbers and JSON over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import parsing as P
from quaestor.functions import text as X

from .registry import Tables, query


@query(r"SELECT p_partkey, regexp_replace(lower(p_name), '[\s\-.,()\[\]]+', '', 'g') AS search, trim(regexp_replace(lower(p_name || '  ' || p_type), '\s+', ' ', 'g')) AS council FROM part")
def normalized_names(t: Tables) -> DataFrame:
    """Names as both searches compare them."""
    return t.part.select("p_partkey", X.normalize_search(F.col("p_name")).alias("search"), X.normalize_council(F.concat("p_name", F.lit("  "), "p_type")).alias("council"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(replace(nfc_normalize(translate(text, '.;-', '···')), '·', '・'), '\s+', '', 'g'), '[‐‑‒–—―ー]', '-', 'g') AS name FROM documents")
def candidate_names(t: Tables) -> DataFrame:
    """Whole texts, written with full-width letters, middle dots and long vowel marks, without blanks and with one kind of dot and dash."""
    wide = F.translate("text", "aeio.;-", "ａｅｉｏ･·･")
    return t.documents.select("doc_id", X.normalize_candidate(wide).alias("name"))


@query("SELECT c_custkey, regexp_replace(c_name || ' (x y)', '\\([^)]*\\)|\\s', '', 'g') AS person, split_part(c_name || ' Doe', ' ', -1) AS family, replace(c_mktsegment || ' 委員会', '委員会', '') AS term FROM customer")
def person_names(t: Tables) -> DataFrame:
    """People's names without brackets and blanks, their last parts, and what a committee is searched by."""
    return t.customer.select("c_custkey", X.normalize_person(F.concat("c_name", F.lit(" (x y)"))).alias("person"), X.family_name_last(F.concat("c_name", F.lit(" Doe"))).alias("family"), X.committee_term(F.concat("c_mktsegment", F.lit(" 委員会"))).alias("term"))


@query("""
WITH w AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name || ', ' || p_type || '. ' || p_name), '[\\s,.]+'), lambda w: length(w) BETWEEN 2 AND 40 AND w <> 'red')) AS terms FROM part)
SELECT p_partkey, array_to_string(list_sort(terms), '') AS x, len(terms)::BIGINT AS n FROM w""")
def search_terms(t: Tables) -> DataFrame:
    """A query's distinct terms less stop words."""
    terms = X.query_terms(F.concat("p_name", F.lit(", "), "p_type", F.lit(". "), "p_name"), ("red",))
    return t.part.select("p_partkey", F.array_join(F.sort_array(terms), "").alias("x"), F.size(terms).cast("long").alias("n"))


@query("""
WITH a(tag, aliases) AS (VALUES ('LARGE', ['BIG', 'HUGE']), ('SMALL', ['TINY', 'SMALL'])),
u AS (SELECT p_partkey, unnest(list_concat([p_type], coalesce(aliases, []), [p_brand])) AS term, generate_subscripts(list_concat([p_type], coalesce(aliases, []), [p_brand]), 1) AS i FROM part LEFT JOIN a ON tag = p_type),
f AS (SELECT p_partkey, term, min(i) AS i FROM u GROUP BY ALL)
SELECT p_partkey, string_agg(term, ',' ORDER BY i) AS terms FROM f GROUP BY 1""")
def expanded_queries(t: Tables) -> DataFrame:
    """Terms and their aliases, each once, in order."""
    aliases = F.create_map(F.lit("LARGE"), F.array(F.lit("BIG"), F.lit("HUGE")), F.lit("SMALL"), F.array(F.lit("TINY"), F.lit("SMALL")))
    return t.part.select("p_partkey", F.array_join(X.expanded_terms(F.array("p_type", "p_brand"), aliases), ",").alias("terms"))


@query("SELECT p_partkey, CASE CASE trim(p_type) WHEN 'PROMO' THEN 'SMALL' ELSE p_type END WHEN 'SMALL' THEN 'SMALL' WHEN 'LARGE' THEN 'LARGE' END AS tag FROM part")
def canonical_tags(t: Tables) -> DataFrame:
    """Tags under their aliases, if they are known ones."""
    aliases = F.create_map(F.lit("PROMO"), F.lit("SMALL"))
    return t.part.select("p_partkey", X.canonical_tag(F.concat(F.lit(" "), "p_type"), aliases, ("SMALL", "LARGE")).alias("tag"))


@query("""
WITH v AS (SELECT vec_id, CASE WHEN embedding[1] > 0.1 THEN embedding[1:63] WHEN embedding[2] > 0.1 THEN list_transform(embedding, lambda x: x / (CASE WHEN x > 0.2 THEN 0 ELSE 1 END)::FLOAT) ELSE embedding END AS e FROM embeddings)
SELECT vec_id, len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS valid FROM v""")
def vector_validity(t: Tables) -> DataFrame:
    """Whether vectors have their dimension and finite numbers; some are cut short here, and some divided by zero."""
    e = F.col("embedding")
    broken = F.transform(e, lambda x: F.when(x > 0.2, F.lit(float("inf"))).otherwise(x))
    made = F.when(e[0] > 0.1, F.slice(e, 1, 63)).when(e[1] > 0.1, broken).otherwise(e)
    return t.embeddings.select("vec_id", X.valid_vector(made, 64).alias("valid"))


@query("SELECT p_brand, array_to_string(list_transform(range(0, CAST(ceil(len(l) / 10.0) AS BIGINT)), lambda i: array_to_string(l[i * 10 + 1:i * 10 + 10], ',')), ';') AS pieces FROM (SELECT p_brand, list_sort(list(p_partkey)) AS l FROM part GROUP BY 1)")
def id_batches(t: Tables) -> DataFrame:
    """A group's ids in pieces of ten."""
    ids = t.part.groupBy("p_brand").agg(F.sort_array(F.collect_list("p_partkey")).alias("l"))
    return ids.select("p_brand", F.array_join(F.transform(X.chunked(F.col("l"), 10), lambda x: F.array_join(x.cast("array<string>"), ",")), ";").alias("pieces"))


@query("SELECT p_partkey, 'see ' || CASE WHEN p_size % 3 = 0 THEN '' ELSE '[' || p_size || '](/ref/' || p_size || ')' END || ' and [3](/ref/3) end' AS linked FROM part")
def linked_texts(t: Tables) -> DataFrame:
    """Reference marks as links; those to nothing go."""
    text = F.concat(F.lit("see [ref:"), "p_size", F.lit("] and [ref:0, 3] end"))
    valid = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("3"))).otherwise(F.array(F.col("p_size").cast("string"), F.lit("3")))
    linked = X.linked_references(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("see [ref:0] and [ref:0, 3] end"))).otherwise(text), valid)
    return t.part.select("p_partkey", linked.alias("linked"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.07 THEN NULL ELSE CAST(floor(least(100, greatest(0, l_quantity * 4 - 50)) + 0.5) AS INT) END AS richness FROM lineitem")
def clamped_scores(t: Tables) -> DataFrame:
    """Scores rounded and held to 0..100."""
    value = F.when(F.col("l_tax") <= 0.07, F.col("l_quantity") * 4 - 50)
    return t.lineitem.select("l_orderkey", "l_linenumber", X.clamp_score(value).alias("richness"))


@query("SELECT doc_id, sha256(text) AS sha256, length(text)::BIGINT AS chars, (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::BIGINT AS utf16_units, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def text_sizes(t: Tables) -> DataFrame:
    """Digests and sizes of whole texts in characters, UTF-16 units and bytes."""
    m = P.text_metrics(F.col("text"))
    return t.documents.select("doc_id", m.alias("m")).select("doc_id", "m.sha256", *[F.col(f"m.{c}").cast("long").alias(c) for c in ("chars", "utf16_units", "bytes")])


@query("SELECT event_id, CASE event_type WHEN 'click' THEN round((event_id * 2 + user_id * 10) / 1e6, 6)::DOUBLE WHEN 'view' THEN round((event_id * 3 + user_id) / 1e6, 6)::DOUBLE END AS cost FROM events")
def event_costs(t: Tables) -> DataFrame:
    """Costs by prices for a million tokens, looked up by model; null for an unknown model."""
    price = lambda a, b: F.when(F.col("event_type") == "click", a).when(F.col("event_type") == "view", b)
    return t.events.select("event_id", P.token_cost(F.col("event_id"), F.col("user_id"), price(2.0, 3.0), price(10.0, 1.0)).alias("cost"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN ((event_id % 60) * 0.25)::DOUBLE WHEN 'view' THEN ((event_id % 60) * 0.5)::DOUBLE END AS cost FROM events")
def interview_costs(t: Tables) -> DataFrame:
    """Estimated costs by a price a minute."""
    return t.events.select("event_id", P.interview_cost(F.col("event_id") % 60, {"click": 0.25, "view": 0.5}, F.col("event_type")).alias("cost"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN greatest(0, CAST(ceil(30 - date_diff('second', o_orderdate, TIMESTAMP '1996-01-01 00:10:30') / 60.0) AS BIGINT)) END AS minutes FROM orders")
def minutes_left(t: Tables) -> DataFrame:
    """Minutes left of an estimate, rounded up, 0 at least."""
    left = P.remaining_minutes(F.when(F.col("o_orderkey") % 4 > 0, 30), F.col("o_orderdate").cast("timestamp"), F.lit("1996-01-01 00:10:30").cast("timestamp"))
    return t.orders.select("o_orderkey", left.alias("minutes"))


@query("""
WITH c AS (SELECT conv_id, list(DISTINCT turn % 5) AS a, count(*) AS n FROM conversations GROUP BY 1)
SELECT conv_id, CAST(CASE WHEN n % 3 = 0 THEN 100 WHEN n % 3 = 1 THEN 90 ELSE floor(greatest(0, len(a) - 1) / 8.0 * 80 + 0.5) END AS INT) AS progress FROM c""")
def interview_progress(t: Tables) -> DataFrame:
    """How far interviews are, by stage and questions asked."""
    c = t.conversations.groupBy("conv_id").agg(F.collect_set(F.col("turn") % 5).alias("a"), F.count("*").alias("n"))
    stage = F.when(F.col("n") % 3 == 0, "summary_complete").when(F.col("n") % 3 == 1, "summary").otherwise("chat")
    return c.select("conv_id", P.progress(F.lit(8), stage, F.col("a")).alias("progress"))


@query("SELECT conv_id, turn, CASE WHEN (contains(lower(text), 'the') OR contains(lower(text), 'zqx')) AND NOT contains(lower(text), 'and') THEN 'blocked' ELSE 'allowed' END AS verdict FROM conversations")
def off_topic_messages(t: Tables) -> DataFrame:
    """Messages with an off-topic term and no civic one."""
    return t.conversations.select("conv_id", "turn", P.off_topic(F.col("text"), ("the", "zqx"), ("and",)).alias("verdict"))


@query("SELECT event_id, CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, year(ts + INTERVAL 9 HOUR)::BIGINT AS year FROM events")
def japan_days(t: Tables) -> DataFrame:
    """Dates and calendar years in Japan."""
    day = P.japan_day(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", day.alias("day"), F.year(day).cast("long").alias("year"))


@query("SELECT n_nationkey, 'intro ' || n_name AS s0, 'body ' || n_nationkey AS s1 FROM nation")
def sections(t: Tables) -> DataFrame:
    """The text under each heading of a Markdown text; a skipped part goes with all that is under it."""
    md = F.concat(F.lit("intro\n"), "n_name", F.lit("\n# One\nbody\n "), "n_nationkey", F.lit("\n# Opinions\nhidden\n## Under\nhidden"))
    found = P.markdown_sections(t.nation.select("n_nationkey", md.alias("md")), "n_nationkey", "md", "top", F.col("heading") == "Opinions")
    return found.groupBy("n_nationkey").agg(F.max(F.when(F.col("heading") == "top", F.col("content"))).alias("s0"), F.max(F.when(F.col("heading") == "One", F.col("content"))).alias("s1"))


@query("SELECT n_nationkey, k.n, 'Member ' || k.n AS speaker, n_name || ' ' || k.n AS content FROM nation, (VALUES (1), (2)) k(n)")
def extracted_statements(t: Tables) -> DataFrame:
    """Statements under one heading of level 1, a row for each heading of level 2."""
    md = F.concat(F.lit("# Other\n## Nobody\nx\n# Statements\n## Member 1\n"), "n_name", F.lit("\n1\n## Member 2\n"), "n_name", F.lit("\n\n2\n# End\n## Nobody\ny"))
    return P.statements(t.nation.select("n_nationkey", md.alias("md")), "n_nationkey", "md", "Statements")


@query("""
WITH l AS (SELECT l_orderkey, (l_linenumber, l_partkey, l_suppkey) AS n, CAST(l_quantity AS BIGINT) % 9 AS item, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL WHEN l_suppkey % 7 = 6 THEN 'null' ELSE 'topic-' || (l_suppkey % 7) END AS token FROM lineitem),
last AS (SELECT l_orderkey, item, arg_max(token, n) AS token FROM l WHERE token IS NOT NULL AND item BETWEEN 1 AND 7 GROUP BY ALL),
i AS (SELECT DISTINCT l_orderkey, k AS item FROM lineitem, range(1, 8) r(k))
SELECT l_orderkey, item, CASE WHEN token IN ('topic-0', 'topic-1', 'topic-2', 'topic-3') THEN token END AS topic FROM i LEFT JOIN last USING (l_orderkey, item)""")
def parsed_assignments(t: Tables) -> DataFrame:
    """Topics that a reply's lines give to items: separators and decoration vary, an item's last line counts, lines with a dot after the number say nothing, unknown topics give null."""
    item, k = (F.col("l_quantity").cast("long") % 9).cast("string"), F.col("l_suppkey") % 7
    topic = F.when(k == 6, "null").when(k % 2 == 0, F.concat(F.lit("`topic-"), k, F.lit("`,"))).otherwise(F.concat(F.lit("topic-"), k))
    line = F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), F.concat(item, F.lit(". "), topic)).when(F.col("l_suppkey") % 3 == 0, F.concat(item, F.lit(" → "), topic)).when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("  "), item, F.lit(": "), topic, F.lit(" (sure)"))).otherwise(F.concat(item, F.lit("\t"), topic))
    replies = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line")))).alias("l"))
    reply = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return P.assignments(replies.select("l_orderkey", reply.alias("r")), "l_orderkey", "r", 7, ("topic-0", "topic-1", "topic-2", "topic-3"))


@query("SELECT event_id, 'said ' || event_id AS text, CASE WHEN event_id % 2 = 0 THEN 'summary' END AS stage, event_id % 5 = 0 AS has_report FROM events WHERE event_id % 7 > 0 UNION ALL SELECT event_id, 'plain ' || event_id, NULL, false FROM events WHERE event_id % 7 = 0")
def parsed_messages(t: Tables) -> DataFrame:
    """Messages' JSON; what is none is its own text, unknown stages are null."""
    report = F.when(F.col("event_id") % 5 == 0, ', "report": {"summary": "s"}').otherwise("")
    made = F.concat(F.lit('{"text": "said '), "event_id", F.lit('", "next_stage": "'), F.when(F.col("event_id") % 2 == 0, "summary").otherwise("unheard of"), F.lit('"'), report, F.lit("}"))
    content = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("plain "), "event_id")).otherwise(made)
    return t.events.select("event_id", P.message(content, ("summary",)).alias("m")).select("event_id", "m.text", "m.stage", "m.has_report")


@query("SELECT event_id, 0 AS opinion_index, 'a' AS title, NULL AS content, CAST(least(100, event_id) AS INT) AS richness FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, 1, NULL, 'c', NULL FROM events WHERE event_id % 3 > 0")
def extracted_opinions(t: Tables) -> DataFrame:
    """Opinions of the reports in messages, by index; what they lack is null, richness is clamped; other messages have none."""
    made = F.concat(F.lit('{"text": "t", "report": {"summary": "s", "opinions": [{"title": "a", "richness": '), "event_id", F.lit('}, {"content": "c"}]}}'))
    content = F.when(F.col("event_id") % 3 > 0, made).otherwise('{"text": "t", "report": {"opinions": 1}}')
    reports = t.events.select("event_id", P.report(content)["opinions"].alias("o"))
    return P.opinion_rows(reports, "event_id", "o")


@query("SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN 'a ' || turn ELSE text END AS text FROM conversations WHERE NOT (role = 'assistant' AND turn % 4 = 3)")
def spoken_transcript(t: Tables) -> DataFrame:
    """Turns as they were said, without those that only hand over a report."""
    report = F.when(F.col("turn") % 4 == 3, ', "report": "r"').otherwise("")
    made = F.concat(F.lit('{"text": "a '), "turn", F.lit('"'), report, F.lit("}"))
    rows = t.conversations.withColumn("text", F.when(F.col("role") == "assistant", made).otherwise(F.col("text")))
    return P.spoken_turns(rows, "conv_id", "turn", "role", "text")


@query("SELECT n_nationkey, 'Nation' || n_nationkey AS member, CASE n_nationkey % 3 WHEN 0 THEN '総務委員会' WHEN 1 THEN '文教委員会' END AS committee FROM nation")
def parsed_notes(t: Tables) -> DataFrame:
    """Who asked and which committee a note names."""
    where = F.when(F.col("n_nationkey") % 3 == 0, "付託委員会: 総務委員会").when(F.col("n_nationkey") % 3 == 1, "付託（文教委員会）").otherwise("なし")
    note = F.concat(F.lit("本会議でNation "), "n_nationkey", F.lit("議員が一般質問。"), where)
    return t.nation.select("n_nationkey", P.questioner(note).alias("member"), P.committee(note).alias("committee"))


@query("SELECT p_partkey, array_to_string(list_filter([p_name, '', 'x', p_type], lambda x: x <> '')[1:2], '|') AS points, length(p_name)::BIGINT AS n FROM part")
def summary_points(t: Tables) -> DataFrame:
    """The first points that aren't blank."""
    return t.part.select("p_partkey", F.array_join(X.summary_points(F.array("p_name", F.lit("  "), F.lit(" x"), "p_type"), 2), "|").alias("points"), F.length(X.inline(F.concat("p_name", F.lit(" \n")))).cast("long").alias("n"))


@query("SELECT s_suppkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT s_suppkey, sha1('supplier:' || s_suppkey || ':é') AS h FROM supplier)")
def seeded_ids(t: Tables) -> DataFrame:
    """Ids that are made from names, the same at every run."""
    return t.supplier.select("s_suppkey", X.name_uuid(F.concat(F.lit("supplier:"), "s_suppkey", F.lit(":é"))).alias("id"))
