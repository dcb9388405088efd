"""Topics of documents through opaque calls, which rules stand in for here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.operators import opaque as O

from .registry import Tables, query


def _ruled() -> O.Calls:
    """Calls that answer by rules: a document's topic is its language; a batch with a number that 97 divides isn't assigned."""

    def drafts(rows: list[dict]) -> list[dict]:
        return [{"title": t, "description": f"in {t}"} for t in sorted({r["title"] for r in rows})]

    def judge(found: list[dict], existing: list[dict]) -> list[int]:
        has = {t["title"] for t in existing}
        return [n for n, d in enumerate(found, 1) if d["title"] not in has]

    def assign(rows: list[dict], topics: list[dict]) -> str:
        if any(r["opinion"] % 97 == 0 for r in rows):
            raise ValueError("no answer")
        by = {t["title"]: t["topic"] for t in topics}
        return "\n".join(f"{n}\t{by[r['title']]}" for n, r in enumerate(rows, 1))

    return O.Calls(drafts, drafts, judge, assign)


@query("""
WITH d AS (SELECT source AS subject, doc_id AS opinion, coalesce(lang, '') AS title, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 20 AS batch FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL),
n AS (SELECT *, 'new-' || row_number() OVER (PARTITION BY subject ORDER BY title) AS topic FROM (SELECT DISTINCT subject, title FROM d WHERE NOT (title = 'en' AND length(subject) % 2 = 0)))
SELECT subject, opinion, CASE WHEN count_if(opinion % 97 = 0) OVER (PARTITION BY subject, batch) = 0 THEN coalesce(n.topic, 'old') END AS topic, n.topic IS NOT NULL AS is_new FROM d LEFT JOIN n USING (subject, title)""")
def analysed_topics(t: Tables) -> DataFrame:
    """Each document's topic under its source, by batches of 40, a merge, a judgement and batches of 20; sources of an even length have one topic from before."""
    rows = t.documents.select(F.col("source").alias("subject"), F.col("doc_id").alias("opinion"), F.coalesce("lang", F.lit("")).alias("title"), F.col("text").alias("content"))
    existing = rows.where(F.length("subject") % 2 == 0).select("subject").distinct().select("subject", F.lit("old").alias("topic"), F.lit("en").alias("title"), F.lit("").alias("description"))
    topics, assigned, _ = O.topic_analysis(rows, existing, _ruled(), delay=0.0)
    # What an opinion would have is known by its title here; only its batch can have taken that away.
    titled = topics.select("subject", "title", F.col("is_new"))
    return assigned.join(rows.select("subject", "opinion", "title"), ["subject", "opinion"]).join(titled, ["subject", "title"]).select("subject", "opinion", "topic", "is_new")
