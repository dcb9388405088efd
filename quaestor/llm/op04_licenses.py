"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A template of n shingles is looked for in windows of W shingles, W the power of 2
from 2n on, that start every W/2 shingles: wherever the template stands, a window
holds all of it, and its resemblance to that window is 0.19 at least even if only
0.8 of it is there. One of BANDS bands of one MinHash then agrees with probability
1 - 0.81 ** 32 = 0.999 or more. A band can agree only in a window that has the
very shingle that gives the template its minimum, so signatures are computed for
the windows around those shingles alone. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let
from .licenses import TEMPLATES

SHINGLE = 5
CONTAINED = 0.8
BANDS = 32


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _starts(words: Column) -> Column:
    """Where the shingles start; fewer than SHINGLE words form a single one."""
    return F.when(F.size(words) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0))))


def _hashes(words: Column) -> Column:
    return F.transform(_starts(words), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))


def _minimum(shingles: Column, band: Column) -> Column:
    return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, band)))


def template_table(spark: SparkSession, templates: dict[str, str] | DataFrame) -> DataFrame:
    """license, words, hashes, width (of its windows) and, for each band, minimum and the shingle that gives it."""
    given = templates if isinstance(templates, DataFrame) else spark.createDataFrame(sorted(templates.items()), "license string, text string")
    rows = given.where("license is not null").select("license", tokens(F.col("text")).alias("words"))
    rows = rows.where(F.size("words") > 0).withColumn("hashes", F.array_distinct(_hashes(F.col("words")))).withColumn("width", F.pow(F.lit(2), F.ceil(F.log2(F.size("hashes") * 2))).cast("int"))
    least = F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.struct(j.alias("band"), F.array_min(F.transform("hashes", lambda h: F.struct(F.xxhash64(h, j).alias("minimum"), h.alias("shingle")))).alias("least"))))
    return rows.select("license", "words", "hashes", "width", least.alias("b")).select("license", "words", "hashes", "width", "b.band", "b.least.minimum", "b.least.shingle")


def scanned(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, key: str = "doc_id", text: str = "text", least: float = CONTAINED) -> DataFrame:
    """(doc_id, license, containment, n_windows, first_word): the templates found in whole texts.

    containment is the largest share of a template's distinct shingles in one
    window; first_word is where the first such window begins. Of licenses whose notices
    resemble each other all are reported. Rows that share a key
    are reported together, the windows of each counted, be the rows equal or not; empty and null texts and tables give no rows; other
    columns aren't looked at. Templates are a dict or a table (license, text), each
    license once, of some thousands at most, as they are sent to all tasks. A window
    takes along its own words alone, so the work grows with a text's length, however
    many notices it holds.
    """
    spark = docs.sparkSession
    table = template_table(spark, TEMPLATES if templates is None else templates)
    bands = table.select("license", "width", "band", "minimum", "shingle").collect()
    wanted, minima = (sorted({r[c] for r in bands}) for c in ("shingle", "minimum"))
    widths = sorted({r["width"] for r in bands})
    if not bands:
        return docs.select(F.col(key).alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("n_windows"), F.lit(0).alias("first_word")).limit(0)

    def hit_places(words: Column) -> Column:
        found = lambda h: F.filter(F.transform(h, lambda x, i: F.when(x.isin(wanted), i)), lambda i: i.isNotNull())
        return let(_hashes(words), lambda h: F.struct(words.alias("words"), h.alias("h"), found(h).alias("at"), F.xxhash64(h).alias("text")))

    hits = docs.select(F.col(key).alias("doc_id"), let(tokens(F.col(text)), hit_places).alias("s")).where(F.size("s.at") > 0)

    def begin(w: int, back: int):
        half = w // 2
        # One long for width and start: an array of longs is made distinct by hashing.
        return lambda p: F.greatest(F.floor(p / half) * half - back * half, F.lit(0)).bitwiseOR(F.lit(w << 32))

    def window(w: Column) -> Column:
        width, start = F.shiftright(w, 32).cast("int"), w.bitwiseAND(0x7FFFFFFF).cast("int")
        return F.struct(width.alias("width"), start.alias("start"), F.slice("s.words", start + 1, width + SHINGLE - 1).alias("words"), F.slice("s.h", start + 1, width).alias("h"))

    # Of each width, the two windows that hold a place; a text's first window starts at 0.
    around = [F.transform("s.at", begin(w, back)) for w in widths for back in (0, 1)]
    windows = hits.select("doc_id", "s.text", F.explode(F.transform(F.array_distinct(F.concat(*around)), window)).alias("w")).select("doc_id", "text", "w.*")
    signature = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.struct(j.alias("band"), _minimum(F.col("h"), j).alias("minimum")))
    # Only a minimum that some template has can retrieve it.
    signed = windows.select("doc_id", "text", "width", "start", "words", F.explode(F.filter(signature, lambda b: b["minimum"].isin(minima))).alias("b")).select("doc_id", "text", "width", "start", "words", "b.*")
    retrieved = signed.join(F.broadcast(table.select("license", "width", "band", "minimum")), ["width", "band", "minimum"])
    # A window's candidates, each once, before the exact test.
    shingles = F.broadcast(table.select("license", F.col("words").alias("_t")).distinct())
    spelled = lambda words: F.transform(_starts(words), lambda i: F.array_join(F.slice(words, i + 1, SHINGLE), " "))
    # A repeated row comes once with each band.
    rows = F.count("*") / F.bit_count(F.bit_or(F.expr("shiftleft(1L, band)")))
    tested = retrieved.groupBy("doc_id", "license", "width", "start", "text").agg(F.first("words").alias("words"), rows.cast("long").alias("rows")).join(shingles, "license")
    own = F.array_distinct(spelled(F.col("_t")))
    share = let(own, lambda t: F.size(F.array_intersect(t, spelled(F.col("words")))) / F.size(t))
    good = tested.withColumn("containment", share).where(F.col("containment") >= least)
    return good.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.sum("rows").alias("n_windows"), F.min("start").alias("first_word"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The same by testing every window against every template.
SQL = f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}) v(license, txt)),
tw AS (SELECT license, list_filter(regexp_split_to_array(lower(txt), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') w FROM t),
ts AS (SELECT license, list_distinct(list_transform(range(0, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) s FROM tw),
tn AS (SELECT license, unnest(s) s, len(s) n, CAST(pow(2, ceil(log2(2 * len(s)))) AS INT) width FROM ts),
d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') w FROM documents),
ds AS (SELECT doc_id, rid, unnest(range(0, greatest(len(w) - 4, 1))) i, unnest(list_transform(range(0, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) s FROM d WHERE len(w) > 0),
m AS (SELECT DISTINCT doc_id, rid, license, n, width, s, greatest((i // (width // 2) - k) * (width // 2), 0) AS start FROM ds JOIN tn USING (s), (VALUES (0), (1)) b(k)),
c AS (SELECT doc_id, rid, license, start, count(DISTINCT s) / n AS share FROM m GROUP BY doc_id, rid, license, start, n)
SELECT doc_id, license, max(share) AS containment, count(*) AS n_windows, CAST(min(start) AS INT) AS first_word
FROM c WHERE share >= {CONTAINED} GROUP BY doc_id, license
"""
