"""Ranked lexical search: the best documents for each item of a table of queries.

Threshold-seeded join. Each document's matches with the items' terms are stored once.
For each term the k highest impacts and their documents are stored; a term's kth
impact is a lower bound of the kth score of every item that holds it, and exact
scores of the stored documents raise that bound. An item's terms are then taken by
their highest impacts: as long as the sum of the smallest ones stays below the bound,
no document can reach it by these alone, so they generate no candidates. Documents
with one of the other terms are candidates; those that could still reach the bound
are scored exactly over all terms.

Items are handled in blocks of at most BLOCK terms, so what is broadcast (terms,
their weights, thresholds) has that size whatever the tables have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, running, small_batches

TOP = 10
#: Terms of items (each once an item) that are handled at once.
BLOCK = 1 << 18
#: Pairs of a document and an item for which sums are held at once.
CELLS = 1 << 21
#: A-Z lowered, other ASCII characters that are neither digit nor letter blank; bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z lowered."""
    return (text or b"").translate(_TABLE).split()


def _bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, found, times = [], [], []
        for i, text in enumerate(_bytes(batch, "text")):
            for term, n in sorted(Counter(terms(text)).items()):
                at.append(i)
                found.append(term.decode())
                times.append(n)
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("iid").take(rows), pa.array(found, pa.string()), pa.array(times, pa.int64())], names=["iid", "term", "times"])


def indexed(docs: DataFrame, known) -> DataFrame:
    """(rid, doc_id, n, tids, tfs): each document with a term, its number of terms, and its matches with the broadcast terms ``known``."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, wanted = known.value, set(known.value)
        for batch in batches:
            keep, n, ends, tids, tfs = [], [], [0], [], []
            for i, text in enumerate(_bytes(batch, "text")):
                words = terms(text)
                if not words:
                    continue
                counts = Counter(words)
                for term in wanted.intersection(counts):
                    tids.append(number[term])
                    tfs.append(counts[term])
                keep.append(i)
                n.append(len(words))
                ends.append(len(tids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (tids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "tids", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(index, f"doc_id {kind}, n long, tids array<int>, tfs array<int>").withColumn("rid", F.monotonically_increasing_id())


def _postings(index: DataFrame, weights: DataFrame, total: int, length: int, *keys: str) -> DataFrame:
    """(keys, tid, impact) of each match."""
    each = index.select(*keys, "n", F.explode(F.arrays_zip("tids", "tfs")).alias("p")).select(*keys, "n", F.col("p.tids").alias("tid"), F.col("p.tfs").cast("long").alias("tf"))
    m = f"(25 + (75L * n * {total}L) div {length}L)"
    return each.join(F.broadcast(weights), "tid").select(*keys, "tid", F.expr(f"w * ((1000000000L * tf) div (1000L * tf + 8L * {m}))").alias("impact"))


def _best(df: DataFrame, group: str, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each group, cut to as many in each task before the shuffle; ``rank`` numbers them."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


class _Block:
    """A block's items and terms as arrays: each term's items in two lists, by whether the term generates candidates for them."""

    def __init__(self, item: np.ndarray, tid: np.ndarray, times: np.ndarray, weight: np.ndarray, highest: np.ndarray, bound: np.ndarray):
        most = times * highest[tid]
        order = np.lexsort((tid, most, item))
        item, tid, times, most = item[order], tid[order], times[order], most[order]
        first = np.searchsorted(item, np.arange(len(bound)))
        before = np.cumsum(most)
        so_far = before - np.concatenate([[0], before])[first][item]
        seeds = so_far >= bound[item]
        self.bound, self.weight, self.n_items = bound, weight, len(bound)
        self.rest = np.zeros(len(bound), np.int64)
        np.add.at(self.rest, item[~seeds], most[~seeds])
        self.lists = []
        for some in (seeds, ~seeds):
            order = np.argsort(tid[some], kind="stable")
            self.lists.append((np.searchsorted(tid[some][order], np.arange(len(weight) + 1)), item[some][order], times[some][order]))

    def add(self, sums: np.ndarray, which: int, row: np.ndarray, tid: np.ndarray, impact: np.ndarray) -> None:
        """Adds the matches' impacts to the cells (row, item) of ``sums``."""
        start, items, times = self.lists[which]
        n = start[tid + 1] - start[tid]
        each = np.repeat(np.arange(len(tid)), n)
        at = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + start[tid][each]
        np.add.at(sums, (row[each], items[at]), impact[each] * times[at])


def candidates(index: DataFrame, block, total: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): exact scores of all documents that reach their item's bound, less those that a task's batch already outranks."""

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: _Block = block.value
        for batch in batches:
            step = max(1, CELLS // max(1, b.n_items))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                tids = part.column("tids")
                row = np.repeat(np.arange(part.num_rows), tids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                tid = tids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = part.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                m = 25 + 75 * part.column("n").to_numpy() * total // length
                impact = b.weight[tid] * (1000000000 * tf // (1000 * tf + 8 * m[row]))
                sums = np.zeros((part.num_rows, b.n_items), np.int64)
                b.add(sums, 0, row, tid, impact)
                could = (sums > 0) & (sums + b.rest >= b.bound)
                some = could.any(1)[row]
                b.add(sums, 1, row[some], tid[some], impact[some])
                r, item = np.nonzero(could & (sums >= b.bound))
                score = sums[r, item]
                doc = part.column("doc_id").take(pa.array(r))
                # Nulls, which rank last among equals, have a number of their own in the order alone.
                last = doc.is_null().to_numpy(zero_copy_only=False)
                order = np.lexsort((doc.fill_null(0).to_numpy(zero_copy_only=False), last, -score, item))
                item = item[order]
                place = np.arange(len(item)) - np.searchsorted(item, item)
                order = order[place < k]
                yield pa.RecordBatch.from_arrays([pa.array(item[place < k], pa.int32()), doc.take(pa.array(order)), pa.array(score[order], pa.int64())], names=["item", "doc_id", "score"])

    return index.select("doc_id", "n", "tids", "tfs").mapInArrow(generate, "item int, doc_id long, score long")


def _ranked_block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame | None:
    """(iid, rank, doc_id, score) of a block's items, given as (iid, term, times)."""
    spark = docs.sparkSession
    got = asked.toArrow()
    iids, item = np.unique(got.column("iid").to_numpy(), return_inverse=True)
    names = sorted(set(got.column("term").to_pylist()))
    number = {t: i for i, t in enumerate(names)}
    tid = np.array([number[t] for t in got.column("term").to_pylist()], np.int64)
    times = got.column("times").to_numpy()
    index = cut(indexed(docs, spark.sparkContext.broadcast({t.encode(): i for t, i in number.items()})))
    sizes = index.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    total, length = sizes["docs"], sizes["length"]
    if not total:
        return None
    df = np.zeros(len(names), np.int64)
    for r in index.select(F.explode("tids").alias("tid")).groupBy("tid").count().collect():  # a row a term of the block
        df[r["tid"]] = r["count"]
    weight = np.array([floor(1000 * log((2 * total + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    weights = spark.createDataFrame(pa.table({"tid": pa.array(np.arange(len(names)), pa.int32()), "w": pa.array(weight)}))
    items = spark.createDataFrame(pa.table({"tid": pa.array(tid, pa.int32()), "item": pa.array(item, pa.int32()), "times": pa.array(times, pa.int64())}))
    top = cut(_best(_postings(index, weights, total, length, "rid"), "tid", k, F.desc("impact"), "rid"))
    highest, kth = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for r in top.groupBy("tid").agg(F.max("impact").alias("most"), F.min("impact").alias("least"), F.count("*").alias("n")).collect():  # a row a term of the block
        highest[r["tid"]], kth[r["tid"]] = r["most"], r["least"] if r["n"] == k else 0
    bound = np.ones(len(iids), np.int64)
    np.maximum.at(bound, item, times * kth[tid])
    # The stored documents of an item's terms, scored exactly.
    pairs = top.join(F.broadcast(items), "tid").select("item", "rid").distinct()
    of_pairs = _postings(index.join(pairs, "rid"), weights, total, length, "rid", "item")
    seeded = of_pairs.join(F.broadcast(items), ["item", "tid"]).groupBy("item", "rid").agg(F.sum(F.col("impact") * F.col("times")).alias("score"))
    for r in _best(seeded, "item", k, F.desc("score"), "rid").where(F.col("rank") == k).collect():  # a row an item of the block
        bound[r["item"]] = max(bound[r["item"]], r["score"])
    block = spark.sparkContext.broadcast(_Block(item, tid, times, weight, highest, bound))
    found = candidates(index, block, total, length, k)
    ranked = _best(found, "item", k, F.desc("score"), F.col("doc_id").asc_nulls_last())
    names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(iids)), pa.int32()), "iid": pa.array(iids)}))
    return ranked.join(F.broadcast(names), "item").select("iid", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = TOP, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each row of ``items``.

    Null and empty texts have no terms: such items have no rows, such documents count
    nowhere. Repeated rows of items are answered each; repeated rows of documents are
    ranked each, side by side; among equal scores a null doc_id comes last. Empty
    tables give an empty result. Document keys are longs; items' keys are of any type.
    Other columns aren't looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    numbered = cut(items.select(F.col(item_key).alias("item_id"), F.col(item_text).cast("string").alias("text")).withColumn("iid", F.monotonically_increasing_id()))
    asked = cut(numbered.select("iid", "text").mapInArrow(_item_terms, "iid long, term string, times long"))
    sized = running(asked.groupBy("iid").agg(F.count("*").alias("n")), [F.col("iid")], before=F.col("n"))
    blocks = cut(sized.select("iid", F.floor(F.col("before") / block).alias("block")))
    rows = docs.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    out = None
    for r in blocks.select("block").distinct().orderBy("block").toLocalIterator():
        of_block = asked.join(blocks.where(F.col("block") == r["block"]).select("iid"), "iid")
        found = _ranked_block(rows, of_block, k)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        return numbered.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return out.join(numbered.select("iid", "item_id"), "iid").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same without bounds: every document with a term is scored.
SQL = r"""
WITH i AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT iid, term, count(*) AS times FROM (SELECT iid, unnest(t) AS term FROM i) GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
m AS (SELECT rid, doc_id, 25 + (75 * len(t) * n_docs) // n_terms AS m FROM d, s WHERE len(t) > 0),
r AS (SELECT iid, rid, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL),
b AS (SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM r JOIN m USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM b JOIN i USING (iid) WHERE rank <= 10
"""
