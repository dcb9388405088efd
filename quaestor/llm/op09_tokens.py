"""Token counts by an exact histogram of encoded lengths.

Documents are counted by their encoded length; sums over all longer lengths then
answer, for any context limit, how many documents fit, how many tokens there are
and how many remain when longer documents are truncated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, running, small_batches, without

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits texts for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def counted(docs: DataFrame, text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with ``n_tokens``, the whole text's encoded length, in place of the text.

    ``ranks`` is a vocabulary file on the driver; its bytes travel to the workers.
    Empty and null texts have 0 tokens. A column n_tokens is replaced, one named _text goes.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(Path(ranks).read_bytes())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(x.as_py() or "")) for x in batch.column("_text")]
            yield batch.drop_columns(["_text"]).append_column("n_tokens", pa.array(sizes, pa.int64()))

    rows = without(docs, "n_tokens", "_text")
    rest = [c for c in rows.columns if c != text]
    named = rows.select(*rest, F.col(text).cast("string").alias("_text"))
    schema = rows.select(*rest).withColumn("n_tokens", F.lit(0).cast("long")).schema
    return named.mapInArrow(encoded, schema)


def histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """(n_tokens, docs): documents of each length; lengths that are null aren't counted."""
    return lengths.where(F.col(length).isNotNull()).groupBy(F.col(length).alias("n_tokens")).agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """``hist`` with, for each length as a context limit, what that limit gives.

    docs_over and tokens_over: longer documents and their tokens. docs_within and
    quantile: documents of this length or less, and their share. tokens_within:
    their tokens. truncated_tokens: all tokens, each document cut at the limit. An
    empty histogram gives an empty result.
    """
    held = cut(hist)
    total = held.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("d"), F.coalesce(F.sum(F.col("docs") * F.col("n_tokens")), F.lit(0)).alias("t")).first()
    docs, tokens = total["d"], total["t"]
    over = running(held, [F.col("n_tokens").desc()], docs_over=F.col("docs"), tokens_over=F.col("docs") * F.col("n_tokens"))
    within = F.lit(docs) - F.col("docs_over")
    return over.select("n_tokens", "docs", "docs_over", "tokens_over", within.alias("docs_within"), (within / F.lit(float(max(docs, 1)))).alias("quantile"), (F.lit(tokens) - F.col("tokens_over")).alias("tokens_within"), (F.lit(tokens) - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_tokens"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_within, truncated_tokens) for any limits, from the table of suffix sums.

    The largest length within a limit answers for it; a limit below all lengths keeps
    its own number of tokens of every document.
    """
    asked = F.explode(F.array(*[F.lit(int(x)) for x in limits]))
    known = sums.select("*", asked.alias("context_limit"))
    fits = F.col("n_tokens") <= F.col("context_limit")
    best = known.groupBy("context_limit").agg(F.max_by(F.when(fits, F.struct("docs_within", "tokens_within", "docs_over")), F.when(fits, F.col("n_tokens"))).alias("b"), F.sum("docs").alias("n"))
    over = F.coalesce("b.docs_over", F.col("n"))
    return best.select("context_limit", F.coalesce("b.docs_within", F.lit(0)).cast("long").alias("docs_within"), (F.coalesce("b.tokens_within", F.lit(0)) + over * F.col("context_limit")).cast("long").alias("truncated_tokens"))


def at_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): for each share, the least length that so many documents don't exceed."""
    known = sums.select("n_tokens", "quantile", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return known.where("quantile >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    return suffix_sums(histogram(counted(docs)))
