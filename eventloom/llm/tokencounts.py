"""Token counts: an exact histogram of encoded lengths, and all that suffix sums over it answer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm.common import materialize, read

VOCABULARY = "byte_bpe_50k.tiktoken"
_BLOCK = 1024
_encodings: dict = {}


def encoding(path: str):
    """One encoding for each worker process."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _encodings[path] = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(enc.encode_ordinary(t.as_py() or "")) for t in b.column(0)], pa.int64())], ["length"])

    return run


def encoded_lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(length) of each whole text; a null text has length 0."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return docs.select(F.col("text").cast("string")).mapInArrow(_lengths(path), "length long")


def length_table(lengths: DataFrame) -> DataFrame:
    """One row for each distinct length, ascending: n_docs and n_tokens of that length; docs_upto and tokens_upto of this length or
    less; docs_over of more; total_docs, total_tokens; truncated_tokens, the tokens left where each document is cut to this length.

    The histogram is aggregated on the map side. Running sums are taken in blocks of lengths, and over the blocks' totals, so no
    task sorts all lengths. Empty input: empty table.
    """
    hist = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")).withColumn("block", F.floor(F.col("length") / _BLOCK))
    hist = materialize(hist, "lengths")
    totals = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum(F.col("n_docs") * F.col("length")).alias("bt"))
    over = W.orderBy("block")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    whole = over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0).cast("long")
    offsets = totals.select("block", *(F.coalesce(F.sum(c).over(before), zero).alias(f"{c}_before") for c in ("bd", "bt")), F.sum("bd").over(whole).alias("total_docs"), F.sum("bt").over(whole).alias("total_tokens"))
    within = W.partitionBy("block").orderBy("length").rowsBetween(W.unboundedPreceding, 0)
    out = hist.join(offsets, "block").withColumn("n_tokens", F.col("n_docs") * F.col("length"))
    out = out.withColumn("docs_upto", F.col("bd_before") + F.sum("n_docs").over(within)).withColumn("tokens_upto", F.col("bt_before") + F.sum("n_tokens").over(within))
    out = out.withColumn("docs_over", F.col("total_docs") - F.col("docs_upto")).withColumn("truncated_tokens", F.col("tokens_upto") + F.col("docs_over") * F.col("length"))
    return out.select("length", "n_docs", "n_tokens", "docs_upto", "tokens_upto", "docs_over", "truncated_tokens", "total_docs", "total_tokens")


def truncated_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, n_cut, truncated_tokens) for any limits, from the table alone: each limit asks the longest length not above it."""
    at = table.sparkSession.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit long")
    pick = table.join(F.broadcast(at), F.col("length") <= F.col("context_limit"), "right").groupBy("context_limit").agg(F.max_by(F.struct("docs_over", "tokens_upto"), "length").alias("r"))
    every = table.agg(F.max("total_docs").alias("docs")).first()["docs"] or 0
    over = F.coalesce("r.docs_over", F.lit(every))
    return pick.select("context_limit", over.alias("n_cut"), (F.coalesce("r.tokens_upto", F.lit(0)) + over * F.col("context_limit")).alias("truncated_tokens"))


def quantiles(table: DataFrame, shares: list[float]) -> list[int | None]:
    """The least length that at least each share of documents does not exceed."""
    row = table.agg(*(F.min(F.when(F.col("docs_upto") >= F.ceil(F.col("total_docs") * q), F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares))).first()
    return list(row)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(encoded_lengths(read(spark, sf_dir, "documents")))
