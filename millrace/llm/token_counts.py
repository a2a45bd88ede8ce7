"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from millrace.session import scratch_dir

# Fixed value: how the byte-level vocabularies cut text into pieces before merging (public pattern).
PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_VOCABULARY_BYTES = 16 << 20
BLOCK = 1024

_ENCODERS: dict[int, object] = {}


def vocabulary(path: str) -> bytes:
    """A public vocabulary file of ranks, checked against a size bound as every worker gets it."""
    data = Path(path).read_bytes()
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes")
    return data


def encoder(data: bytes):
    import tiktoken

    key = hash(data)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks,
                                           special_tokens={})
    return _ENCODERS[key]


def encoded_lengths(docs: DataFrame, path: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many of a task's documents have each encoded length.

    A null or empty text has length 0. Every row counts, repeated ones too. Only lengths leave the
    task, already counted, so the shuffle holds distinct lengths and not documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode_ordinary
        seen: dict[int, int] = {}
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                n = len(encode(text)) if text else 0
                seen[n] = seen.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())],
            ["n_tokens", "n_docs"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(
        count, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, path: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """One row per distinct encoded length, with what any context limit needs.

    ``n_docs``, ``tokens``: documents of exactly ``n_tokens`` and their tokens. ``docs_ge``,
    ``tokens_ge``: the same for all documents of at least that length (suffix sums).
    ``docs_le`` answers quantiles: the q-quantile is the least length whose ``docs_le`` reaches
    q times all documents. ``truncated_tokens``: tokens left when every document is cut to
    ``n_tokens``. No documents, no rows.

    Sums run within blocks of lengths and then over block totals, so no task holds all lengths. Texts
    are encoded once; the counts, a row per length, are written for both uses.
    """
    folder = scratch_dir(docs.sparkSession, "lengths")
    encoded_lengths(docs, path, text_col).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).write.parquet(folder)
    counted = (docs.sparkSession.read.parquet(folder)
               .withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
               .withColumn("block", F.floor(F.col("n_tokens") / BLOCK)))
    totals = counted.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        "block", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for c, w, n in (
            ("d", after, "docs_after"), ("t", after, "tokens_after"),
            ("d", before, "docs_before"), ("t", before, "tokens_before"))))
    down = W.partitionBy("block").orderBy(F.desc("n_tokens"))
    up = W.partitionBy("block").orderBy("n_tokens")
    out = counted.join(totals, "block").select(
        "n_tokens", "n_docs", "tokens",
        (F.sum("n_docs").over(down) + F.col("docs_after")).alias("docs_ge"),
        (F.sum("tokens").over(down) + F.col("tokens_after")).alias("tokens_ge"),
        (F.sum("n_docs").over(up) + F.col("docs_before")).alias("docs_le"),
        (F.sum("tokens").over(up) + F.col("tokens_before")).alias("tokens_le"))
    cut = F.col("tokens_le") + F.col("n_tokens") * (F.col("docs_ge") - F.col("n_docs"))
    return out.withColumn("truncated_tokens", cut)


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left of all documents when each is cut to ``limit`` tokens (0: none)."""
    return histogram.agg(F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")),
                                    F.lit(0)).alias("tokens"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least a share q of the documents do not exceed."""
    total = histogram.agg(F.sum("n_docs").alias("all_docs"))
    return (histogram.filter(F.col("docs_le") >= F.lit(q) * total.scalar())
            .agg(F.min("n_tokens").alias("n_tokens")))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return length_histogram(spark.read.parquet(f"{folder}/documents.parquet"))
