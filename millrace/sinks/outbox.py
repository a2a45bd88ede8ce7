"""Rows for many topics, each delivered exactly once.

A micro-batch writes its rows into a folder of this attempt and then one line into the list of
commits. Readers take, of every batch, the rows of its first committed attempt: what an attempt
that was cut short or repeated has left behind is never seen. A batch's rows have positions, so
(topic, batch, position) names a row for good.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.sinks.tables import folder_or_none

ROWS = "batch bigint, attempt string, topic string, position bigint, value string"


def commits(spark: SparkSession, path: str) -> DataFrame | None:
    """(batch, attempt): the attempt of each batch that counts."""
    marks = folder_or_none(spark, f"{path}/commits", f"{path}/commits")
    return None if marks is None else marks.groupBy("batch").agg(F.min_by("attempt", F.struct("at", "attempt")).alias("attempt"))


def write_attempt(rows: DataFrame, path: str, batch_id: int) -> str:
    """Write (topic, value) rows without committing them; returns the attempt's name."""
    attempt = uuid.uuid4().hex
    rows.select("topic", F.monotonically_increasing_id().alias("position"), "value").write.partitionBy(
        "topic").parquet(f"{path}/rows/batch={batch_id}/attempt={attempt}")
    return attempt


def commit(spark: SparkSession, path: str, batch_id: int, attempt: str) -> None:
    spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch"), F.lit(attempt).alias("attempt"),
                          F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def outbox_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer of (topic, value) rows; a batch that is already committed is not written again."""

    def each(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        done = commits(spark, path)
        if done is None or done.filter(F.col("batch") == batch_id).isEmpty():
            commit(spark, path, batch_id, write_attempt(rows, path, batch_id))

    return each


def read_outbox(spark: SparkSession, path: str, *topics: str, after: int = -1) -> DataFrame:
    """(topic, batch, position, value) of committed rows in batches after `after`; all topics by default."""
    done = commits(spark, path)
    if done is None:
        return spark.createDataFrame([], ROWS).select("topic", "batch", "position", "value")
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows").filter(F.col("batch") > after)
    rows = rows.filter(F.col("topic").isin(*topics)) if topics else rows
    return rows.join(done.filter(F.col("batch") > after), ["batch", "attempt"], "left_semi").select(
        "topic", "batch", "position", "value")
