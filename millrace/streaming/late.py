"""Rows behind the watermark, written aside instead of being dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from millrace.sinks.tables import folder_or_none, write_batch


def passed(spark: SparkSession, path: str, before: int):
    """The newest event time that batches below `before` have brought, or None."""
    marks = folder_or_none(spark, f"{path}_marks", f"{path}_marks")
    return marks.filter(F.col("batch") < before).agg(F.max("newest")).first()[0] if marks is not None else None


def late_sink(path: str, time: str = "ts", delay: str = "3 seconds") -> Callable[[DataFrame, int], None]:
    """Micro-batch writer to ``path/late=…/batch=…``: a row is late if it lies more than `delay` behind the
    newest time of the batches before its own, which is when stateful operators drop it.

    Counts and the batch's newest time are observed on the way and stored in ``<path>_marks``, so a
    restart and a repeated batch judge alike. A row without a time is never late.
    """

    def each(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        newest = passed(spark, path, batch_id)
        late = F.lit(False) if newest is None else F.coalesce(
            F.col(time) < F.lit(newest) - F.expr(f"interval {delay}"), F.lit(False))
        seen = Observation()
        rows = df.withColumn("late", late).observe(
            seen, F.count("*").alias("rows"), F.count_if("late").alias("late_rows"), F.max(time).alias("newest"))
        write_batch(rows, path, batch_id, ["late"])
        got = seen.get
        spark.createDataFrame([(got["rows"], got["late_rows"], got["newest"])],
                              f"rows bigint, late_rows bigint, newest {dict(df.dtypes)[time]}").write.mode(
            "overwrite").parquet(f"{path}_marks/batch={batch_id}")

    return each
