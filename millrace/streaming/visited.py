"""Unique visits of a page stream, against the visits already stored.

No state and no watermark: a visit may come days late and still counts. A micro-batch keeps the
earliest opening row of each device and day with the batch operator, so a busy device sends one row
per day and task, and drops those whose device already has a stored visit on that day. A stored visit
stays: an earlier opening row of the same device and day that arrives in a later micro-batch is
dropped, so which row stands for a visit follows arrival, while the number of visits does not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.times import day_key
from millrace.operators import visits
from millrace.sinks import tables


def stored_visits(spark: SparkSession, path: str, days: list[str], before: int, key: str) -> DataFrame | None:
    """(device, day) of visits that batches below `before` stored on the given days."""
    frames = [f for f in (tables.folder_or_none(spark, f"{path}/dt={d}", path) for d in days) if f is not None]
    out = None
    for f in frames:        # one folder per day that the micro-batch holds
        part = f.filter(F.col("batch") < before).select(key, F.col("dt").cast("string").alias("_day"))
        out = part if out is None else out.unionByName(part)
    return out


def unique_visits_sink(path: str, *, key: str = "mid", time: str = "ts",
                       tie: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer of unique visits to ``path/dt=…/batch=…``; a repeated batch writes the same."""

    def each(pages: DataFrame, batch_id: int) -> None:
        spark = pages.sparkSession
        first = visits.unique_visits(pages, key=key, time=time, tie=tie).withColumn(
            "_day", day_key(time)).persist()
        days = [r["_day"] for r in first.select("_day").distinct().collect()]
        known = stored_visits(spark, path, days, batch_id, key)
        new = first if known is None else first.join(known.distinct(), [key, "_day"], "left_anti")
        tables.write_batch(new.withColumnRenamed("_day", "dt"), path, batch_id, ["dt"])
        first.unpersist()

    return each
