"""A table's rows first, then its changes: hand-over from a snapshot to the log at one position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sinks.tables import folder_or_none, write_batch
from millrace.streaming.runner import start

Snapshot = Callable[[], tuple[DataFrame, int]]


def stored_position(spark: SparkSession, base: str, take: Snapshot, seq: str = "seq") -> int:
    """The log position that the stored snapshot stands for.

    `take` gives the rows and the position up to which they hold the log's changes. It is called only
    until its rows are stored; the position is written after them, so a run that was cut short takes
    the snapshot anew, and no run after that does.
    """
    mark = folder_or_none(spark, f"{base}/handover", f"{base}/handover")
    known = mark.first() if mark is not None else None
    if known is not None:
        return known["position"]
    rows, position = take()
    read = rows.withColumns({"type": F.lit("read"), seq: F.lit(position).cast("bigint")})
    write_batch(read, f"{base}/changes", -1)
    spark.range(1).select(F.lit(position).cast("bigint").alias("position")).write.mode("overwrite").parquet(
        f"{base}/handover")
    return position


def snapshot_then_log(log: DataFrame, take: Snapshot, base: str, seq: str = "seq", *, name: str = "capture",
                      **options) -> StreamingQuery:
    """Start the job that keeps ``<base>/changes``: the snapshot as batch -1, then every change after it.

    The log may begin before the snapshot's position; what the snapshot already holds is left out.
    """
    position = stored_position(log.sparkSession, base, take, seq)

    def each(df: DataFrame, batch_id: int) -> None:
        write_batch(df.filter(F.col(seq) > position), f"{base}/changes", batch_id)

    return start(log, name=name, checkpoint=f"{base}/checkpoints/{name}", each=each, **options)
