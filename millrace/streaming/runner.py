"""Starting and watching streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start(df: DataFrame, *, name: str, checkpoint: str, fmt: str = "parquet",
          path: str | None = None, each: Callable[[DataFrame, int], None] | None = None,
          partition_by: list[str] | None = None, every: str | None = None,
          once: bool = False, **options: str) -> StreamingQuery:
    """Start an append query under a fixed name and checkpoint folder.

    Give `path` for a file sink (exactly once), or `each` for a function per micro-batch, which
    must be idempotent by batch id. ``once`` processes what is there and stops; a later start
    with the same checkpoint goes on from where it ended. The checkpoint has to lie on storage
    every executor can reach, so that a restart after any loss finds offsets and state.
    """
    writer = df.writeStream.queryName(name).outputMode("append").option(
        "checkpointLocation", checkpoint).options(**options)
    if once:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    if each:
        return writer.foreachBatch(each).start()
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.format(fmt)
    return writer.start(path) if path else writer.start()


def finish(query: StreamingQuery) -> list[dict]:
    """Wait for an ``once`` query and return the progress of its state operators."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return progress_report(query)


def progress_report(query: StreamingQuery) -> list[dict]:
    """Per micro-batch: input rows, state rows and rows dropped for being late."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"],
             "watermark": (p.get("eventTime") or {}).get("watermark"),
             "state_rows": sum(s["numRowsTotal"] for s in p["stateOperators"]),
             "late_rows": sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])}
            for p in query.recentProgress]
