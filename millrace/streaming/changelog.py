"""A continuously updated table as a change log: what every change replaces, and by what."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from millrace.sinks.keyed import KeyedTable
from millrace.sinks.tables import write_batch


def retractions(changes: DataFrame, table: KeyedTable, batch_id: int, columns: list[str]) -> DataFrame:
    """(kind, key, *columns, order) of a micro-batch of typed changes, and the table brought up to date.

    ``+I`` adds a row, ``-U`` and ``+U`` are the row before and after an update, ``-D`` takes a row
    away; applying them in order gives the current table. A key's change is compared with the one
    before it in the batch, the first with the stored row. A deletion of a row that is not there says
    nothing. `changes` holds the table's columns; ``type`` tells deletions.
    """
    key, order = table.key, table.order
    table.compact(batch_id)
    keys = changes.select(key).distinct()
    stored = table.rows(batch_id, keys).select(
        F.col(key).alias("_key"), F.when(F.col("type") != "delete", F.struct(*columns)).alias("_stored"))
    table.append(changes, batch_id)
    alive = F.when(F.col("type") != "delete", F.struct(*columns))
    line = Window.partitionBy(key).orderBy(order)
    rows = (changes.withColumns({"_after": alive, "_at": F.row_number().over(line)})
            .withColumn("_lag", F.lag("_after").over(line))
            .join(stored, F.col(key) == F.col("_key"), "left")
            .withColumn("_before", F.when(F.col("_at") == 1, F.col("_stored")).otherwise(F.col("_lag"))))
    plus, minus = F.col("_after"), F.col("_before")

    def entry(kind: str, row) -> F.Column:
        return F.struct(F.lit(kind).alias("kind"), row.alias("row"))

    entries = (F.when(minus.isNull() & plus.isNotNull(), F.array(entry("+I", plus)))
               .when(minus.isNotNull() & plus.isNotNull(), F.array(entry("-U", minus), entry("+U", plus)))
               .when(minus.isNotNull(), F.array(entry("-D", minus))))
    return rows.select(key, order, F.inline(entries)).select("kind", key, *(f"row.{c}" for c in columns), order)


def changelog_sink(path: str, table: KeyedTable, columns: list[str]) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer of a table's change log below `path`; a repeated batch writes the same."""

    def each(changes: DataFrame, batch_id: int) -> None:
        held = changes.persist()
        write_batch(retractions(held, table, batch_id, columns), path, batch_id)
        held.unpersist()

    return each
