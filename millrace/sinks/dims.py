"""Dimension store: a log of upserts, folded into current rows when read.

Every micro-batch appends its own folder, so a repeated batch replaces itself. Compaction writes
a new snapshot version and never touches a folder somebody may be reading; a version counts
only once its line in the version list has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.changes import upsert_by_key
from millrace.sinks.tables import write_batch


def dim_columns(sink_columns: str | None, sink_pk: str | None) -> tuple[str, list[str]]:
    """(key, columns) of a dimension table as its route declares it; the key is ``id`` if unnamed."""
    pk = sink_pk or "id"
    listed = [c for c in (sink_columns or "").split(",") if c]
    return pk, [pk, *[c for c in listed if c != pk]]


def append_changes(dims: DataFrame, path: str, batch_id: int, seq: str = "seq",
                   on_delete: str = "keep") -> None:
    """Append a micro-batch of routed dimension changes; changes without data are skipped.

    `seq` orders the changes inside a batch, for example a log position. With ``on_delete="drop"``
    a delete removes its row, known by ``data`` or by the row ``before`` it; otherwise the last
    values stay.
    """
    if on_delete not in ("keep", "drop"):
        raise ValueError(on_delete)
    data, deleted = F.col("data"), F.lit(False)
    if on_delete == "drop":
        deleted = F.coalesce(F.col("type") == "delete", F.lit(False))
        if "before" in dims.columns:
            data = F.when(deleted & (F.size("data") <= 0), F.col("before")).otherwise(data)
    rows = dims.withColumns({"data": data, "deleted": deleted}).filter(F.size("data") > 0).select(
        "sink_table", F.coalesce("sink_pk", F.lit("id")).alias("sink_pk"),
        F.lit(batch_id).cast("bigint").alias("batch_no"), F.col(seq).cast("bigint").alias("seq"),
        "data", "deleted")
    write_batch(rows, f"{path}/log", batch_id, ["sink_table"])


def _versions(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(newest snapshot version, last batch folded into it), if any."""
    from pyspark.errors import AnalysisException
    try:
        rows = spark.read.schema("version bigint, upto bigint").parquet(f"{path}/versions")
        newest = rows.orderBy(F.desc("version")).first()
    except AnalysisException:
        return None
    return (newest["version"], newest["upto"]) if newest else None


def _changes(spark: SparkSession, path: str, table: str | None) -> DataFrame:
    log = spark.read.parquet(f"{path}/log")
    rows = log.filter(F.col("sink_table") == table) if table else log
    newest = _versions(spark, path)
    if newest is None:
        return rows.drop("batch")
    version, upto = newest
    snap = spark.read.option("basePath", f"{path}/snapshot/v={version}").parquet(
        f"{path}/snapshot/v={version}")
    snap = snap.filter(F.col("sink_table") == table) if table else snap
    # `batch` names the folders: what the snapshot holds is not opened again
    return rows.filter(F.col("batch") > upto).drop("batch").unionByName(snap)


def _fold(rows: DataFrame) -> DataFrame:
    """Current data per (table, key): the last value of each field wins."""
    keyed = rows.withColumns({
        "_id": F.struct("sink_table", "sink_pk",
                        F.try_element_at("data", F.col("sink_pk")).alias("key")),
        "_seq": F.struct("batch_no", "seq")})
    return upsert_by_key(keyed.filter("_id.key is not null"), "_id", "_seq", deleted="deleted")


def current_dim(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """The dimension as it is now, all columns text."""
    rows = _fold(_changes(spark, path, table))
    return rows.select(*[F.try_element_at("data", F.lit(c)).alias(c) for c in columns])


class DimView:
    """A dimension that a running job keeps at hand and brings up to date from the log.

    Calling it gives the newest rows. Batches of the log that came since the last call, and only
    those, are read and folded into the held rows, which are written below `held` and read back, so
    that the plan stays short and a lost executor loses nothing; without new batches the frame of
    the last call is returned as it is. `columns` may be given types in `cast`.
    """

    def __init__(self, spark: SparkSession, path: str, table: str, columns: list[str], held: str,
                 cast: dict[str, str] | None = None):
        self.spark, self.path, self.table, self.columns, self.held = spark, path, table, columns, held
        self.cast, self.upto, self.frame = cast or {}, -1, None

    def newer(self) -> DataFrame:
        """Rows of the log in batches not yet folded; their folders are chosen by name."""
        return self.spark.read.parquet(f"{self.path}/log").filter(
            (F.col("sink_table") == self.table) & (F.col("batch") > self.upto))

    def _known(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.held}/{self.table}/upto={self.upto}")

    def __call__(self) -> DataFrame:
        newer = self.newer()
        last = newer.agg(F.max("batch")).first()[0]
        if last is None and self.frame is not None:
            return self.frame
        if last is not None:
            rows = newer.filter(F.col("batch") <= last).drop("batch")
            rows = rows if self.upto < 0 else rows.unionByName(self._known())
            _fold(rows).select(
                "_id.sink_table", "_id.sink_pk", F.lit(last).cast("bigint").alias("batch_no"),
                F.lit(-1).cast("bigint").alias("seq"), "data", F.lit(False).alias("deleted")).write.mode(
                "overwrite").parquet(f"{self.held}/{self.table}/upto={last}")
            self.upto = last
        rows = self._known() if self.upto >= 0 else newer
        self.frame = rows.select(*[F.try_element_at("data", F.lit(c)).cast(self.cast.get(c, "string")).alias(c)
                                   for c in self.columns])
        return self.frame


def compact(spark: SparkSession, path: str) -> int:
    """Fold log and snapshot of all tables into a new snapshot; returns its version."""
    rows = _changes(spark, path, None)
    newest = _versions(spark, path)
    version = newest[0] + 1 if newest else 0
    seen = rows.agg(F.max("batch_no")).first()[0]
    upto = max(x for x in (seen, newest[1] if newest else -1) if x is not None)
    folded = _fold(rows.filter(F.col("batch_no") <= upto)).select(
        "_id.sink_table", "_id.sink_pk", F.lit(upto).cast("bigint").alias("batch_no"),
        F.lit(-1).cast("bigint").alias("seq"), "data", F.lit(False).alias("deleted"))
    folded.write.mode("overwrite").partitionBy("sink_table").parquet(f"{path}/snapshot/v={version}")
    spark.createDataFrame([(version, upto)], "version bigint, upto bigint").write.mode(
        "append").parquet(f"{path}/versions")
    return version
