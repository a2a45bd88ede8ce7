"""One row per key on shared storage, brought up to date by micro-batches.

A micro-batch appends a folder of its own, dealt by a hash of the key, so a repeated batch replaces
itself and a lookup opens only the buckets it needs. Compaction folds log and snapshot into a new
snapshot; it counts only once its line in the version list has been written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from millrace.sinks.tables import folder_or_none


@dataclass(frozen=True)
class KeyedTable:
    """`columns` (DDL) of the stored rows. Of two rows with one `key` the one with the greatest `order`
    counts, or with ``newest=False`` the one with the least."""
    spark: SparkSession
    path: str
    columns: str
    key: str
    order: str
    newest: bool = True
    buckets: int = 32
    compact_every: int = 20

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _names(self) -> list[str]:
        return StructType.fromDDL(self.columns).names

    def fold(self, rows: DataFrame) -> DataFrame:
        """The row of each key that counts; combined before the shuffle."""
        pick = F.max_by if self.newest else F.min_by
        rest = [c for c in self._names() if c != self.key]
        return rows.groupBy(self.key).agg(pick(F.struct(*rest), self.order).alias("_r")).select(
            *(F.col(c) if c == self.key else F.col(f"_r.{c}") for c in self._names()))

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Add a micro-batch's rows."""
        (self.fold(rows.select(*self._names())).select("*", self._bucket()).hint("rebalance", "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/log/batch={batch_id}"))

    def _snapshot(self, before: int) -> int:
        """The last batch folded into the newest snapshot that batch `before` may use; -1 if none."""
        versions = folder_or_none(self.spark, f"{self.path}/versions", f"{self.path}/versions")
        newest = versions.filter(F.col("upto") < before).agg(F.max("upto")).first()[0] if versions is not None else None
        return -1 if newest is None else newest

    def _parts(self, before: int) -> DataFrame:
        upto, shape = self._snapshot(before), f"{self.columns}, bucket int, batch bigint"
        names = [*self._names(), "bucket"]
        out = self.spark.createDataFrame([], shape).select(*names)
        if upto >= 0:
            out = out.unionByName(self.spark.read.schema(f"{self.columns}, bucket int").parquet(
                f"{self.path}/snapshot/upto={upto}").select(*names))
        try:
            log = self.spark.read.schema(shape).parquet(f"{self.path}/log")
        except Exception as e:  # nothing was ever appended
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return out
        return out.unionByName(log.filter((F.col("batch") > upto) & (F.col("batch") < before)).select(*names))

    def rows(self, before: int, like: DataFrame | None = None) -> DataFrame:
        """The rows as batch `before` finds them. With `like`, only buckets that hold one of its keys
        are opened; all rows of those come back."""
        parts = self._parts(before)
        if like is not None:
            wanted = [r[0] for r in like.select(self._bucket()).distinct().collect()]    # `buckets` at most
            parts = parts.filter(F.col("bucket").isin(wanted))
        return self.fold(parts)

    def compact(self, before: int) -> None:
        """Fold what batch `before` finds into a snapshot, if enough batches have come since the last."""
        upto = before - 1
        if upto - self._snapshot(before) < self.compact_every:
            return
        (self.fold(self._parts(before)).select("*", self._bucket()).hint("rebalance", "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/snapshot/upto={upto}"))
        self.spark.range(1).select(F.lit(upto).cast("bigint").alias("upto")).write.mode("append").parquet(
            f"{self.path}/versions")
