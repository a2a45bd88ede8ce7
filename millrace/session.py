"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on: adaptive plans (partition coalescing, skewed-join
# splitting, size-checked broadcast) and a spill-to-disk state store for streams.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What one task reads, so that its memory stays the same however large the tables are: sorting and
    # grouping hold the rows they read at some twenty times their packed size.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.files.openCostInBytes": "512k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
TASKS_PER_CORE = 8
TASK_ROWS = 200_000     # input rows per shuffle partition, at most


def build(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Plans here are built from many expressions; recording a Python call site for each of them
    # would take longer than planning.
    fixed = {"spark.python.sql.dataFrameDebugging.enabled": "false"}
    for name, value in {**fixed, **RUNTIME, **conf}.items():
        builder = builder.config(name, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession, rows: int = 0) -> SparkSession:
    """Give a session somebody else made the runtime settings it does not set itself.

    `rows` of input ask for as many shuffle partitions as keep each of them within `TASK_ROWS`; the
    adaptive plan merges those that turn out small.
    """
    chosen = {r["key"] for r in spark.sql("SET").collect()}
    for name, value in RUNTIME.items():
        if name not in chosen:
            spark.conf.set(name, value)
    # Start shuffles fine-grained and let the adaptive plan merge small partitions, so that
    # a large input does not have to fit the default number. Streams are not affected.
    fine = max(-(-rows // TASK_ROWS), 0 if is_local(spark) else TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if fine > int(spark.conf.get(INITIAL_PARTITIONS, None) or (least if is_local(spark) else 0)):
        spark.conf.set(INITIAL_PARTITIONS, str(max(fine, least)))
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for written intermediate tables and stream checkpoints.

    It lies below the shared folder named in ``spark.checkpoint.dir``, or else in the session's
    warehouse, so every executor sees it and a lost executor loses nothing. On a cluster a
    warehouse on the driver's own disk is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        if not is_local(spark) and root.startswith(("file:", "/")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is written within are dropped once it is there, not when the driver next collects
    garbage, so that disk holds one step at a time."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def kept(table: DataFrame, folder: str) -> DataFrame:
    """The table as written to a folder, without the shuffles it was made by."""
    spark = table.sparkSession
    with freed_shuffles(spark):
        table.write.parquet(folder)
    return spark.read.parquet(folder)


def lay_out(table: DataFrame, folder: str, by: str) -> None:
    """Add the table's rows to a folder of intermediate rows that are taken up one value of `by` at a time."""
    with freed_shuffles(table.sparkSession):
        table.write.mode("append").option("compression", "zstd").partitionBy(by).parquet(folder)


def taken_up(rows: DataFrame, folder: str) -> None:
    """Drop intermediate rows that were laid out in a folder, once what they were for is written."""
    rows.sparkSession.createDataFrame([], rows.schema).write.mode("overwrite").parquet(folder)
