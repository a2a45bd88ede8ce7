"""Result tables: by day (or other columns) first, and below that one folder per micro-batch.

A day is read from its own folder, however many batches or other days there are. Once a day is
over, `close_day` writes it anew into few files beside the table, which later reads prefer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace import schemas
from millrace.operators.serving import with_day
from millrace.session import freed_shuffles

LAYOUTS = {"visitor_stats": schemas.VISITOR_STATS, "product_stats": schemas.PRODUCT_STATS,
           "province_stats": schemas.PROVINCE_STATS, "keyword_stats": schemas.KEYWORD_STATS}


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: list[str] | None = None
                ) -> None:
    """Write one micro-batch; a repeated batch replaces its own folders and nothing else."""
    with freed_shuffles(df.sparkSession):
        (df.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*(partition_by or []), "batch")
         .parquet(path.rstrip("/")))


def stats_sink(path: str, layout: str, by_day: bool = False) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer of a statistics table, in stored column order, one partition per day.

    Several sources may feed one table (searches and products both give keywords); each uses its
    own path below the table's. Rows that lie `by_day` already are written as they lie.
    """
    columns = LAYOUTS[layout]

    def each(df: DataFrame, batch_id: int) -> None:
        # a day's rows into few files; a day with many is dealt over more tasks at run time
        rows = with_day(df.select(*columns, *(["dt"] if by_day and "dt" in df.columns else [])))
        write_batch(rows if by_day else rows.hint("rebalance", "dt"), path, batch_id, ["dt"])

    return each


def folder_or_none(spark: SparkSession, path: str, base: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException
    try:
        return spark.read.option("basePath", base).parquet(path)
    except AnalysisException:
        return None


def closed_upto(spark: SparkSession, path: str, day: int) -> int | None:
    """The last batch whose rows the closed form of a day holds; None if the day is open."""
    marks = folder_or_none(spark, f"{path}_days", f"{path}_days")
    return marks.filter(F.col("dt") == day).agg(F.max("upto")).first()[0] if marks is not None else None


def close_day(spark: SparkSession, path: str, day: int) -> None:
    """Write a finished day's rows of all batches anew as ``<path>_closed/upto=…/dt=<day>``, in as few files
    as their size asks for.

    The batches stay untouched for whoever is reading them and can be retired later. The list of
    closed days says up to which batch a day was folded, and only after its rows are written; batches
    that bring more of the day later are read beside it, and closing it again folds them too.
    """
    rows = spark.read.option("basePath", path).parquet(f"{path}/dt={day}")
    upto = rows.agg(F.max("batch")).first()[0]
    if upto == closed_upto(spark, path, day):
        return
    # the day may have been retired from the batches up to its last closing: those rows come from there
    whole = read_day(spark, path, day).drop("dt")
    whole.hint("rebalance").write.mode("overwrite").parquet(f"{path}_closed/upto={upto}/dt={day}")
    spark.range(1).select(F.lit(day).cast("int").alias("dt"), F.lit(upto).cast("bigint").alias("upto")).coalesce(
        1).write.mode("append").parquet(f"{path}_days")


def read_day(spark: SparkSession, path: str, day: int) -> DataFrame:
    """One day's rows, from that day's folders alone: its closed form, if any, and the batches after it."""
    upto = closed_upto(spark, path, day)
    rows = folder_or_none(spark, f"{path}/dt={day}", path)
    if rows is None and upto is None:        # no such day: the table's columns, no rows
        rows = spark.read.parquet(path).filter(F.col("dt") == day)
    if upto is None:
        return rows.drop("batch")
    base = f"{path}_closed/upto={upto}"
    closed = spark.read.option("basePath", base).parquet(f"{base}/dt={day}")
    if rows is None:
        return closed
    return closed.unionByName(rows.filter(F.col("batch") > upto).drop("batch"))


def read_table(spark: SparkSession, *paths: str) -> DataFrame:
    """All batches of a table; a filter on ``dt`` opens only that day's folders."""
    frames = [spark.read.parquet(p).drop("batch") for p in paths]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def jdbc_sink(url: str, table: str, layout: str, **options: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer to a database over JDBC, columns in stored order. At-least-once."""
    columns = LAYOUTS[layout]

    def each(df: DataFrame, batch_id: int) -> None:
        df.select(*[F.col(c) for c in columns]).write.format("jdbc").options(
            url=url, dbtable=table, **options).mode("append").save()

    return each
