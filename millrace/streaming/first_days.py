"""The new-visitor flag on a stream, against a stored table of first days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.times import day_key
from millrace.sinks.keyed import KeyedTable

SALTS = 8       # a busy device's rows of one micro-batch are dealt over so many join keys


def first_days(spark: SparkSession, path: str, **options) -> KeyedTable:
    """Devices with the first day (``yyyyMMdd``) on which they were marked new."""
    return KeyedTable(spark, path, "mid string, day string", "mid", "day", newest=False, **options)


def repair_is_new_batch(logs: DataFrame, batch_id: int, days: KeyedTable, *, time: str = "ts") -> DataFrame:
    """The rows of a micro-batch with ``is_new`` '0' where they come after the device's first marked day.

    Days of new devices are stored under the batch's number, so a repeated batch gives the same rows.
    Rows not marked new are neither looked up nor shuffled. An earlier day that arrives late counts
    for what comes after it; rows already passed on stay as they are.
    """
    marked = F.coalesce((F.col("is_new") == "1") & F.col("mid").isNotNull(), F.lit(False))
    found = logs.filter(marked).groupBy("mid").agg(F.min(day_key(time)).alias("day")).persist()
    days.compact(batch_id)
    known = days.rows(batch_id, found).select("mid", F.col("day").alias("_known"))
    first = found.join(known, "mid", "left")
    new = first.filter(F.col("_known").isNull() | (F.col("day") < F.col("_known")))
    days.append(new, batch_id)
    salted = first.select(F.col("mid").alias("_mid"), F.least("day", "_known").alias("_first"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = logs.filter(marked).withColumn("_own", F.pmod(F.xxhash64(time), F.lit(SALTS)).cast("int"))
    fixed = (rows.join(salted, (F.col("mid") == F.col("_mid")) & (F.col("_own") == F.col("_salt")))
             .withColumn("is_new", F.when(day_key(time) == F.col("_first"), "1").otherwise("0")))
    return logs.filter(~marked).unionByName(fixed.select(*logs.columns))
