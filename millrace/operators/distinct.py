"""Exact distinct counts that can be stored and added up: sets of whole numbers as bitmaps.

A set is cut into buckets of 64 neighbouring ids, one long each, so that a short time's few ids take a few
longs and aggregation buffers have a fixed size. Sets of parts of the time are stored; the set of a longer
time is their union bucket by bucket, so a day's distinct ids follow from stored rows without the rows
they came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def id_sets(rows: DataFrame, id_column: str, *keys: str | Column) -> DataFrame:
    """(*keys, bucket, ids): the different ids of each key; null ids are in no set."""
    known = rows.filter(F.col(id_column).isNotNull())
    number = F.col(id_column).cast("bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(F.lit(63)).cast("int"))
    return known.groupBy(*keys, F.shiftright(number, 6).alias("bucket")).agg(F.bit_or(bit).alias("ids"))


def united(sets: DataFrame, *keys: str | Column) -> DataFrame:
    """The unions of sets by coarser keys."""
    return sets.groupBy(*keys, "bucket").agg(F.bit_or("ids").alias("ids"))


def set_sizes(sets: DataFrame, *keys: str, out: str = "distinct_ct") -> DataFrame:
    """How many ids the sets of each key hold together, each counted once."""
    return united(sets, *keys).groupBy(*keys).agg(F.sum(F.bit_count("ids")).alias(out))
