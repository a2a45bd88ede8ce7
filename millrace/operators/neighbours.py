"""The next or previous row of a key, within a bounded reach of time.

A window over the whole history of a key would put one busy key into one task. Here every key
is cut into time slices, and no group grows with the length of the history. What a slice has to
see of its neighbours comes to it as copies:

- reach up to a slice: all rows that near the slice's edge. One shuffle, on (key, slice).
- a longer reach: the edge row of the nearest slice in use. Edge rows are one per key and slice,
  picked with an aggregate that combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

MICROS = 1_000_000


def _slice(time: str, slice_seconds: int):
    size = slice_seconds * MICROS
    return F.expr(f"unix_micros({time}) div {size} - if(unix_micros({time}) % {size} < 0, 1, 0)")


def with_slices(df: DataFrame, time: str, reach: float, slice_seconds: int,
                direction: str) -> DataFrame:
    """Add ``_slice`` and ``_copy``; rows another slice must see appear there again as copies."""
    if slice_seconds < reach:
        raise ValueError("a slice must be at least as long as the reach")
    own = _slice(time, slice_seconds)
    offset = F.unix_micros(time) - own * F.lit(slice_seconds * MICROS)
    if direction == "next":      # the slice before looks ahead at rows near my start
        near, other = offset < F.lit(int(reach * MICROS)), own - 1
    else:                        # the slice after looks back at rows near my end
        near, other = offset >= F.lit(int((slice_seconds - reach) * MICROS)), own + 1
    mine = F.struct(own.alias("s"), F.lit(False).alias("c"))
    copy = F.struct(other.alias("s"), F.lit(True).alias("c"))
    places = F.when(near, F.array(mine, copy)).otherwise(F.array(mine))
    return df.select("*", F.inline(places).alias("_slice", "_copy"))


def with_carried_edges(df: DataFrame, key: str, time: str, needed: list[str], order: list[str],
                       reach: float, slice_seconds: int, direction: str) -> DataFrame:
    """Add ``_slice`` and ``_copy``; each slice in use also gets the edge row of the nearest other
    slice of its key on the side looked at, unless that lies beyond the reach."""
    rows = df.withColumns({"_slice": _slice(time, slice_seconds), "_copy": F.lit(False)})
    pick, step = (F.min_by, F.lag) if direction == "next" else (F.max_by, F.lead)
    edges = rows.groupBy(key, "_slice").agg(
        pick(F.struct(*needed), F.struct(*order)).alias("_edge"))
    in_use = Window.partitionBy(key).orderBy("_slice")     # one row per slice in use
    gap = (F.abs(F.col("_to") - F.col("_slice")) - 1) * slice_seconds
    copies = (edges.withColumn("_to", step("_slice").over(in_use)).filter(gap < reach)
              .select(key, F.col("_to").alias("_slice"), F.lit(True).alias("_copy"), "_edge.*"))
    return rows.unionByName(copies, allowMissingColumns=True)


def with_neighbour(df: DataFrame, key: str, time: str, take: dict[str, str], *, reach: float,
                   slice_seconds: int, direction: str = "next",
                   tie: tuple[str, ...] = ()) -> DataFrame:
    """Add columns of the neighbouring row of the same key, null when none is within `reach`.

    `take` maps new columns to columns of the neighbour. The gap must be below `reach` seconds.
    Rows are ordered by `time`, then by the `tie` columns.
    """
    if slice_seconds >= reach:
        sliced = with_slices(df, time, reach, slice_seconds, direction)
    else:
        needed = list(dict.fromkeys([time, *tie, *take.values()]))
        sliced = with_carried_edges(df, key, time, needed, [time, *tie], reach, slice_seconds,
                                    direction)
    order = Window.partitionBy(key, "_slice").orderBy(time, *tie)
    step = F.lead if direction == "next" else F.lag
    row = F.struct(F.col(time).alias("_t"), *[F.col(c).alias(n) for n, c in take.items()])
    gap = F.abs(F.unix_micros("_near._t") - F.unix_micros(time))
    close = gap < F.lit(int(reach * MICROS))
    return (sliced.withColumn("_near", step(row).over(order))
            .filter(~F.col("_copy"))
            .withColumns({n: F.when(close, F.col(f"_near.{n}")) for n in take})
            .drop("_slice", "_copy", "_near"))
