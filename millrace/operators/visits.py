"""Unique visits and bounces on batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from millrace.operators.logs import blank
from millrace.operators.neighbours import with_neighbour


def unique_visits(pages: DataFrame, *, key: str = "mid", time: str = "ts",
                  tie: tuple[str, ...] = ()) -> DataFrame:
    """The first opening row (no previous page) of each device and day.

    The rank filter is applied before the shuffle as well, so a busy device sends at most one
    row per day and task.
    """
    first = Window.partitionBy(key, "_day").orderBy(time, *tie)
    return (pages.filter(blank("last_page_id") & F.col(key).isNotNull())
            .withColumn("_day", F.to_date(time))
            .withColumn("_rank", F.row_number().over(first))
            .filter("_rank = 1").drop("_rank", "_day"))


def openings(pages: DataFrame, within: float = 10.0, *, key: str = "mid", time: str = "ts",
             tie: tuple[str, ...] = (), slice_seconds: int = 600) -> DataFrame:
    """Opening rows with ``outcome``, decided by the device's immediately next row.

    ``bounce``: no row follows in less than `within` seconds. ``match``: one does and it has a
    page id. ``broken``: one does, without a page id.
    """
    seen = pages.filter(F.col(key).isNotNull()).withColumn("_has_page", ~blank("page_id"))
    paired = with_neighbour(seen, key, time, {"_next_has_page": "_has_page"}, reach=within,
                            slice_seconds=slice_seconds, tie=tie)
    outcome = (F.when(F.col("_next_has_page").isNull(), "bounce")
               .when(F.col("_next_has_page"), "match").otherwise("broken"))
    return (paired.filter(blank("last_page_id")).withColumn("outcome", outcome)
            .drop("_has_page", "_next_has_page"))


def flag_visits(pages: DataFrame, within: float = 10.0, *, key: str = "mid", time: str = "ts",
                tie: tuple[str, ...] = (), slice_seconds: int = 600) -> DataFrame:
    """Every page row with ``is_unique`` and ``is_jump``: `unique_visits` and `user_jumps` as marks.

    A visit and a bounce are page rows, so one pass over the log gives all three. Rows without a
    device have neither mark and are spread by their time.
    """
    paired = with_neighbour(pages.withColumn("_seen", F.lit(True)), key, time, {"_followed": "_seen"},
                            reach=within, slice_seconds=slice_seconds, tie=tie)
    opens = blank("last_page_id") & F.col(key).isNotNull()
    spread = F.when(F.col(key).isNull(), F.xxhash64(time, *tie))
    marked = paired.withColumns({"_opens": opens, "_day": F.to_date(time), "_spread": spread})
    first = F.row_number().over(Window.partitionBy(key, "_day", "_opens", "_spread").orderBy(time, *tie))
    return marked.withColumns({"is_unique": F.col("_opens") & (first == 1),
                               "is_jump": F.col("_opens") & F.col("_followed").isNull()}).drop(
        "_seen", "_followed", "_opens", "_day", "_spread")


def user_jumps(pages: DataFrame, within: float = 10.0, **options) -> DataFrame:
    """Opening rows after which the device stayed away for `within` seconds or for good."""
    return openings(pages, within, **options).filter("outcome = 'bounce'").drop("outcome")
