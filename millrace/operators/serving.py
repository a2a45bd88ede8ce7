"""Dashboard queries over the stored statistics.

Each takes a `date` (``yyyyMMdd``, 0 for the day of `asof`, None for every day at once). Stored
tables are partitioned by ``dt``, so a date reads one partition; frames without that column get
it from ``stt``.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, functions as F, Window

from millrace.codes import KEYWORD_WEIGHTS
from millrace.functions.numbers import div_half_up, ratio, zero
from millrace.functions.times import day_number

DEFAULT_LIMIT = 20
HOURS = 24


def with_day(stats: DataFrame) -> DataFrame:
    return stats if "dt" in stats.columns else stats.withColumn("dt", day_number("stt"))


def on_day(stats: DataFrame, date: int | None, asof: datetime.date | None = None) -> DataFrame:
    """Rows of one day, or of every day when `date` is None."""
    days = with_day(stats)
    if date is None:
        return days
    if date == 0:   # today by the session's zone; a constant when the plan is made, so folders are pruned
        today = F.current_date() if asof is None else F.lit(asof)
        return days.filter(F.col("dt") == F.date_format(today, "yyyyMMdd").cast("int"))
    return days.filter(F.col("dt") == date)


def _top(df: DataFrame, order: list[Column], n: int, date: int | None) -> DataFrame:
    """The first n rows of the one day asked for, or of each day."""
    if date is not None:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy("dt").orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def _sales(stats: DataFrame, keys: list[str], date: int | None, n: int, **more: Column) -> DataFrame:
    sums = (on_day(stats, date).groupBy("dt", *keys)
            .agg(F.sum("order_amount").alias("order_amount"),
                 *[c.alias(name) for name, c in more.items()])
            .filter("order_amount > 0"))
    return _top(sums, [F.desc("order_amount"), *[F.asc_nulls_last(k) for k in keys]], n, date)


def gmv(stats: DataFrame, date: int | None = 0) -> DataFrame:
    """Sales of a day; without rows a single day gives null."""
    days = on_day(stats, date)
    total = F.sum("order_amount").alias("order_amount")
    return days.groupBy("dt").agg(total) if date is None else days.agg(total)


def top_brands(stats: DataFrame, date: int | None = 0, n: int = DEFAULT_LIMIT) -> DataFrame:
    return _sales(stats, ["tm_id", "tm_name"], date, n)


def top_categories(stats: DataFrame, date: int | None = 0, n: int = DEFAULT_LIMIT) -> DataFrame:
    return _sales(stats, ["category3_id", "category3_name"], date, n)


def top_spus(stats: DataFrame, date: int | None = 0, n: int = DEFAULT_LIMIT) -> DataFrame:
    return _sales(stats, ["spu_id", "spu_name"], date, n, order_ct=F.sum("order_ct"))


def province_sales(stats: DataFrame, date: int | None = 0) -> DataFrame:
    return (on_day(stats, date).groupBy("dt", "province_id", "province_name")
            .agg(F.sum("order_amount").alias("order_amount")))


def visitor_sums(stats: DataFrame, date: int | None = 0) -> DataFrame:
    """The five visitor measures per new flag."""
    return on_day(stats, date).groupBy("dt", "is_new").agg(*[
        F.sum(c).alias(c) for c in ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")])


def _ratios(prefix: str = "") -> dict[str, Column]:
    """Bounce percentage, seconds per visit and pages per visit, half up; 0 without visits."""
    uv, pv, sv, uj, dur = (F.col(prefix + c) for c in
                           ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"))
    usable = (uv != 0) & (sv != 0)
    one = F.when(usable, sv).otherwise(F.lit(1).cast("bigint"))

    def guarded(value: Column, scale: int) -> Column:
        return F.when(usable, value).otherwise(F.lit(0)).cast(f"decimal(18,{scale})")

    return {"uj_rate": guarded(ratio(uj * 100, one, 2), 2),
            "dur_per_sv": guarded(ratio(div_half_up(dur, one), F.lit(1000).cast("bigint"), 1), 1),
            "pv_per_sv": guarded(ratio(pv, one, 2), 2)}


def visit_ratios(sums: DataFrame) -> DataFrame:
    """Add the three ratios to rows that hold the five sums."""
    return sums.withColumns(_ratios())


def visitor_matrix(stats: DataFrame, date: int | None = 0) -> DataFrame:
    """Five rows (uv, pv, bounce %, seconds per visit, pages per visit), new against old.

    Any flag but '1' counts as old; a side without rows shows zeros.
    """
    names = ("uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum")
    is_new = F.coalesce(F.col("is_new") == "1", F.lit(False))
    sides = {"new_": is_new, "old_": ~is_new}
    days = on_day(stats, date)
    sums = [F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0).cast("bigint")).alias(side + c)
            for side, cond in sides.items() for c in names]
    wide = days.groupBy("dt").agg(*sums) if date is None else days.agg(*sums)
    new, old = _ratios("new_"), _ratios("old_")

    def line(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), a.cast("decimal(20,2)").alias("new"),
                        b.cast("decimal(20,2)").alias("old"))

    rows = F.array(line("uv", F.col("new_uv_ct"), F.col("old_uv_ct")),
                   line("pv", F.col("new_pv_ct"), F.col("old_pv_ct")),
                   *[line(k, new[k], old[k]) for k in new])
    return wide.select(*(["dt"] if date is None else []), F.inline(rows))


def visitors_by_hour(stats: DataFrame, date: int | None = 0, *, literal: bool = False) -> DataFrame:
    """uv, pv and new uv for each hour 00–23, zero where nothing happened.

    With ``date=None`` every day that has rows gets its hours; ``literal`` stops before 23, as
    the original page does.
    """
    days = on_day(stats, date).withColumn("hr", F.substring("stt", 12, 2).cast("int"))
    new = F.when(F.col("is_new") == "1", F.col("uv_ct")).otherwise(0)
    per_hour = days.groupBy("dt", "hr").agg(F.sum("uv_ct").alias("uv_ct"),
                                            F.sum("pv_ct").alias("pv_ct"), F.sum(new).alias("new_uv"))
    # At most 24 rows of a day meet here; the gaps are filled while they are laid out again.
    seen = F.map_from_entries(F.collect_list(F.struct("hr", F.struct("uv_ct", "pv_ct", "new_uv")))
                              ).alias("seen")
    by_day = per_hour.groupBy("dt").agg(seen) if date is None else per_hour.agg(seen)

    def line(hour: Column) -> Column:
        found = F.try_element_at("seen", hour)
        return F.struct(F.lpad(hour.cast("string"), 2, "0").alias("hr"), *[
            zero(found[c]).cast("bigint").alias(c) for c in ("uv_ct", "pv_ct", "new_uv")])

    hours = F.sequence(F.lit(0), F.lit(HOURS - 2 if literal else HOURS - 1))
    return by_day.select(*(["dt"] if date is None else []), F.inline(F.transform(hours, line)))


def day_totals(stats: DataFrame, date: int | None = 0, *, literal: bool = False) -> DataFrame:
    """Page views and unique visitors of a day in one pass.

    ``literal`` counts stored rows instead, as the original queries do.
    """
    total = F.count if literal else F.sum
    days = on_day(stats, date)
    sums = [total(c).alias(c) for c in ("pv_ct", "uv_ct")]
    return days.groupBy("dt").agg(*sums) if date is None else days.agg(*sums)


def pv(stats: DataFrame, date: int | None = 0, *, literal: bool = False) -> DataFrame:
    """Page views of a day."""
    return day_totals(stats, date, literal=literal).drop("uv_ct")


def uv(stats: DataFrame, date: int | None = 0, *, literal: bool = False) -> DataFrame:
    """Unique visitors of a day."""
    return day_totals(stats, date, literal=literal).drop("pv_ct")


def hot_keywords(stats: DataFrame, date: int | None = 0, n: int = DEFAULT_LIMIT, *,
                 rank_by: str = "count") -> DataFrame:
    """Keywords with their weighted count, ranked by plain count or by ``rank_by="weight"``."""
    weight = F.lit(0)
    for source, w in KEYWORD_WEIGHTS.items():
        weight = F.when(F.col("source") == source, w).otherwise(weight)
    sums = on_day(stats, date).groupBy("dt", "keyword").agg(
        F.sum(F.col("ct") * weight).alias("weighted"), F.sum("ct").alias("plain"))
    order = F.desc("plain" if rank_by == "count" else "weighted")
    return _top(sums, [order, F.asc("keyword")], n, date).select(
        "dt", "keyword", F.col("weighted").alias("ct"))
