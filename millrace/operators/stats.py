"""Ten-second tumbling statistics. Each works on a batch table and on a stream alike.

All aggregates are sums, minima and counts, combined before the shuffle. Exact distinct counts
use two levels: the first groups by the id as well, so a hot key is spread over its ids and no
set of ids is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace import schemas
from millrace.codes import SEARCH
from millrace.functions import text
from millrace.functions.times import day_key, day_number, tumble, watermarked, window_bounds
from millrace.operators import facts
from millrace.operators.joins import PRODUCT_ATTRS, enrich_product

WINDOW = "10 seconds"
AMOUNT_SUM = "decimal(28,4)"
DEALS = 4       # a product's windows lie in so many partitions while its attributes are looked up
MONEY = {m for m, kind in facts.PRODUCT_MEASURES.items() if kind == facts.AMOUNT}
# what keywords are counted by
NAMED_COUNTS = ["spu_name", "click_ct", "cart_ct", "order_ct", "stt", "edt"]


def _units(column: str) -> str:
    """Money as whole ten-thousandths: exact, and summed as a long instead of a wide decimal.

    One window and key would need 9e14 in money to overflow, which raises an error.
    """
    return f"cast({column} * 10000 as bigint)"


def _amount(units: str) -> Column:
    return F.expr(f"cast(cast({units} as decimal(20,0)) * cast(0.0001 as decimal(5,4))"
                  f" as {AMOUNT_SUM}) as {units}")


def _sums(columns: Sequence[str], value: dict[str, str] | None = None) -> list[Column]:
    return [F.expr(f"sum({(value or {}).get(c, c)}) as {c}") for c in columns]


def _first_ms() -> Column:
    return F.unix_millis(F.min("_first")).alias("ts")


def processing_millis() -> Column:
    """Now, in whole seconds, as epoch millis."""
    return F.unix_timestamp() * 1000


def tumble_counts(df: DataFrame, time: str, *keys: str, size: str = WINDOW,
                  delay: str | None = None) -> DataFrame:
    """Rows per window and key."""
    return (watermarked(df, time, delay).groupBy(tumble(time, size), *keys)
            .agg(F.count("*").alias("ct"))
            .select(*window_bounds(), *keys, "ct"))


def distinct_ct(df: DataFrame, keys: list[str | Column], id_column: str,
                out: str = "distinct_ct") -> DataFrame:
    """Exact distinct ids per key, in two levels."""
    names = [k if isinstance(k, str) else "window" for k in keys]
    return (df.groupBy(*keys, id_column).agg(F.count("*").alias("_n"))
            .groupBy(*names).agg(F.count(id_column).alias(out)))


def visitor_stats(events: DataFrame, *, size: str = WINDOW, delay: str | None = "13 seconds"
                  ) -> DataFrame:
    """Visitor measures per version, channel, area and new flag.

    Bounces are known only once their waiting time is over, so a stream's watermark waits for
    that long on top of the usual three seconds.
    """
    out = (watermarked(events, "ts", delay).groupBy(tumble("ts", size), *facts.VISITOR_DIMS)
           .agg(*_sums(facts.VISITOR_MEASURES), F.min("ts").alias("_ts")))
    return out.select(*window_bounds(), *facts.VISITOR_DIMS, *facts.VISITOR_MEASURES,
                      F.unix_millis("_ts").alias("ts"))


def _product_parts(rows: DataFrame, size: str) -> DataFrame:
    """One behaviour frame as window rows: measures, and 1 per distinct id it carries."""
    rows = rows.filter("sku_id is not null and ts is not null")
    has = set(rows.columns)
    ids = [i for i in facts.PRODUCT_IDS if i in has]
    measures = [m for m in facts.PRODUCT_MEASURES if m in has]
    value = {m: _units(m) if m in MONEY else m for m in measures}
    if ids:
        rows = rows.groupBy(tumble("ts", size), "sku_id", *ids).agg(
            *_sums(measures, value), F.min("ts").alias("_first"))
    else:
        rows = rows.selectExpr(f"window(ts, '{size}') as window", "sku_id", "ts as _first",
                               *[f"{v} as {m}" for m, v in value.items()])
    zero = "cast(0 as bigint)"
    return rows.selectExpr(
        "window", "sku_id", "_first",
        *[m if m in has else f"{zero} as {m}" for m in facts.PRODUCT_MEASURES],
        *[(f"cast({i} is not null as bigint)" if i in has else zero) + f" as {n}"
          for i, n in facts.PRODUCT_IDS.items()])


def product_sums(behaviours: DataFrame | Sequence[DataFrame], *, size: str = WINDOW,
                 delay: str | None = "3 seconds") -> DataFrame:
    """Product measures per sku, before the product attributes are looked up.

    Give the behaviours as one frame or one by one. One by one, the frames that carry order ids
    are first grouped by them on their own: coming from a join on the order they already lie
    by order, so this level needs no further shuffle, and frames without ids skip it.
    """
    return _told(_summed(product_rows(behaviours, size=size, delay=delay), "window", "sku_id"))


def product_rows(behaviours: DataFrame | Sequence[DataFrame], *, size: str = WINDOW,
                 delay: str | None = "3 seconds") -> DataFrame:
    """Behaviours as rows per window and sku that are still to be added up, by `product_row_stats` for one."""
    parts = [behaviours] if isinstance(behaviours, DataFrame) else list(behaviours)
    if any(p.isStreaming for p in parts):
        whole = parts[0] if len(parts) == 1 else facts.product_behaviours(*parts)
        parts = [watermarked(whole, "ts", delay)]
    return reduce(DataFrame.unionAll, [_product_parts(p, size) for p in parts])


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*_sums([*facts.PRODUCT_MEASURES, *facts.PRODUCT_IDS.values()]), _first_ms())


def _told(sums: DataFrame, *more: str) -> DataFrame:
    """Window and money as results show them."""
    return sums.select(*window_bounds(), "sku_id", *[
        _amount(m) if m in MONEY else m for m in (*facts.PRODUCT_MEASURES, *facts.PRODUCT_IDS.values())], "ts", *more)


def product_stats(behaviours: DataFrame | Sequence[DataFrame], products: DataFrame, *, size: str = WINDOW,
                  delay: str | None = "3 seconds") -> DataFrame:
    """Product statistics with attributes, in stored column order: aggregate first, then look up."""
    rows = product_rows(behaviours, size=size, delay=delay)
    if rows.isStreaming:
        return enrich_product(_told(_summed(rows, "window", "sku_id")), products, price=True).select(*schemas.PRODUCT_STATS)
    return product_row_stats(rows, products)


def product_row_stats(rows: DataFrame, products: DataFrame, *, by_day: bool = False) -> DataFrame:
    """Product statistics from `product_rows` of a table.

    The rows are dealt once, by sku and one of `DEALS` numbers drawn from their window: both the sums and the
    look-up find them in place, and a busy product lies in several partitions. With `by_day` the sums are
    dealt by day after that, before windows and money are spelled out, and the day comes as ``dt``.
    """
    dealt = rows.withColumn("_deal", F.expr(f"cast(pmod(xxhash64(window.start), {DEALS}) as int)")).repartition("sku_id", "_deal")
    sums = enrich_product(_summed(dealt, "sku_id", "_deal", "window"), products, price=True, salts=DEALS, dealt="_deal")
    if by_day:
        sums = sums.withColumn("dt", day_number("window.start")).hint("rebalance", "dt")
    day = ["dt"] if by_day else []
    return _told(sums, *(c for c in schemas.PRODUCT_STATS if c in {*PRODUCT_ATTRS, "sku_price"}), *day).select(
        *schemas.PRODUCT_STATS, *day)


def day_sums(sums: DataFrame, *measures: str) -> DataFrame:
    """Measures per day and sku from window rows; far fewer rows to look attributes up for."""
    return sums.groupBy(day_number("stt").alias("dt"), "sku_id").agg(*(F.sum(m).alias(m) for m in measures))


def day_keywords(searches: DataFrame, sums: DataFrame, products: DataFrame, *, segment=text.words) -> DataFrame:
    """(dt, keyword, ct, source) of searches, and of products by their behaviours' window rows.

    Counts are added up by day before a name is cut into words.
    """
    asked = text.explode_words(searches.withColumn("dt", day_key("ts").cast("int")), "fullword", segment=segment).groupBy(
        "dt", "keyword").agg(F.count("*").alias("ct")).withColumn("source", F.lit(SEARCH))
    named = enrich_product(day_sums(sums, "click_ct", "cart_ct", "order_ct"), products).groupBy("dt", "spu_name").agg(
        *(F.sum(c).alias(c) for c in ("click_ct", "cart_ct", "order_ct")))
    counted = text.unpivot_counts(text.explode_words(named, "spu_name", segment=segment))
    return asked.unionByName(counted.select("dt", "keyword", "ct", "source"))


def province_stats(wide: DataFrame, *, time: str = "create_time", size: str = WINDOW,
                   delay: str | None = "3 seconds", now: Column | None = None) -> DataFrame:
    """Distinct orders and sales per province."""
    keys = ["province_id", "province_name", "province_area_code", "province_iso_code",
            "province_3166_2_code"]
    rows = watermarked(wide, time, delay).withColumn(
        "order_amount", F.coalesce(F.col("split_total_amount").cast(facts.AMOUNT), F.lit(0)))
    per_order = rows.groupBy(tumble(time, size), *keys, "order_id").agg(
        *_sums(["order_amount"], {"order_amount": _units("order_amount")}))
    out = per_order.groupBy("window", *keys).agg(
        F.sum("order_amount").alias("order_amount"), F.count("order_id").alias("order_count"))
    return out.select(*window_bounds(), "province_id", "province_name",
                      F.col("province_area_code").alias("area_code"),
                      F.col("province_iso_code").alias("iso_code"),
                      F.col("province_3166_2_code").alias("iso_3166_2"),
                      _amount("order_amount"), "order_count",
                      (processing_millis() if now is None else now).alias("ts"))


def keyword_search_stats(searches: DataFrame, *, size: str = WINDOW,
                         delay: str | None = "3 seconds", segment=text.words,
                         now: Column | None = None) -> DataFrame:
    """Searches per keyword."""
    exploded = text.explode_words(watermarked(searches, "ts", delay), "fullword", segment=segment)
    out = exploded.groupBy(tumble("ts", size), "keyword").agg(F.count("*").alias("ct"))
    return out.select("keyword", "ct", F.lit(SEARCH).alias("source"), *window_bounds(),
                      (processing_millis() if now is None else now).alias("ts"))


def keyword_product_stats(stats: DataFrame, *, segment=text.words, now: Column | None = None
                          ) -> DataFrame:
    """Clicks, cart additions and orders of a product, counted for each word of its name."""
    rows = text.unpivot_counts(text.explode_words(stats.select(*NAMED_COUNTS), "spu_name", segment=segment))
    return rows.select("keyword", "ct", "source", "stt", "edt",
                       (processing_millis() if now is None else now).alias("ts"))
