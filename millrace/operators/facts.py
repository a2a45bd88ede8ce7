"""One-row-in, one-row-out measures that the statistics add up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from millrace.codes import APPRAISE_GOOD

AMOUNT = "decimal(18,4)"

# Measures of one product behaviour and their types; the three ids are counted distinct.
PRODUCT_MEASURES = {
    "display_ct": "bigint", "click_ct": "bigint", "favor_ct": "bigint", "cart_ct": "bigint",
    "order_sku_num": "bigint", "order_amount": AMOUNT, "payment_amount": AMOUNT,
    "refund_amount": AMOUNT, "comment_ct": "bigint", "good_comment_ct": "bigint",
}
PRODUCT_IDS = {"order_id": "order_ct", "paid_order_id": "paid_order_ct",
               "refund_order_id": "refund_order_ct"}
VISITOR_DIMS = ["vc", "ch", "ar", "is_new"]
VISITOR_MEASURES = ["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"]


SKU = "try_cast(sku_id as bigint) as sku_id"


def _ts(column: str = "create_time") -> str:
    return f"cast({column} as timestamp) as ts"


def _one(name: str) -> str:
    return f"cast(1 as bigint) as {name}"


def _money(column: str, name: str) -> str:
    return f"cast(coalesce({column}, 0) as {AMOUNT}) as {name}"


def product_clicks(pages: DataFrame) -> DataFrame:
    """A view of a product's own page is a click on it."""
    return pages.filter("page_id = 'good_detail'").selectExpr(
        "try_cast(item as bigint) as sku_id", _one("click_ct"), _ts("ts"))


def product_displays(displays: DataFrame) -> DataFrame:
    """An exposed object that is a product. Expects exposure rows that carry their log's `ts`."""
    return displays.filter("item_type = 'sku_id'").selectExpr(
        "try_cast(item as bigint) as sku_id", _one("display_ct"), _ts("ts"))


def product_favors(favors: DataFrame) -> DataFrame:
    return favors.selectExpr(SKU, _one("favor_ct"), _ts())


def product_carts(carts: DataFrame, *, literal: bool = False) -> DataFrame:
    """Cart additions; ``literal`` counts them as clicks, as the original job does."""
    return carts.selectExpr(SKU, _one("click_ct" if literal else "cart_ct"), _ts())


def product_orders(wide: DataFrame) -> DataFrame:
    return wide.selectExpr(SKU, "cast(sku_num as bigint) as order_sku_num",
                           _money("split_total_amount", "order_amount"),
                           "cast(order_id as bigint) as order_id", _ts())


def product_payments(paid: DataFrame) -> DataFrame:
    return paid.selectExpr(SKU, _money("split_total_amount", "payment_amount"),
                           "cast(order_id as bigint) as paid_order_id", _ts("payment_create_time"))


def product_refunds(refunds: DataFrame) -> DataFrame:
    return refunds.selectExpr(SKU, _money("refund_amount", "refund_amount"),
                              "cast(order_id as bigint) as refund_order_id", _ts())


def product_comments(comments: DataFrame) -> DataFrame:
    good = f"cast(if(appraise = '{APPRAISE_GOOD}', 1, 0) as bigint) as good_comment_ct"
    return comments.selectExpr(SKU, _one("comment_ct"), good, _ts())


def product_behaviours(*parts: DataFrame) -> DataFrame:
    """All behaviours in one shape: measures they do not have are 0, ids they do not have null."""
    shaped = []
    for part in parts:
        has = set(part.columns)
        measures = [f"cast({f'coalesce({c}, 0)' if c in has else 0} as {t}) as {c}"
                    for c, t in PRODUCT_MEASURES.items()]
        ids = [c if c in has else f"cast(null as bigint) as {c}" for c in PRODUCT_IDS]
        shaped.append(part.filter("sku_id is not null and ts is not null")
                      .selectExpr("sku_id", "ts", *measures, *ids))
    return reduce(DataFrame.unionAll, shaped)


def _visitor(rows: DataFrame, **measures: str) -> DataFrame:
    return rows.selectExpr(*VISITOR_DIMS, *[
        f"cast({measures.get(m, 0)} as bigint) as {m}" for m in VISITOR_MEASURES], "ts")


def visitor_pages(pages: DataFrame) -> DataFrame:
    """A page view; one without a previous page also opens a visit."""
    return _visitor(pages, pv_ct="1", dur_sum="coalesce(during_time, 0)",
                    sv_ct="if(coalesce(last_page_id, '') = '', 1, 0)")


def visitor_uniques(uniques: DataFrame) -> DataFrame:
    return _visitor(uniques, uv_ct="1")


def visitor_jumps(jumps: DataFrame) -> DataFrame:
    return _visitor(jumps, uj_ct="1")


def visitor_marks(flagged: DataFrame, *, literal: bool = False) -> DataFrame:
    """Pages with the marks of `visits.flag_visits`, one row of measures each: the sums are those of
    `visitor_events`, from one pass over the log."""
    return _visitor(flagged, pv_ct="1", dur_sum="coalesce(during_time, 0)",
                    sv_ct="if(coalesce(last_page_id, '') = '', 1, 0)", uv_ct="int(is_unique)",
                    uj_ct="int(is_unique)" if literal else "int(is_jump)")


def visitor_events(pages: DataFrame, uniques: DataFrame, jumps: DataFrame, *,
                   literal: bool = False) -> DataFrame:
    """Pages, unique visits and bounces in one shape.

    ``literal`` counts unique visits as bounces, as the original job does.
    """
    return (visitor_pages(pages).unionByName(visitor_uniques(uniques))
            .unionByName(visitor_jumps(uniques if literal else jumps)))
