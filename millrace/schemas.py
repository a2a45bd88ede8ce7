"""Row shapes of the inputs and the column order of the result tables."""

from __future__ import annotations

MONEY = "DECIMAL(16,2)"

# One line of the raw event log. `start` is only tested for presence and kept as its JSON text.
RAW_LOG = """
    common STRUCT<mid: STRING, vc: STRING, ch: STRING, ar: STRING, is_new: STRING>,
    page STRUCT<page_id: STRING, last_page_id: STRING, item: STRING, during_time: BIGINT>,
    start STRING,
    displays ARRAY<STRUCT<item: STRING, item_type: STRING>>,
    ts BIGINT
"""

# The same log read by the keyword job, which only looks keys up.
PAGE_VIEW = "common MAP<STRING, STRING>, page MAP<STRING, STRING>, ts BIGINT"

# A database change as captured, and after normalisation.
CAPTURED_CHANGE = """
    before MAP<STRING, STRING>,
    after MAP<STRING, STRING>,
    source STRUCT<db: STRING, `table`: STRING>,
    op STRING,
    ts_ms BIGINT
"""
CHANGE = "database STRING, `table` STRING, type STRING, data MAP<STRING, STRING>"

ROUTE_COLUMNS = ["source_table", "operate_type", "sink_type", "sink_table",
                 "sink_columns", "sink_pk", "sink_extend"]

ORDER_INFO = f"""
    id BIGINT, province_id BIGINT, order_status STRING, user_id BIGINT,
    total_amount {MONEY}, activity_reduce_amount {MONEY}, coupon_reduce_amount {MONEY},
    original_total_amount {MONEY}, feight_fee {MONEY},
    expire_time STRING, create_time STRING, operate_time STRING
"""
ORDER_DETAIL = f"""
    id BIGINT, order_id BIGINT, sku_id BIGINT, order_price {MONEY}, sku_num BIGINT,
    sku_name STRING, create_time STRING, split_total_amount {MONEY},
    split_activity_amount {MONEY}, split_coupon_amount {MONEY}
"""
PAYMENT_INFO = f"""
    id BIGINT, order_id BIGINT, user_id BIGINT, total_amount {MONEY}, subject STRING,
    payment_type STRING, create_time STRING, callback_time STRING
"""
SKU_EVENT = "sku_id BIGINT, create_time STRING"

# Columns of the stored result tables, in stored order.
ORDER_WIDE = [
    "detail_id", "order_id", "sku_id", "order_price", "sku_num", "sku_name", "province_id",
    "order_status", "user_id", "total_amount", "activity_reduce_amount", "coupon_reduce_amount",
    "original_total_amount", "feight_fee", "split_activity_amount", "split_coupon_amount",
    "split_total_amount", "create_time", "create_date", "create_hour",
]
VISITOR_STATS = ["stt", "edt", "vc", "ch", "ar", "is_new",
                 "uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum", "ts"]
PRODUCT_STATS = ["stt", "edt", "sku_id", "sku_name", "sku_price", "spu_id", "spu_name",
                 "tm_id", "tm_name", "category3_id", "category3_name", "display_ct", "click_ct",
                 "favor_ct", "cart_ct", "order_sku_num", "order_amount", "order_ct",
                 "payment_amount", "paid_order_ct", "refund_order_ct", "refund_amount",
                 "comment_ct", "good_comment_ct", "ts"]
PROVINCE_STATS = ["stt", "edt", "province_id", "province_name", "area_code", "iso_code",
                  "iso_3166_2", "order_amount", "order_count", "ts"]
KEYWORD_STATS = ["keyword", "ct", "source", "stt", "edt", "ts"]
