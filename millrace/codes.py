"""Business codes of the shop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The codes written by the shop's database.
CODES = {
    "order_status": {
        "1001": "unpaid", "1002": "paid", "1003": "cancelled",
        "1004": "finished", "1005": "refunding", "1006": "refunded",
    },
    "payment_type": {"1101": "alipay", "1102": "wechat", "1103": "unionpay"},
    "appraise": {"1201": "good", "1202": "neutral", "1203": "bad", "1204": "automatic"},
    "refund_reason": {
        "1301": "quality", "1302": "not as described", "1303": "out of stock",
        "1304": "wrong size", "1305": "ordered by mistake", "1306": "no longer wanted",
        "1307": "other",
    },
    "coupon_status": {"1401": "unused", "1402": "in use", "1403": "used"},
    "refund_type": {"1501": "money only", "1502": "money and goods"},
    "source_type": {
        "2401": "search", "2402": "promotion", "2403": "recommendation", "2404": "campaign",
    },
    "activity_rule": {
        "3101": "amount off", "3102": "percent off", "3103": "discount",
    },
    "coupon_type": {"3201": "amount off", "3202": "percent off", "3203": "voucher"},
    "coupon_range": {"3301": "category", "3302": "brand", "3303": "product"},
}

# The good review, keyword sources and their weights in the hot-keyword ranking.
APPRAISE_GOOD = "1201"
SEARCH, CLICK, CART, ORDER = "SEARCH", "CLICK", "CART", "ORDER"
KEYWORD_WEIGHTS = {SEARCH: 10, ORDER: 3, CART: 2, CLICK: 1}

# Where a routed change goes.
SINK_DIM = "hbase"
SINK_FACT = "kafka"
SINK_STATS = "clickhouse"


def code_labels(spark: SparkSession) -> DataFrame:
    """Code → label lookup (one row per code)."""
    rows = [(group, code, label) for group, codes in CODES.items() for code, label in codes.items()]
    return spark.createDataFrame(rows, "code_group string, code string, label string")
