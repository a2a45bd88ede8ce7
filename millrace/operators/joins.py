"""Interval joins, dimension lookups and the row merges built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.times import age_years, seconds


def _salted(one: DataFrame, many: DataFrame, spread_by: str | None, salts: int, dealt: str | None = None):
    """Copy `one` per salt and deal the rows of `many` over the salts by a stable hash, or as the numbers
    of their column `dealt` say."""
    if salts <= 1:
        return one, many, F.lit(True)
    if spread_by is None and dealt is None:
        raise ValueError("salts need spread_by, a column that differs within a hot key")
    one = one.withColumn("_salt_one", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    many = many.withColumn("_salt_many", F.col(dealt) if dealt else F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    return one, many, F.col("_salt_one") == F.col("_salt_many")


def interval_join(one: DataFrame, many: DataFrame, on: tuple[str, str], times: tuple[str, str],
                  lower: float, upper: float, *, salts: int = 1,
                  spread_by: str | None = None) -> DataFrame:
    """Rows of equal keys whose times satisfy ``one + lower ≤ many ≤ one + upper`` (seconds).

    Column names of the two sides must not overlap. On streams both sides need a watermark;
    the time condition lets the state be dropped. A batch join leaves a hot key to the adaptive
    skew split. A stream has no such split: there `salts` deals a hot key's `many` rows over
    that many state partitions and copies the `one` side to each.
    """
    one, many, same_salt = _salted(one, many, spread_by, salts)
    t1, t2 = F.col(times[0]), F.col(times[1])
    near = (t2 >= t1 + seconds(lower)) & (t2 <= t1 + seconds(upper))
    joined = one.join(many, (F.col(on[0]) == F.col(on[1])) & same_salt & near)
    return joined.drop("_salt_one", "_salt_many")


def enrich(df: DataFrame, dim: DataFrame, key: str, attrs: dict[str, Column | str], *,
           dim_key: str = "id", salts: int = 1, spread_by: str | None = None, dealt: str | None = None) -> DataFrame:
    """Left join `dim` on its unique key and add or overwrite `attrs` (name → dim column).

    A row without a match, or with a null key, keeps what it has: new columns are null and an
    existing column of the same name stays as it was. No broadcast is forced; a dimension below
    the broadcast threshold is sent to every task, a larger one is shuffled.
    """
    found = dim.select(F.expr(f"{dim_key} as _key"), F.expr("true as _hit"), *[
        c.alias(f"_dim_{n}") if isinstance(c, Column) else F.expr(f"{c} as _dim_{n}")
        for n, c in attrs.items()])
    found, df, same_salt = _salted(found, df, spread_by, salts, dealt)
    joined = df.join(found, (F.col(key) == F.col("_key")) & same_salt, "left")
    old = set(df.columns)
    new = {n: F.expr(f"if(_hit, _dim_{n}, {n})" if n in old else f"_dim_{n}") for n in attrs}
    return joined.withColumns(new).drop("_key", "_hit", "_salt_one", "_salt_many",
                                        *[f"_dim_{n}" for n in attrs])


def lookup(dim: DataFrame, match: dict[str, object]) -> DataFrame:
    """Rows of `dim` whose columns equal the given values (text comparison, as dims are text)."""
    return dim.filter(reduce(lambda a, b: a & b, [
        F.col(c).cast("string") == F.lit(str(v)) for c, v in match.items()]))


def product_dim(sku: DataFrame, spu: DataFrame, category3: DataFrame,
                trademark: DataFrame) -> DataFrame:
    """One row per sku with its product, category and brand names, so facts join only once."""
    wide = sku.select("id", "sku_name", "price", "spu_id", "tm_id", "category3_id")
    wide = enrich(wide, spu, "spu_id", {"spu_name": "spu_name"})
    wide = enrich(wide, category3, "category3_id", {"category3_name": "name"})
    return enrich(wide, trademark, "tm_id", {"tm_name": "tm_name"})


def enrich_user(df: DataFrame, users: DataFrame, asof: Column, **options) -> DataFrame:
    return enrich(df, users, "user_id", {"user_gender": "gender",
                                         "user_age": age_years(F.col("birthday"), asof)}, **options)


def enrich_province(df: DataFrame, provinces: DataFrame, **options) -> DataFrame:
    return enrich(df, provinces, "province_id", {
        "province_name": "name", "province_area_code": "area_code",
        "province_iso_code": "iso_code", "province_3166_2_code": "iso_3166_2"}, **options)


PRODUCT_ATTRS = ["sku_name", "spu_id", "spu_name", "tm_id", "tm_name",
                 "category3_id", "category3_name"]


def enrich_product(df: DataFrame, products: DataFrame, *, price: bool = False, **options) -> DataFrame:
    """Product attributes of ``sku_id``; the current sku name replaces the one bought."""
    attrs = {c: c for c in PRODUCT_ATTRS}
    return enrich(df, products, "sku_id", attrs | ({"sku_price": "price"} if price else {}), **options)


BUYER_AND_PLACE = ["user_gender", "user_age", "province_name", "province_area_code", "province_iso_code",
                   "province_3166_2_code"]


def merge_order(order_info: DataFrame, order_detail: DataFrame, *, slack: float = 5.0,
                salts: int = 1) -> DataFrame:
    """Order lines with their order, both written within `slack` seconds of each other. An order's buyer and
    province, where they are looked up already, come along."""
    head = order_info.selectExpr(
        "id as order_id", "province_id", "order_status", "user_id", "total_amount",
        "activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee",
        *[c for c in ("expire_time", "operate_time") if c in order_info.columns],
        "create_time", "date_format(create_time, 'yyyy-MM-dd') as create_date",
        "date_format(create_time, 'HH') as create_hour", *[c for c in BUYER_AND_PLACE if c in order_info.columns])
    line = order_detail.selectExpr(
        "id as detail_id", "order_id as _order", "sku_id", "order_price", "sku_num", "sku_name",
        "split_total_amount", "split_activity_amount", "split_coupon_amount",
        "create_time as _line_time")
    return interval_join(head, line, ("order_id", "_order"), ("create_time", "_line_time"),
                         -slack, slack, salts=salts, spread_by="detail_id"
                         ).drop("_order", "_line_time")


def order_placed(order_info: DataFrame, order_detail: DataFrame, users: DataFrame, provinces: DataFrame,
                 asof: Column, *, slack: float = 5.0, salts: int = 1) -> DataFrame:
    """Order lines with order, buyer and province; these are looked up once per order, not per line."""
    placed = enrich_province(enrich_user(order_info, users, asof), provinces)
    lines = merge_order(placed, order_detail, slack=slack, salts=salts)
    return lines.select(*[c for c in lines.columns if c not in BUYER_AND_PLACE], *BUYER_AND_PLACE)


def order_wide(order_info: DataFrame, order_detail: DataFrame, users: DataFrame,
               provinces: DataFrame, products: DataFrame, asof: Column, *, slack: float = 5.0,
               salts: int = 1) -> DataFrame:
    """Order lines with order, buyer, province and product attributes."""
    return enrich_product(order_placed(order_info, order_detail, users, provinces, asof, slack=slack, salts=salts), products)


def merge_payment(payment_info: DataFrame, wide: DataFrame, *, horizon: float = 1800.0,
                  salts: int = 1) -> DataFrame:
    """Payments with the order lines they pay for, ordered at most `horizon` seconds earlier.

    Fields both sides have come from the payment; the order's time is ``order_create_time``.
    """
    pay = payment_info.selectExpr(
        "id as payment_id", "order_id as _paid_order", "subject", "payment_type",
        "create_time as payment_create_time", "callback_time", "user_id as _pay_user",
        "total_amount as _pay_total")
    lines = wide.withColumnRenamed("create_time", "order_create_time").drop("create_date",
                                                                            "create_hour")
    joined = interval_join(pay, lines, ("_paid_order", "order_id"),
                           ("callback_time", "order_create_time"), -horizon, 0,
                           salts=salts, spread_by="detail_id")
    return joined.withColumns({"user_id": F.col("_pay_user"), "total_amount": F.col("_pay_total")}
                              ).drop("_paid_order", "_pay_user", "_pay_total")


payment_wide = merge_payment


def coalesce_rows(a: DataFrame, b: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Rows of `a` with nulls in `cols` filled from the row of `b` with the same unique key."""
    fill = b.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_b_{c}") for c in cols])
    joined = a.join(fill, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.coalesce(c, f"_b_{c}") for c in cols}).select(*a.columns)
