"""The statistics jobs as SQL text over registered views, batch or streaming alike.

Views: ``page_view`` (common, page: maps; rowtime), ``order_wide`` (rowtime), ``product_stats``.
The table functions come from `functions.text.register`. Exact distinct counts are written
in two levels because a stream refuses ``count(distinct ...)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.functions import text
from millrace.functions.times import watermarked, with_event_time

KEYWORD_SEARCH = """
    select keyword, count(*) as ct, 'SEARCH' as source,
           date_format(window.start, 'yyyy-MM-dd HH:mm:ss') as stt,
           date_format(window.end, 'yyyy-MM-dd HH:mm:ss') as edt,
           unix_timestamp() * 1000 as ts
    from page_view, lateral words_of(if(page['page_id'] = 'good_list', page['item'], null)) as w(keyword)
    group by window(rowtime, '10 seconds'), keyword
"""

# A stored product row gives every word of its name once per behaviour that was counted.
KEYWORD_PRODUCT = """
    select scored.*, stt, edt, unix_timestamp() * 1000 as ts
    from product_stats as p, lateral word_scores(p.spu_name, p.click_ct, p.cart_ct, p.order_ct) as scored
"""

PROVINCE = """
    select date_format(window.start, 'yyyy-MM-dd HH:mm:ss') as stt,
           date_format(window.end, 'yyyy-MM-dd HH:mm:ss') as edt,
           province_id, province_name, province_area_code as area_code,
           province_iso_code as iso_code, province_3166_2_code as iso_3166_2,
           cast(sum(amount) as decimal(28,4)) as order_amount, count(order_id) as order_count,
           unix_timestamp() * 1000 as ts
    from (select window, province_id, province_name, province_area_code, province_iso_code,
                 province_3166_2_code, order_id,
                 sum(coalesce(cast(split_total_amount as decimal(18,4)), 0)) as amount
          from (select window(rowtime, '10 seconds') as window, * from order_wide)
          group by window, province_id, province_name, province_area_code, province_iso_code,
                   province_3166_2_code, order_id)
    group by window, province_id, province_name, province_area_code, province_iso_code,
             province_3166_2_code
"""


def page_view(rows: DataFrame, delay: str = "3 seconds") -> None:
    """Register log rows with `ts` millis as ``page_view``; event time is in whole seconds."""
    with_event_time(rows, "ts", "rowtime", "seconds", delay).createOrReplaceTempView("page_view")


def order_wide(rows: DataFrame, time: str = "create_time", delay: str = "3 seconds") -> None:
    """Register wide order lines as ``order_wide``; `time` is a timestamp or its text."""
    if dict(rows.dtypes)[time] == "string":
        timed = with_event_time(rows, time, "rowtime", "text", delay)
    else:
        timed = watermarked(rows.withColumnRenamed(time, "rowtime"), "rowtime", delay)
    timed.createOrReplaceTempView("order_wide")


def run(spark: SparkSession, sql: str) -> DataFrame:
    text.register(spark)
    return spark.sql(sql)
