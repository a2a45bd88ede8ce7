"""The shop's standing jobs: streams in, tables out.

Each function wires operators to a sink and starts one query. Inputs are parsed streams; `base`
is the folder of the warehouse, and checkpoints lie next to the tables under a fixed name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.functions.times import watermarked
from millrace.operators import changes, facts, joins, logs, stats, visits
from millrace.sinks import dims, tables, topics
from millrace.streaming import carried, first_days, stateful, visited
from millrace.streaming.runner import start

Loader = Callable[[], DataFrame]

# Streams have no skew split, so interval joins deal a hot key's rows over this many partitions.
# The copied side is the smaller one, and its state lasts only as long as the join's interval.
SALTS = 4


def _start(df: DataFrame, base: str, name: str, **options) -> StreamingQuery:
    return start(df, name=name, checkpoint=f"{base}/checkpoints/{name}", **options)


def land_lines(lines: DataFrame, base: str, received: str | None = None, **options) -> StreamingQuery:
    """Keep every received line as it came, by the day it came (today, or that of a column)."""
    return _start(topics.raw_lines(lines, received), base, "raw_log", fmt="text", path=f"{base}/raw_log",
                  partition_by=["dt"], **options)


def split_log(lines: DataFrame, base: str, **options) -> list[StreamingQuery]:
    """Raw log lines → one table of start, page and display rows by kind, with repaired flags; bad
    lines aside."""
    good, bad = logs.parse_logs(lines)
    days = first_days.first_days(lines.sparkSession, f"{base}/first_days")

    def each(df: DataFrame, batch_id: int) -> None:
        repaired = first_days.repair_is_new_batch(df, batch_id, days)
        tables.write_batch(logs.tagged_log(repaired), f"{base}/log", batch_id, ["kind"])

    return [_start(logs.flat_log(good), base, "split_log", each=each, **options),
            _start(bad, base, "quarantine_log", path=f"{base}/quarantine_log", **options)]


def route(rows: DataFrame, routes: Loader, base: str, seq: str = "seq", **options) -> StreamingQuery:
    """Changes → dimension log and one folder per fact table. Routes are reread per micro-batch."""
    def each(df: DataFrame, batch_id: int) -> None:
        routed = changes.route_changes(changes.valid_changes(df), routes()).persist()
        dim_rows, fact_rows = changes.split_routes(routed)
        dims.append_changes(dim_rows, f"{base}/dims", batch_id, seq)
        tables.write_batch(topics.rows_by_table(fact_rows), f"{base}/facts", batch_id, ["topic"])
        routed.unpersist()

    return _start(rows, base, "route_changes", each=each, **options)


def unique_visits(pages: DataFrame, base: str, tie: tuple[str, ...] = (), **options) -> StreamingQuery:
    return _start(pages, base, "unique_visit",
                  each=visited.unique_visits_sink(f"{base}/unique_visit", tie=tie), **options)


def user_jumps(pages: DataFrame, base: str, within: float = 10.0, tie: tuple[str, ...] = (), **options) -> StreamingQuery:
    return _start(stateful.user_jumps_stream(pages, within, tie=tie), base, "user_jump_detail",
                  path=f"{base}/user_jump_detail", **options)


def merged_orders(order_info: DataFrame, order_detail: DataFrame, delay: str = "0 seconds",
                  salts: int = SALTS) -> DataFrame:
    """Order lines from two streams whose watermarks follow `create_time`."""
    return joins.merge_order(watermarked(order_info, "create_time", delay),
                             watermarked(order_detail, "create_time", delay), salts=salts)


def order_wide(order_info: DataFrame, order_detail: DataFrame, users: Loader, provinces: Loader,
               products: Loader, base: str, asof: Callable[[], Column] = F.current_date,
               slack: float = 5.0, **options) -> StreamingQuery:
    """Order lines with attributes. Dimensions are asked for anew per micro-batch, so rows get the newest;
    a `dims.DimView` then reads only what has changed."""
    def write(df: DataFrame, batch_id: int) -> None:
        wide = joins.enrich_province(joins.enrich_user(df, users(), asof()), provinces())
        tables.write_batch(joins.enrich_product(wide, products()), f"{base}/order_wide", batch_id)

    def merge(orders: DataFrame, lines: DataFrame) -> DataFrame:
        return joins.merge_order(orders, lines, slack=slack)

    each = carried.joined_sink(f"{base}/order_wide_open", merge, ("create_time", "create_time"), -slack, slack, write)
    return _start(carried.paired(order_info, order_detail), base, "order_wide", each=each, **options)


def merged_payments(payment_info: DataFrame, wide: DataFrame, delay: str = "5 seconds",
                    salts: int = SALTS) -> DataFrame:
    return joins.merge_payment(watermarked(payment_info, "callback_time", delay),
                               watermarked(wide, "create_time", delay), salts=salts)


def payment_wide(payment_info: DataFrame, wide: DataFrame, base: str, horizon: float = 1800.0,
                 **options) -> StreamingQuery:
    def merge(payments: DataFrame, lines: DataFrame) -> DataFrame:
        return joins.merge_payment(payments, lines, horizon=horizon)

    each = carried.joined_sink(f"{base}/payment_wide_open", merge, ("callback_time", "create_time"), -horizon, 0,
                               lambda df, n: tables.write_batch(df, f"{base}/payment_wide", n), delay=5)
    return _start(carried.paired(payment_info, wide), base, "payment_wide", each=each, **options)


def visitor_measures(pages: DataFrame, within: float = 10.0, *, tie: tuple[str, ...] = (),
                     delay: str = "3 seconds") -> DataFrame:
    """Pages, unique visits and bounces of one page stream, as measures on one clock.

    The watermark is that of the pages; bounces come later by their waiting time, and statistics that
    follow in the same query wait for them.
    """
    timed = watermarked(pages, "ts", delay)
    return facts.visitor_events(timed, stateful.unique_visits_stream(timed, tie=tie, delay=None),
                                stateful.user_jumps_stream(timed, within, tie=tie, delay=None))


def visitor_chain(pages: DataFrame, base: str, within: float = 10.0, *, tie: tuple[str, ...] = (),
                  **options) -> StreamingQuery:
    """Page log in, visitor statistics out, in one query.

    Windows are flagged and summed whole once the bounces of their rows are known; from batch to batch go
    the rows of open windows and the stored visits. `visitor_measures` is the same with a state store.
    """
    sink, seen = tables.stats_sink(f"{base}/visitor_stats", "visitor_stats"), f"{base}/visitor_chain_visits"
    store, kinds = visited.unique_visits_sink(seen, tie=tie), StructType([
        *pages.schema.fields, StructField("dt", StringType()), StructField("batch", LongType())])

    def done(over: DataFrame, still: DataFrame, batch_id: int) -> None:
        store(over, batch_id)
        first = over.sparkSession.read.schema(kinds).parquet(seen).filter(F.col("batch") == batch_id)
        known = over.withColumn("_over", F.lit(True)).unionByName(still.withColumn("_over", F.lit(False)))
        jumps = visits.user_jumps(known, within, tie=tie).filter("_over")
        sink(stats.visitor_stats(facts.visitor_events(over, first, jumps)), batch_id)

    each = carried.closed_sink(f"{base}/visitor_chain_open", "ts", done, ahead=within)
    return _start(pages, base, "visitor_chain", each=each, **options)


def visitor_stats(pages: DataFrame, uniques: DataFrame, jumps: DataFrame, base: str,
                  **options) -> StreamingQuery:
    rows = facts.visitor_events(pages, uniques, jumps)
    return _start(stats.visitor_stats(rows), base, "visitor_stats",
                  each=tables.stats_sink(f"{base}/visitor_stats", "visitor_stats"), **options)


def product_stats(behaviours: DataFrame, products: Loader, base: str, **options) -> StreamingQuery:
    """Product statistics; attributes are looked up after the sums, from the newest dimension."""
    sink = tables.stats_sink(f"{base}/product_stats", "product_stats")

    def write(df: DataFrame, batch_id: int) -> None:
        sink(joins.enrich_product(df, products(), price=True), batch_id)

    each = carried.windows_sink(f"{base}/product_stats_open", "ts", stats.product_sums, write)
    return _start(behaviours, base, "product_stats", each=each, **options)


def province_stats(wide: DataFrame, base: str, **options) -> StreamingQuery:
    each = carried.windows_sink(f"{base}/province_stats_open", "create_time", stats.province_stats,
                                tables.stats_sink(f"{base}/province_stats", "province_stats"))
    return _start(wide, base, "province_stats", each=each, **options)


def keyword_search_stats(searches: DataFrame, base: str, **options) -> StreamingQuery:
    return _start(stats.keyword_search_stats(searches), base, "keyword_search",
                  each=tables.stats_sink(f"{base}/keyword_search", "keyword_stats"), **options)


def keyword_product_stats(product_rows: DataFrame, base: str, **options) -> StreamingQuery:
    """Keywords of the products in the statistics stream; no aggregation, so no state."""
    return _start(stats.keyword_product_stats(product_rows), base, "keyword_product",
                  each=tables.stats_sink(f"{base}/keyword_product", "keyword_stats"), **options)


def keyword_stats(spark: SparkSession, base: str) -> DataFrame:
    """The keyword table, fed by searches and by products."""
    return tables.read_table(spark, f"{base}/keyword_search", f"{base}/keyword_product")
