"""The shop's inputs as views over the given benchmark tables.

Each method is one input of the operators. Column types follow the shop's own tables; times are
session-zone timestamps.
"""

from __future__ import annotations

from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.operators.joins import product_dim
from millrace.operators.neighbours import with_neighbour

HOUR = 3600

# The page each kind of event stands for; other kinds have no page id.
PAGES = {"click": "good_detail", "view": "good_list", "signup": "home", "purchase": "cart"}

# source table, operation, sink type, sink table, fields kept, key
ROUTES = [
    ("user_info", "insert", "hbase", "dim_user_info", "id,name", "id", None),
    ("user_info", "update", "hbase", "dim_user_info", "id,name", "id", None),
    ("order_info", "insert", "kafka", "dwd_order_info", "", "id", None),
    ("base_trademark", "insert", "clickhouse", "brand_stats", "id", None, None),
]


MONEY = "decimal(16,2)"
NO_MONEY = f"cast(0 as {MONEY})"
NO_TEXT = "cast(null as string)"


def _later(time: str, secs: str) -> str:
    return f"timestamp_micros(unix_micros({time}) + cast({secs} as bigint) * 1000000)"


def once(method):
    """Build a frame only once per object (or per first argument); frames are lazy plans."""
    @wraps(method)
    def get(self, *args):
        key = (method.__name__, *args)
        if key not in self.frames:
            self.frames[key] = method(self, *args)
        return self.frames[key]
    return get


class ShopTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.frames: dict[tuple, DataFrame] = {}

    @once
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def size(self) -> int:
        """Rows of the tables that grow, as their files' footers tell."""
        large = [self.table(name).select(F.lit(1)) for name in ("orders", "lineitem", "events")]
        return reduce(DataFrame.unionAll, large).count()

    # ---- event log -------------------------------------------------------------------------

    def _events(self, page_id: str | None = None) -> DataFrame:
        """Every event as a page view, or only those of one page (filtered in the scan)."""
        events = self.table("events")
        if page_id:
            kind = next(k for k, p in PAGES.items() if p == page_id)
            events, page = events.filter(F.col("event_type") == kind), f"'{page_id}'"
        else:
            cases = " ".join(f"when '{k}' then '{p}'" for k, p in PAGES.items())
            page = f"case event_type {cases} else '' end"
        return events.selectExpr(
            "event_id", "user_id", "cast(ts as timestamp) as ts", f"{page} as page_id",
            "get_json_object(props, '$.k') as item",
            "cast(round(value * 100) as bigint) * 10 as during_time")

    @once
    def page_views(self) -> DataFrame:
        """Page views without their previous page."""
        return self._events()

    @once
    def page_log(self) -> DataFrame:
        """Page views; the previous page is known when it was opened less than 6 hours before."""
        linked = with_neighbour(self._events(), "user_id", "ts", {"last_page_id": "page_id"},
                                reach=6 * HOUR, slice_seconds=HOUR // 6, direction="prev",
                                tie=("event_id",))
        return linked.selectExpr(
            "event_id", "concat('m', user_id) as mid", "ts", "page_id", "last_page_id", "item",
            "during_time", "concat('v', user_id % 3) as vc", "concat('c', user_id % 5) as ch",
            "concat('a', user_id % 7) as ar", "if(event_id % 2 = 0, '1', '0') as is_new")

    @once
    def display_log(self) -> DataFrame:
        return self._exposed(self._events("good_list")).select(
            "event_id", "ts", F.inline("displays"))

    @staticmethod
    def _exposed(pages: DataFrame) -> DataFrame:
        return pages.withColumn("displays", F.expr("""
            transform(sequence(0, cast(event_id % 3 as int)), i -> struct(
                cast((cast(item as int) + i) % 100 as string) as item,
                if((event_id + i) % 2 = 0, 'sku_id', 'activity_id') as item_type))"""))

    def broken_log(self) -> DataFrame:
        """Log lines that were cut off, one for some of the events."""
        cut = self.table("events").filter("event_id % 50 = 3")
        return cut.select(F.concat(F.lit('{"common":{"mid":"m'), "user_id").alias("value"))

    def received_lines(self) -> DataFrame:
        """Lines as they reached the collector, with the time they did."""
        return self.table("events").select(F.col("props").alias("value"), F.col("ts").cast("timestamp").alias("received"))

    def raw_log(self) -> DataFrame:
        """The log as JSON lines: one per page view, plus one start line per signup."""
        log = self._exposed(self.page_log())
        common = F.struct("mid", "vc", "ch", "ar", "is_new").alias("common")
        ms = F.unix_millis("ts").alias("ts")
        page = log.select(F.to_json(F.struct(
            common, F.struct("page_id", "last_page_id", "item", "during_time").alias("page"),
            F.when(F.col("page_id") == "good_list", F.col("displays")).alias("displays"),
            ms)).alias("value"))
        start = log.filter("page_id = 'home'").select(F.to_json(F.struct(
            common, F.struct(F.lit("icon").alias("entry")).alias("start"), ms)).alias("value"))
        return page.unionByName(start)

    @once
    def search_log(self) -> DataFrame:
        names = self.table("part").select("p_partkey", F.col("p_name").alias("fullword"))
        asked = self._events("good_list").select(
            "event_id", "ts", F.col("item").cast("bigint").alias("_item"))
        return asked.join(names, F.col("_item") == F.col("p_partkey"), "left").select(
            "event_id", "ts", "fullword")

    def _sku_events(self, page_id: str) -> DataFrame:
        return self._events(page_id).selectExpr("cast(item as bigint) as sku_id",
                                                "ts as create_time")

    def favor_info(self) -> DataFrame:
        return self._sku_events("home")

    def cart_info(self) -> DataFrame:
        return self._sku_events("cart")

    # ---- orders ----------------------------------------------------------------------------

    @once
    def _order_times(self) -> DataFrame:
        ordered = _later("cast(o_orderdate as timestamp)", "o_orderkey % 86400")
        return self.table("orders").selectExpr(
            "o_orderkey as id", "o_custkey as user_id", "o_orderstatus as order_status",
            f"cast(o_totalprice as {MONEY}) as total_amount", f"{ordered} as create_time")

    @once
    def order_info(self, located: bool = True) -> DataFrame:
        """Orders; without `located` the province is left null and the buyers are not read."""
        heads, place = self._order_times(), "cast(null as bigint) as province_id"
        if located:
            homes = self.table("customer").selectExpr("c_custkey", "c_nationkey")
            heads = heads.join(homes, F.expr("user_id = c_custkey"), "left")
            place = "cast(c_nationkey as bigint) as province_id"
        return heads.selectExpr(
            "id", place, "order_status", "user_id", "total_amount",
            f"{NO_MONEY} as activity_reduce_amount", f"{NO_MONEY} as coupon_reduce_amount",
            "total_amount as original_total_amount", f"{NO_MONEY} as feight_fee",
            f"{NO_TEXT} as expire_time", "create_time", f"{NO_TEXT} as operate_time")

    @once
    def order_detail(self) -> DataFrame:
        heads = self._order_times().selectExpr("id as _order", "create_time as _ordered")
        price, rate = f"cast(l_extendedprice as {MONEY})", "cast(l_discount as decimal(4,2))"
        return self.table("lineitem").join(heads, F.expr("l_orderkey = _order")).selectExpr(
            "l_orderkey * 10 + l_linenumber as id", "l_orderkey as order_id",
            "l_partkey as sku_id", f"{price} as order_price", "cast(l_quantity as bigint) as sku_num",
            f"{NO_TEXT} as sku_name", f"{_later('_ordered', 'l_linenumber * 2 - 5')} as create_time",
            f"{price} * (1 - {rate}) as split_total_amount", f"{NO_MONEY} as split_activity_amount",
            f"{price} * {rate} as split_coupon_amount", "l_returnflag", "l_linestatus", "l_linenumber")

    @once
    def payment_info(self) -> DataFrame:
        return self._order_times().filter("order_status <> 'O'").selectExpr(
            "id", "id as order_id", "user_id", "total_amount", f"{NO_TEXT} as subject",
            "cast(1101 + id % 3 as string) as payment_type",
            f"{_later('create_time', 'id % 2400')} as create_time",
            f"{_later('create_time', 'id % 2400 + 5')} as callback_time")

    def refund_info(self) -> DataFrame:
        return self.order_detail().filter("l_returnflag = 'R'").selectExpr(
            "sku_id", "order_id", "order_price as refund_amount", "create_time")

    def comment_info(self) -> DataFrame:
        return self.order_detail().filter("l_linestatus = 'F'").selectExpr(
            "sku_id", "cast(1201 + l_linenumber % 4 as string) as appraise", "create_time")

    # ---- dimensions ------------------------------------------------------------------------

    def dim_user(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey as id", "date_add(date'1950-01-01', cast(c_custkey % 18000 as int)) as birthday",
            "if(c_custkey % 2 = 0, 'M', 'F') as gender")

    def dim_province(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "cast(n_nationkey as bigint) as id", "n_name as name",
            "cast(n_regionkey as string) as area_code", "concat('P', n_nationkey) as iso_code",
            "concat('CN-', n_nationkey) as iso_3166_2")

    @once
    def _named(self, column: str) -> DataFrame:
        """One id per distinct text: the smallest part key that carries it."""
        return self.table("part").groupBy(column).agg(F.min("p_partkey").alias("_id"))

    def dim_spu(self) -> DataFrame:
        return self._named("p_name").selectExpr("_id as id", "p_name as spu_name")

    def dim_category3(self) -> DataFrame:
        return self._named("p_type").selectExpr("_id as id", "p_type as name")

    def dim_trademark(self) -> DataFrame:
        return self.table("part").selectExpr(
            "cast(substring(p_brand, 7) as bigint) as id", "p_brand as tm_name").distinct()

    def dim_sku(self) -> DataFrame:
        spu = self._named("p_name").selectExpr("p_name as _name", "_id as spu_id")
        cat = self._named("p_type").selectExpr("p_type as _type", "_id as category3_id")
        return self.table("part").join(spu, F.expr("p_name = _name")).join(
            cat, F.expr("p_type = _type")).selectExpr(
            "p_partkey as id", "p_name as sku_name", f"cast(p_retailprice as {MONEY}) as price",
            "spu_id", "cast(substring(p_brand, 7) as bigint) as tm_id", "category3_id")

    @once
    def products(self) -> DataFrame:
        return product_dim(self.dim_sku(), self.dim_spu(), self.dim_category3(),
                           self.dim_trademark())

    # ---- change data -----------------------------------------------------------------------

    def captured_changes(self) -> DataFrame:
        """Captured records as JSON lines with a sequence number."""
        users = self.table("customer").select("c_custkey", "c_name")
        key = F.col("c_custkey")

        record = self._record

        user = F.struct(key.alias("id"), F.col("c_name").alias("name"), (key % 7).alias("level"))
        renamed = F.struct(key.alias("id"), F.concat("c_name", F.lit("x")).alias("name"))
        order = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
        nation = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
        broken = users.filter(key % 40 == 1).select(
            F.lit(4).cast("bigint").alias("seq"), F.concat(F.lit('{"after":{"id":'), key).alias("value"))
        return (record(users, "user_info", 1, "c", user)
                .unionByName(record(users.filter(key % 5 == 0), "user_info", 2, "u", renamed))
                .unionByName(record(users.filter(key % 50 == 0), "user_info", 3, "d", None, renamed))
                .unionByName(record(self.table("orders"), "order_info", 1, "c", order))
                .unionByName(record(self.table("nation"), "base_province", 1, "bootstrap-insert", nation))
                .unionByName(broken))

    @staticmethod
    def _record(rows: DataFrame, table: str, seq: int, op: str, after: Column | None,
                before: Column | None = None) -> DataFrame:
        """Captured records of one table, as JSON lines; a delete has only the row before it."""
        source = F.struct(F.lit("shop").alias("db"), F.lit(table).alias("table"))
        sides = [c.alias(n) for c, n in ((before, "before"), (after, "after")) if c is not None]
        return rows.select(F.lit(seq).cast("bigint").alias("seq"), F.to_json(F.struct(
            *sides, source.alias("source"), F.lit(op).alias("op"))).alias("value"))

    def captured_routes(self) -> DataFrame:
        """Captured changes of the route table: one route per nation, renamed for some, deleted for others."""
        nations, key = self.table("nation"), F.col("n_nationkey")

        def route(sink: Column) -> Column:
            return F.struct(F.col("n_name").alias("sourceTable"), F.lit("insert").alias("operateType"),
                            F.lit("kafka").alias("sinkType"), sink.alias("sinkTable"))

        name, other = F.concat(F.lit("dwd_"), key), F.concat(F.lit("ods_"), key)
        return (self._record(nations, "table_process", 1, "c", route(name))
                .unionByName(self._record(nations.filter(key % 3 == 0), "table_process", 2, "u", route(other)))
                .unionByName(self._record(nations.filter(key % 5 == 0), "table_process", 3, "d", None, route(name))))

    def logged_users(self) -> DataFrame:
        """Captured changes of the user table with their positions in the log, one position each."""
        lines = self.captured_changes().filter(F.get_json_object("value", "$.source.table") == "user_info")
        key = F.coalesce(F.get_json_object("value", "$.after.id"), F.get_json_object("value", "$.before.id"))
        return lines.withColumn("seq", F.col("seq") * 1_000_000_000 + key.cast("bigint"))

    def changes(self) -> DataFrame:
        """Typed changes of the user table, deletes with the row they remove."""
        users = self.table("customer").select(F.col("c_custkey").alias("id"), "c_name")

        def change(rows: DataFrame, seq: int, kind: str, name: Column) -> DataFrame:
            return rows.select(F.lit(seq).cast("bigint").alias("seq"),
                               F.lit("user_info").alias("table"), F.lit(kind).alias("type"), "id",
                               name.alias("name"))

        return (change(users, 1, "insert", F.col("c_name"))
                .unionByName(change(users.filter("id % 5 = 0"), 2, "update",
                                    F.concat("c_name", F.lit("x"))))
                .unionByName(change(users.filter("id % 50 = 0"), 3, "delete", F.col("c_name"))))

    def routes(self) -> DataFrame:
        return self.spark.createDataFrame(
            ROUTES, "source_table string, operate_type string, sink_type string, "
                    "sink_table string, sink_columns string, sink_pk string, sink_extend string")
