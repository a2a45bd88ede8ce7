import datetime
from decimal import Decimal as D

from conftest import at, rows
from pyspark.sql import functions as F

from millrace import schemas
from millrace.operators import facts, joins, serving, stats
from millrace.streaming import jobs
from millrace.streaming.replay import Feed, replay

ORDER = schemas.ORDER_INFO.replace("create_time STRING", "create_time TIMESTAMP")
DETAIL = schemas.ORDER_DETAIL.replace("create_time STRING", "create_time TIMESTAMP")
PAY = schemas.PAYMENT_INFO.replace("create_time STRING", "create_time TIMESTAMP").replace(
    "callback_time STRING", "callback_time TIMESTAMP")


def order(spark, *data):
    """(id, province, user, time)"""
    return spark.createDataFrame([(i, p, "1001", u, D(10), None, None, D(10), None, None, t, None)
                                  for i, p, u, t in data], ORDER)


def detail(spark, *data):
    """(id, order, sku, amount, time)"""
    return spark.createDataFrame([(i, o, s, D(5), 2, f"bought {s}", t, a, None, None)
                                  for i, o, s, a, t in data], DETAIL)


def payment(spark, *data):
    """(id, order, callback time)"""
    return spark.createDataFrame([(i, o, 9, D(7), "s", "1101", t, t) for i, o, t in data], PAY)


def lines(spark):
    head = order(spark, (1, 5, 100, at(100)))
    offsets = [-5.001, -5, 0, 5, 5.001]
    line = detail(spark, *[(i, 1, 7, D(1), at(100 + o)) for i, o in enumerate(offsets)],
                  (9, 2, 7, D(1), at(100)))
    return head, line


def test_order_interval_bounds(spark):
    head, line = lines(spark)
    for salts in (1, 4):
        got = joins.merge_order(head, line, salts=salts)
        assert [r[0] for r in rows(got, "detail_id")] == [1, 2, 3]
    assert rows(joins.merge_order(head, line), "create_date", "create_hour")[0] == ("2021-05-01", "00")


def test_order_interval_stream(spark):
    head, line = lines(spark)
    out = replay(spark, "orders", {"o": Feed(head, "create_time"), "d": Feed(line, "create_time")},
                 lambda s: jobs.merged_orders(s["o"], s["d"], delay="10 seconds", salts=2))
    assert [r[0] for r in rows(spark.read.parquet(out), "detail_id")] == [1, 2, 3]


def test_payment_interval_bounds_and_merge(spark):
    head, line = lines(spark)
    wide = joins.merge_order(head, line.filter("id = 2"))
    pay = payment(spark, (1, 1, at(1900)), (2, 1, at(1900.001)), (3, 1, at(100)), (4, 1, at(99.999)))
    got = joins.merge_payment(pay, wide)
    assert rows(got, "payment_id", "user_id", "total_amount", "order_create_time") == [
        (1, 9, D("7.00"), at(100)), (3, 9, D("7.00"), at(100))]
    assert "create_time" not in got.columns


def test_enrich_keeps_rows_without_a_dimension(spark):
    df = spark.createDataFrame([(1, 7, "old"), (2, 8, "old"), (3, None, "old")],
                               "id bigint, sku_id bigint, sku_name string")
    dim = spark.createDataFrame([(7, "new", 3)], "id bigint, sku_name string, spu_id bigint")
    for options in ({}, {"salts": 3, "spread_by": "id"}):
        got = joins.enrich(df, dim, "sku_id", {"sku_name": "sku_name", "spu_id": "spu_id"}, **options)
        assert rows(got, "id", "sku_name") == [(1, "new"), (2, "old"), (3, "old")]
        assert got.filter("spu_id = 3").count() == 1


def test_ages(spark):
    dim = spark.createDataFrame([(1, datetime.date(2000, 2, 29), "M"), (2, datetime.date(2000, 6, 1), "F")],
                                "id bigint, birthday date, gender string")
    df = spark.createDataFrame([(1,), (2,), (3,)], "user_id bigint")

    def ages(day):
        out = joins.enrich_user(df, dim, F.lit(day).cast("date"))
        return {r["user_id"]: r["user_age"] for r in out.collect()}

    assert ages("2021-02-28") == {1: 20, 2: 20, 3: None}
    assert ages("2021-03-01")[1] == 21
    assert ages("2021-05-31")[2] == 20 and ages("2021-06-01")[2] == 21


def test_product_dim_survives_missing_links(spark):
    sku = spark.createDataFrame([(1, "a", D(2), 5, 6, 7), (2, "b", D(3), 50, None, 7)],
                                "id bigint, sku_name string, price decimal(16,2), spu_id bigint, "
                                "tm_id bigint, category3_id bigint")
    one = lambda name, key: spark.createDataFrame([(key, "n")], f"id bigint, {name} string")
    got = joins.product_dim(sku, one("spu_name", 5), one("name", 7), one("tm_name", 6))
    assert {r["id"]: (r["spu_name"], r["category3_name"], r["tm_name"]) for r in got.collect()} == {
        1: ("n", "n", "n"), 2: (None, "n", None)}


def test_skewed_join_is_split(spark):
    """A hot key's partition is read by several tasks."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        facts_ = spark.range(0, 200000, 1, 8).select(
            "id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("sku_id"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        dim = spark.range(200000).select("id", F.concat(F.lit("n"), "id").alias("sku_name"))
        got = joins.enrich(facts_, dim, "sku_id", {"sku_name": "sku_name"})
        joined = got.agg(F.count("sku_name"), F.max("payload"))
        assert joined.collect()[0][0] == 200000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_coalesce_rows(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, 5, None), (3, None, None)], "id int, n int, s string")
    b = spark.createDataFrame([(1, 8, "y"), (2, 9, "z")], "id int, n int, s string")
    assert joins.coalesce_rows(a, b, "id", ["n", "s"]).orderBy("id").collect() == [
        (1, 8, "x"), (2, 5, "z"), (3, None, None)]


def behaviours(spark):
    head = order(spark, (1, 5, 100, at(101)), (2, 5, 100, at(102)))
    wide = joins.merge_order(head, detail(
        spark, (10, 1, 7, D("1.50"), at(101)), (11, 1, 7, None, at(101)), (12, 2, 8, D(4), at(102))))
    carts = spark.createDataFrame([(7, at(105))], "sku_id bigint, create_time timestamp")
    comments = spark.createDataFrame([(7, "1201", at(109.999)), (7, "1202", at(110)), (None, "1201", at(1))],
                                     "sku_id bigint, appraise string, create_time timestamp")
    return facts.product_behaviours(facts.product_orders(wide), facts.product_carts(carts),
                                    facts.product_comments(comments))


def test_product_window(spark):
    got = {(r["stt"], r["sku_id"]): r for r in stats.product_sums(behaviours(spark)).collect()}
    row = got["2021-05-01 00:01:40", 7]
    assert (row["order_ct"], row["order_amount"], row["order_sku_num"]) == (1, D("1.5000"), 4)
    assert (row["cart_ct"], row["click_ct"], row["comment_ct"], row["good_comment_ct"]) == (1, 0, 1, 1)
    assert row["ts"] == int(at(101).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    assert got["2021-05-01 00:01:40", 8]["order_ct"] == 1       # a window with one row
    assert got["2021-05-01 00:01:50", 7]["comment_ct"] == 1     # the next window starts at 110 s
    assert len(got) == 3


def test_literal_carts_count_as_clicks(spark):
    carts = spark.createDataFrame([(7, at(105))], "sku_id bigint, create_time timestamp")
    assert facts.product_carts(carts, literal=True).columns == ["sku_id", "click_ct", "ts"]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    from millrace.streaming.runner import finish, start
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    shape = "sku_id bigint, create_time timestamp"
    reports = []
    for batch in ([(1, at(0)), (1, at(100))], [(1, at(1)), (1, at(101))], [(1, at(1000))]):
        spark.createDataFrame(batch, shape).write.mode("append").parquet(src)
        stream = spark.readStream.schema(shape).parquet(src)
        sums = stats.product_sums(facts.product_behaviours(facts.product_favors(stream)))
        reports += finish(start(sums, name="late", once=True, path=out, checkpoint=str(tmp_path / "cp")))
    got = rows(spark.read.parquet(out), "stt", "favor_ct")
    assert got == [("2021-05-01 00:00:00", 1), ("2021-05-01 00:01:40", 2)]
    assert sum(r["late_rows"] for r in reports) == 1


def test_visitor_literal_bounces(spark):
    shape = "mid string, vc string, ch string, ar string, is_new string, ts timestamp, last_page_id string, during_time bigint"
    pages = spark.createDataFrame([("m", "v", "c", "a", "1", at(1), None, 5), ("m", "v", "c", "a", "1", at(2), "home", None)], shape)
    none = pages.filter("false")
    real = stats.visitor_stats(facts.visitor_events(pages, pages.limit(1), none)).first()
    assert (real["uv_ct"], real["pv_ct"], real["sv_ct"], real["uj_ct"], real["dur_sum"]) == (1, 2, 1, 0, 5)
    literal = stats.visitor_stats(facts.visitor_events(pages, pages.limit(1), none, literal=True)).first()
    assert literal["uj_ct"] == literal["uv_ct"] == 1


VISITOR = "stt string, is_new string, uv_ct bigint, pv_ct bigint, sv_ct bigint, uj_ct bigint, dur_sum bigint"


def visitor(spark, *data):
    return spark.createDataFrame(list(data), VISITOR)


def test_visitor_matrix_with_one_side_missing(spark):
    v = visitor(spark, ("2021-05-01 23:10:00", "1", 3, 7, 3, 1, 10000), ("2021-05-02 00:00:00", "0", 1, 1, 0, 1, 5))
    got = {r["type"]: (r["new"], r["old"]) for r in serving.visitor_matrix(v, 20210501).collect()}
    assert got == {"uv": (D("3.00"), D(0)), "pv": (D(7), D(0)), "uj_rate": (D("33.33"), D(0)),
                   "dur_per_sv": (D("3.30"), D(0)), "pv_per_sv": (D("2.33"), D(0))}
    no_visits = {r["type"]: r["old"] for r in serving.visitor_matrix(v, 20210502).collect()}
    assert no_visits["uv"] == 1 and no_visits["uj_rate"] == 0      # sv = 0 with uv > 0


def test_half_up(spark):
    v = visitor(spark, ("x", "1", 1, 1, 8, 1, 8 * 1050), ("y", "1", 1, 5, 1000, 0, 0))
    got = [tuple(r) for r in serving.visit_ratios(v).orderBy("stt").select("uj_rate", "dur_per_sv", "pv_per_sv").collect()]
    assert got == [(D("12.50"), D("1.1"), D("0.13")), (D("0.00"), D("0.0"), D("0.01"))]


def test_hours(spark):
    v = visitor(spark, ("2021-05-01 23:10:00", "1", 3, 7, 3, 1, 1), ("2021-05-01 23:20:00", "0", 2, 1, 0, 1, 5))
    got = rows(serving.visitors_by_hour(v, 20210501))
    assert len(got) == 24 and got[23] == ("23", 5, 8, 3) and got[0] == ("00", 0, 0, 0)
    assert len(rows(serving.visitors_by_hour(v, 20210501, literal=True))) == 23
    assert len(rows(serving.visitors_by_hour(v, None))) == 24
    assert sum(r[1] for r in rows(serving.visitors_by_hour(v, 20200101))) == 0


def test_rankings(spark):
    s = spark.createDataFrame(
        [("2021-05-01 01:00:00", i, f"b{i}", D(a)) for i, a in ((1, 5), (2, 9), (3, 0), (4, 9))],
        "stt string, tm_id bigint, tm_name string, order_amount decimal(28,4)")
    one_day = [r["tm_id"] for r in serving.top_brands(s, 20210501, 2).collect()]
    every_day = sorted(r["tm_id"] for r in serving.top_brands(s, None, 2).collect())
    assert one_day == [2, 4] == every_day
    assert serving.top_brands(s, 20210501).count() == 3
    assert serving.gmv(s, 20210501).first()[0] == 23 and serving.gmv(s, 20210502).first()[0] is None
    today = serving.on_day(s, 0, asof=datetime.date(2021, 5, 1))
    assert today.count() == 4


def test_hot_keywords(spark):
    k = spark.createDataFrame([("a", 3, "CLICK"), ("b", 1, "SEARCH"), ("c", 3, "ORDER"), ("d", 1, "other")],
                              "keyword string, ct bigint, source string").withColumn("stt", F.lit("2021-05-01 00:00:00"))
    got = [(r["keyword"], r["ct"]) for r in serving.hot_keywords(k, 20210501).collect()]
    assert got == [("a", 3), ("c", 9), ("b", 10), ("d", 0)]
    weighted = [r["keyword"] for r in serving.hot_keywords(k, 20210501, 2, rank_by="weight").collect()]
    assert weighted == ["b", "c"]


def test_day_measures(spark):
    v = visitor(spark, ("2021-05-01 23:10:00", "1", 3, 7, 3, 1, 1), ("2021-05-01 23:20:00", "0", 2, 1, 0, 1, 5))
    assert serving.pv(v, 20210501).first()[0] == 8 and serving.uv(v, 20210501).first()[0] == 5
    assert serving.pv(v, 20210501, literal=True).first()[0] == 2


def test_day_sums_and_stored_sets(spark):
    from millrace.operators import distinct
    rows_ = spark.createDataFrame([("a", 1), ("a", 1), ("a", 40_000), ("b", 7), ("b", None), ("b", -3), ("a", 2**40)], "k string, id bigint")
    sets = distinct.id_sets(rows_, "id", "k")
    assert rows(distinct.set_sizes(sets, "k"), "k", "distinct_ct") == [("a", 3), ("b", 2)]
    both = sets.unionByName(distinct.id_sets(rows_.filter("k = 'a'"), "id", "k"))       # overlapping parts
    assert rows(distinct.set_sizes(both, "k"), "k", "distinct_ct") == [("a", 3), ("b", 2)]
    assert sets.filter("k = 'a'").count() == 3          # one bucket per 32,768 neighbouring ids
    sums = spark.createDataFrame([("2021-05-01 00:00:00", 1, 2), ("2021-05-01 10:00:00", 1, 3), ("2021-05-02 00:00:00", 1, 5)],
                                 "stt string, sku_id bigint, order_ct bigint")
    assert rows(stats.day_sums(sums, "order_ct"), "dt", "order_ct") == [(20210501, 5), (20210502, 5)]


def test_rankings_read_orders_alone(spark):
    import os
    if not os.path.isdir("/root/testdata/sf0.001"):
        return
    from millrace.plans import queries
    plan = queries.queries()["top_brands"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "event_type" not in plan and "l_orderkey" in plan


def test_partitions_grow_with_the_input(spark):
    from millrace import session
    before = spark.conf.get(session.INITIAL_PARTITIONS, None)
    try:
        session.tune(spark, 1000)
        assert spark.conf.get(session.INITIAL_PARTITIONS, None) == before       # small inputs keep what was set
        session.tune(spark, 30 * session.TASK_ROWS + 1)
        assert spark.conf.get(session.INITIAL_PARTITIONS) == "31"
        session.tune(spark, 10)                                                 # never fewer again
        assert spark.conf.get(session.INITIAL_PARTITIONS) == "31"
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "16m"
    finally:
        spark.conf.unset(session.INITIAL_PARTITIONS) if before is None else spark.conf.set(session.INITIAL_PARTITIONS, before)


def test_product_rows_are_dealt_once(spark):
    from millrace.operators import stats as operators
    products = spark.range(50_000).selectExpr("id", "concat('s', id) as sku_name", "cast(1 as decimal(16,2)) as price", "id as spu_id",
                                              "'spu' as spu_name", "id as tm_id", "'tm' as tm_name", "id as category3_id", "'c' as category3_name")
    orders = spark.range(3000).selectExpr("id % 7 as sku_id", "1L as order_sku_num", "cast(2 as decimal(18,4)) as order_amount",
                                          "id as order_id", "timestamp_seconds(id % 90) as ts")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = operators.product_stats([orders], products)
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        fact_side = [line for line in plan.splitlines() if "Exchange hashpartitioning(sku_id" in line or "Exchange hashpartitioning(window" in line]
        assert len([line for line in fact_side if "order_id" not in line.split("(", 1)[1].split(")")[0]]) == 1, plan
        assert got.filter("sku_name is null").count() == 0
        assert got.agg(F.sum("order_ct"), F.sum("order_amount")).first()[:] == (3000, D(6000))
        assert got.count() == got.select("stt", "sku_id").distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_sets_of_few_ids_are_small(spark):
    from millrace.operators import distinct
    ids = [n for i in range(200) for n in (i * 100_000, i * 100_000 + 63, -i * 100_000 - 64, i * 100_000)]
    sets = distinct.id_sets(spark.createDataFrame([("a", n) for n in ids], "k string, id long"), "id", "k")
    assert dict(sets.dtypes)["ids"] == "bigint" and sets.count() <= len(set(ids))
    assert rows(distinct.set_sizes(sets, "k"), "k", "distinct_ct") == [("a", len(set(ids)))]
