import datetime
import json
from decimal import Decimal as D

from conftest import at, rows
from pyspark.sql import functions as F

from millrace import schemas
from millrace.codes import CODES, code_labels
from millrace.functions import text
from millrace.functions.times import with_event_time
from millrace.operators import changes
from millrace.plans import sql_jobs
from millrace.sinks import dims, tables, topics
from millrace.sources.changes import load_routes, normalize_change, parse_change, read_changes
from millrace.sources.topics import parse_json, read_json_topic, read_topic, split_corrupt, to_json_rows
from millrace.streaming import jobs
from millrace.streaming.runner import finish


def captured(table, op, after, db="shop"):
    return (json.dumps({"after": after, "source": {"db": db, "table": table}, "op": op}),)


def lines(spark, data):
    return spark.createDataFrame(list(data), "value string")


def test_normalize_change(spark):
    df = lines(spark, [captured("t_user", "c", {"name": "lisi"}), captured("t_user", "u", {"id": 3, "ok": True}),
                       captured("t_user", "d", None), captured("t_user", "r", {"id": 1}), ("oops",)])
    got = [(r["type"], dict(r["data"])) for r in normalize_change(df)[0].collect()]
    assert got == [("insert", {"name": "lisi"}), ("update", {"id": "3", "ok": "true"}), ("delete", {}),
                   ("read", {"id": "1"})]
    one = normalize_change(df)[0].toJSON().first()
    assert json.loads(one) == {"database": "shop", "table": "t_user", "type": "insert", "data": {"name": "lisi"}}
    assert [r[0] for r in normalize_change(df)[1].collect()] == ["oops"]
    raw, _ = normalize_change(df, op_field="operation", map_create=False)
    assert raw.columns == ["database", "table", "operation", "data"] and raw.first()["operation"] == "create"


def envelope(table, kind, data):
    return (json.dumps({"database": "shop", "table": table, "type": kind, "data": data}),)


ROUTES = [("user", "insert", "hbase", "dim_user", "id,name", None, None),
          ("order", "insert", "kafka", "dwd_order", "", None, None),
          ("brand", "insert", "clickhouse", "x", None, None, None)]
ROUTE_SCHEMA = ", ".join(f"{c} string" for c in schemas.ROUTE_COLUMNS)


def test_routing(spark):
    df, _ = parse_change(lines(spark, [
        envelope("user", "bootstrap-insert", {"id": 1, "name": "a", "name ": "b", "pw": "c"}),
        envelope("user", "update", {"id": 1}), envelope("user", "insert", {}), envelope("", "insert", {"a": 1}),
        envelope("order", "insert", {"id": 2, "x": 3}), envelope("brand", "insert", {"id": 2}),
        envelope("other", "insert", {"id": 2})]))
    valid = changes.valid_changes(df)
    assert valid.count() == 5
    routes = spark.createDataFrame(ROUTES, ROUTE_SCHEMA)
    dim, fact = changes.split_routes(changes.route_changes(valid, load_routes(routes)))
    assert [(r["sink_table"], r["type"], r["data"]) for r in dim.collect()] == [
        ("dim_user", "insert", {"id": "1", "name": "a"})]
    assert [(r["sink_table"], r["data"]) for r in fact.collect()] == [("dwd_order", {"id": "2", "x": "3"})]
    assert rows(changes.unrouted(valid, routes), "table", "type") == [("other", "insert"), ("user", "update")]


def test_routes_from_changes(spark):
    def route(seq, kind, table, sink, names="snake"):
        data = {"source_table": table, "operate_type": "insert", "sink_type": "kafka", "sink_table": sink}
        if names == "camel":
            data = {"sourceTable": table, "operateType": "insert", "sinkType": "kafka", "sinkTable": sink}
        return (seq, kind, data)

    df = spark.createDataFrame([
        route(1, "insert", "a", "a1"), route(2, "update", "a", "a2", "camel"), route(1, "insert", "b", "b1"),
        route(2, "delete", "b", "b1"), (3, "delete", {})], "seq int, type string, data map<string,string>")
    assert rows(load_routes(df, "seq"), "source_table", "sink_table") == [("a", "a2")]


def test_captured_deletes_take_effect(spark, tmp_path):
    def record(op, before, after):
        return (json.dumps({"before": before, "after": after, "source": {"db": "shop", "table": "user"}, "op": op}),)

    a, b = {"id": 1, "name": "a"}, {"id": 2, "name": "b"}
    data = [record("c", None, a), record("c", None, b), record("d", a, None), record("c", None, {"id": 1, "age": 9}),
            record("d", b, None)]
    df = spark.createDataFrame([(i, v[0]) for i, v in enumerate(data)], "seq int, value string")
    rows_, _ = normalize_change(df, with_before=True)
    kept = changes.valid_changes(rows_, deletes=True)
    assert kept.count() == 5 and changes.valid_changes(rows_).count() == 3
    from millrace.sources.changes import keyed_data
    left = changes.latest_by_key(keyed_data(kept, "id"), "id", "seq", on_delete="drop")
    assert rows(left, "id", "seq") == [("1", 3)]
    routed = kept.withColumns({"sink_table": F.lit("dim_user"), "sink_pk": F.lit(None).cast("string")})
    for n, (policy, want) in enumerate((("drop", [("1", None, "9")]), ("keep", [("1", "a", "9"), ("2", "b", None)]))):
        path = str(tmp_path / policy)
        for batch in (0, 1):
            dims.append_changes(routed.filter(f"seq {'<' if batch == 0 else '>='} 3"), path, batch, on_delete=policy)
            assert dims.compact(spark, path) == batch
        assert rows(dims.current_dim(spark, path, "dim_user", ["id", "name", "age"])) == want
    route = {"sourceTable": "a", "operateType": "insert", "sinkType": "kafka", "sinkTable": "a1"}
    routes = spark.createDataFrame([(1, record("c", None, route)[0]), (2, record("d", route, None)[0]),
                                    (1, record("c", None, {**route, "sourceTable": "b"})[0])], "seq int, value string")
    assert rows(load_routes(normalize_change(routes, with_before=True)[0], "seq"), "source_table") == [("b",)]


def test_latest_by_key(spark):
    df = spark.createDataFrame([(1, "insert", 1, "a"), (2, "update", 1, "b"), (1, "insert", 2, "c"),
                                (3, "delete", 2, "c"), (4, "insert", None, "n")],
                               "seq int, type string, id int, name string")
    assert rows(changes.latest_by_key(df.filter("id is not null"), "id", "seq"), "id", "name") == [(1, "b"), (2, "c")]
    dropped = changes.latest_by_key(df.filter("id is not null"), ["id"], ["seq"], on_delete="drop")
    assert rows(dropped, "id", "name") == [(1, "b")]
    plan = changes.latest_by_key(df, "id", "seq")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_upsert_merges_fields(spark):
    df = spark.createDataFrame([(1, {"id": "1", "a": "x", "b": "y"}), (2, {"id": "1", "b": "z"}), (3, {"a": "no key"})],
                               "seq int, data map<string,string>")
    assert [(r["id"], r["data"]) for r in changes.upsert_by_key(df, "id", "seq").collect()] == [
        ("1", {"id": "1", "a": "x", "b": "z"})]


def test_dimension_store(spark, tmp_path):
    path = str(tmp_path / "dims")

    def batch(n, *data):
        dims.append_changes(spark.createDataFrame(
            [("dim_user", "id", i, d) for i, d in enumerate(data)],
            "sink_table string, sink_pk string, seq int, data map<string,string>"), path, n)

    def now():
        return rows(dims.current_dim(spark, path, "dim_user", ["id", "name", "age"]))

    batch(0, {"id": "1", "name": "a", "age": "5"}, {"id": "2", "name": "b"}, {})
    batch(1, {"id": "1", "name": "c"}, {"id": "1", "name": "d"})
    batch(1, {"id": "1", "name": "c"}, {"id": "1", "name": "d"})      # the same batch again
    expected = [("1", "d", "5"), ("2", "b", None)]
    assert now() == expected
    assert dims.compact(spark, path) == 0 and now() == expected
    batch(2, {"id": "2", "age": "9"})
    assert now() == [("1", "d", "5"), ("2", "b", "9")]
    assert dims.compact(spark, path) == 1 and now() == [("1", "d", "5"), ("2", "b", "9")]
    assert dims.dim_columns("name,id", None) == ("id", ["id", "name"])
    plan = dims.current_dim(spark, path, "dim_user", ["id"])._jdf.queryExecution().executedPlan().toString()
    log = next(line for line in plan.split("FileScan")[1:] if "/log" in line)
    assert "PartitionFilters" in log and "batch" in log.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_json_in_and_out(spark):
    df = lines(spark, [('{"a": 1, "m": {"k": "v"}}',), ("{a",), ("[]",)])
    good, bad = split_corrupt(parse_json(df, "a INT, m MAP<STRING,STRING>"))
    assert good.filter("a = 1").count() == 1 and bad.count() >= 1
    assert to_json_rows(good.filter("a = 1"), drop=("m",)).first()[0] == '{"a":1}'


def test_topics_from_files(spark, tmp_path):
    path = str(tmp_path / "t")
    lines(spark, [('{"ts": 1999, "page": {"page_id": "home"}}',), ("bad",)]).write.text(path)
    assert read_topic(spark, path, fmt="text", stream=False).count() == 2
    table, bad = read_json_topic(spark, path, schemas.PAGE_VIEW, fmt="text", stream=False, view="pv")
    assert rows(bad) == [("bad",)]
    timed = with_event_time(table, "ts", "rowtime", "seconds")
    assert rows(timed, "rowtime") == [(at(1, "1970-01-01 00:00:00"),)]
    assert spark.table("pv").count() == 1
    text_time = spark.createDataFrame([("2021-05-01 00:00:05",), ("soon",)], "t string")
    assert with_event_time(text_time, "t").collect()[0]["rowtime"] == at(5)
    assert with_event_time(text_time, "t").collect()[1]["rowtime"] is None


def test_read_changes_narrows_and_types(spark, tmp_path):
    path = str(tmp_path / "c")
    lines(spark, [captured("user_info", "c", {"id": 1, "name": "a", "age": "x"}), captured("other", "c", {"id": 2}),
                  captured("user_info", "c", {"id": 3}, db="else"), ("{cut",)]).write.text(path)
    got, bad = read_changes(spark, path, databases=["shop"], tables=["shop.user_info"], fmt="text", stream=False,
                       schema="id INT, name STRING, age INT")
    assert rows(got, "id", "name", "age") == [(1, "a", None)] and rows(bad) == [("{cut",)]


def test_result_table_is_idempotent_and_pruned(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([("2021-05-01 00:00:00", "2021-05-01 00:00:10", 1, "n", None, None, None, D(3), 1, 5),
                                ("2021-05-02 00:00:00", "2021-05-02 00:00:10", 1, "n", None, None, None, D(4), 1, 5)],
                               "stt string, edt string, province_id bigint, province_name string, area_code string, "
                               "iso_code string, iso_3166_2 string, order_amount decimal(28,4), order_count bigint, ts bigint")
    sink = tables.stats_sink(path, "province_stats")
    for n in (0, 0, 1):
        sink(df, n)
    got = tables.read_table(spark, path)
    assert got.count() == 4 and [c for c in got.columns if c != "dt"] == schemas.PROVINCE_STATS
    one = tables.read_day(spark, path, 20210502)
    assert one.count() == 2 and {f.split("/")[-3] for f in one.inputFiles()} == {"dt=20210502"}
    assert tables.read_day(spark, path, 19990101).count() == 0
    tables.close_day(spark, path, 20210502)
    closed = tables.read_day(spark, path, 20210502)
    read = [r[0] for r in closed.select(F.input_file_name()).distinct().collect()]
    assert closed.count() == 2 and len(read) == 1 and "/p_closed/" in read[0]
    assert closed.columns == one.columns
    from millrace.operators.serving import province_sales
    day = province_sales(got, 20210502)
    assert [r["order_amount"] for r in day.collect()] == [D(8)]
    assert "PartitionFilters: [isnotnull(dt" in day._jdf.queryExecution().explainString(
        day._jdf.sparkSession().sessionState().conf().getClass() and
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_facts_go_to_the_topic_of_their_route(spark, tmp_path):
    routed = spark.createDataFrame([("dwd_a", {"id": "1"}), ("dwd_b", {"id": "2"})],
                                   "sink_table string, data map<string,string>")
    topics.write_topics(topics.rows_by_table(routed), str(tmp_path / "k"), fmt="text")
    assert spark.read.text(str(tmp_path / "k" / "topic=dwd_b")).first()[0] == '{"id":"2"}'
    assert topics.topic_rows(routed, "t").columns == ["topic", "value"]


def test_words(spark):
    df = spark.createDataFrame([(1, "Apple iPhoneXSMax (A2104) 256GB 深空灰色 4G手机"), (2, None), (3, "--")],
                               "id int, t string")
    assert [r["keyword"] for r in text.explode_words(df, "t").collect()] == [
        "apple", "iphonexsmax", "a2104", "256gb", "深空灰色", "4g手机"]
    segment = text.dictionary_words(spark, ["深空", "灰色", "手机"])
    assert [r["keyword"] for r in text.explode_words(df, "t", segment=segment).collect()] == [
        "apple", "iphonexsmax", "a2104", "256gb", "深空", "灰色", "4g", "手机"]


def test_unpivot_counts(spark):
    df = spark.createDataFrame([("x", 1, 0, 3), ("y", 0, 0, None)],
                               "spu_name string, click_ct bigint, cart_ct bigint, order_ct bigint")
    assert rows(text.unpivot_counts(df), "spu_name", "ct", "source") == [("x", 1, "CLICK"), ("x", 3, "ORDER")]
    df.createOrReplaceTempView("counts")
    text.register(spark)
    got = spark.sql("select s.* from counts, lateral word_scores(spu_name, click_ct, cart_ct, order_ct) as s")
    assert rows(got) == [("x", 1, "CLICK"), ("x", 3, "ORDER")]
    assert rows(spark.sql("select * from words_of('A b-A')")) == [("a",), ("a",), ("b",)]


def test_codes(spark):
    assert code_labels(spark).count() == sum(len(c) for c in CODES.values())


def test_sql_job_on_a_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    log = [{"page": {"page_id": "good_list", "item": "Red bolt"}, "ts": ms} for ms in (1000, 2000, 999000)]
    lines(spark, [(json.dumps(r),) for r in log]).write.text(src)
    sql_jobs.page_view(read_json_topic(spark, src, schemas.PAGE_VIEW, fmt="text")[0])
    from millrace.streaming.runner import start
    finish(start(sql_jobs.run(spark, sql_jobs.KEYWORD_SEARCH), name="kw", once=True, path=out,
                 checkpoint=str(tmp_path / "cp")))
    assert rows(spark.read.parquet(out), "keyword", "ct", "stt") == [
        ("bolt", 2, "1970-01-01 00:00:00"), ("red", 2, "1970-01-01 00:00:00")]


def test_log_job_end_to_end(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "shop")

    def log(mid, ts, **more):
        common = {"mid": mid, "vc": "v", "ch": "c", "ar": "a", "is_new": "1"}
        return (json.dumps({"common": common, "ts": ts, **more}),)

    def go():
        stream = read_topic(spark, src, fmt="text")
        for q in [*jobs.split_log(stream, base, once=True), jobs.land_lines(stream, base, once=True)]:
            finish(q)

    page = {"page_id": "home", "during_time": 3}
    lines(spark, [log("a", 1000, page=page, displays=[{"item": "1", "item_type": "sku_id"}]),
                  log("a", 2000, start={"entry": "icon"}), ("broken",)]).write.mode("append").text(src)
    go()
    lines(spark, [log("a", 90000000, page=page), log("b", 90000000, page=page)]).write.mode("append").text(src)
    go()
    log = tables.read_table(spark, f"{base}/log")
    pages = log.filter("kind = 'page'")
    assert rows(pages, "mid", "is_new", "page_id") == [("a", "0", "home"), ("a", "1", "home"), ("b", "1", "home")]
    assert log.filter("kind = 'start'").count() == 1
    assert rows(log.filter("kind = 'display'"), "page_id", "item") == [("home", "1")]
    assert spark.read.parquet(f"{base}/quarantine_log").count() == 1
    assert spark.read.text(f"{base}/raw_log").count() == 5


def test_change_job_end_to_end(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "shop")
    routes = [list(ROUTES)]

    def go(*data):
        lines(spark, data).write.mode("append").text(src)
        stream = parse_change(read_topic(spark, src, fmt="text"))[0].withColumn("seq", F.lit(0))
        finish(jobs.route(stream, lambda: spark.createDataFrame(routes[0], ROUTE_SCHEMA), base, once=True))

    go(envelope("user", "insert", {"id": 1, "name": "a"}), envelope("order", "insert", {"id": 5}),
       envelope("user", "update", {"id": 1, "name": "lost"}))
    routes[0] = [*ROUTES, ("user", "update", "hbase", "dim_user", "id,name", None, None)]
    go(envelope("user", "update", {"id": 1, "name": "b"}))
    assert rows(dims.current_dim(spark, f"{base}/dims", "dim_user", ["id", "name"])) == [("1", "b")]
    assert rows(tables.read_table(spark, f"{base}/facts"), "topic", "value") == [("dwd_order", '{"id":"5"}')]


def test_order_job_sees_new_dimension_rows(spark, tmp_path):
    from test_joins_stats import DETAIL, ORDER, detail, order
    base = str(tmp_path / "shop")
    users = [[(100, datetime.date(2000, 1, 1), "F")]]
    place = spark.createDataFrame([(5, "p", "1", "P5", "CN-5")],
                                  "id bigint, name string, area_code string, iso_code string, iso_3166_2 string")
    product = spark.createDataFrame([(7, "s", 1, "spu", 2, "tm", 3, "cat")],
                                    "id bigint, sku_name string, spu_id bigint, spu_name string, tm_id bigint, "
                                    "tm_name string, category3_id bigint, category3_name string")

    def go(o, d):
        order(spark, o).write.mode("append").parquet(f"{base}/o")
        detail(spark, d).write.mode("append").parquet(f"{base}/d")
        query = jobs.order_wide(
            spark.readStream.schema(ORDER).parquet(f"{base}/o"), spark.readStream.schema(DETAIL).parquet(f"{base}/d"),
            lambda: spark.createDataFrame(users[0], "id bigint, birthday date, gender string"),
            lambda: place, lambda: product, base, asof=lambda: F.lit("2021-05-01").cast("date"), once=True)
        finish(query)

    go((1, 5, 100, at(0)), (10, 1, 7, D(1), at(0)))
    users[0].append((101, datetime.date(1990, 1, 1), "M"))
    go((2, 5, 101, at(60)), (20, 2, 7, D(1), at(60)))
    wide = tables.read_table(spark, f"{base}/order_wide")
    assert rows(wide, "detail_id", "user_gender", "user_age", "province_name", "tm_name") == [
        (10, "F", 21, "p", "tm"), (20, "M", 31, "p", "tm")]
