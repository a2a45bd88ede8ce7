import random

import pytest
from conftest import at, rows
from pyspark.sql import functions as F

from millrace.operators import facts, stats, visits
from millrace.session import scratch_dir
from millrace.sinks import dims, outbox, tables
from millrace.sinks.keyed import KeyedTable
from millrace.streaming import changelog, first_days, handover, jobs, late, stateful
from millrace.streaming.replay import Feed, replay

LOG = ("id bigint, mid string, ts timestamp, page_id string, last_page_id string, during_time bigint, vc string, ch string, "
       "ar string, is_new string")


def log(spark, data):
    return spark.createDataFrame([(i, m, t, p, l, 5, f"v{len(m or '')}", "c", "a", "1") for i, (m, t, p, l) in enumerate(data)], LOG)


def visits_of(seed, n, devices=6, span=200_000):
    r = random.Random(seed)
    return [(r.choice([*(f"m{i}" for i in range(devices)), "hot", "hot", "hot", None]), at(r.randrange(span) * r.choice((0.25, 1))),
             "home", r.choice((None, "", "home"))) for _ in range(n)]


def test_visitor_chain_equals_the_batch_operators(spark):
    data = [("a", at(1), "home", None), ("a", at(4), "cart", "home"), ("b", at(2), "home", None), ("b", at(9), "home", None),
            ("a", at(86_399), "home", None), ("a", at(86_401), "home", None), *visits_of(5, 250)]
    pages = log(spark, data)
    want = stats.visitor_stats(facts.visitor_events(pages, visits.unique_visits(pages, tie=("id",)), visits.user_jumps(pages, tie=("id",))))
    base = replay(spark, "chain", {"p": Feed(pages, "ts", {"mid": "~", "vc": "~"})}, rounds=3,
                  job=lambda s, b: jobs.visitor_chain(s["p"], b, tie=("id",), once=True))
    got = tables.read_table(spark, f"{base}/visitor_stats").filter("vc <> '~'").select(*want.columns)
    assert rows(got) == rows(want)


def test_visitor_chain_keeps_no_state_store(spark, tmp_path):
    pages = log(spark, visits_of(6, 50))
    pages.write.parquet(f"{tmp_path}/in")
    query = jobs.visitor_chain(spark.readStream.schema(pages.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", tie=("id",), once=True)
    query.awaitTermination()
    assert query.exception() is None and all(not p["stateOperators"] for p in query.recentProgress)


def test_bounces_of_a_busy_device_without_python(spark):
    data = [("hot", at(0.5 * i), "home", None if i % 9 == 0 else "home") for i in range(900)] + visits_of(8, 100, 2, 400)
    pages = log(spark, data).select("id", "mid", "ts", "page_id", "last_page_id")
    out = replay(spark, "busy", {"p": Feed(pages, "ts", {"mid": "~"})}, lambda s: stateful.user_jumps_stream(s["p"], tie=("id",)))
    assert rows(spark.read.parquet(out), "id") == rows(visits.user_jumps(pages, tie=("id",)), "id")
    stream = spark.readStream.schema(pages.schema).parquet(out)
    plan = stateful.user_jumps_stream(stream)._jdf.queryExecution().analyzed().toString()
    assert "LeftOuter" in plan and "Python" not in plan and "Pandas" not in plan


def flags(spark, data):
    return spark.createDataFrame(data, "id int, mid string, ts timestamp, is_new string")


def test_first_days_survive_repeats_and_compaction(spark, tmp_path):
    days, day = first_days.first_days(spark, str(tmp_path / "d"), compact_every=2), 86_400
    batches = [[(1, "a", at(5), "1"), (2, None, at(5), "1")], [(3, "a", at(day), "1"), (4, "b", at(day), "1")],
               [(5, "b", at(2 * day), "1"), (6, "a", at(0), "1")], [(7, "a", at(day), "1"), (8, "b", at(0), "1")],
               [(9, "b", at(day), "1"), (10, "c", at(day), "0")]]
    seen = []
    for n, data in enumerate(batches):
        for _ in range(2):      # every batch is repeated
            got = rows(first_days.repair_is_new_batch(flags(spark, data), n, days), "id", "is_new")
        seen += got
    assert seen == [(1, "1"), (2, "1"), (3, "0"), (4, "1"), (5, "0"), (6, "1"), (7, "0"), (8, "1"), (9, "0"), (10, "0")]
    assert rows(days.rows(9), "mid", "day") == [("a", "20210501"), ("b", "20210501")]
    assert spark.read.parquet(f"{days.path}/versions").count() >= 1


def test_a_hot_device_is_dealt_over_the_repair_join(spark, tmp_path):
    days = first_days.first_days(spark, str(tmp_path / "d"))
    hot = spark.range(4000).select(F.col("id").cast("int").alias("id"), F.lit("hot").alias("mid"),
                                   F.timestamp_seconds(F.col("id") * 60 + 1_620_000_000).alias("ts"), F.lit("1").alias("is_new"))
    fixed = first_days.repair_is_new_batch(hot, 0, days)
    assert fixed.filter("is_new = '1'").count() == hot.filter("to_date(ts) = '2021-05-03'").count()
    plan = fixed._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "Python" not in plan


def test_a_lookup_opens_only_its_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "k"), "k string, v int, o int", "k", "o", buckets=16)
    data = spark.range(200).select(F.col("id").cast("string").alias("k"), F.col("id").cast("int").alias("v"), F.lit(0).alias("o"))
    table.append(data, 0)
    one = table.rows(1, data.filter("k = '7'"))
    assert 0 < one.count() < 60 and one.filter("k = '7'").count() == 1
    assert table.rows(0).count() == 0 and table.rows(1).count() == 200


def test_dimension_view_reads_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "dims")

    def change(batch, *pairs):
        df = spark.createDataFrame([("dim_user", "id", "update", batch, {"id": i, "age": a}) for i, a in pairs],
                                   "sink_table string, sink_pk string, type string, seq bigint, data map<string,string>")
        dims.append_changes(df, path, batch)

    change(0, ("1", "10"), ("2", "20"))
    view = dims.DimView(spark, path, "dim_user", ["id", "age"], str(tmp_path / "held"), {"age": "int"})
    assert rows(view()) == [("1", 10), ("2", 20)]
    assert view() is view()     # nothing new: the same frame
    change(1, ("2", "21"), ("3", "30"))
    scan = view.newer()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "batch" in scan.split("PartitionFilters")[1].split("]")[0]
    assert view.newer().select("batch").distinct().collect()[0][0] == 1 and view.newer().count() == 2
    assert rows(view()) == [("1", 10), ("2", 21), ("3", 30)] and view.newer().isEmpty()
    other = dims.DimView(spark, path, "dim_none", ["id"], str(tmp_path / "held"))
    assert other().count() == 0


def test_late_batches_of_a_closed_day(spark, tmp_path):
    path = str(tmp_path / "t")

    def batch(n, ids):
        tables.write_batch(spark.createDataFrame([(i, 20210501 + i % 2) for i in ids], "id int, dt int"), path, n, ["dt"])

    batch(0, range(4))
    tables.close_day(spark, path, 20210501)
    tables.close_day(spark, path, 20210501)     # nothing new
    batch(1, range(4, 8))
    assert [r[0] for r in rows(tables.read_day(spark, path, 20210501), "id")] == [0, 2, 4, 6]
    tables.close_day(spark, path, 20210501)
    closed = tables.read_day(spark, path, 20210501)
    assert [r[0] for r in rows(closed, "id")] == [0, 2, 4, 6]
    assert {r[0].split("/t_closed/")[1].split("/")[0] for r in closed.select(F.input_file_name()).distinct().collect()} == {"upto=1"}
    batch(2, [8])
    assert [r[0] for r in rows(tables.read_day(spark, path, 20210501), "id")] == [0, 2, 4, 6, 8]
    assert [r[0] for r in rows(tables.read_day(spark, path, 20210502), "id")] == [1, 3, 5, 7]


def test_scratch_folder_needs_a_shared_root_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return {"spark.sql.warehouse.dir": "file:/w"}.get(name, default)

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})

    with pytest.raises(RuntimeError):
        scratch_dir(Session(), "x")


def test_late_rows_are_kept_apart(spark, tmp_path):
    path = str(tmp_path / "p")
    each = late.late_sink(path, delay="3 seconds")
    batches = [[(1, at(10)), (2, at(100))], [(3, at(96)), (4, at(97)), (5, None), (6, at(200))], [(7, at(150)), (8, at(198))]]
    for n, data in enumerate(batches):
        for _ in range(2):
            each(spark.createDataFrame(data, "id int, ts timestamp"), n)
    got = spark.read.parquet(path).select("id", F.col("late").cast("boolean").alias("late"))
    assert rows(got, "id", "late") == [
        (1, False), (2, False), (3, True), (4, False), (5, False), (6, False), (7, True), (8, False)]
    marks = spark.read.parquet(f"{path}_marks")
    assert rows(marks, "batch", "rows", "late_rows") == [(0, 2, 0), (1, 4, 1), (2, 2, 1)]


def test_outbox_delivers_once(spark, tmp_path):
    path, send = str(tmp_path / "o"), outbox.outbox_sink(str(tmp_path / "o"))
    assert outbox.read_outbox(spark, path).count() == 0
    data = spark.createDataFrame([("t1", "a"), ("t2", "b"), ("t1", "c")], "topic string, value string")
    outbox.write_attempt(data, path, 0)         # cut short before its commit
    send(data, 0)
    send(data, 0)                               # repeated after its commit
    outbox.commit(spark, path, 0, outbox.write_attempt(data, path, 0))      # two drivers at once
    send(data.limit(1), 1)
    got = outbox.read_outbox(spark, path)
    assert rows(got, "topic", "batch", "value") == [("t1", 0, "a"), ("t1", 0, "c"), ("t1", 1, "a"), ("t2", 0, "b")]
    assert got.select("topic", "batch", "position").distinct().count() == 4
    assert rows(outbox.read_outbox(spark, path, "t1", after=0), "value") == [("a",)]


def typed(spark, data):
    return spark.createDataFrame(data, "id string, name string, type string, seq bigint")


def test_change_log_folds_to_the_current_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id string, name string, type string, seq bigint", "id", "seq", compact_every=1)
    sink = changelog.changelog_sink(str(tmp_path / "out"), table, ["name"])
    r, now, n = random.Random(4), {}, 0
    for batch in range(4):
        data = []
        for _ in range(30):
            key, kind, n = f"k{r.randrange(12)}", r.choice(("insert", "update", "update", "delete")), n + 1
            data.append((key, None if kind == "delete" else f"n{n}", kind, n))
            now[key] = data[-1][1]
        for _ in range(2):
            sink(typed(spark, data), batch)
    found, held = tables.read_table(spark, str(tmp_path / "out")), {}
    sign = {"-U": 0, "-D": 0, "+I": 1, "+U": 1}
    for kind, key, name, _ in sorted(map(tuple, found.collect()), key=lambda x: (x[3], sign[x[0]])):
        if sign[kind]:
            assert key not in held
            held[key] = name
        else:
            assert held.pop(key) == name        # what is taken back is what was there
    assert held == {k: v for k, v in now.items() if v is not None}


def test_snapshot_is_taken_once_and_nothing_comes_twice(spark, tmp_path):
    base, taken = str(tmp_path / "b"), []

    def take():
        taken.append(1)
        return spark.createDataFrame([("1", "x"), ("2", "b")], "id string, name string"), 3

    first = [("1", "a", "insert", 1), ("2", "b", "insert", 2), ("1", "x", "update", 3), ("2", "y", "update", 4)]
    for data in (first, [("3", "c", "insert", 5)]):
        typed(spark, data).write.mode("append").parquet(f"{base}/in")
        from millrace.streaming.runner import finish
        stream = spark.readStream.schema("id string, name string, type string, seq bigint").parquet(f"{base}/in")
        finish(handover.snapshot_then_log(stream, take, f"{base}/out", once=True))
    got = tables.read_table(spark, f"{base}/out/changes")
    assert rows(got, "id", "name", "type", "seq") == [
        ("1", "x", "read", 3), ("2", "b", "read", 3), ("2", "y", "update", 4), ("3", "c", "insert", 5)]
    assert taken == [1]


def test_windows_carry_only_open_rows(spark, tmp_path):
    from millrace.streaming import carried
    schema, out = "sku_id bigint, click_ct bigint, ts timestamp", str(tmp_path / "out")
    sink = carried.windows_sink(str(tmp_path / "open"), "ts", stats.product_sums, lambda df, n: tables.write_batch(df, out, n))
    batches = [[(1, 1, at(1)), (1, 1, at(12)), (2, 1, at(9)), (3, 1, None)], [(1, 1, at(8)), (1, 1, at(13)), (1, 1, at(41))],
               [(1, 1, at(15))], [(9, 1, at(1000))]]
    for n, data in enumerate(batches):
        for _ in range(2):      # every batch is repeated
            sink(spark.createDataFrame(data, schema), n)
    # at(12) - 3 < 10: the first window stays open for at(8); at(15) comes behind its closed window
    assert rows(tables.read_table(spark, out).select(F.right("stt", F.lit(8)).alias("t"), "sku_id", "click_ct")) == [
        ("00:00:00", 1, 2), ("00:00:00", 2, 1), ("00:00:10", 1, 2), ("00:00:40", 1, 1)]
    assert rows(spark.read.parquet(f"{tmp_path}/open/open/batch=1"), "ts") == [(at(41),)]


def test_joins_carry_only_rows_that_can_still_meet(spark, tmp_path):
    from test_joins_stats import DETAIL, ORDER, D, detail, order
    from millrace.operators import joins
    from millrace.streaming import carried
    out, r = str(tmp_path / "out"), random.Random(3)
    heads = [(i, 5, 100, at(r.randrange(400))) for i in range(120)]
    lines = [(10 * i + k, i, 7, D(1), at((h[3] - at(0)).seconds + r.randrange(-7, 8))) for i, h in enumerate(heads) for k in range(3)]
    sink = carried.joined_sink(str(tmp_path / "open"), joins.merge_order, ("create_time", "create_time"), -5, 5,
                               lambda df, n: tables.write_batch(df, out, n))

    def part(data, n):
        return [d for d in data if at(100 * n) <= max(d[-1], at(0)) < at(100 * (n + 1))]

    for n in range(5):
        both = [spark.createDataFrame([], s) if not d else f(spark, *d) for s, f, d in (
            (ORDER, order, part(heads, n)), (DETAIL, detail, part(lines, n)))]
        for _ in range(2):
            sink(carried.paired(*both), n)
    want = joins.merge_order(order(spark, *heads), detail(spark, *lines))
    assert rows(tables.read_table(spark, out), "detail_id", "order_id") == rows(want, "detail_id", "order_id")
    assert spark.read.parquet(f"{tmp_path}/open/many/batch=2").count() < 40


def test_order_job_keeps_no_row_state(spark, tmp_path):
    from test_joins_stats import DETAIL, ORDER, D, detail, order
    base = str(tmp_path / "shop")
    order(spark, (1, 5, 100, at(0))).write.parquet(f"{base}/o")
    detail(spark, (10, 1, 7, D(1), at(0))).write.parquet(f"{base}/d")
    empty = {"u": "id bigint, birthday date, gender string", "p": "id bigint, name string, area_code string, iso_code string, iso_3166_2 string",
             "s": "id bigint, sku_name string, spu_id bigint, spu_name string, tm_id bigint, tm_name string, category3_id bigint, category3_name string"}
    query = jobs.order_wide(spark.readStream.schema(ORDER).parquet(f"{base}/o"), spark.readStream.schema(DETAIL).parquet(f"{base}/d"),
                            *(lambda s=s: spark.createDataFrame([], s) for s in empty.values()), base, once=True)
    query.awaitTermination()
    assert not query.lastProgress["stateOperators"] and tables.read_table(spark, f"{base}/order_wide").count() == 1
