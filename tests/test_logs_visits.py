import json
import random

from conftest import at, rows
from pyspark.sql import functions as F

from millrace.operators import logs, neighbours, visits
from millrace.sinks import tables
from millrace.streaming import first_days, stateful, visited
from millrace.streaming.replay import Feed, replay

PAGES = "id bigint, mid string, ts timestamp, page_id string, last_page_id string"


def pages(spark, data):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], PAGES)


def line(**fields):
    return (json.dumps(fields),)


def test_parse_and_split_logs(spark):
    common = {"mid": "m1", "vc": "v", "ch": "c", "ar": "a", "is_new": "1"}
    lines = spark.createDataFrame([
        line(common=common, start={"entry": "icon"}, ts=1000),
        line(common=common, page={"page_id": "home", "during_time": 5}, ts=2000,
             displays=[{"item": "7", "item_type": "sku_id"}, {"item": "8", "item_type": "act"}]),
        line(common=common, page={"page_id": "cart", "last_page_id": "home"}, ts=3000, displays=[]),
        ("{broken",), line(common={}, ts=1), line(common=common), ("",),
    ], "value string")
    good, bad = logs.parse_logs(lines)
    assert good.count() == 3 and bad.count() == 4
    start, page, display = logs.split_logs(logs.flat_log(good))
    assert rows(start, "mid", "is_new") == [("m1", "1")]
    assert [r[0] for r in rows(page, "page_id")] == ["cart", "home"]
    assert rows(display, "page_id", "item", "item_type") == [("home", "7", "sku_id"), ("home", "8", "act")]


def test_repair_is_new(spark):
    day = 86400
    data = [("a", at(0), "1"), ("a", at(5), "1"), ("a", at(day), "1"), ("a", at(2 * day), "0"),
            ("b", at(0), "0"), ("b", at(day), "1"), (None, at(0), "1"), ("c", at(0), None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)],
                               "id bigint, mid string, ts timestamp, is_new string")
    expected = ["1", "1", "0", "0", "0", "1", "1", None]
    assert [r[1] for r in rows(logs.repair_is_new(df), "id", "is_new")] == expected
    from millrace.session import scratch_dir
    out = scratch_dir(spark, "flags")
    days = first_days.first_days(spark, f"{out}/days")
    replay(spark, "flags", {"x": Feed(df, "ts")}, lambda s: s["x"], each=lambda b, n: tables.write_batch(
        first_days.repair_is_new_batch(b, n, days), f"{out}/rows", n))
    out = f"{out}/rows"
    assert [r[1] for r in rows(spark.read.parquet(out), "id", "is_new")] == expected


def test_bounce_sample(spark):
    df = pages(spark, [("101", at(10), "home", None), ("102", at(12), "home", None),
                       ("102", at(15), "good_list", "home"), ("102", at(30), "good_list", "detail")])
    assert rows(visits.user_jumps(df, tie=("id",)), "mid", "ts") == [("101", at(10))]
    out = replay(spark, "sample", {"p": Feed(df, "ts", {"mid": "~"})}, lambda s: stateful.user_jumps_stream(s["p"], tie=("id",)))
    assert rows(spark.read.parquet(out), "mid", "ts") == [("101", at(10))]


EDGES = [
    ("a", at(0), "home", None), ("a", at(9.999), "x", "home"),              # 0: answered in time
    ("b", at(0), "home", ""), ("b", at(10), "x", "home"),                   # 2: exactly 10 s
    ("c", at(0), "home", None), ("c", at(3), "", "home"),                   # 4: next has no page
    ("d", at(0), "home", None),                                             # 6: last page
    ("e", at(0), "home", None), ("e", at(4), "home", None),                 # 7 no, 8 yes
    ("f", at(595), "home", None), ("f", at(604), "x", "home"),              # 9: over a slice edge
    ("g", at(595), "home", None), ("g", at(605), "x", "home"),              # 11: slice edge, too late
    (None, at(0), "home", None),
]


def test_bounce_edges(spark):
    df = pages(spark, EDGES)
    assert [r[0] for r in rows(visits.user_jumps(df, tie=("id",)), "id")] == [2, 6, 8, 11]
    outcome = dict(rows(visits.openings(df, tie=("id",)), "id", "outcome"))
    assert outcome[0] == "match" and outcome[4] == "broken" and outcome[7] == "match"


def plain_bounces(data, within):
    """The rule in plain Python."""
    by_mid = {}
    for i, (mid, ts, _, last) in enumerate(data):
        by_mid.setdefault(mid, []).append((ts, i, last))
    out = []
    for visits_ in by_mid.values():
        visits_.sort(key=lambda v: v[:2])
        for n, (ts, i, last) in enumerate(visits_):
            gap = (visits_[n + 1][0] - ts).total_seconds() if n + 1 < len(visits_) else None
            if not last and (gap is None or gap >= within):
                out.append(i)
    return sorted(out)


def random_pages(seed, n=400):
    rng = random.Random(seed)
    return [(f"m{rng.randrange(4)}", at(rng.randrange(4000) / 2), rng.choice(["home", "x", ""]),
             rng.choice([None, "", "home"])) for _ in range(n)]


def test_bounces_match_plain_model(spark):
    for seed, within, size in ((1, 10, 10), (2, 10, 600), (3, 2.5, 5)):
        data = random_pages(seed)
        got = visits.user_jumps(pages(spark, data), within, tie=("id",), slice_seconds=size)
        assert [r[0] for r in rows(got, "id")] == plain_bounces(data, within)


def test_bounce_stream_matches_batch(spark):
    data = random_pages(7, 200)
    feed = Feed(pages(spark, data), "ts", {"mid": "~"})
    out = replay(spark, "jumps", {"p": feed},
                 lambda s: stateful.user_jumps_stream(s["p"], tie=("id",), slice_seconds=20), rounds=3)
    assert [r[0] for r in rows(spark.read.parquet(out), "id")] == plain_bounces(data, 10)


def test_late_rows_of_stateful_streams(spark):
    """A bounce row behind the watermark is dropped; a visit that comes days late still counts."""
    data = [("a", at(100), "home", None), ("a", at(15), "home", None), ("a", at(101), "x", "home")]
    first = pages(spark, data[:1])
    from millrace.session import scratch_dir
    from millrace.streaming.runner import finish, start
    base, late = scratch_dir(spark, "late"), 0
    for rows_ in (first, pages(spark, data).filter("id > 0"), pages(spark, [("~", at(9999), "x", "y")])):
        rows_.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(PAGES).parquet(f"{base}/in")
        late += sum(p["late_rows"] for p in finish(start(
            stateful.user_jumps_stream(stream, tie=("id",)), name="late", once=True,
            path=f"{base}/out", checkpoint=f"{base}/cp")))
    assert spark.read.schema(PAGES).parquet(f"{base}/out").count() == 0     # answered at 101; 15 was late
    assert late == 2        # once as an opening row and once as a follower

    base = scratch_dir(spark, "old")
    day = 86400
    for n, t in enumerate((5 * day, 0, 5 * day + 9)):
        pages(spark, [("a", at(t), "home", None)]).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(PAGES).parquet(f"{base}/in")
        finish(start(stream, name="old", once=True, each=visited.unique_visits_sink(f"{base}/out"),
                     checkpoint=f"{base}/cp"))
    assert rows(spark.read.parquet(f"{base}/out"), "ts") == [(at(0),), (at(5 * day),)]
    again = visited.unique_visits_sink(f"{base}/out")
    again(pages(spark, [("a", at(0), "home", None), ("b", at(0), "home", None)]), 1)     # batch 1 once more
    assert rows(spark.read.parquet(f"{base}/out"), "mid", "ts") == [("a", at(0)), ("a", at(5 * day)), ("b", at(0))]


def test_unique_visits(spark):
    day = 86400
    df = pages(spark, [
        ("a", at(5), "home", None), ("a", at(1), "home", ""), ("a", at(0), "x", "home"),
        ("a", at(day - 1), "home", None), ("a", at(day), "home", None), ("b", at(3), "x", "home"),
        (None, at(0), "home", None)])
    expected = [(1, "a", at(1)), (4, "a", at(day))]
    assert rows(visits.unique_visits(df, tie=("id",)), "id", "mid", "ts") == expected
    from millrace.session import scratch_dir
    out = scratch_dir(spark, "uv")
    replay(spark, "uv", {"p": Feed(df, "ts")}, lambda s: s["p"], each=visited.unique_visits_sink(out, tie=("id",)))
    assert rows(spark.read.parquet(out), "id", "mid", "ts") == expected


def test_unique_visits_cut_before_the_shuffle(spark):
    plan = visits.unique_visits(pages(spark, EDGES))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_busy_device_is_spread_over_slices(spark):
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), "id")).alias("mid"),
        F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    groups = neighbours.with_slices(df, "ts", 10, 600, "next").groupBy("mid", "_slice").count()
    assert groups.agg(F.max("count")).first()[0] <= 600 / 7 / 3 + 3


def test_neighbours_match_plain_model(spark):
    """Both ways of filling slices, both directions, against a sorted list."""
    data = random_pages(11, 300)
    df = pages(spark, data)
    for direction in ("next", "prev"):
        expected = {}
        for mid in {d[0] for d in data}:
            mine = sorted((d[1], i) for i, d in enumerate(data) if d[0] == mid)
            mine = mine if direction == "prev" else mine[::-1]
            for before, (ts, i) in zip([None, *mine], mine):
                near = before is not None and abs((ts - before[0]).total_seconds()) < 45
                expected[i] = before[1] if near else None
        for size in (45, 600, 20, 7):
            got = neighbours.with_neighbour(df, "mid", "ts", {"other": "id"}, reach=45,
                                            slice_seconds=size, direction=direction, tie=("id",))
            assert {r["id"]: r["other"] for r in got.collect()} == expected, (direction, size)


def test_search_terms(spark):
    view = spark.createDataFrame(
        [({"page_id": "good_list", "item": "red bolt"}, at(1)), ({"page_id": "good_list"}, at(2)),
         ({"page_id": "home", "item": "x"}, at(3))], "page map<string,string>, rowtime timestamp")
    assert rows(logs.search_terms_from_view(view), "fullword") == [("red bolt",)]
