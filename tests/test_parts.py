"""History worked off in parts gives what one pass gives, and holds less on disk meanwhile."""

import glob
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.plans import queries as registered
from millrace.session import FREE_SHUFFLES
from millrace.sinks import tables
from millrace.streaming.replay import Feed, replay


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of some weeks; some rows come twice and some keys are null."""
    at = str(tmp_path_factory.mktemp("shop"))

    def save(name, n, *columns):
        rows = spark.range(n).selectExpr(*columns)
        rows.unionAll(rows.limit(2)).coalesce(1).write.parquet(f"{at}/{name}.parquet")

    save("orders", 60, "nullif(id, 7) as o_orderkey", "nullif(id % 9, 4) as o_custkey", "if(id % 3 = 0, 'O', 'F') as o_orderstatus",
         "double(id * 1.5) as o_totalprice", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, int(id % 11)) as o_orderdate")
    save("lineitem", 240, "id div 4 as l_orderkey", "nullif(id % 13, 5) as l_partkey", "int(id % 4 + id % 3 + 1) as l_linenumber",
         "double(id % 5 + 1) as l_quantity", "double(id + 0.25) as l_extendedprice", "double(0.04) as l_discount",
         "if(id % 2 = 0, 'R', 'N') as l_returnflag", "if(id % 5 < 3, 'F', 'O') as l_linestatus")
    save("events", 120, "id as event_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, int(id % 9), 0, 0, id) as ts", "id % 6 as user_id",
         "element_at(array('click', 'view', 'signup', 'purchase'), int(id % 4 + 1)) as event_type", "double(id) as value",
         "concat('{\"k\": ', id % 13, '}') as props")
    save("part", 12, "id as p_partkey", "concat('part ', id % 4) as p_name", "concat('Brand#', id % 3) as p_brand",
         "concat('TYPE ', id % 2) as p_type", "double(id + 900) as p_retailprice")
    save("customer", 9, "id as c_custkey", "int(id % 5) as c_nationkey", "concat('c', id) as c_name")
    spark.range(5).selectExpr("int(id) as n_nationkey", "concat('N', id) as n_name", "int(id % 2) as n_regionkey").write.parquet(f"{at}/nation.parquet")
    return at


def told(df, *columns):
    return Counter(map(tuple, df.select(*(columns or sorted(df.columns))).collect()))


def test_the_product_table_is_written_some_days_at_a_time(spark, folder, monkeypatch):
    """F4 (F2, F3, F6, F7, F9, F10): all days were summed, looked up and dealt by day at once."""
    monkeypatch.setattr(registered, "PART_ROWS", 100)
    monkeypatch.setattr(registered, "STORED", {})
    t = registered.ShopTables(spark, folder)
    path, = registered.stored(t, "product_stats")
    days = [glob.glob(f"{path.removeprefix('file:')}/dt={d}/batch=*") for d in range(20240101, 20240112)]
    assert [len(d) for d in days] == [1] * 11
    assert len({os.path.basename(d[0]) for d in days}) == registered.parts(t) == 4
    want = registered.product_stats(t)
    assert told(registered.sink_product_stats(t)) == told(want, *sorted(want.columns)) != Counter()
    laid = max(glob.glob(f"{path.removeprefix('file:').rpartition('/product_stats')[0]}/product_rows-*"), key=os.path.getmtime)
    assert spark.read.parquet(laid).count() == 0        # a part's rows are dropped when its days are written


def test_a_written_batch_leaves_no_shuffle(spark, tmp_path):
    """shuffles of a written table stayed until the driver collected garbage."""
    def shuffles():
        root = spark.sparkContext.getConf().get("spark.local.dir", "/tmp")
        return set(glob.glob(f"{root}/blockmgr-*/*/shuffle_*.data"))

    before, conf = shuffles(), spark.conf.get(FREE_SHUFFLES)
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    tables.write_batch(sums, str(tmp_path / "t"), 0)
    assert shuffles() <= before and spark.conf.get(FREE_SHUFFLES) == conf
    assert tables.read_table(spark, str(tmp_path / "t")).count() == 7


@pytest.mark.parametrize("name", ["stream_order_wide", "stream_payment_wide"])
def test_order_streams_come_in_slices(spark, folder, monkeypatch, name):
    """F5, F8: half of history was one micro-batch, and its rows were stored twice."""
    want = told(registered.QUERIES[name](registered.ShopTables(spark, folder)))
    seen = []
    start = registered.jobs._start
    monkeypatch.setattr(registered.jobs, "_start", lambda df, base, *a, **o: (seen.append(base), start(df, base, *a, **o))[1])
    monkeypatch.setattr(registered, "PART_ROWS", 100)
    got = told(registered.QUERIES[name](registered.ShopTables(spark, folder)))
    assert got == want != Counter()
    assert len(seen) == 4 and len(set(seen)) == 1
    fed = f"{seen[0].removeprefix('file:').removesuffix('/out')}"
    stored = glob.glob(f"{fed}/stored/*")
    assert not any(spark.read.parquet(s).count() for s in stored) and len(stored) == (name == "stream_payment_wide")
    for feed in glob.glob(f"{fed}/in/*"):
        assert len(glob.glob(f"{feed}/_slice=*")) == 4


def test_a_feed_may_have_no_rows_in_a_slice(spark):
    """F5, F8: every row of every feed is streamed once, whichever slices it has rows in."""
    early, late = ("timestamp_seconds(id * 10 + 1600000000) as ts", f"timestamp_seconds(id * 10 + {1_600_000_000 + 2900}) as ts")
    a, b = spark.range(300).selectExpr("id", early), spark.range(10).selectExpr("id + 1000 as id", late)
    c = b.unionAll(spark.sql("select -1L as id, cast(null as timestamp) as ts"))
    out = replay(spark, "slices", {"a": Feed(a, "ts"), "b": Feed(b, "ts"), "c": Feed(c, "ts", then=lambda df: df.selectExpr("id + 5000 as id", "ts"))},
                 lambda s: s["a"].unionByName(s["b"]).unionByName(s["c"]), slices=3)
    assert told(spark.read.parquet(out)) == told(a.unionAll(b).unionAll(c.selectExpr("if(ts is null, 4999, id + 5000) as id", "ts")))
