"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from check import compare, duck

import __spark_entry__ as entry
from millrace.plans import expected_sql, queries as registered

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables not here")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_of_the_shop_has_sql():
    assert set(registered.queries()) == set(expected_sql.oracle_sql())
    assert set(registered.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    difference = compare(spark, con, entry.queries()[name], SQL[name], FOLDER)
    assert difference in ("", "no rows")     # a lookup may find nothing in tables this small


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_product_keyword_stream_stores_only_what_it_reads(spark, monkeypatch, tmp_path):
    """all columns of the statistics were written by day first, and read from one small file a day."""
    fed = {}

    def replay(spark, label, feeds, build):
        fed.update(feeds)
        build({name: feed.rows for name, feed in feeds.items()}).write.parquet(f"{tmp_path}/out")
        return f"{tmp_path}/out"

    monkeypatch.setattr(registered, "replay", replay)
    monkeypatch.setattr(registered, "stored", lambda *_: pytest.fail("the day table is not needed"))
    t = registered.ShopTables(spark, FOLDER)
    got = registered.stream_keyword_product_stats(t)
    assert set(fed["rows"].rows.columns) == {"spu_name", "click_ct", "cart_ct", "order_ct", "stt", "edt", "at"}
    want = registered.keyword_product_stats(t).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
