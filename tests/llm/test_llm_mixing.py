from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from samples import edge_rows, prose, table

from millrace.llm import mixing


def brute_targets(rows):
    """Rounds of resharing, as the contract words it."""
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(size.values()), {}, set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over


@pytest.fixture(scope="module")
def rows():
    return [(i, prose(i, 30 + 7 * (i % 90)), "en", "s" + "abcdefg"[min(i % 13, 6)]) for i in range(260)] + edge_rows()


def test_targets_equal_resharing_rounds(spark, rows):
    _, aims = mixing.planned(table(spark, rows))
    got = {r.source: r.target for r in aims.collect()}
    want = brute_targets(rows)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_meets_targets_without_overdrawing(spark, rows):
    sizes, aims = mixing.planned(table(spark, rows))
    blocks = mixing.mix(sizes, aims).cache()
    goal, taken = {r.source: r.target for r in aims.collect()}, defaultdict(int)
    by_row = Counter()
    for b in blocks.collect():
        taken[b.source] += b.n_words
        by_row[b.row] += b.n_words
    size = {r.row: r.size for r in sizes.collect()}
    assert all(abs(taken[s] - goal[s]) <= mixing.BLOCK_WORDS / 2 for s in goal)
    assert all(n <= 2 * size[row] for row, n in by_row.items())
    draws = blocks.groupBy("row", "block", "epoch").count()
    assert draws.filter("count > 1").count() == 0
    per_shard = [r["count"] for r in blocks.groupBy("shard").count().collect()]
    assert len(per_shard) == 2 ** mixing.LEVELS and max(per_shard) - min(per_shard) <= mixing.LEVELS
    again = mixing.mix(*mixing.planned(table(spark, rows)))
    assert Counter(map(tuple, blocks.drop("row").collect())) == Counter(map(tuple, again.drop("row").collect()))
    texts = mixing.block_texts(blocks.filter("id < 50").drop("row"), table(spark, rows)).collect()
    words = {r[0]: (r[1] or "").split() for r in rows}
    assert texts and all(t.text.split() == words[t.id][t.first_word - 1:t.first_word - 1 + t.n_words] for t in texts)


def test_hypergeometric_draws_have_the_right_spread(spark):
    u = mixing.uniform(F.lit(1), F.col("id"))
    some = spark.range(4000).select(mixing.hypergeometric(
        F.lit(30).cast("long"), F.lit(100).cast("long"), F.lit(50).cast("long"), u).alias("k"))
    got = some.agg(F.avg("k"), F.var_samp("k"), F.min("k"), F.max("k")).first()
    assert got[0] == pytest.approx(15, abs=0.15)
    assert got[1] == pytest.approx(50 * 0.3 * 0.7 * 50 / 99, rel=0.1)
    assert got[2] >= 0 and got[3] <= 30
    edges = spark.range(1).select(*(mixing.hypergeometric(*(F.lit(x).cast("long") for x in a), F.lit(0.5)) for a in (
        (0, 10, 5), (10, 10, 4), (3, 10, 0), (3, 10, 10), (0, 0, 0)))).first()
    assert list(edges) == [0, 4, 0, 3, 0]


def test_quotas_are_split_exactly(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 37), (None, 5), ("z", 0)], "source string, quota long")
    runs = mixing.split_quotas(quotas, levels=3).collect()
    first = defaultdict(list)
    for r in sorted(runs, key=lambda r: r.shard):
        first[r.source].append(r.first)
    assert set(first) == {"a", "b", None, "z"} and all(len(v) == 8 for v in first.values())
    assert all(v == sorted(v) and v[0] == 0 for v in first.values())
    assert all(v[-1] <= q for v, q in ((first["a"], 1000), (first["b"], 37), (first[None], 5), (first["z"], 0)))


def test_nothing_to_mix(spark):
    for rows in ([], [(1, None, "en", "s"), (2, " ", None, None)]):
        sizes, aims = mixing.planned(table(spark, rows))
        assert mixing.mix(sizes, aims).count() == 0
        assert [r.target for r in aims.collect()] in ([], [0.0, 0.0])
