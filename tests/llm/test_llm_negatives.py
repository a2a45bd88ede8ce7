import random

import numpy as np
import pytest

from millrace.llm import hard_negatives
from millrace.llm.hard_negatives import mine, relabelled
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, row int, block string, tops int, vector string, anchor int"
EXTRA = (1, "b", 2, "v", 3)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def brute(rows, k=5):
    """Every pair in plain Python; a null id comes last."""
    use = [(i, r[0], ((r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2]),
            [int(np.floor(256 * float(np.float32(x)))) for x in r[1]])
           for i, r in enumerate(rows)
           if r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    out = []
    last = lambda x: (x is None, x or 0)
    for i, a, label, v in use:
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), b, other == label) for j, b, other, w in use if j != i]
        order = sorted(scored, key=lambda s: (-s[0], last(s[1])))
        for top, p, _ in [s for s in order if s[2]][:k]:
            inside = [s for s in order if not s[2] and 80 * top <= 100 * s[0] <= 100 * top][:k]
            out += [(a, p, rank, b, top, s) for rank, (s, b, _) in enumerate(inside, 1)]
    return sorted(map(repr, out))


def got(spark, rows):
    df = mine(table(spark, rows), label=relabelled(F.col("vec_id"), F.col("label")))
    return sorted(repr(tuple(r)[:6]) for r in df.collect())


def vectors(n, dims, seed, spread=1.0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(4, dims))
    return [(int(i), (centres[i % 4] + spread * r.normal(size=dims)).astype(np.float32).tolist(), int(r.integers(0, 10)))
            for i in range(n)]


@pytest.mark.parametrize("seed,spread,dims", [(1, 0.3, 70), (2, 2.0, 64), (3, 0.8, 5)])
def test_equals_brute_force(spark, seed, spread, dims):
    rows = vectors(700, dims, seed, spread)
    mined = got(spark, rows)
    assert mined == brute(rows) and len(mined) > 20


def test_ties_repeats_nulls_and_unequal_lengths(spark):
    rows = vectors(300, 8, 5, 0.5)
    same = [0.5] * 8
    rows += [(1000 + i, same, i % 3) for i in range(120)]                   # one vector in very many rows
    rows += [(1100, same, 1), (1100, same, 1), (1100, same, 2), (None, same, 1), (None, same, 2), (None, same, None)]
    rows += [(1200, None, 1), (1300, [], 1), (1400, [float("nan")] * 8, 1), (1500, [float("inf")] * 8, 1),
             (1600, [None, 1.0], 1), (1700, [0.5, 0.25], 1), (-100, [-0.5] * 8, 1), (-7, [0.75] * 9, 0), (1800, [0.0] * 8, 2)]
    random.Random(2).shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rows = [(i * 50, [float((i * 37) % 91 - 40) * 300, float(i % 13) * 90, 1.0 / (i + 1)], i % 2) for i in range(60)]
    assert got(spark, rows) == brute(rows)
    huge = mine(table(spark, [(100, [3e38, 1.0], 1), (1, [3e38, 1.0], 1), (2, [3e38, 0.5], 2)])).collect()
    top = hard_negatives.LARGEST ** 2
    assert [(r.positive_score, r.negative_score) for r in huge] == [(top + 65536, top + 32768)]


def test_empty_and_single(spark):
    assert got(spark, []) == [] and got(spark, [(100, [1.0], 1)]) == []


def test_the_bitmap_shrinks_before_the_last_dimension():
    r = np.random.default_rng(7)
    import pyarrow as pa
    base = np.round(256 * r.normal(size=64) * np.exp(-np.arange(64) / 6)).astype(int)
    vectors = np.round(base * r.uniform(-1, 1, size=(2000, 1)) + r.normal(size=(2000, 64)) * 4).astype(int)
    block = hard_negatives.Block(pa.table({
        "row": np.arange(2000), "vec_id": np.arange(2000), "label": np.zeros(2000, dtype=int),
        "vector": pa.array(vectors.tolist(), pa.list_(pa.int32()))}))
    scan = hard_negatives.Scan(block, base, [block.span(0)])
    for _ in scan.steps():
        low, high = scan.bounds()
        scan.keep(high >= hard_negatives.kth_largest(low, 6))
        if scan.at == 32:
            assert len(scan.part) < 200
