import random
from collections import Counter

from pyspark.sql import functions as F
from samples import edge_rows, prose, table, words

from millrace.llm import ngram_join
from millrace.llm.graphs import components


def brute(rows, k=4, percent=85):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = (r[1] or "").encode().translate(lower).split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(i), []).append(r[0])
    least = {g: min((x for x in v if x is not None), default=None) for g, v in ids.items()}
    return Counter((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def edited(base, seed, share):
    r = random.Random(seed)
    return " ".join("".join(r.choices("klmnop", k=5)) if r.random() < share else w for w in base)


def answer(df):
    return Counter((r.id, r.n_shingles, r.component_id) for r in df.collect())


def test_equals_brute_force(spark):
    rows = [*edge_rows(), (1, "one two three", "en", "s"), (2, "ONE two\tThree", "en", "s"), (3, "É a", "", ""), (4, "é a", "", "")]
    for f in range(6):
        base = words(f, 40 + 50 * f)
        rows += [(100 * f + 10 + i, edited(base, 100 * f + i, 0.004 * i), "en", "s") for i in range(14)]
    rows += [(2000 + i, prose(1, 12) + " " + prose(3000 + i, 60), "en", "s") for i in range(30)]   # a shared passage
    random.Random(1).shuffle(rows)
    assert answer(ngram_join.jaccard_join(table(spark, rows))) == brute(rows)


def test_a_family_too_large_for_one_tile(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 16)
    monkeypatch.setattr(ngram_join, "LIST", 4)
    base = words(77, 150)
    rows = [(i, edited(base[: 110 + i % 40], i, 0.012), "en", "s") for i in range(150)]
    rows += [(1000 + i, prose(500 + i, 30), "en", "s") for i in range(20)]
    assert answer(ngram_join.jaccard_join(table(spark, rows))) == brute(rows)


def test_frequent_ngrams_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIST", 3)
    rows = [(i, prose(1, 20) + " " + prose(10 + i % 25, 60 + i // 25), "en", "s") for i in range(75)]
    assert answer(ngram_join.jaccard_join(table(spark, rows))) == brute(rows)


def test_many_rows_of_one_id_and_of_none(spark):
    texts = []
    for f in range(10):
        base = words(50 + f, 60)
        texts += [edited(base, 900 * f + i, 0.01) for i in range(45)]
    texts += texts[:50]
    for ids in (lambda i: 7, lambda i: None, lambda i: None if i % 3 else i % 4):
        rows = [(ids(i), x, "en", "s") for i, x in enumerate(texts)]
        assert answer(ngram_join.jaccard_join(table(spark, rows))) == brute(rows)


def test_empty_table_and_bounds(spark):
    assert ngram_join.jaccard_join(table(spark, [])).count() == 0
    assert ngram_join.prefix_size(100, 85) == 16 and ngram_join.needed(100, 100, 85) == 92


def test_components_of_long_paths(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).filter("a % 100 <> 99")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: i // 100 * 100 for i in range(300)}
    assert components(links.limit(0)).count() == 0
