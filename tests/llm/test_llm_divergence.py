import random
import re
from collections import Counter, defaultdict

import numpy as np
from samples import edge_rows, table, words

from millrace.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least=30, most=50):
    """Every share of every group and term, in plain Python."""
    groups, counts, docs, whole = defaultdict(set), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(found)
        whole[lang].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole[lang])
        ranked = lambda pairs: sorted(pairs, key=lambda x: (-x[0], x[1].encode()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[h][t]) for t in kept), h) for h in sources if h != s]
            over = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", h, x, r) for r, (x, h) in enumerate(ranked(pairs), 1)]
            out += [(lang, s, "term", t, x, r) for r, (x, t) in enumerate(ranked(over)[:most], 1)]
    return sorted(out)


def corpus(n=600, seed=3):
    r = random.Random(seed)
    vocabulary = words(seed, 150, "abcdéß") + ["The", "tHe", "😀x", "don't", "a1b"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    rows = []
    for i in range(n):
        lang, source = r.choice(["en", "fr", None]), r.choice(["s1", "s1", "s1", "s2", "Ä", "é", None, "", "z"])
        shift = len(source or "")
        rows.append((i, " ".join(r.choices(vocabulary[shift:] + vocabulary[:shift], weights, k=r.randint(0, 60))), lang, source))
    return rows


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(spark):
    rows = [*corpus(), *edge_rows(), *[(i, "rare words here", "es", f"q{i % 4}") for i in range(12)], (1, None, "it", "x"), (2, "y", "it", "y")]
    assert got(divergence.audit(table(spark, rows))) == brute(rows)
    assert got(divergence.audit(table(spark, rows), least_docs=2, most_terms=3)) == brute(rows, 2, 3)


def test_many_blocks_and_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(divergence, "POSTINGS", 64)
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = corpus(400, 9)
    assert got(divergence.audit(table(spark, rows), least_docs=5)) == brute(rows, 5)


def test_empty_table_and_a_single_source(spark):
    assert got(divergence.audit(table(spark, []))) == []
    rows = [(i, "one two", "en", "s") for i in range(40)]
    assert got(divergence.audit(table(spark, rows))) == brute(rows) == []


def test_scatter_corrects_the_baseline():
    r = np.random.default_rng(1)
    dense = r.integers(0, 4, size=(7, 30)) * r.integers(0, 2, size=(7, 30))
    z = r.integers(50, 400, size=7)
    p = np.where(dense > 0, dense * 100 + z[:, None] // 3, z[:, None])
    g, t = np.nonzero(dense)
    total = 30 * np.abs(z[:, None] - z[None])
    for i, row in divergence.scattered(g, t, p[g, t], z):
        total[i] += row
        total[:, i] += row
    assert (total == np.abs(p[:, None] - p[None]).sum(2)).all()


def test_shares_beyond_a_long(spark):
    from pyspark.sql import functions as F
    row = spark.range(1).select(divergence.share(F.lit(9 * 10**15), F.lit(10**16), F.lit(10**9)).alias("p")).first()
    assert row.p == 1 + 10**9 * (9 * 10**15 + 5) // (10**16 + 5 * 10**9)
