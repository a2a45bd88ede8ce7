import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st
from samples import edge_rows, prose, table

from millrace.llm import suffix_dedup


def brute(rows, length=100):
    least, own = {}, {}
    texts = {(r[0], (r[1] or "").encode()) for r in rows}
    key = lambda i: (i is not None, i or 0)
    for i, b in texts:
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            least[w] = min(least.get(w, key(i)), key(i))
            own[i, b, w] = min(own.get((i, b, w), s), s)
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if least[w] < key(r[0]) or own[r[0], b, w] < s:
                gone[s:s + length] = True
        gone = gone[:-1]
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(r[0]), len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def answer(df):
    return sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


def planted():
    r, passages = random.Random(4), [prose(i, 40) for i in range(5)]
    rows = list(edge_rows())
    for i in range(60):
        parts = [prose(100 + i, 30), r.choice(passages), prose(300 + i, 10), r.choice(passages)[r.randint(0, 60):]]
        rows.append((i, " ".join(parts), "en", "s"))
    rows += [(200 + i, rows[12 + i][1], "en", "s") for i in range(6)]                      # exact copies
    rows += [(210, "ab" * 200, "", ""), (211, "ab" * 130, "", ""), (212, "é" * 70, "", ""), (213, "x" * 99, "", ""),
             (214, "x" * 100, "", ""), (215, "x" * 101, "", ""), (216, prose(7, 60), "", ""), (216, prose(8, 60) + prose(7, 60), "", "")]
    r.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = planted()
    assert answer(suffix_dedup.dedup(table(spark, rows))) == brute(rows)


def test_equals_brute_force_when_anchors_are_spread(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "SALTS", 3)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "CHUNK_ROWS", 50)
    rows = planted()
    assert answer(suffix_dedup.dedup(table(spark, rows))) == brute(rows)


def test_many_rows_of_one_id_and_of_none(spark):
    r, passages = random.Random(6), [prose(50 + i, 40) for i in range(6)]
    texts = [" ".join([prose(1000 + i, 8), r.choice(passages), prose(2000 + i, 3), r.choice(passages)[:150]]) for i in range(500)]
    texts[400:] = texts[:100]       # repeated rows
    for ids in (lambda i: 7, lambda i: None, lambda i: None if i % 3 else i % 4):
        rows = [(ids(i), t, "en", "s") for i, t in enumerate(texts)] + [(9, passages[0], "en", "s"), (5, passages[1], "en", "s")]
        r.shuffle(rows)
        assert answer(suffix_dedup.dedup(table(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert suffix_dedup.dedup(table(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=40, max_size=300).map(lambda b: bytes(97 + x % 2 for x in b)), st.data())
def test_mergesort_orders_suffixes(data, draw):
    length = 12
    starts = np.arange(len(data) - length + 1)
    groups = np.sort(np.array(draw.draw(st.lists(st.integers(0, 3), min_size=len(starts), max_size=len(starts)))))
    order = suffix_dedup.Suffixes(np.frombuffer(data, dtype=np.uint8), length).sort(starts, groups)
    want = sorted(range(len(starts)), key=lambda i: (groups[i], data[i:i + length], i))
    assert order.tolist() == want


def test_hash_collisions_are_caught():
    s = suffix_dedup.Suffixes(np.frombuffer(b"abcdabceabcd", dtype=np.uint8), 4)
    s.same = lambda x, y, size: np.ones(len(x), dtype=bool)      # every hash collides
    assert s.alike(np.array([0, 0]), np.array([4, 8])).tolist() == [False, True]
