import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from millrace.llm.runs import whole_groups
from millrace.llm.words import pieces, shingles

TEXT = st.text(alphabet="ab \n\x0bé😀", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=8), st.integers(1, 60))
def test_words_are_those_of_a_split(texts, budget):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    seen, names = [], {}
    for piece in pieces([batch], budget=budget):
        found = piece.words()
        hashes = found.hashes()
        for r in range(piece.n):
            own = slice(found.first[r], found.first[r + 1])
            words = [bytes(piece.data[a:b]) for a, b in zip(found.starts[own], found.ends[own])]
            seen.append(words)
            for w, h in zip(words, hashes[own].tolist()):
                assert names.setdefault(w, h) == h
    assert seen == [(t or "").encode().split() for t in texts]
    assert len(set(names.values())) == len(names)


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_shingles_are_distinct_runs(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for piece in pieces([batch]):
        found = piece.words()
        rows, hashes = shingles(found, found.hashes(), 3)
        want, name = [], {}
        for t in texts:
            w = t.encode().split()
            want.append({tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} - {()})
        assert np.bincount(rows, minlength=len(texts)).tolist() == [len(s) for s in want]
        sets = [set(hashes[rows == i].tolist()) for i in range(len(texts))]
        for a, x in zip(want, sets):
            for b, y in zip(want, sets):
                assert len(a & b) == len(x & y), name


def test_groups_are_whole_across_batches():
    keys = [1, 1, 2, 3, 3, 3, 3, 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + 2])], ["k"]) for i in range(0, 8, 2)]
    tables = [t.column("k").to_pylist() for t in whole_groups(batches, "k")]
    assert sum(tables, []) == keys
    assert all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))
