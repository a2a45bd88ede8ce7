import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from samples import edge_rows, prose, table

from millrace.llm import language_model
from millrace.llm.language_model import CLASSES, CODES, OWN, PLACES, Model, Sums, score_texts

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
END = ""


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), END]


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


def base(rows):
    """Counter of (doc_id, held_out, n_tokens, n_known, train_tokens, rounded base_score)."""
    c = Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    return Counter((r[0], held(r[0]), len(tokens(r[1])), sum(c[t] > 0 for t in tokens(r[1])), n,
                    round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(r[1])), 6)) for r in rows)


def got(scored):
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)


def corpus(n=400):
    letters = ("aeitnshr", "eußnär", "éèalç")
    return [(i, prose(i % 150, 20 + i % 60, letters[i % 3]) + " " + prose(i % 9, 30, letters[i % 3]), "en", "s") for i in range(n)]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [*corpus(), *edge_rows(), (8000, "w" * 200_000 + " " + "Ab " * 70_000, "en", "s")]
    return rows, score_texts(table(spark, rows)).collect()


def test_base_equals_brute_force(scored):
    rows, found = scored
    assert got(found) == base(rows)


def test_the_model_beats_the_base_on_held_out_texts(scored):
    _, found = scored
    own = [r for r in found if r.held_out and r.n_tokens > 20]
    assert len(own) > 20
    assert sum(r.score for r in own) > sum(r.base_score for r in own) + 0.15 * sum(r.n_tokens for r in own)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_equal_texts_get_equal_scores(scored):
    _, found = scored
    assert len({r.score for r in found if r.doc_id == 905}) == 1
    blank = {r.doc_id: r.score for r in found}
    assert blank[900] == blank[901] == blank[902] == blank[903]


def test_words_that_are_not_sent_meet_their_counts_in_a_join(spark, monkeypatch):
    monkeypatch.setattr(language_model, "MOST_WORDS", 20)
    rows = [*corpus(90), *edge_rows(), (8001, "x" * 500 + " " + "x" * 500, "en", "s")]
    assert got(score_texts(table(spark, rows)).collect()) == base(rows)


def test_small_counting_tasks(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HELD", 3)
    rows = corpus(60)
    assert got(score_texts(table(spark, rows), rounds=1).collect()) == base(rows)


def test_nothing_to_learn_from(spark):
    assert score_texts(table(spark, [])).count() == 0
    rows = [(None, "some words", "en", "s"), (None, None, "en", "s")]
    found = score_texts(table(spark, rows)).collect()
    assert got(found) == base(rows) and all(r.base_score == 0 for r in found)


def a_model(seed=1):
    r = np.random.default_rng(seed)
    model = Model(r.dirichlet(np.ones(CLASSES)), r.dirichlet(np.ones(PLACES), size=CLASSES - 1))
    model.class_weights[:] = r.normal(size=model.class_weights.shape)
    model.place_weights[:] = r.normal(size=model.place_weights.shape)
    return model


def histories(n, seed=2):
    r = np.random.default_rng(seed)
    return [r.integers(0, CODES, n) for _ in range(3)]


def test_shares_of_all_words_sum_to_one():
    model, before = a_model(), histories(40)
    every = np.zeros(40)
    for code in [*range(OWN), OWN + 5]:
        every += 10 ** model.log10(np.full(40, code), before)
    assert np.allclose(every, 1, atol=1e-5)


def test_gradient_is_the_slope_of_the_log_likelihood():
    model, before = a_model(), histories(300)
    codes = np.random.default_rng(3).integers(0, 700, 300)
    sums = Sums()
    model.gradient(codes, before, sums)
    value = lambda: model.log10(codes, before).sum() * math.log(10)
    for weights, g in ((model.class_weights, sums.classes), (model.place_weights, sums.places)):
        rows = np.argsort(-np.abs(g[:, :-1]).max(1))[:4]
        for r in rows:
            c = int(np.abs(g[r, :-1]).argmax())
            at = weights[r, c]
            weights[r, c] = at + 0.01
            up = value()
            weights[r, c] = at - 0.01
            down = value()
            weights[r, c] = at
            assert abs((up - down) / 0.02 - g[r, c]) < 0.05 + 0.02 * abs(g[r, c])
    assert Sums.of(sums.flat()).classes.tolist() == sums.classes.tolist()


def test_histories_stop_at_the_start_of_a_text():
    a, b, c = Model.history(np.array([5, 6, 7, 8, 0, 9]), np.array([0, 1, 2, 3, 0, 1]))
    assert (a.tolist(), b.tolist(), c.tolist()) == ([0, 5, 6, 7, 0, 0], [0, 0, 5, 6, 0, 0], [0, 0, 0, 5, 0, 0])


def test_blocks_cover_every_token(monkeypatch):
    texts = [np.arange(1, 8, dtype=np.uint16), np.zeros(1, np.uint16), np.arange(20, 24, dtype=np.uint16)]
    batch = pa.record_batch({"codes": [x.tobytes() for x in texts]})
    whole = list(language_model.blocks(batch))
    monkeypatch.setattr(language_model, "BLOCK", 3)
    for found in (whole, list(language_model.blocks(batch))):
        assert np.concatenate([x[0] for x in found]).tolist() == [*range(1, 8), 0, *range(20, 24)]
        assert np.concatenate([x[1] for x in found]).tolist() == [0] * 7 + [1] + [2] * 4
        assert np.concatenate([x[2][2] for x in found]).tolist() == [0, 0, 0, 1, 2, 3, 4, 0, 0, 0, 0, 20]
