import os

import pytest
from samples import edge_rows, prose, table

from millrace.llm import token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(token_counts.VOCABULARY), reason="vocabulary not here")


def test_histogram_answers_every_limit(spark):
    rows = [*edge_rows(), *((i, prose(i, 1 + i * i % 97), "en", "s") for i in range(60))]
    encode = token_counts.encoder(token_counts.vocabulary(token_counts.VOCABULARY)).encode_ordinary
    n = sorted(len(encode(r[1] or "")) for r in rows)
    table_ = token_counts.length_histogram(table(spark, rows)).cache()
    got = {r.n_tokens: r for r in table_.collect()}
    assert sorted(got) == sorted(set(n))
    for k, r in got.items():
        assert (r.n_docs, r.tokens) == (n.count(k), k * n.count(k))
        assert (r.docs_ge, r.tokens_ge) == (sum(x >= k for x in n), sum(x for x in n if x >= k))
        assert (r.docs_le, r.tokens_le) == (sum(x <= k for x in n), sum(x for x in n if x <= k))
        assert r.truncated_tokens == sum(min(x, k) for x in n)
    for limit in (0, 1, 7, 100, 10 ** 6):
        assert token_counts.truncated_total(table_, limit).first()[0] == sum(min(x, limit) for x in n)
    for q in (0.01, 0.25, 0.5, 0.9, 1.0):
        want = next(x for i, x in enumerate(n) if i + 1 >= q * len(n))
        assert token_counts.quantile(table_, q).first()[0] == want


def test_blocks_of_lengths_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 4)
    rows = [(i, prose(i, i % 23), "en", "s") for i in range(50)]
    got = token_counts.length_histogram(table(spark, rows)).collect()
    assert max(r.docs_ge for r in got) == 50 and max(r.docs_le for r in got) == 50
    assert sum(r.tokens for r in got) == max(r.truncated_tokens for r in got)
    assert token_counts.length_histogram(table(spark, [])).count() == 0


def test_long_vocabularies_are_refused(tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        token_counts.vocabulary(token_counts.VOCABULARY)
