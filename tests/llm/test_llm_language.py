import zlib

import numpy as np
from samples import edge_rows, prose, table

from millrace.llm import language

LETTERS = {"en": "aeitnshr", "de": "eßnüäirst", "fr": "éèaluçeq", "xx": "zkwyvj"}


def rows_of(n):
    return [(i, prose(i, 30 + i % 50, LETTERS[l]).capitalize(), l, "s")
            for i in range(n) for l in [list(LETTERS)[i % 4]]]


def test_learns_from_labels_and_predicts_held_out(spark):
    rows = [*rows_of(240), *edge_rows(), (5000, "123 *** 45", "en", "s"), (5001, prose(1, 40, LETTERS["fr"]), None, "s")]
    got = language.identify(table(spark, rows), "doc_id").collect()
    by = {r.doc_id: r for r in got}
    for i, _, lang, _ in rows_of(240):
        assert by[i].lang_pred == lang and 0.5 < by[i].score <= 1
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert by[5001].lang_pred == "fr"
    for i in (900, 901, 902, 903, 907, 5000):
        assert (by[i].lang_pred, by[i].score, by[i].ambiguous) == ("und", 0.0, False)
    assert by[906].lang_pred in LETTERS and by[None].held_out
    assert len(got) == len(rows)


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = rows_of(120)
    wrong = [(i, t, "de" if zlib.crc32(str(i).encode()) % 5 == 0 else l, s) for i, t, l, s in rows]
    a, b = (sorted(map(tuple, language.identify(table(spark, x), "doc_id").collect())) for x in (rows, wrong))
    assert a == b


def test_ambiguous_text_is_flagged(spark):
    rows = rows_of(200) + [(900 + i, prose(i, 40, LETTERS["en"]) + " " + prose(i, 40, LETTERS["en"][::-1]), "en", "s") for i in range(2)]
    assert not any(r.ambiguous for r in language.identify(table(spark, rows), "doc_id").collect())
    same = [(2 * i + j, prose(i, 40, "abc"), lang, "s") for i in range(100) for j, lang in enumerate(("en", "de"))]
    found = language.identify(table(spark, same), "doc_id").collect()      # two names for one language
    assert sum(r.ambiguous for r in found) > 60


def test_few_languages(spark):
    assert language.identify(table(spark, []), "doc_id").count() == 0
    one = language.identify(table(spark, [(i, "some text", "en", "s") for i in range(8)]), "doc_id").collect()
    assert {r.lang_pred for r in one} == {"en"}
    none = language.identify(table(spark, [(i, "some text", None, "s") for i in range(3)]), "doc_id").collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 40):
        codes = language.codewords(n)
        apart = [(a != b).sum() for i, a in enumerate(codes) for b in codes[:i]]
        assert codes.shape[0] == n and min(apart) >= max(1, codes.shape[1] // 4)
        assert (np.abs(codes.sum(0)) < n).all()
