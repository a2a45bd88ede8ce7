from collections import Counter

from samples import edge_rows, prose, table, words

from millrace.llm import quality


def base(text):
    w = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))


def test_counts_and_edges(spark):
    rows = [*edge_rows(), (1, "x y z\nx y z\n\n \nx y z ", "en", "s"), (2, "a|b # 5%\r\nq\n", "en", "s"),
            (3, "one two three " * 30, "en", "s"), (4, prose(4, 80) + "\n" + prose(5, 3), "fr", "t")]
    got = quality.statistics(table(spark, rows), "doc_id", "score").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r.doc_id), *(r[n] for n in names)) for r in got) == sorted(
        (str(r[0]), *base(r[1])) for r in rows)
    assert {r.score for r in got} == {"z"}


def test_outliers_go_and_clean_documents_stay(spark):
    clean = [(i, prose(i, 80 + i % 60).capitalize() + ".", "en" if i % 3 else "de", f"s{i % 2}") for i in range(400)]
    junk = [(1000 + i, " ".join(w + "***" for w in words(2000 + i, 90)), "en", "s0") for i in range(12)]
    few = [(2000 + i, prose(5000 + i, 90), "xx", "rare") for i in range(5)]     # judged with all others
    got = {r.doc_id: r for r in quality.quality_rules(table(spark, clean + junk + few + edge_rows()), "doc_id").collect()}
    assert all(got[r[0]].kept for r in clean + few)
    assert not any(got[r[0]].kept for r in junk)
    assert all(got[i].base_failed and not got[i].kept for i in (900, 901, 902, 903, 905, 906, 907))


def test_too_few_documents_are_kept_and_none_give_none(spark):
    rows = [(i, prose(i, 60), None, None) for i in range(3)]
    assert [r.kept for r in quality.quality_rules(table(spark, rows), "doc_id").collect()] == [True] * 3
    assert quality.quality_rules(table(spark, []), "doc_id").count() == 0


def test_concentration_ignores_a_contaminated_quarter(spark):
    rows = [(i, prose(i, 100), "en", "s") for i in range(300)]
    rows += [(1000 + i, prose(1000 + i, 100).upper() + " 123456789" * 20, "en", "s") for i in range(70)]
    got = {r.doc_id: r.kept for r in quality.quality_rules(table(spark, rows), "doc_id").collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(70))


def test_an_outlier_in_each_single_rate_goes(spark):
    def lined(w, n=10):
        return "\n".join(" ".join(w[i:i + n]) for i in range(0, len(w), n))

    rows = [(i, lined(words(i, 100)), "en", "s") for i in range(300)]
    w = words(7000, 100)
    odd = {"f_length": lined([x * 4 for x in w]), "f_symbols": lined([x + "#" for x in w]),
           "f_marks": lined([x + "," for x in w]), "f_digits": lined([x if i % 2 else "12345678" + str(i) for i, x in enumerate(w)]),
           "f_upper": lined([x.upper() for x in w]),
           "f_dup_lines": "\n".join(f"{lined(w[i:i + 10])}\nabcde" for i in range(0, 100, 10)),
           "f_repeats": lined([*w[:56], *w[56:78], *w[56:78]], 9)}
    rows += [(1000 + i, t, "en", "s") for i, t in enumerate(odd.values())]
    got = {r.doc_id: r for r in quality.quality_rules(table(spark, rows), "doc_id").collect()}
    assert not any(got[1000 + i].base_failed for i in range(len(odd)))
    assert [n for i, n in enumerate(odd) if got[1000 + i].kept] == []
    assert all(got[i].kept for i in range(300))
