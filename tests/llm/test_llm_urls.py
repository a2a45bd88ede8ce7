import re

import pytest
from samples import EXTRA

from millrace.llm import url_filter

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def pages(spark, urls):
    return spark.createDataFrame([(i, u, None, *EXTRA) for i, u in enumerate(urls)],
                                 "page_id long, url string, html string, host string, gram int, cut int, "
                                 "path string, n int, at int, label string, verdict string")


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(len(d + p), d + p, v) for v, d, p in RULES
            if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


ODD = [None, "", "no scheme", "http://", "HTTP://A.ORG", "http://a.org/", "http://org/x", "http://aorg/", "x://y.com/fr/?a=/b",
       "http://EXAMPLE.org/es/1", "http://www.example.org/en/12", "http://www.example.org/en/2", "a://b://c.org/",
       "http://É.com/de/", "http://a.com:80/fr/", "http://a.com?x=/fr/", "http://a.com#/fr/", "http://a.com/fr/\nnew", "ftp://u@h.net/p"]


def test_hosts_paths_and_rules(spark):
    urls = [*ODD, *ODD[5:8]]
    got = {r.page_id: r for r in url_filter.judge(pages(spark, urls), "page_id").collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert all(got[i].verdict == "block" and got[i].score is None for i in range(4))


def test_a_very_long_url_takes_time_in_proportion(spark):
    import time

    base = [f"https://reading{i % 9}.example.org/fr/{i}" for i in range(40)] + [f"http://w{i}.example.com/de/{i}" for i in range(40)]

    def took(n):
        urls = [*base, "http://long.example.net/" + "😀ab/c" * (n // 5)]
        began = time.time()
        rows = {r.page_id: r for r in url_filter.judge(pages(spark, urls), "page_id").collect()}
        assert rows[len(base)].path == urls[-1][len("http://long.example.net"):] and rows[len(base)].score is not None
        return time.time() - began

    took(100)
    assert took(100_000) < 4 * took(10_000) + 6


def test_model_judges_how_urls_are_written(spark):
    good = [f"https://reading{i % 9}.example.org/fr/{i}" for i in range(150)]
    bad = [f"http://win-casino{i % 9}.example.com/de/{i}" for i in range(150)]
    new = [f"https://reading{i}.example.net/fr/{i}" for i in range(9)], [f"http://win-casino{i}.example.net/de/{i}" for i in range(9)]
    rows = {r.url: r for r in url_filter.judge(pages(spark, [*good, *bad, *new[0], *new[1], *ODD]), "url").collect()}
    assert {rows[u].verdict for u in new[0]} == {"allow"} and {rows[u].verdict for u in new[1]} == {"block"}
    assert all(rows[u].rule is None for u in new[0])


def test_model_is_the_smoothed_recursion(spark):
    counted = spark.createDataFrame([("\u0002\u0002\u0002\u0002a", 3, 1), ("\u0002\u0002\u0002ab", 2, 0),
                                     ("\u0002\u0002\u0002ac", 1, 1), ("\u0002\u0002\u0002aq", 0, 0)], "gram string, a long, b long")
    got = {r.gram: r.ratio for r in url_filter.log_ratios(counted).collect()}
    rows = [tuple(r) for r in counted.collect()]

    def p(gram, side):
        if not gram:
            return 1 / url_filter.ALPHABET
        n = sum(r[side] for r in rows if r[0].endswith(gram))
        context = sum(r[side] for r in rows if r[0][:-1].endswith(gram[:-1]))
        return (n + url_filter.WEIGHT * p(gram[1:], side)) / (context + url_filter.WEIGHT)

    import math
    assert got == pytest.approx({r[0]: math.log(p(r[0], 1) / p(r[0], 2)) for r in rows})


def test_without_labels_or_rows(spark):
    assert url_filter.judge(pages(spark, []), "page_id").count() == 0
    plain = url_filter.judge(pages(spark, ["http://a.net/x", "http://b.net/y"]), "page_id").collect()
    assert {r.cut for r in plain} == {0.0} and all(r.verdict in ("allow", "block") for r in plain)
