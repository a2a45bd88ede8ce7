import re

from pyspark.sql import functions as F
from samples import edge_rows, prose, table

from millrace.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    names = list(PATTERNS)
    found = sorted((m.start(), names.index(k), m.end()) for k, p in PATTERNS.items()
                   for m in re.finditer(p, text or "") if valid(k, m.group()))
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in found)


ODD = ["a@b.c@d.e", "a@b-c.d_x@y.z", "x a@b..c@d.e.. z", "..a@b.c..d@e.f", "a@b a@.c a@b. a@-.-", "@b.c a@b.c.", "é@b.c 😀 q@r.st",
       "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 1..2.3.4.5 01.02.03.04", "4111 1111 1111 1111  4111-1111-1111-1111 4111--1111 1111 1111",
       "4111 1111 1111 1112 0000000000000 0 0 0 0 0 0 0 0 0 0 0 0", "+1 (017) 555-7713+12 +1 +12345678 +123456789-", "+1.2.3.4.5.6.7.8.9 ++1 234 567 890",
       "﷐a@b.c ﷑ d@e.f ﷒﷓ 1.2.3.4", "12 " * 3000, "1" * 5000, "a." * 4000 + "@x.y", "+" * 500 + "1" * 12, "a@b." * 300, "\na@b.cd\n1.1.1.1\n"]


def base(spark, rows):
    got = pii.find_pii(table(spark, rows), "doc_id", "key").select("doc_id", "key", "base", "spans", pii.spelled(F.col("base")).alias("s"))
    return got.collect()


def test_base_spans_equal_plain_patterns(spark):
    rows = [*edge_rows(), *((i, t, "en", "s") for i, t in enumerate(ODD)),
            *((100 + i, prose(i, 30, "0123456789.+- @ab"), "en", "s") for i in range(150))]
    got = {r.doc_id: r for r in base(spark, rows) if r.doc_id != 905}
    for r in rows:
        if r[0] != 905:
            assert got[r[0]].s == brute(r[1]), (r[0], (r[1] or "")[:80])
            assert set(got[r[0]].base) <= set(got[r[0]].spans)
    assert got[900].key == 7


def test_context_finds_identifiers_that_no_pattern_fits(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "378282246310005", "6011000990139424", "30569309025904"]
    rows = [(i, f"{prose(i, 5)} card number: {cards[i % 6]} {prose(50 + i, 5)}", "en", "s") for i in range(24)]
    rows += [(100, f"{prose(7, 5)} card number: 4111-2222x3333-4444 {prose(8, 5)}", "en", "s"),
             (101, f"{prose(9, 5)} order total: 123456789012 {prose(10, 5)}", "en", "s")]
    got = {r.doc_id: r for r in base(spark, rows)}
    text = dict((r[0], r[1]) for r in rows)
    assert [text[100][s.start:s.stop] for s in got[100].spans] == ["4111-2222x3333-4444"]
    assert pii.KINDS[got[100].spans[0].kind] == "card" and got[100].base == []
    assert got[101].spans == []


def card(i):
    digits = [int(c) for c in f"4{i:014d}"]
    total = sum(d if k % 2 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits))
    return "".join(map(str, digits)) + str(-total % 10)


def test_hundreds_of_unseen_identifiers_and_no_decoy(spark):
    fill = lambda n: prose(n, 6, "klmnoprs")
    rows, unseen, decoys = [], {}, set()

    def add(text, token=None, into=None):
        rows.append((len(rows), text, "en", "s"))
        if token is not None:
            into[len(rows) - 1] = token

    for i in range(400):        # seeds in one context, and as many unseen ones that no base pattern fits
        add(f"{fill(i)} paid with card number: {card(i)} {fill(9000 + i)}")
        if i < 250:
            add(f"{fill(2000 + i)} paid with card number: X{i:03d}-44x{i * 7919 % 10**6:06d} {fill(3000 + i)}", f"X{i:03d}-44x{i * 7919 % 10**6:06d}", unseen)
    for i in range(120):        # some of those again in a context without a seed, which holds others too
        add(f"{fill(4000 + i)} member key {f'X{i:03d}-44x{i * 7919 % 10**6:06d}'} {fill(5000 + i)}", f"X{i:03d}-44x{i * 7919 % 10**6:06d}", unseen)
    for i in range(80):
        add(f"{fill(6000 + i)} member key Y{i:02d}-77y{i * 104729 % 10**6:06d} {fill(7000 + i)}", f"Y{i:02d}-77y{i * 104729 % 10**6:06d}", unseen)
    for i in range(300):        # plain numbers in contexts of their own, some of which a few seeds share
        decoys.add(len(rows))
        add(f"{fill(8000 + i)} order total {10**9 + i * 7717} {fill(10000 + i)}")
    for i in range(4):
        add(f"{fill(11000 + i)} order total {card(5000 + i)} {fill(12000 + i)}")
    got = {r.doc_id: [rows[r.doc_id][1][s.start:s.stop] for s in r.spans if s not in r.base] for r in base(spark, rows)}
    assert sum(token in got[i] for i, token in unseen.items()) >= 0.9 * len(unseen) and len(unseen) == 450
    assert not any(got[i] for i in decoys)


def test_a_pattern_does_not_confirm_itself(spark):
    rows = [(i, f"{prose(i, 5)} id code {card(i) if i < 3 else 10**8 + i * 31} {prose(100 + i, 5)}", "en", "s") for i in range(10)]
    for rounds in (3, 12):
        found = pii.find_pii(table(spark, rows), "doc_id", rounds=rounds).collect()
        assert all(set(r.spans) == set(r.base) for r in found)


def test_redaction(spark):
    spans = [(2, 0, 5), (4, 1, 8), (9, 3, 10)]
    rows = spark.createDataFrame([("abcdefghij", spans), ("x😀", []), (None, None)],
                                 "t string, s array<struct<start:int,kind:int,stop:int>>")
    got = [r[0] for r in rows.select(pii.redact(F.col("t"), F.col("s"))).collect()]
    assert got[:2] == ["ab[EMAIL]i[PHONE]", "x😀"] and got[2] is None


def test_many_matches_and_no_rows(spark):
    text = " ".join(f"u{i}@h{i}.org" for i in range(2000))
    (r,) = base(spark, [(1, text, "en", "s")])
    assert r.s == brute(text)
    assert base(spark, []) == []
