import itertools
import random
import re

from samples import EXTRA, edge_rows, prose, table, words

from millrace.llm import decontaminate

WORD = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def items(spark, texts):
    return spark.createDataFrame([(i, t, *EXTRA[:3]) for i, t in texts], "item_id long, text string, id string, n int, seed int")


def brute(rows, texts):
    """Every alignment of every pair, compared in full."""
    found = {}
    for d, text, *_ in rows:
        doc = WORD.findall((text or "").lower())
        for i, t in texts:
            item = WORD.findall((t or "").lower())
            width = min(20, len(item))
            for shift in range(-len(item), len(doc)):
                same = [0 <= j + shift < len(doc) and doc[j + shift] == w for j, w in enumerate(item)]
                for a in range(len(item) - width + 1):
                    inside = a + shift >= 0 and a + shift + width <= len(doc)
                    if len(item) >= 5 and inside and sum(same[a:a + width]) >= 0.8 * width:
                        found[d, i] = max(found.get((d, i), 0), sum(same[a:a + width]))
    return found


def replaced(text, every, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("xyz", k=4)) if i % every == every - 1 else w for i, w in enumerate(text.split()))


def sample():
    texts = [(i, prose(50 + i, 22 + 3 * i)) for i in range(8)] + [(20, "just five words in it"), (21, "four words are few"),
             (22, None), (23, ""), (24, prose(50, 22)), (25, "Ünder é one two three four five six")]
    rows = list(edge_rows())
    for i in range(30):
        body = prose(500 + i, 20 + 9 * i)
        item = texts[i % 8][1]
        part = [item, item.upper().replace(" ", ", "), replaced(item, 6, i), " ".join(item.split()[:20]), replaced(item, 3, i)][i % 5]
        rows.append((i, f"{body} {part}. {prose(900 + i, 12)}" if i % 2 else f"{part} {body}", "en", "s"))
    rows += [(100, "there: Just FIVE words, in it!", "", ""), (101, "x four words are few x", "", ""), (102, "ÜNDER É one two three four five six", "", "")]
    return rows, texts


def test_finds_what_brute_force_finds(spark):
    rows, texts = sample()
    want = brute(rows, texts)
    for limit in (decontaminate.MOST_BROADCAST, 0):
        got = {(r.id, r.item): r.agreed for r in decontaminate.overlaps(table(spark, rows), items(spark, texts), most_broadcast=limit).collect()}
        assert got.keys() <= want.keys() and all(got[k] == want[k] for k in got)
        # at most one word in six replaced: found for certain
        assert {k for k in want if want[k] >= 17 or want[k] < 16} <= got.keys()
        assert (100, 20) in got and (102, 25) in got and not any(k[0] == 101 for k in got)


def test_alignment(spark):
    rows, texts = sample()
    for r in decontaminate.overlaps(table(spark, rows), items(spark, texts)).collect():
        doc, item = (WORD.findall(dict((x[0], x[1]) for x in t)[k].lower()) for t, k in ((rows, r.id), (texts, r.item)))
        pairs = zip(doc[r.doc_word:r.doc_word + r.compared], item[r.item_word:r.item_word + r.compared], strict=True)
        assert sum(a == b for a, b in pairs) == r.agreed >= 0.8 * r.compared


def test_nothing_to_find(spark):
    rows, texts = sample()
    for limit in (1 << 20, 0):
        assert decontaminate.overlaps(table(spark, []), items(spark, texts), most_broadcast=limit).count() == 0
        assert decontaminate.overlaps(table(spark, rows), items(spark, [(1, None)]), most_broadcast=limit).count() == 0


def test_masks_tolerate_any_single_substitution():
    text = words(3, 20)
    for at in range(20):
        changed = [w if i != at else "other" for i, w in enumerate(text)]
        hit = any(all(text[s + p] == changed[s + p] for p, c in enumerate(m) if c == "1")
                  for m in decontaminate.MASKS for s in range(20 - len(m) + 1))
        assert hit


def test_masks_meet_every_accepted_pattern():
    for n in range(5, 21):
        wrong = next(k for k in range(n, -1, -1) if n - k >= 0.8 * n)
        masks = [m for m, low, high in decontaminate.masks_for([n]) if low <= n <= high]
        places = [{int(p) + s for p in m} for m in masks for s in range(n - decontaminate.span_of(m) + 1)]
        for changed in itertools.combinations(range(n), wrong):
            assert any(p.isdisjoint(changed) for p in places), (n, changed)


def test_finds_every_overlap_within_the_rule(spark):
    r = random.Random(8)
    texts = [(n, prose(700 + n, n)) for n in range(5, 21)] + [(40, prose(740, 40)), (None, prose(741, 20))]
    rows = []
    for i, t in texts:
        for _ in range(12):
            item = t.split()
            part = item[:20]
            for at in r.sample(range(len(part)), len(part) // 5):
                part[at] = "other"
            rows.append((len(rows), " ".join([prose(len(rows), 9), *part, prose(2000 + len(rows), 9)]), "en", "s"))
    rows.append((None, f"{prose(1, 9)} {texts[3][1]}", "en", "s"))
    want = brute(rows, texts)
    assert len([k for k in want if want[k] == 16]) >= 12
    for limit in (decontaminate.MOST_BROADCAST, 0):
        got = {(x.id, x.item): x.agreed for x in decontaminate.overlaps(table(spark, rows), items(spark, texts), most_broadcast=limit).collect()}
        assert got == want
