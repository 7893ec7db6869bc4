import random
import re
from collections import Counter

import awkward

from awkward import none, odd  # noqa: F401
from docquarry.llm import personal_data as p


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits(v):
    return re.sub("[^0-9]", "", v)


CHECKS = {
    "email": lambda v: True,
    "ip": lambda v: all(int(x) <= 255 for x in v.split(".")),
    "card": lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v)),
    "phone": lambda v: 9 <= len(digits(v)) <= 15,
}


def expected(text):
    return [
        (k, m.start(), m.end())
        for k, kind in enumerate(p.KINDS)
        for m in re.finditer(p.BASE[kind], text or "")
        if CHECKS[kind](m.group())
    ]


def spans(column):
    return [tuple(s) for s in column]


def test_base_against_brute_force(spark, odd, none):
    tricky = [
        "a@b.com_x@y.org", "a@b..c a@@b.c x@-.-", "..@a.b.c.", "1.2.3.4.5.6.7.8", "0001.2.3.4", "256.1.1.1 1.256.1.1.1",
        "4111-1111-1111-1111", "4111  1111 1111 1111", "94111111111111111", "4111 1111 1111 11112222", "0000000000000", "1 2 3 4 5 6 7 8 9 0 1 2 8",
        "+1+2 555 555 5555)", "+12345678", "+123456789", "+1 (((((", "++49 30 1234567.", "é😀 a@b.co 😀 +33 1 23 45 67 89", "9" * 3000, "a" * 50_000 + "@", "x@y.zz 10.0.0.1 " * 3_000, "123456 " * 30_000, "1." * 20_000, "a@" * 5_000,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    for r in p.personal_spans(df).collect():
        assert spans(r.base) == expected(tricky[r.doc_id]), tricky[r.doc_id][:50]
    got = Counter((r.doc_id, tuple(spans(r.base))) for r in p.personal_spans(odd).collect())
    assert got == Counter((i, tuple(expected(t))) for i, t, *_ in awkward.rows())
    assert p.personal_spans(none).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"Text {i}. Please call me at +1 555 010 {1000 + i} today.") for i in range(30)]
    rows += [(100, "Please call me at 555-0199-77 today."), (101, "Please see page 1234567 now."), (102, "token 1234567")]
    got = {r.doc_id: r for r in p.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans(got[100].base) == [] and spans(got[100].spans) == [(3, 18, 29)]
    assert all(not got[i].spans for i in (101, 102))
    assert all(r.base == r.spans for i, r in got.items() if i < 100)


def test_found_values_find_patterns_and_spaced_candidates(spark):
    rows = [(i, f"Text {i}. Please call me at +1 555 010 {1000 + i} today.") for i in range(60)]
    rows += [(100 + i, f"Please call me at 555-0199-{70 + i} today.") for i in range(6)]
    rows += [(200 + i, f"Office line: 555-0199-{70 + i} or so.") for i in range(6)]  # no seed in this context
    rows += [(300, "Office line: 555-0288-11 or so.")]
    rows += [(400, "Please call me at (555) 010 1234 today."), (401, "Please see page 1234567 now.")]
    rows += [(500 + i, f"Kindly write to user{i}@mail.example.org soon.") for i in range(30)]
    rows += [(600, "Kindly write to jane@localhost soon.")]
    cards = [n for n in map(str, range(4000000000000000, 4000000000000300)) if luhn(n)]
    rows += [(700 + i, f"Kindly charge card {n} soon.") for i, n in enumerate(cards)]
    rows += [(1200, "Kindly charge card 4111 1111 1111 1112 soon.")]
    got = {r.doc_id: spans(r.spans) for r in p.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] for i in (100, 105, 200, 205))
    assert got[300] == [(3, 13, 24)]
    assert got[400] == [(3, 18, 32)] and got[600] == [(0, 16, 30)]
    assert got[1200] == [(2, 19, 38)] and got[401] == []


def test_mask(spark):
    rows = [("ab a@b.co é 1.2.3.4!", [(1, 12, 19), (0, 3, 9), (2, 4, 9)]), ("x", []), (None, [])]
    df = spark.createDataFrame(rows, "text string, spans array<struct<kind:int,start:int,stop:int>>")
    assert [r.t for r in df.select(p.mask(df.text, df.spans).alias("t")).collect()] == ["ab [email] é [ip]!", "x", None]


def test_hosts_of_very_many_labels(spark):
    texts = ["x@" + "a." * 100_000 + "a", "x@" + "ab-1." * 60_000, "y x@a" + ".b" * 30_000 + ". z@c.d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in p.personal_spans(df).collect():
        assert spans(r.base) == expected(texts[r.doc_id])


def test_mask_against_a_plain_pass(spark):
    pick = random.Random(2)
    rows = []
    for n in (1, 50, 5_000, 100_000):
        text = "".join(pick.choices("aé😀 \n", k=n * 3))
        cuts = sorted(pick.randrange(len(text) + 1) for _ in range(2 * n))
        found = [(pick.randrange(4), a, b) for a, b in zip(cuts[::2], cuts[1::2]) if a < b]
        found += [(k, a + 1, min(b + 2, len(text))) for k, a, b in found[:40] if b - a > 1]  # some overlap
        rows.append((text, found))
    df = spark.createDataFrame(rows, "text string, spans array<struct<kind:int,start:int,stop:int>>").repartition(4)
    got = {r.text: r.t for r in df.select("text", p.mask(df.text, df.spans).alias("t")).collect()}
    for text, found in rows:
        out, at = [], 0
        for start, stop, kind in sorted((a, b, k) for k, a, b in found):
            if start >= at:
                out += [text[at:start], f"[{p.KINDS[kind]}]"]
            at = max(at, stop)
        assert got[text] == "".join(out) + text[at:]


def test_main_path_is_native(odd):
    plan = p.personal_spans(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
