"""Spans discovered by context against plain Python, and texts with very many matches."""

import random
import re
import time
from collections import defaultdict

import pytest

from datalathe.llm import pii
from tests.llm import brute


def plain(rows, least_score=0.75, least_seeds=5, least_length=7, least_digits=4):
    """{row: [(start, end)]} of the tokens that contexts discover in texts."""
    instances = []  # row, start, end, text, patterns, is a seed
    for n, text in enumerate(rows):
        text = text or ""
        taken = []
        for k, (name, rule) in enumerate(brute.RULES.items()):
            for m in re.finditer(rule, text, re.ASCII):
                digits = re.sub("[^0-9]", "", m[0])
                if name == "card" and not 14 <= len(digits) <= 19:
                    continue
                valid = f"{name}:{m.start()}:{m.end()}" in brute.personal(text).split(",")
                taken.append((m.start(), m.end()))
                if valid:
                    instances.append((n, *m.span(), m[0], context(text[:m.start()]), True))
        for m in re.finditer(r"\S+", text):
            if not re.search("[0-9_@]", m[0]):
                continue
            core = re.search(r"[A-Za-z0-9](?:.*[A-Za-z0-9])?", m[0])
            if core:
                a, b = m.start() + core.start(), m.start() + core.end()
                if not any(x < b and a < y for x, y in taken):
                    instances.append((n, a, b, core[0], context(text[:m.start()]), False))
    edges, kinds = defaultdict(set), {}
    for _, _, _, text, patterns, seed in instances:
        for p in patterns:
            edges[p].add(text)
            kinds[p, text] = kinds.get((p, text), False) or seed
    strong = {p: ts for p, ts in edges.items() if sum(kinds[p, t] for t in ts) >= least_seeds}
    of_text = defaultdict(set)
    for p, ts in strong.items():
        for t in ts:
            of_text[t].add(p)
    known = {t: any(kinds[p, t] for p in ps) for t, ps in of_text.items()}
    score, best = {t: float(k) for t, k in known.items()}, {}
    while True:
        of_pattern = {p: sum(score[t] for t in ts) / (len(ts) + 0.2) for p, ts in strong.items()}
        best = {t: max(of_pattern[p] for p in ps) for t, ps in of_text.items()}
        new = {t: 1.0 if known[t] else 0.5 * best[t] for t in of_text}
        change = max((abs(new[t] - score[t]) for t in new), default=0)
        score = new
        if change < pii.SETTLED:
            break
    out = defaultdict(list)
    for n, a, b, text, patterns, seed in instances:
        if patterns and not seed and len(text) >= least_length and (len(re.sub("[^0-9]", "", text)) >= least_digits or re.search("[_@]", text)) \
                and text in known and not known[text] and best[text] >= least_score:
            out[n].append((a, b))
    return dict(out)


def context(before):
    """The patterns before a match: the last two words, and the last."""
    m = re.search(r"(?:(?<!\S)(\S+\s+))?(?<!\S)\S+\s+$", before)
    words = m[0].lower().split() if m else []
    return {" ".join(words), words[-1]} if words else set()


def odd_rows():
    r = random.Random(9)
    ident = lambda: r.choice([f"KX-{r.randrange(10**8):08d}", f"user_{r.choice('abc')}{r.choice('xyz')}_name", f"@handle{r.randrange(99)}x"])
    rows = [None, "", "__", "mail jane.doe@mail.example.com", "x " * 300 + "call +1 (456) 555-2186"]
    rows += [f"My mail is user{i}@mail.example.com, bye" for i in range(40)] + [f"write to jane{chr(97 + i % 26)}{chr(97 + i // 26)}@a.org now" for i in range(40)]
    rows += [f"{r.choice(['mail is', 'write to', 'so to', 'order'])} {r.choice([ident(), 'v1', 'a@b', '12345678', 'nothing'])} {r.choice(['', 'and 7'])}" for _ in range(40)]
    rows += [f"order {10**7 + i}" for i in range(30)] + [f"order ok{i}@x.org" for i in range(6)] + rows[5:8]
    rows += ["seen  WRITE\n\nto\n\tagent_smith_7, twice " + "y" * 200 + " is bond_007_james"]
    return rows


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_discovered_spans_equal_plain_python(spark, table):
    if table == "odd":
        rows = odd_rows()
        df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, pattern string").repartition(3)
    else:
        df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
        rows = [r.text for r in df.orderBy("doc_id").collect()]
    want = plain(rows)
    got = {r.doc_id: sorted((s.start, s.end) for s in r.found if s.kind == 4) for r in pii.find_personal(df).collect()}
    assert {i: s for i, s in got.items() if s} == {i: sorted(s) for i, s in want.items()}
    if table == "odd":
        assert len(want) > 5


def test_a_long_text_with_a_million_matches(spark):
    text = " ".join(str(i) for i in range(900_000))
    start = time.time()
    row = pii.find_personal(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).where("doc_id = 1").first()
    assert len(row.base) == 0 and time.time() - start < 150
