"""Ranked search against plain Python and DuckDB: odd rows, ties, many batches, a text of several blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from datalathe.llm import queries, ranking
from datalathe.llm.text import unsqueeze
from tests.llm.brute import LOW
from tests.oracle_harness import compare, duck

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k):
    """[(item_id, rank, id, score)] of (id, text) rows."""
    terms = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    total, n_docs = sum(sum(c.values()) for _, c in terms), sum(bool(c) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        asked, scored = set(TERM.findall((text or "").translate(LOW))), []
        for i, c in terms:
            m = 50 + 50 * sum(c.values()) * n_docs // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, n, i, -s) for n, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def odd_rows():
    r = random.Random(11)
    words = ["a", "É", "é", "été", "B2", "the", "x_y", "日本", "q" * 300, "IJ", "K"] + [f"w{i}" for i in range(300)]  # the Kelvin sign is no K
    docs = [(None, "the a"), (None, "the a"), (1, None), (2, ""), (3, " \n-."), (4, "the the the"), (4, "the the the"), (5, "\x7fthe\x80a_b")]
    docs += [(10 + i, " ".join(r.choice(words[:20] if r.random() < 0.3 else words) for _ in range(r.randrange(1, 120)))) for i in range(300)]
    docs += [(1000 + i, docs[20][1]) for i in range(70)]
    items = [(1, docs[20][1]), (2, "THE"), (2, "THE"), (3, None), (4, "nowhere"), (None, "é É b2 w5 w5 w6"), (5, " ".join(words)), (6, "w7 w8 w9")]
    return docs, items


@pytest.mark.parametrize("width,batch", [(1024, 512), (8, 3), (1, 512)])
def test_ranking_equals_plain_python(spark, monkeypatch, width, batch):
    monkeypatch.setattr(ranking, "QUERIES", batch)
    docs, items = odd_rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, block string").repartition(3)
    of = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, id int").coalesce(1)
    got = [(r.item_id, r["rank"], r.id, r.score) for r in ranking.rank(ranking.build_index(df, width=width), of, k=50).collect()]
    assert sorted(got, key=key) == sorted(plain(docs, items, 50), key=key)


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id string, text string")
    assert ranking.rank(ranking.build_index(none), items).collect() == []
    one = ranking.build_index(spark.createDataFrame([("x", "a b")], "doc_id string, text string"))
    assert ranking.rank(one, items.where("false")).collect() == []
    assert [(r.item_id, r.id) for r in ranking.rank(one, items).collect()] == [("1", "x")]


def test_a_text_of_more_than_a_block(spark):
    docs = [(1, "alpha beta " * 600_000), (2, "alpha"), (3, "gamma " * 10)]
    items = [(1, "beta"), (2, "alpha gamma")]
    index = ranking.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = [(r.item_id, r["rank"], r.id, r.score) for r in ranking.rank(index, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got) == sorted(plain(docs, items, 50))


def test_bounds_hold_and_prune(spark):
    """Every score is below its bound, and fewer documents are rescored than looked up."""
    sf = "/root/testdata/sf0.1"
    index = ranking.build_index(spark.read.parquet(f"{sf}/documents.parquet"))
    items = [(n, i, t) for n, (i, t) in enumerate(ranking.query_terms(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id", "text"))]
    searcher = ranking.Searcher(items, 50, (index.n_docs, index.n_terms, index.width, index.unit()))
    for row in index.table.collect():
        numbers = {c: unsqueeze(bytes(row[c])) for c in ("lengths", "sizes", "term", "tf", "df", "peak", "filled", "coordinate", "most")}
        terms = ranking.pa.array(row.terms)
        searcher.block(row.ids, *(numbers[c] for c in ("lengths", "sizes", "term", "tf")), terms, *(numbers[c] for c in ("df", "peak", "filled", "coordinate", "most")))
        impact = ranking.weights(numbers["df"], index.n_docs)[numbers["term"]] * ranking.saturated(numbers["lengths"], numbers["sizes"], numbers["tf"], index.n_docs, index.n_terms)
        sketch = np.zeros((len(row.ids), index.width), np.int64)
        sketch[np.repeat(np.arange(len(row.ids)), numbers["filled"]), numbers["coordinate"]] = numbers["most"]
        at = ranking.coordinates(terms, index.width)[numbers["term"]]
        assert (impact <= sketch[np.repeat(np.arange(len(row.ids)), numbers["sizes"]), at] * index.unit()).all() and numbers["most"].max() <= 255
    print(f"rescored {searcher.rescored} of {searcher.looked_up}")
    assert searcher.rescored < searcher.looked_up / 5


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    res = compare(spark, "op12_ranking", queries.op12_ranking, queries.ORACLE["op12_ranking"], sf, duck(sf))
    assert res["ok"], res
