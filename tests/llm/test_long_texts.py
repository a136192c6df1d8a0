"""Each operator on a text longer than a block, beside short ones."""

import collections
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from datalathe.llm import bpe, counts, exact, lm, near, packing, quality, suffix
from tests.llm import brute

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(30_000)]
    long = " ".join(r.choice(vocabulary) for _ in range(1_200_000))
    assert len(long) > 6 << 20
    return [(1, long), (2, "Short text é"), (3, long[:3000]), (4, None), (5, long.upper()), (6, long[:3000] + " end")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2).selectExpr("*", "'en' AS lang").cache()


def test_tokens(docs, rows):
    library = Tokenizer.from_file(WORDS)
    want = {i: np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for i, t in rows}
    assert {r.doc_id: bytes(r.ids) for r in bpe.encode_decode(docs, WORDS).select("doc_id", "ids").collect()} == want
    assert {r.doc_id: r.n_tokens for r in counts.count_tokens(docs, WORDS, limit=10).collect()} == {i: len(b) // 4 for i, b in want.items()}


def test_packing(docs, rows):
    library = Tokenizer.from_file(BYTES)
    pieces = collections.defaultdict(list)
    for p in packing.pack(docs, BYTES, window=1024, end_id=0).collect():
        pieces[p.doc_id].append((p.start, bytes(p.ids)))
    for i, t in rows:
        want = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        got = b"".join(ids for _, ids in sorted(pieces[i]))
        assert got == want


def test_quality(spark, rows):
    """One row's words are arrays of the row, so a very long text needs heap: 1.5 MB here, for the tests' 1 GB."""
    short = [(i, t if t is None else t[:1_500_000], "en") for i, t in rows if i != 5]
    df = spark.createDataFrame(short, "doc_id long, text string, lang string").repartition(2)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality_rules(df).collect()}
    assert got == {i: brute.quality(t) for i, t, _ in short}


def test_exact(docs, rows):
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(docs).collect()} == {1: (5, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (5, 2), 6: (6, 1)}


def test_near(docs):
    got = {r.doc_id: r.component_id for r in near.near_groups(docs, 3, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 3}


def test_repeats(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdefgh \n") for _ in range(5 << 20))
    passage = "".join(r.choice("xyz ") for _ in range(300))
    rows = [(1, long[:1000] + passage + long[1000:]), (2, passage + "end"), (3, None)]
    got = {x.doc_id: (x.n_bytes, [(s.start, s.end) for s in x.spans]) for x in suffix.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string"), depth=200).collect()}
    assert got == {1: (len(long) + 300, [(1000, 1300)]), 2: (303, [(0, 300)]), 3: (0, [])}


def test_scores(docs, rows):
    want = {x[0]: x for x in brute.model(rows)}
    for x in lm.lm_scores(docs).collect():
        _, held, n, known, total, base, score = want[str(x.doc_id)]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held, n, known, total)
        assert x.base_score == pytest.approx(base) and x.score == pytest.approx(score, rel=0.02)
