"""Each operator against plain Python, on hand-made rows (nulls, empty and long texts, ties, repeated rows, clashing
column names, an empty table) and on the smallest documents."""

import mmap
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from datalathe.llm import bpe, chat, counts, exact, lm, near, packing, pii, quality, suffix
from datalathe.llm.text import unsqueeze
from datalathe.llm.trie import BigramTrie
from tests.llm import brute

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "/root/testdata/sf0.001/documents.parquet"


def odd_rows():
    r = random.Random(3)
    base = "".join(r.choice("abcdé \n") for _ in range(1500))
    rows = [(None, "X y"), (None, "x y"), (1, None), (2, ""), (2, ""), (3, "ÉA"), (4, "Éa"), (5, "éa"), (6, base), (6, base), (7, base[:700] + "X" + base[700:]),
            (8, base[100:390]), (9, "a" * 900), (10, "é🙂 4111 1111 1111 1111 +1 (456) 555-2186 x@y x@y.z@q.r 1.2.3.4.5 300.1.1.1 a@b.c_x@y.z"),
            (11, "don't I'LL 'S <|endoftext|>x  <|startoftext|> İΣ ½ 日本 a\x1cb  ́   é́\n\n"), (12, "one two three " * 40), (13, " \t\x0b\n"),
            (14, "# a|b\nx\nx\n\nx # a|b c # a|b c"), (15, "1" * 3000 + " " + "a." * 1500 + "@")]
    for i in range(40):
        t = list(base[r.randrange(500):][:r.randrange(50, 900)])
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = r.choice("XYZ")
        rows.append((20 + i, "".join(t)))
    return rows


@pytest.fixture(scope="module", params=["odd", "documents"])
def docs(request, spark):
    if request.param == "odd":
        return spark.createDataFrame(odd_rows(), "doc_id long, text string").repartition(3).withColumns(
            {c: F.lit(None if c == "rid" else "en") for c in ("id", "key", "row", "rid", "t", "lang")}).cache()
    return spark.read.parquet(DOCS)


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def key(i):
    return str(i)


def test_bpe_equals_the_library(docs, rows):
    library = Tokenizer.from_file(WORDS)
    want = sorted((key(i), np.array(e.ids, "<u4").tobytes(), library.decode(e.ids, skip_special_tokens=False))
                  for (i, _), e in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True))
    got = bpe.encode_decode(docs, WORDS).collect()
    assert sorted((key(r.doc_id), bytes(r.ids), r.decoded) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    counted = counts.count_tokens(docs, WORDS, limit=100).collect()
    assert sorted((key(r.doc_id), r.n_tokens) for r in counted) == sorted((i, len(b) // 4) for i, b, _ in want)
    assert sorted((key(r.doc_id), r.n_bytes, r.over_limit == (r.n_tokens > 100)) for r in counted) == sorted((key(i), len((t or "").encode()), True) for i, t in rows)


def test_bpe_of_random_strings():
    r, table = random.Random(1), bpe.word_bpe(WORDS)
    texts = ["".join(r.choice("ab'sSt  \né́日1½Σ<|endoftext|>\x1c_-.ÀÉ×÷") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    from datalathe.llm.text import distinct_spans, text_blocks
    import pyarrow as pa

    for block in text_blocks(iter([pa.RecordBatch.from_pydict({"i": list(range(len(texts))), "t": texts})]), 20_000):
        buf, starts, ends, from_ = table.pre_tokens(block)
        first, number, _ = distinct_spans(buf, starts, ends)
        ids, at = table.encode_spans(buf, starts[first], ends[first])
        for k, i in enumerate(block.ids):
            got = [x for n in number[from_[k]:from_[k + 1]] for x in ids[at[n]:at[n + 1]].tolist()]
            assert got == table.library.encode(texts[i], add_special_tokens=False).ids, texts[i]


def test_packing(docs, rows):
    got = packing.pack(docs, BYTES).collect()
    sequences, whole = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length, r.padded))
        whole[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        own.sort()
        assert [o for o, _, _ in own] == np.cumsum([0, *(n for _, n, _ in own)])[:-1].tolist()
        fill = sum(n for _, n, _ in own)
        assert fill <= 1024 and own[0][2] == (fill if fill & (fill - 1) == 0 else 1024)
    library = Tokenizer.from_file(BYTES)
    once = [(i, t) for i, t in rows if [x for x, _ in rows].count(i) == 1]
    for (i, _), e in zip(once, library.encode_batch([t or "" for _, t in once], add_special_tokens=False), strict=True):
        assert b"".join(x for _, x, _ in sorted(whole[i])) == np.array([*e.ids, 0], "<u4").tobytes()


def test_best_fill_is_best():
    r = random.Random(2)
    for _ in range(200):
        lengths = {r.randint(1, 30): r.randint(1, 4) for _ in range(r.randint(1, 5))}
        capacity, reach = r.randint(1, 60), {0}
        for n, c in lengths.items():
            reach = {s + n * k for s in reach for k in range(c + 1)}
        chosen = packing.best_fill(lengths, capacity)
        assert all(c <= lengths[n] for n, c in chosen.items())
        assert sum(n * c for n, c in chosen.items()) == max(s for s in reach if s <= capacity)


def test_quality(docs, rows):
    got = quality.quality_rules(docs).collect()
    assert sorted((key(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((key(i), *brute.quality(t)) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)


def test_quality_keeps_good_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality.quality_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not base_failed").join(labels, "doc_id")
    found = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert (1, False) not in found and found[0, False] > 0


def test_quality_distances_and_verdict(spark):
    docs = spark.read.parquet(DOCS)
    rows = docs.select("doc_id", "text", "lang").collect()
    want = {r.doc_id: x for r, x in zip(rows, brute.divergence([(r.text, r.lang) for r in rows], quality.COMMON_WORDS), strict=True)}
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(want)
    for r in got:
        for have, value in zip((r.char_jsd, r.word_jsd), want[r.doc_id]):
            assert (have is None) == (value is None) and (have is None or abs(have - value) < 1e-6)
        assert r.kept == want[r.doc_id][2]


def test_quality_rejects_invented_words(spark):
    """Lists of invented words, short ones and ones with a common word here and there, beside good texts of equal length."""
    r, rows = random.Random(6), []
    for i in range(60):
        n = (60, 100, 149, 400)[i % 4]
        good = [r.choice(quality.COMMON_WORDS["en"]) if r.random() < 0.15 else r.choice(["tree", "house", "walked", "under"]) + chr(97 + r.randrange(26)) for _ in range(n)]
        junk = ["".join(r.choice("aeinorst") for _ in range(7)) for _ in range(n)]
        junk[:n // 120] = ["the"] * (n // 120)
        rows += [(2 * i, " ".join(good), "en"), (2 * i + 1, " ".join(junk), "en" if i < 12 else None)]
    kept = {x.doc_id for x in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("kept").collect()}
    assert kept == {2 * i for i in range(60)}


def test_suffix(docs, rows):
    got = suffix.repeated_strings(docs).collect()
    small = brute.repeats(rows)
    assert sorted((key(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got) == small


def test_suffix_family_over_batches():
    r = random.Random(4)
    family, parts = suffix.SuffixFamily(20), []
    for _ in range(9):
        text = bytes(r.choice(b"ab") for _ in range(300)) + (parts[0][50:90] if parts else b"")
        parts.append(text)
        family.add(np.frombuffer(text, np.uint8), np.arange(len(text) - 19))
    every = [t[p:p + 20] for t in parts for p in range(len(t) - 19)]
    assert family.repeated.tolist() == [every.count(x) > 1 for x in every]
    assert [x.weight for x in family.levels] == [8, 1]


def test_personal(docs, rows):
    got = pii.find_personal(docs).select("doc_id", pii.written("base").alias("base"), pii.written("found").alias("found")).collect()
    assert sorted((key(r.doc_id), r.base) for r in got) == sorted((key(i), brute.personal(t)) for i, t in rows)
    assert all(set(filter(None, r.base.split(","))) <= set(r.found.split(",")) for r in got)


def test_personal_found_by_context(spark):
    rows = [(i, f"please reach me at user{i}@mail.example.com today") for i in range(12)] + [
        (50, "please reach me at KX-4471-9920 today"), (51, "License, Version 2024.10.01-b7"), (52, "pay at 4111111111111112 now")]
    got = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string"), with_rows=True)
    found = {r.doc_id: (r.found, r.clean) for r in got.select("doc_id", pii.written("found").alias("found"), pii.redacted(F.col("row.text"), "found").alias("clean")).collect()}
    assert found[50] == ("id:19:31", "please reach me at [ID] today")
    assert found[51][0] == "" and found[52][0] == "" and found[3][1] == "please reach me at [EMAIL] today"


def test_exact(docs, rows):
    got = exact.exact_groups(docs, with_rows=True).collect()
    assert sorted((key(r.doc_id), key(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute.exact(rows)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept) and all(r.row.doc_id == r.doc_id for r in got)


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near(docs, rows, k, percent):
    got = near.near_groups(docs, k, percent).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == brute.near(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_links_that_miss_the_pivot(spark):
    """A chain: the smallest is linked with the next only, each with its neighbours."""
    words = [f"w{i}" for i in range(220)]
    rows = [(i, " ".join(words[4 * i:4 * i + 120])) for i in range(24)]
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == brute.near(rows, 3, 85)


def test_model(docs, rows):
    got = lm.lm_scores(docs).collect()
    have = sorted((key(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    want = brute.model(rows)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert all(abs(a[5] - b[5]) <= 1e-9 * b[2] + 1e-9 and abs(a[6] - b[6]) <= 0.02 * b[2] for a, b in zip(have, want, strict=True))


def test_model_sends_a_hot_bigram_once_for_each_block(spark):
    rows = [(i, "hot " * (2000 + i) + f"w{i % 3}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks = lm._bigrams(df, "doc_id", "text")[0]
    sent = blocks.select(F.explode("bigrams").alias("b")).select("b.*").drop("shard").collect()
    assert max(len(unsqueeze(x)) for r in sent for x in r) <= 8  # hot hot, end hot, hot w0-w2, w0-w2 end
    have = sorted((key(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.lm_scores(df).collect())
    want = brute.model(rows)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert all(abs(a[6] - b[6]) <= 0.02 * b[2] for a, b in zip(have, want, strict=True))


def test_model_beats_unigrams_on_held_out(spark):
    scored = lm.lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    r = scored.agg(F.sum("score").alias("two"), F.sum("base_score").alias("one")).first()
    assert r.two > r.one


def test_trie_from_a_memory_map(tmp_path):
    r = np.random.default_rng(5)
    pairs = np.unique(r.integers(0, 400, 5000) * 1000 + r.integers(0, 1000, 5000))
    context, word = pairs // 1000, pairs % 1000
    log_p = -r.random(len(pairs)) * 5
    own = np.unique(context)
    path = tmp_path / "trie"
    path.write_bytes(BigramTrie.build(context, word, log_p, np.full(len(own), -0.5), 400, 1000))
    with path.open("rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as mapped:
        trie = BigramTrie(mapped)
        asked = np.arange(400 * 1000)
        got, backoff = trie.query(asked // 1000, asked % 1000)
        assert np.array_equal(asked[~np.isnan(got)], pairs)
        assert np.abs(got[~np.isnan(got)] - log_p).max() <= 5 / 256 + 1e-6 and np.isclose(backoff[0], -0.5)
        del trie


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", None),
             (2, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, None, "x"), (None, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("a", F.lit(1))
    got = {r.pair_id: r for r in chat.format_preferences(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    assert got[0].n_prompt_turns == 1 and got[0].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert got[0].chosen == "<|im_start|>assistant\nyes<|im_end|>\n" and [(m.length, m.learn) for m in got[0].chosen_mask] == [(22, False), (14, True)]
    assert got[0].rejected.endswith("user\n<|im_end|>\n") and sum(m.length for m in got[0].rejected_mask) == len(got[0].rejected)
    assert (got[1].prompt, got[1].chosen, got[1].rejected) == ("<|im_start|>user\na<|im_end|>\n", "", "")
    assert got[2].prompt == "" and got[2].rejected == "" and got[None].n_prompt_turns == 0


def test_empty_tables(spark):
    docs = spark.read.parquet(DOCS).limit(0)
    for out in (bpe.encode_decode(docs, WORDS), counts.count_tokens(docs, WORDS), packing.pack(docs, BYTES), quality.quality_rules(docs), suffix.repeated_strings(docs),
                pii.find_personal(docs), exact.exact_groups(docs), near.near_groups(docs), lm.lm_scores(docs)):
        assert out.count() == 0


def test_pipeline_keeps_one_row_of_repeated_and_null_ids(spark):
    r = random.Random(7)
    one, two, three = (" ".join(f"w{r.randrange(10**6)}" for _ in range(150)) for _ in range(3))
    rows = [(1, one), (1, one + " more"), (None, one + " other"), (2, two), (None, three), (None, three + " more"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(x.doc_id, x.text[:20]) for x in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, one[:20]), (2, two[:20]), (None, three[:20]), (None, "")], key=str)


def test_pipeline(spark):
    docs, sf = spark.read.parquet(DOCS), DOCS.rsplit("/", 1)[0]
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    low = defaultdict(list)
    for i in kept:
        low[rows[i].translate(brute.LOW)].append(i)
    left = sorted(max(v) for v in low.values())
    left = [i for i, (j, _, c) in zip(sorted(map(str, left)), brute.near([(i, rows[i]) for i in left], 5, 80), strict=True) if c == j == i]
    out = corpus_pipeline.run(spark, sf).collect()
    assert {str(r.doc_id) for r in out} == set(left)
    library, pieces = Tokenizer.from_file(BYTES), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append((r.start, bytes(r.ids)))
    for i, own in pieces.items():
        ids = np.frombuffer(b"".join(x for _, x in sorted(own)), "<u4")
        text = library.decode(ids[:-1].tolist(), skip_special_tokens=False)
        assert ids[-1] == 0 and not brute.personal(text)
        if not brute.personal(rows[i]):
            assert text.strip() == rows[i].strip() and zlib.crc32(text.encode())
