"""Language-model scores from a sharded bigram trie.

Texts become blocks of word numbers. Vocabularies are exchanged by word hash,
which gives each word a number and its training count; distinct bigrams of a
block are exchanged by context. A shard sums their training counts, builds its
Elias-Fano trie, and answers its own queries, so neither the vocabulary nor the
model is ever whole in one place. A bigram's occurrences stay with their block:
a shard sees each bigram once for each block, and returns one probability for it. The context of a text's first word is the end
of a text. Probabilities: P(w|v) = (c(vw) + MU * P(w)) / (c(v) + MU)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalathe.llm.counts import pack_words, unpack_words
from datalathe.llm.text import (LOWER, arrow_type, distinct_spans, forget, mix, shards, squeeze, stored, text_blocks, two_columns,
                                unsqueeze, word_spans)
from datalathe.llm.trie import BigramTrie

#: Bytes of text in a block.
LM_BLOCK_BYTES = 6 << 20
#: Weight of the unigram distribution in a bigram's.
MU = 4.0
#: A context with more training tokens is divided by its successors' hashes into parts of about this many tokens.
CONTEXT_TOKENS = 1 << 20
#: The end of a text, as a word that no text holds.
END = 10
VALUES = ("contexts", "context_n", "context_words", "words", "word_n", "train")


def _blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each block of texts: ids, training flags, the tokens as places in the block's vocabulary."""
    source = two_columns(df, id_col, text_col)
    kind = source.schema["id"].dataType
    held = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    source = source.select(F.struct("id", held.alias("held")).alias("id"), "text")
    n_shards = shards(df.sparkSession)
    schema = pa.schema([
        ("block", pa.string()), ("ids", pa.list_(arrow_type(kind))), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())),
        ("tokens", pa.binary()), ("vocabulary", pa.list_(pa.struct([
            ("shard", pa.int32()), ("sizes", pa.binary()), ("words", pa.binary()), ("train", pa.binary())])))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, texts in enumerate(text_blocks(batches, LM_BLOCK_BYTES)):
            starts, ends, from_ = word_spans(texts)
            # after each text's words its end: a byte that is no part of a word
            at = from_[1:]
            starts = np.insert(starts, at, len(texts.buf))
            ends = np.insert(ends, at, len(texts.buf) + 1)
            n = np.diff(from_) + 1
            buf = np.append(LOWER[texts.buf], np.uint8(END))
            held = np.array([x["held"] for x in texts.ids], bool)
            first, word, hashes = distinct_spans(buf, starts, ends)
            shard = (hashes % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            tokens = place[word]
            train = np.bincount(tokens[np.repeat(~held, n)], minlength=len(order))
            vocabulary = pack_words(buf, starts[first[order]], ends[first[order]], shard[order])
            cuts = np.cumsum([0, *np.bincount(shard, minlength=n_shards)[[v["shard"] for v in vocabulary]]]).tolist()
            yield pa.RecordBatch.from_pylist([{
                "block": f"{part}-{k}", "ids": [x["id"] for x in texts.ids], "held": held.tolist(), "n_tokens": n.tolist(), "tokens": squeeze(tokens),
                "vocabulary": [v | {"train": squeeze(train[a:b])} for v, (a, b) in zip(vocabulary, itertools.pairwise(cuts), strict=True)]}], schema)

    return stored(source.mapInArrow(number, f"""
        block string, ids array<{kind.simpleString()}>, held array<boolean>, n_tokens array<bigint>, tokens binary,
        vocabulary array<struct<shard int, sizes binary, words binary, train binary>>"""), "lm-blocks")


def _bigrams(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """Blocks with base scores and their bigrams by shard; N and V of the training tokens."""
    spark = df.sparkSession
    n_shards = shards(spark)
    blocks = _blocks(df, id_col, text_col)
    kind = blocks.schema["ids"].dataType.elementType

    def words(rows: pd.DataFrame) -> pd.DataFrame:
        buf, starts, ends, from_ = unpack_words(rows)
        first, number, _ = distinct_spans(buf, starts, ends)
        train = np.concatenate([unsqueeze(x) for x in rows["train"]])
        count = np.zeros(len(first), np.int64)
        np.add.at(count, number, train)
        ids = number * n_shards + int(rows["shard"].iloc[0])
        one = np.arange(len(rows)) == 0
        return pd.DataFrame({"block": rows["block"], "shard": rows["shard"],
                             "counts": [squeeze(count[number[a:b]]) for a, b in itertools.pairwise(from_.tolist())],
                             "numbers": [squeeze(ids[a:b]) for a, b in itertools.pairwise(from_.tolist())],
                             "known": np.where(one, int((count > 0).sum()), 0), "total": np.where(one, int(count.sum()), 0)})

    vocabulary = blocks.select("block", F.explode("vocabulary").alias("v")).select("block", "v.*")
    counted = stored(vocabulary.groupBy("shard").applyInPandas(
        words, "block string, shard int, counts binary, numbers binary, known bigint, total bigint"), "lm-words")
    total, known = counted.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    per_block = counted.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "counts", "numbers"))).alias("words"))

    schema = pa.schema([
        ("block", pa.string()), ("ids", pa.list_(arrow_type(kind))), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())),
        ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("seen", pa.binary()), ("docs", pa.binary()),
        ("bigrams", pa.list_(pa.struct([("shard", pa.int32()), *[(v, pa.binary()) for v in VALUES]])))])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                count = np.concatenate([unsqueeze(w["counts"]) for w in row["words"]])
                word = np.concatenate([unsqueeze(w["numbers"]) for w in row["words"]])
                tokens, n = unsqueeze(row["tokens"]), np.array(row["n_tokens"], np.int64)
                doc = np.repeat(np.arange(len(n)), n)
                log_p = np.log10((count + 0.5) / (total + 0.5 * (known + 1)))
                base = np.bincount(doc, log_p[tokens], len(n))
                n_known = np.bincount(doc, count[tokens] > 0, len(n)).astype(np.int64)
                last = np.cumsum(n) - 1
                context = np.concatenate((tokens[:1], tokens[:-1]))
                context[last - n + 1] = tokens[last]
                # distinct bigrams, in order of shard, context and word
                pair = context * len(count) + tokens
                order = np.argsort(pair, kind="stable")
                new = np.append(True, pair[order][1:] != pair[order][:-1])
                begin = np.flatnonzero(new)
                seen = np.diff(np.append(begin, len(order)))
                train = np.add.reduceat(~np.array(row["held"], bool)[doc[order]], begin, dtype=np.int64)
                v, w = context[order[begin]], tokens[order[begin]]
                parts = (count[v] + CONTEXT_TOKENS - 1) // CONTEXT_TOKENS
                sub = np.where(parts > 1, (mix(word[w].astype(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64), 0)
                shard = (mix(word[v].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sub.astype(np.uint64)) % np.uint64(n_shards)).astype(np.int64)
                by = np.lexsort((word[w], word[v], shard))
                cuts = np.flatnonzero(np.append(True, shard[by][1:] != shard[by][:-1])).tolist()
                # the texts in which the bigrams occur, one after another
                take = np.repeat(begin[by] - (np.cumsum(seen[by]) - seen[by]), seen[by]) + np.arange(len(order))
                docs = squeeze(doc[order[take]])
                bigrams = []
                for a, b in itertools.pairwise([*cuts, len(by)]):
                    own = by[a:b]
                    head = np.flatnonzero(np.append(True, v[own][1:] != v[own][:-1]))
                    step = np.diff(word[w[own]], prepend=0)
                    step[head] = word[w[own[head]]]
                    bigrams.append({"shard": int(shard[own[0]]), "contexts": squeeze(word[v[own[head]]]), "context_n": squeeze(count[v[own[head]]]),
                                    "context_words": squeeze(np.diff(np.append(head, len(own)))), "words": squeeze(step), "word_n": squeeze(count[w[own]]),
                                    "train": squeeze(train[own])})
                yield pa.RecordBatch.from_pylist([{
                    "block": row["block"], "ids": row["ids"], "held": row["held"], "n_tokens": row["n_tokens"], "n_known": n_known.tolist(),
                    "base": base.tolist(), "seen": squeeze(seen[by]), "docs": docs, "bigrams": bigrams}], schema)

    out = blocks.drop("vocabulary").join(per_block, "block").select("block", "ids", "held", "n_tokens", "tokens", "words").mapInArrow(pairs, f"""
        block string, ids array<{kind.simpleString()}>, held array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base array<double>,
        seen binary, docs binary, bigrams array<struct<shard int, {", ".join(f"{v} binary" for v in VALUES)}>>""")
    out = stored(out, "lm-bigrams")
    forget(blocks, counted)
    return out, total, known


def _shard_table(rows: pd.DataFrame, total: int, known: int) -> tuple:
    """The trie of a shard's bigrams, and its distinct queries: contexts and words (as places), log10 P(word) and
    c(context); then the query of each entry of the rows, and the number of entries of each row."""
    got = {v: [unsqueeze(x) for x in rows[v]] for v in VALUES}
    context = np.concatenate([np.repeat(c, n) for c, n in zip(got["contexts"], got["context_words"], strict=True)])
    context_n = np.concatenate([np.repeat(c, n) for c, n in zip(got["context_n"], got["context_words"], strict=True)])
    word = []
    for step, n in zip(got["words"], got["context_words"], strict=True):
        value = np.cumsum(step)
        head = np.cumsum(n) - n
        word.append(value - np.repeat(np.concatenate(([0], value))[head], n))
    word, word_n, train = np.concatenate(word), np.concatenate(got["word_n"]), np.concatenate(got["train"])
    contexts, context = np.unique(context, return_inverse=True)
    words, word = np.unique(word, return_inverse=True)
    log_word = np.log10((word_n + 0.5) / (total + 0.5 * (known + 1)))
    order = np.argsort(context * len(words) + word, kind="stable")
    new = np.append(True, (context[order][1:] != context[order][:-1]) | (word[order][1:] != word[order][:-1]))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    first = order[new]
    count = np.add.reduceat(train[order], np.flatnonzero(new))
    there = np.flatnonzero(count > 0)
    at = first[there]
    log_p = np.log10((count[there] + MU * 10 ** log_word[at]) / (context_n[at] + MU))
    _, one = np.unique(context[at], return_index=True)
    trie = BigramTrie.build(context[at], word[at], log_p, np.log10(MU / (context_n[at][one] + MU)), len(contexts), len(words))
    return trie, context[first], word[first], log_word[first], context_n[first], number, [len(x) for x in got["train"]]


def lm_tries(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, trie): the model that lm_scores uses, one compact buffer for each shard (see BigramTrie)."""
    blocks, total, known = _bigrams(df, id_col, text_col)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "trie": [_shard_table(rows, total, known)[0]]})

    return blocks.select(F.explode("bigrams").alias("b")).select("b.*").groupBy("shard").applyInPandas(build, "shard int, trie binary")


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text by a model of the texts whose crc32(id as text) mod 5 is not 1.

    Returns one row for each row: the id column, held_out (the remainder is 1), n_tokens (words, lower-cased A-Z, and
    an end), n_known (tokens with a training count), train_tokens, base_score (add-half unigrams, log10), score (the
    trie's log10 probability of the text; 8-bit codes, at most a 256th of their range off, summed from single precision). A null or empty text is
    its end alone; a null id counts as the empty string; repeated rows count and are returned as often as they are
    there. With no training texts every token is unknown. The driver holds two numbers, N and V.
    """
    blocks, total, known = _bigrams(df, id_col, text_col)
    kind = blocks.schema["ids"].dataType.elementType

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        buffer, context, word, log_word, context_n, number, sizes = _shard_table(rows, total, known)
        log_p, backoff = BigramTrie(buffer).query(context, word)
        backoff = np.where(np.isnan(backoff), np.log10(MU / (context_n + MU)), backoff)
        log_p = np.where(np.isnan(log_p), backoff + log_word, log_p)
        minus = (-log_p).astype("<f4").view("<u4")[number]
        return pd.DataFrame({"block": rows["block"], "shard": rows["shard"],
                             "minus": [squeeze(x) for x in np.split(minus, np.cumsum(sizes)[:-1])]})

    # what a block needs again is kept apart, so that its bigrams can go once the shards have answered
    local = stored(blocks.select("block", "ids", "held", "n_tokens", "n_known", "base", "seen", "docs"), "lm-local")
    partial = stored(blocks.select("block", F.explode("bigrams").alias("b")).select("block", "b.*").groupBy("shard").applyInPandas(
        score, "block string, shard int, minus binary"), "lm-answers")
    forget(blocks)
    # the block's bigrams lie in order of the shards
    per_block = partial.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "minus"))).alias("parts"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                log_p = -np.concatenate([unsqueeze(p["minus"]) for p in row["parts"]]).astype("<u4").view("<f4").astype(np.float64)
                score_ = np.bincount(unsqueeze(row["docs"]), np.repeat(log_p, unsqueeze(row["seen"])), len(row["ids"]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["ids"], arrow_type(kind)), pa.array(row["held"], pa.bool_()), pa.array(row["n_tokens"], pa.int64()),
                    pa.array(row["n_known"], pa.int64()), pa.array(row["base"], pa.float64()), pa.array(score_)],
                    names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = local.join(per_block, "block").mapInArrow(
        finish, f"id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
