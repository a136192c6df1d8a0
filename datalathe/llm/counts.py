"""Token counts without token ids.

Documents are cut into blocks that keep, for each document, its pre-tokens'
frequencies as numbers into the block's vocabulary. The vocabularies are
exchanged by word hash, so that each distinct pre-token is split into pieces
once over all documents; the piece counts come back to the blocks, which sum
frequency times pieces."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalathe.llm.bpe import word_bpe
from datalathe.llm.text import (arrow_type, distinct_spans, gather, shards, squeeze, stored, text_blocks, two_columns,
                                unsqueeze)

#: Larger blocks repeat fewer words; 8 MB of text take about 0.4 GB while they are worked on.
COUNT_BLOCK_BYTES = 8 << 20


def pack_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, shard: np.ndarray) -> list[dict]:
    """Words in order of their shard as one row for each shard: their lengths and their bytes."""
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, int)
    return [{"shard": int(shard[a]), "sizes": squeeze(ends[a:b] - starts[a:b]),
             "words": gather(buf, starts[a:b], ends[a:b]).tobytes()}
            for a, b in itertools.pairwise([*cuts.tolist(), len(shard)])]


def unpack_words(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of several rows: buffer, starts, ends, and where each row's words begin."""
    sizes = [unsqueeze(x) for x in rows["sizes"]]
    ends = np.cumsum(np.concatenate(sizes))
    return (np.frombuffer(b"".join(rows["words"]), np.uint8), ends - np.concatenate(sizes), ends,
            np.cumsum([0, *map(len, sizes)]))


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Tokens of every whole text by a word-BPE file of the tokenizers library.

    Returns one row for each row: the id column, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). A null or
    empty text has 0 bytes and 0 tokens; strings of special tokens count as one token; repeated rows are repeated;
    other columns are left out. Texts move through the cluster as compressed frequencies, never as token ids, and a
    word that is in every document costs one entry for each block.
    """
    source = two_columns(df, id_col, text_col)
    kind = source.schema["id"].dataType
    n_shards = shards(df.sparkSession)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        part = TaskContext.get().partitionId()
        for k, texts in enumerate(text_blocks(batches, COUNT_BLOCK_BYTES)):
            buf, starts, ends, from_ = bpe.pre_tokens(texts)
            first, number, hashes = distinct_spans(buf, starts, ends)
            shard = (hashes % np.uint64(n_shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            doc = np.repeat(np.arange(len(texts)), np.diff(from_))
            pair, times = np.unique(doc * (len(order) + 1) + place[number], return_counts=True)
            own, word = pair // (len(order) + 1), pair % (len(order) + 1)
            step = np.diff(word, prepend=0)
            new = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
            step[new] = word[new]
            yield pa.RecordBatch.from_pylist([{
                "block": f"{part}-{k}", "ids": texts.ids, "n_bytes": texts.sizes().tolist(),
                "n_words": np.bincount(own, minlength=len(texts)).tolist(), "words": squeeze(step), "times": squeeze(times),
                "vocabulary": pack_words(buf, starts[first[order]], ends[first[order]], shard[order]),
            }], schema)

    schema = pa.schema([
        ("block", pa.string()), ("ids", pa.list_(arrow_type(kind))), ("n_bytes", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int64())), ("words", pa.binary()), ("times", pa.binary()),
        ("vocabulary", pa.list_(pa.struct([("shard", pa.int32()), ("sizes", pa.binary()), ("words", pa.binary())])))])
    blocks = stored(source.mapInArrow(frequencies, f"""
        block string, ids array<{kind.simpleString()}>, n_bytes array<bigint>, n_words array<bigint>, words binary,
        times binary, vocabulary array<struct<shard int, sizes binary, words binary>>"""), "token-blocks")

    def pieces(rows: pd.DataFrame) -> pd.DataFrame:
        buf, starts, ends, from_ = unpack_words(rows)
        first, number, _ = distinct_spans(buf, starts, ends)
        _, at = word_bpe(tokenizer).encode_spans(buf, starts[first], ends[first])
        counts = np.diff(at)[number]
        return pd.DataFrame({"block": rows["block"], "shard": rows["shard"],
                             "pieces": [squeeze(counts[a:b]) for a, b in itertools.pairwise(from_.tolist())]})

    vocabulary = blocks.select("block", F.explode("vocabulary").alias("v")).select("block", "v.*")
    counted = vocabulary.groupBy("shard").applyInPandas(pieces, "block string, shard int, pieces binary")
    counted = counted.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "pieces"))).alias("pieces"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [unsqueeze(p["pieces"]) for p in row["pieces"] or []]
                value = np.concatenate(found) if found else np.zeros(0, np.int64)
                n_words = np.array(row["n_words"], np.int64)
                ends = np.cumsum(n_words)
                word = np.cumsum(unsqueeze(row["words"]))
                # steps start anew with each document
                word -= np.repeat(np.concatenate(([0], word))[ends - n_words], n_words)
                sums = np.concatenate(([0], np.cumsum(value[word] * unsqueeze(row["times"]))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], arrow_type(kind)), pa.array(row["n_bytes"], pa.int64()),
                     pa.array(sums[ends] - sums[ends - n_words], pa.int64())], names=["id", "n_bytes", "n_tokens"])

    out = blocks.drop("vocabulary").join(counted, "block", "left").mapInArrow(
        totals, f"id {kind.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
