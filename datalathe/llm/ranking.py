"""Ranked lexical search over hashed max-sketches.

The impact of a term in a document is its weight times a saturated frequency. A document's impacts fold into a sketch:
each term hashes to a coordinate, which keeps the largest impact that falls there, rounded up to a byte. The sum of a
query's coordinates, each no more than its term's weight allows in that document, is an upper bound of its score. A batch of queries is looked up in many sketches at once, and
documents are rescored exactly in order of falling bounds until the bound is below the k-th score found so far."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datalathe.llm.text import (LOWER, Texts, arrow_type, distinct_spans, forget, runs, slices, span_hashes, squeeze, stored, text_blocks, two_columns, unsqueeze)

#: Coordinates of a sketch; documents looked up and rescored at once; queries and query terms of a batch.
WIDTH, DOCS, RESCORED, QUERIES, QUERY_TERMS = 4096, 1024, 64, 512, 100_000

TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = True


def terms_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased buffer, starts and ends of the terms, and where each text's terms begin (n + 1 values)."""
    buf = LOWER[texts.buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[texts.offsets] = True
    starts, ends = runs(TERM[buf], cut)
    return buf, starts, ends, np.searchsorted(starts, texts.offsets)


def coordinates(terms: pa.Array, width: int) -> np.ndarray:
    """Each term's coordinate, the same for documents and queries."""
    terms = terms.cast(pa.large_binary())
    offsets = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset:terms.offset + len(terms) + 1]
    buf = np.frombuffer(terms.buffers()[2], np.uint8) if len(terms) and offsets[-1] else np.zeros(0, np.uint8)
    return (span_hashes(buf, offsets[:-1], offsets[1:]) % np.uint64(width)).astype(np.int64)


def weights(holders: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term's number of documents."""
    values, at = np.unique(holders, return_inverse=True)
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in values], np.int64)[at]


def saturated(lengths: np.ndarray, sizes: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 20 m) of each posting, m = 50 + (50 n N) div L of its document; an impact is a term's
    weight times this."""
    m = np.repeat(50 + (50 * lengths * n_docs) // max(1, n_terms), sizes)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def begins(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


@dataclass
class LexicalIndex:
    """Blocks of documents with postings and sketches, and the counts that every score rests on."""

    table: DataFrame
    id_type: str
    n_docs: int
    n_terms: int
    width: int

    def unit(self) -> int:
        """Sketch bytes count units of this many score points, so that no impact needs more than 255."""
        most = math.floor(1000 * math.log((2 * self.n_docs + 2) / 3)) if self.n_docs else 0
        return max(1, -(-most * 1_000_000 // 255))


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> LexicalIndex:
    """Index every whole text of df.

    Terms are runs of ASCII letters, digits and all characters above ASCII, A-Z lower-cased; a null text has none. Blocks
    of some megabytes keep postings (document, term, frequency) with a vocabulary of their own; the numbers of documents
    that hold a term are summed over the blocks' vocabularies, one row for each block and term, and come back to the
    blocks, which then fold impacts into sketches. Null and repeated ids are documents like others; other columns are
    left out; an empty table gives an index that finds nothing.
    """
    source = two_columns(df, id_col, text_col)
    kind = source.schema["id"].dataType
    id_type = arrow_type(kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for texts in text_blocks(batches):
            buf, starts, ends, from_ = terms_of(texts)
            first, number, _ = distinct_spans(buf, starts, ends)
            lengths = np.diff(from_)
            pairs, tf = np.unique(np.repeat(np.arange(len(texts)), lengths) * max(1, len(first)) + number, return_counts=True)
            doc, term = np.divmod(pairs, max(1, len(first)))
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([texts.ids], pa.list_(id_type)), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]),
                *(pa.array([squeeze(x)], pa.binary()) for x in (lengths, np.bincount(doc, minlength=len(texts)), term, tf)),
                pa.array([[t.decode() for t in slices(buf, starts[first], ends[first])]], pa.list_(pa.string())),
                pa.array([np.bincount(term, minlength=len(first))], pa.list_(pa.int64()))],
                names=["block", "ids", "n_docs", "n_terms", "lengths", "sizes", "term", "tf", "terms", "holders"])
            block += 1

    blobs = "lengths binary, sizes binary, term binary, tf binary"
    blocks = stored(source.mapInArrow(scan, f"block bigint, ids array<{kind.simpleString()}>, n_docs bigint, n_terms bigint, {blobs}, "
                                            "terms array<string>, holders array<bigint>"), "lexical-blocks")
    n_docs, n_terms = (x or 0 for x in blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    index = LexicalIndex(blocks, kind.simpleString(), n_docs, n_terms, width)
    unit = index.unit()

    each = blocks.select("block", F.posexplode(F.arrays_zip("terms", "holders")).alias("at", "t")).select("block", "at", "t.terms", "t.holders")
    summed = each.select("block", "at", F.sum("holders").over(Window.partitionBy("terms")).alias("df"))
    by_block = summed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "df"))).alias("dfs")).select("block", F.col("dfs.df").alias("df"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                lengths, sizes, term, tf = (unsqueeze(row.column(c)[0].as_py()) for c in ("lengths", "sizes", "term", "tf"))
                terms = row.column("terms").flatten()
                df = row.column("df").flatten().to_numpy() if len(terms) else np.zeros(0, np.int64)
                part = saturated(lengths, sizes, tf, n_docs, n_terms)
                impact = weights(df, n_docs)[term] * part if len(term) else part
                peak = np.zeros(len(sizes), np.int64)
                np.maximum.at(peak, np.repeat(np.arange(len(sizes)), sizes), part)
                place = np.repeat(np.arange(len(sizes)), sizes) * width + coordinates(terms, width)[term]
                order = np.argsort(place, kind="stable")
                place, impact = place[order], impact[order]
                new = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))[:len(place)])
                most = -(-np.maximum.reduceat(impact, new) // unit) if len(new) else np.zeros(0, np.int64)
                doc, coordinate = np.divmod(place[new], width)
                yield pa.RecordBatch.from_arrays([
                    row.column("ids"), *(row.column(c) for c in ("lengths", "sizes", "term", "tf", "terms")), pa.array([squeeze(df)], pa.binary()),
                    *(pa.array([squeeze(x)], pa.binary()) for x in (peak, np.bincount(doc, minlength=len(sizes)), coordinate, most))],
                    names=["ids", "lengths", "sizes", "term", "tf", "terms", "df", "peak", "filled", "coordinate", "most"])

    folded = blocks.drop("n_docs", "n_terms", "holders").join(by_block, "block", "left").mapInArrow(
        fold, f"ids array<{kind.simpleString()}>, {blobs}, terms array<string>, df binary, peak binary, filled binary, coordinate binary, most binary")
    index.table = stored(folded, "lexical-index")
    forget(blocks)
    return index


def query_terms(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[object, list[str]]]:
    """(item id, its distinct terms) of each row, one partition of items after another."""
    source = two_columns(items, id_col, text_col)
    kind = source.schema["id"].dataType
    id_type = arrow_type(kind)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in text_blocks(batches):
            buf, starts, ends, from_ = terms_of(texts)
            found = [sorted(set(slices(buf, starts[a:b], ends[a:b]))) for a, b in zip(from_[:-1].tolist(), from_[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts.ids, id_type), pa.array([[t.decode() for t in x] for x in found], pa.list_(pa.string()))], names=["id", "terms"])

    for row in source.mapInArrow(distinct, f"id {kind.simpleString()}, terms array<string>").toLocalIterator():
        yield row.id, row.terms


def batches_of(queries: Iterator[tuple[object, list[str]]]) -> Iterator[list[tuple[int, object, list[str]]]]:
    """Numbered queries in batches of bounded size: the side that is sent to all tasks."""
    batch, held = [], 0
    for number, (item, terms) in enumerate(queries):
        if batch and (len(batch) == QUERIES or held + len(terms) > QUERY_TERMS):
            yield batch
            batch, held = [], 0
        batch.append((number, item, terms))
        held += len(terms)
    if batch:
        yield batch


class Searcher:
    """A batch of queries against one block of documents after another; keeps each query's best k so far."""

    def __init__(self, queries: list[tuple[int, object, list[str]]], k: int, index_facts: tuple[int, int, int, int]):
        self.k, (self.n_docs, self.n_terms, self.width, self.unit) = k, index_facts
        names = sorted({t for _, _, terms in queries for t in terms})
        self.names, place = pa.array(names, pa.string()), {t: n for n, t in enumerate(names)}
        self.coordinates = coordinates(self.names, self.width)
        self.queries = [np.array([place[t] for t in terms], np.int64) for _, _, terms in queries]
        self.best: list[list[tuple]] = [[] for _ in queries]  # (-score, id is null, id)
        self.looked_up = self.rescored = 0

    def block(self, ids: list, lengths: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, terms: pa.Array, df: np.ndarray,
              peak: np.ndarray, filled: np.ndarray, coordinate: np.ndarray, most: np.ndarray) -> None:
        here = pc.index_in(self.names, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) if len(terms) else np.full(len(self.names), -1)
        asked = np.zeros(len(terms), bool)
        asked[here[here >= 0]] = True
        own = [here[q][here[q] >= 0] for q in self.queries]  # terms of the block's vocabulary
        places = [self.coordinates[q][here[q] >= 0] for q in self.queries]
        weight = weights(df, self.n_docs) if len(df) else df
        # only postings of terms that some query asks for are rescored
        doc = np.repeat(np.arange(len(sizes)), sizes)
        kept = asked[term]
        doc, term, tf = doc[kept], term[kept], tf[kept]
        sizes = np.bincount(doc, minlength=len(sizes))
        impact = weight[term] * saturated(lengths, sizes, tf, self.n_docs, self.n_terms) if len(term) else np.zeros(0, np.int64)
        at, sketch_at = begins(sizes), begins(filled)
        wanted = np.zeros(len(terms), bool)
        for a in range(0, len(ids), DOCS):
            b = min(len(ids), a + DOCS)
            sketches = np.zeros((b - a, self.width), np.uint8)
            x, y = sketch_at[a], sketch_at[b]
            sketches[np.repeat(np.arange(b - a), filled[a:b]), coordinate[x:y]] = most[x:y]
            self.looked_up += (b - a) * len(own)
            for j, mine in enumerate(own):
                if not len(mine):
                    continue
                bound = np.minimum(sketches[:, places[j]].astype(np.int64) * self.unit, peak[a:b, None] * weight[mine][None, :]).sum(axis=1)
                order = np.argsort(-bound, kind="stable")
                bound = bound[order]
                wanted[mine] = True
                for c in range(0, len(order), RESCORED):
                    best = self.best[j]
                    least = -best[-1][0] if len(best) == self.k else 1
                    n = int(np.searchsorted(-bound[c:c + RESCORED], -least, "right"))
                    docs = order[c:c + n] + a
                    docs = docs[sizes[docs] > 0]
                    self.rescored += len(docs)
                    if len(docs):
                        of = sizes[docs]
                        first = begins(of)[:-1]
                        posting = np.arange(of.sum()) + np.repeat(at[docs] - first, of)
                        score = np.add.reduceat(np.where(wanted[term[posting]], impact[posting], 0), first)
                        new = [(-s, ids[d] is None, ids[d]) for s, d in zip(score.tolist(), docs.tolist(), strict=True) if s >= least]
                        if new:
                            self.best[j] = sorted(best + new)[:self.k]
                    if n < RESCORED:
                        break
                wanted[mine] = False


def rank(index: LexicalIndex, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each item's k documents of the highest score above 0: item (a number for each row of items), item_id, rank (from 1),
    id, score; equal scores by ascending id, null last.

    The score sums the impacts of the item's distinct terms. Items without terms, or whose terms no document holds, have
    no rows; repeated items are ranked each. Each task keeps k documents for each query of a batch, and so does the
    shuffle to the last step; batches are bounded in queries and terms, further batches read the index again.
    """
    facts = (index.n_docs, index.n_terms, index.width, index.unit())
    item_kind = items.schema[id_col].dataType
    item_type, id_type = arrow_type(item_kind), index.table.schema["ids"].dataType.elementType
    columns = ["ids", "lengths", "sizes", "term", "tf", "terms", "df", "peak", "filled", "coordinate", "most"]
    schema = f"item bigint, item_id {item_kind.simpleString()}, id {index.id_type}, score bigint"
    out = None
    for queries in batches_of(query_terms(items, id_col, text_col)):
        def search(batches: Iterator[pa.RecordBatch], queries=queries) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(queries, k, facts)
            for batch in batches:
                for n in range(batch.num_rows):
                    row = batch.slice(n, 1)
                    searcher.block(row.column(0)[0].as_py(), *(unsqueeze(row.column(c)[0].as_py()) for c in range(1, 5)), row.column(5).flatten(),
                                   *(unsqueeze(row.column(c)[0].as_py()) for c in range(6, 11)))
            for (number, item, _), best in zip(queries, searcher.best, strict=True):
                if best:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([number] * len(best)), pa.array([item] * len(best), item_type), pa.array([b[2] for b in best], arrow_type(id_type)),
                        pa.array([-b[0] for b in best])], names=["item", "item_id", "id", "score"])

        part = index.table.select(*columns).mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = items.sparkSession.createDataFrame([], schema)
    best_first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return out.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("item", "item_id", "rank", "id", "score")
