"""Removal of long repeated byte strings with families of suffix arrays.

A 64-byte string chosen by hash inside each 200-byte window (its anchor) tells
where equal windows can be: they have the same anchor at the same offset.
Windows with one anchor form a stretch. Stretches with an anchor that occurs
once are unique. Equal stretches are repeated as a whole. Of the rest, cut into
short runs of windows, a run whose common core occurs once is unique and runs
that are equal are repeated; what is left lies at the borders of repeats. There
each task keeps a logarithmic family of suffix arrays: a new batch gets its
suffix array, is merge-scanned against the levels for matches of full depth, and
levels of equal size are merged, so a suffix is merged log(batches) times."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalathe.llm.text import arrow_type, forget, gather, mix, powers, span_hashes, stored, text_blocks, _BASE, _TABLES

#: Bytes of an anchor; windows of a run.
ANCHOR, RUN = 64, 16


def suffix_order(buf: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first ``depth`` bytes, and which equal the one before them to that depth.

    Sorted by eight bytes at a time; only suffixes that are still tied go on. The sort is stable and merges
    presorted runs in linear time."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    order = np.arange(len(at))
    tied = np.zeros(len(at), bool)  # tied with the one before
    tied[1:] = True
    for k in range(0, depth, 8):
        open_ = np.flatnonzero(tied | np.append(tied[1:], False))
        if not len(open_):
            break
        group = np.cumsum(~tied)[open_]
        own = at[order[open_]] + k
        word = np.zeros(len(own), np.uint64)
        for j in range(min(8, depth - k)):
            word |= padded[own + j].astype(np.uint64) << np.uint64(56 - 8 * j)
        step = np.argsort(word, kind="stable")
        step = step[np.argsort(group[step], kind="stable")]
        order[open_] = order[open_][step]
        word, group = word[step], group[step]
        tied[open_] = np.append(False, (word[1:] == word[:-1]) & (group[1:] == group[:-1]))
    return order, tied


@dataclass
class Level:
    """Suffixes in order; weight: how many batches it holds."""

    weight: int
    buf: np.ndarray
    at: np.ndarray
    number: np.ndarray


class SuffixFamily:
    """A logarithmic family of suffix arrays; ``repeated`` tells which suffixes met an equal one of full depth."""

    def __init__(self, depth: int):
        self.depth, self.levels, self.repeated = depth, [], np.zeros(0, bool)

    def scan(self, one: Level, other: Level) -> Level:
        """Merge two arrays, marking suffixes that are equal to full depth."""
        buf = np.concatenate((one.buf, other.buf))
        at = np.concatenate((one.at, other.at + len(one.buf)))
        number = np.concatenate((one.number, other.number))
        order, tied = suffix_order(buf, at, self.depth)
        self.repeated[number[order[tied | np.append(tied[1:], False)]]] = True
        return Level(one.weight + other.weight, buf, at[order], number[order])

    def add(self, buf: np.ndarray, at: np.ndarray) -> None:
        """A new batch: its suffixes begin at ``at`` and are numbered on from those before."""
        number = np.arange(len(self.repeated), len(self.repeated) + len(at))
        self.repeated = np.concatenate((self.repeated, np.zeros(len(at), bool)))
        none = np.zeros(0, np.int64)
        new = self.scan(Level(1, buf, at, number), Level(0, np.zeros(0, np.uint8), none, none))
        while self.levels and self.levels[-1].weight == new.weight:
            new = self.scan(self.levels.pop(), new)
        for level in self.levels:
            self.scan(level, new)
        self.levels.append(new)


def stretches(buf: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first and last window, anchor, and the anchor's hash."""
    n = len(buf)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if n < depth:
        return *none, np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLES[0][buf] * powers(_BASE, n)[:-1], out=sums[1:])
    hashes = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * powers(pow(_BASE, -1, 2**64), n)[:n - ANCHOR + 1])
    bits = np.uint64(int(n).bit_length())
    value = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    span = depth - ANCHOR + 1
    size = -(-len(value) // span) * span
    value = np.concatenate((value, np.full(size - len(value), 2**64 - 1, np.uint64))).reshape(-1, span)
    front = np.minimum.accumulate(value, axis=1).reshape(-1)
    back = np.minimum.accumulate(value[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - depth + 1
    anchor = (np.minimum(back[:windows], front[span - 1:span - 1 + windows]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(windows), "right") - 1
    valid = np.arange(windows) + depth <= offsets[text + 1]
    new = np.ones(windows, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & valid)
    stop = np.ones(windows, bool)  # the last window of its run that is valid
    stop[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(stop & valid)
    return text[first], first, last, anchor[first], hashes[anchor[first]]


def repeated_strings(df: DataFrame, depth: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The bytes of every whole text that a ``depth``-byte string covers which also starts anywhere else.

    Returns one row for each row: the id column, n_bytes (UTF-8; null: empty), spans (array of struct<start, end>,
    maximal, in bytes, in order), kept (binary: the other bytes concatenated). Strings never cross texts, may overlap
    themselves, and are judged on the input. Repeated rows repeat each other. Shorter texts keep all bytes.
    """
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType
    docs = stored(rows, "texts")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in text_blocks(batches):
            text, first, last, anchor, key = stretches(texts.buf, texts.offsets, depth)
            base = texts.offsets[text]
            # first window, number of windows and the anchor's offset in one number
            place = (first - base) << 24 | (last - first) << 12 | (anchor - first)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.array(texts.ids, np.int64)[text]), pa.array(place)],
                                             names=["key", "rid", "place"])

    found = stored(docs.select("rid", "text").mapInArrow(anchors, "key bigint, rid bigint, place bigint"), "anchors")
    twice = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    per_text = found.join(twice, "key", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("key", "place")).alias("own"))
    per_text = stored(per_text, "anchors-again")
    forget(found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes and a 128-bit hash of each stretch whose anchor occurs again."""
        for batch in batches:
            own = batch.column(2)
            place = own.flatten().field("place").to_numpy()
            flat = {"key": own.flatten().field("key").to_numpy(), "first": (place >> 24).astype(np.int32),
                    "last": ((place >> 24) + (place >> 12 & 4095)).astype(np.int32), "anchor": ((place >> 24) + (place & 4095)).astype(np.int32)}
            number = np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy()))
            for texts in text_blocks(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), batch.column(1)], names=["i", "t"])])):
                mine = (number >= texts.ids[0]) & (number <= texts.ids[-1])
                base = texts.offsets[number[mine] - texts.ids[0]]
                key, first, last, anchor = (flat[f][mine] for f in flat)
                starts, ends = base + first, base + last + depth
                sizes = np.concatenate(([0], np.cumsum(ends - starts)))
                step = max(1, int(np.searchsorted(sizes, 1 << 23)))
                for a in range(0, len(starts), step):
                    b = min(a + step, len(starts))
                    data = gather(texts.buf, starts[a:b], ends[a:b])
                    lengths = np.concatenate(([0], np.cumsum(ends[a:b] - starts[a:b]))).astype(np.int32)
                    shape = mix((anchor[a:b] - first[a:b]).astype(np.uint64) * np.uint64(1024) + (last[a:b] - first[a:b]).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key[a:b]), batch.column(0).take(pa.array(number[mine][a:b])), pa.array(first[a:b]), pa.array(last[a:b]), pa.array(anchor[a:b]),
                        pa.array((span_hashes(texts.buf, starts[a:b], ends[a:b]) ^ shape).view(np.int64)),
                        pa.array(span_hashes(texts.buf, starts[a:b], ends[a:b], 1).view(np.int64)),
                        pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(lengths), pa.py_buffer(data)])],
                        names=["key", "rid", "first", "last", "anchor", "one", "two", "bytes"])

    stretch = stored(per_text.join(docs, "rid").select("rid", "text", "own").mapInArrow(
        cut, "key bigint, rid bigint, first int, last int, anchor int, one bigint, two bigint, bytes binary"), "stretches")
    classes = stored(stretch.groupBy("key", "one", "two").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "first")).alias("holder")), "stretch-classes")
    whole = stored(stretch.select("key", "one", "two", "rid", "first", "last").join(classes.where("n > 1"), ["key", "one", "two"], "left_semi")
                   .select("rid", "first", "last"), "whole-repeats")

    # keys with a stretch that occurs once beside others: one holder of each class
    mixed = classes.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("key")
    holders = classes.join(mixed, "key", "left_semi").select("holder.rid", "holder.first", (F.col("n") == 1).alias("open"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches cut into runs of windows by their offset from the anchor, with hashes of the windows' common core
        and of the whole run."""
        for batch in batches:
            b = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            data = b["bytes"].cast(pa.large_binary())
            offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
            if not len(data):
                continue
            buf = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
            begin = offsets[:-1] - offsets[0]
            first, last, anchor = (b[x].to_numpy().astype(np.int64) for x in ("first", "last", "anchor"))
            low, high = (anchor - last) // RUN, (anchor - first) // RUN
            who = np.repeat(np.arange(len(first)), high - low + 1)
            block = np.arange(len(who)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[who]
            from_ = np.maximum(first[who], anchor[who] - block * RUN - RUN + 1)
            to = np.minimum(last[who], anchor[who] - block * RUN)
            shift = begin[who] - first[who]
            core_start, core_end = anchor[who] - block * RUN + shift, anchor[who] - block * RUN - RUN + 1 + depth + shift
            core = span_hashes(buf, core_start, core_end) ^ mix(block.astype(np.uint64))
            run_hash = span_hashes(buf, from_ + shift, to + depth + shift, 1) ^ mix(((to - from_) * 1024 + block).astype(np.uint64))
            step = 20_000
            for x in range(0, len(who), step):
                y = min(x + step, len(who))
                bytes_ = gather(buf, (from_ + shift)[x:y], (to + depth + shift)[x:y])
                lengths = np.concatenate(([0], np.cumsum((to + depth - from_)[x:y]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(core[x:y].view(np.int64)), pa.array(run_hash[x:y].view(np.int64)), b["rid"].take(pa.array(who[x:y])),
                    pa.array(from_[x:y].astype(np.int32)), pa.array(to[x:y].astype(np.int32)), b["open"].take(pa.array(who[x:y])),
                    pa.Array.from_buffers(pa.binary(), y - x, [None, pa.py_buffer(lengths), pa.py_buffer(bytes_)])],
                    names=["core", "run", "rid", "first", "last", "open", "bytes"])

    run = stored(stretch.join(holders, ["rid", "first"]).select("rid", "first", "last", "anchor", "open", "bytes").mapInArrow(
        runs, "core bigint, run bigint, rid bigint, first int, last int, open boolean, bytes binary"), "runs")
    forget(per_text, stretch, classes)
    kinds = stored(run.groupBy("core", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "first")).alias("holder"), F.max("open").alias("open")), "run-classes")
    equal = run.where("open").select("core", "run", "rid", "first", "last").join(kinds.where("n > 1"), ["core", "run"], "left_semi").select("rid", "first", "last")
    # cores with a run that occurs once, in an open stretch, beside other runs: the borders of repeats
    borders = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("m"), F.max(F.col("open") & (F.col("n") == 1)).alias("some")).where("m > 1 and some").select("core")
    border_runs = kinds.join(borders, "core", "left_semi").select("core", "holder.rid", "holder.first", (F.col("open") & (F.col("n") == 1)).alias("asked"))

    def family(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, owners = SuffixFamily(depth), []
        for batch in batches:
            data = batch.column(4).cast(pa.large_binary())
            if not len(data):
                continue
            offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
            buf = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
            begin = offsets[:-1] - offsets[0]
            n = np.diff(offsets) - depth + 1
            who = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            levels.add(buf, begin[who] + step)
            own = batch.column(1).to_numpy()[who], batch.column(2).to_numpy()[who] + step, batch.column(3).to_numpy(zero_copy_only=False)[who]
            owners.append(own)
        if owners:
            rid, at, asked = (np.concatenate([o[k] for o in owners]) for k in range(3))
            hit = levels.repeated & asked
            rid, at = rid[hit], at[hit]
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(at.astype(np.int32)), pa.array(at.astype(np.int32))], names=["rid", "first", "last"])

    border = run.select("core", "rid", "first", "bytes").join(border_runs, ["core", "rid", "first"]).repartition("core") \
        .select("core", "rid", "first", "asked", "bytes").mapInArrow(family, "rid bigint, first int, last int")
    repeats = stored(whole.unionByName(equal).unionByName(border), "repeats")
    forget(run, kinds, whole)
    spans = repeats.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("windows"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, lists, kept = batch.column(0), [], [], []
            for text, windows in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                data, own = text or b"", []
                if windows.is_valid:
                    first, last = (windows.values.field(f).to_numpy() for f in ("first", "last"))
                    order = np.argsort(first, kind="stable")
                    start, end = first[order].astype(np.int64), np.maximum.accumulate(last[order].astype(np.int64) + depth)
                    new = np.append(True, start[1:] > end[:-1])
                    own = list(zip(start[new].tolist(), end[np.append(new[1:], True)].tolist(), strict=True))
                pieces, at = [], 0
                for a, b in own:
                    pieces.append(data[at:a])
                    at = b
                sizes.append(len(data))
                lists.append([{"start": a, "end": b} for a, b in own])
                kept.append(b"".join([*pieces, data[at:]]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                                              pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    out = docs.join(spans, "rid", "left").select("id", "text", "windows").mapInArrow(
        remove, f"id {kind.simpleString()}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)
