"""Packing token sequences into windows with minimum slack.

Documents longer than a window give full windows and a remainder. The
remainders' lengths form a histogram with fewer entries than the window has
tokens, so the plan is made from the histogram alone: a bitset subset-sum
dynamic program finds the multiset of lengths that fills a window closest to
its capacity, and the pattern is used as often as the counts allow. Each
remainder's place then follows from its rank among the remainders of its length."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datalathe.llm.bpe import byte_characters
from datalathe.llm.text import SPACE, arrow_type, distinct_spans, slices, stored, text_blocks, two_columns

#: A worker keeps the ids of at most this many chunks between blocks; a memory bound only.
CACHE_CHUNKS = 300_000
#: Texts are encoded in blocks of about this many bytes; the arrays over a block are some forty times as large.
ENCODE_BYTES = 1 << 20
#: White space outside ASCII, as UTF-8; texts with it are encoded whole by the library.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class ByteBpe:
    """A byte-level BPE file of the tokenizers library. Ids are found once for each distinct chunk, a run of white
    space and the word after it, which no pre-token crosses."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocab = spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        # The pre-token pattern of byte-level files (a fixed value).
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: chunks that go to the library: other scripts, and special strings
        self.rare = re.compile(b"[\xce-\xff]|" + (b"|".join(re.escape(s.encode()) for s in special) or b"(?!)"))
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.type = "<u2" if self.size <= 1 << 16 else "<u4"
        self.cache: dict[bytes, bytes] = {}

    def whole(self, text: bytes) -> bytes:
        return np.array(self.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.type).tobytes()

    def chunks(self, words: list[bytes]) -> list[bytes]:
        """The ids of each chunk as bytes."""
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        cache, fast, kind = self.cache, self.fast.encode_ordinary, "H" if self.type == "<u2" else "I"
        import array

        out = []
        for w in words:
            ids = cache.get(w)
            if ids is None:
                ids = self.whole(w) if self.rare.search(w) else array.array(kind, fast(w.decode())).tobytes()
                cache[w] = ids
            out.append(ids)
        return out

    def encode(self, texts) -> list[bytes]:
        """The ids of each text of a block as bytes."""
        buf, offsets = texts.buf, texts.offsets
        inside = ~SPACE[buf]
        new = np.zeros(len(buf) + 1, bool)
        new[1:-1] = inside[:-1] & ~inside[1:]
        new[offsets] = True
        starts = np.flatnonzero(new[:-1])
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        first, number, _ = distinct_spans(buf, starts, ends)
        ids = np.empty(len(first), object)
        ids[:] = self.chunks(slices(buf, starts[first], ends[first]))
        own = [b"".join(ids[number[a:b]].tolist()) for a, b in itertools.pairwise(np.searchsorted(starts, offsets).tolist())]
        if len(buf) and (buf >= 0xC2).any() and WIDE_SPACE.search(buf):
            for i in range(len(texts)):
                if WIDE_SPACE.search(text := texts.bytes_of(i)):
                    own[i] = self.whole(text)
        return own


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of the given lengths, at most counts[length] of each, the multiset with the largest sum <= capacity.

    Bit s of the bitset says that the sum s can be reached; counts are split into powers of two, so that an entry
    is one shift, and the bitsets before each shift give the counts back."""
    mask, reach, steps = (1 << capacity + 1) - 1, 1, []
    for length, n in counts.items():
        n = min(n, capacity // length)
        part = 1
        while n > 0:
            part = min(part, n)
            steps.append((length, part, reach))
            reach |= reach << length * part & mask
            n -= part
            part *= 2
        if reach >> capacity & 1:
            break
    left, chosen = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> left & 1:
            chosen[length] = chosen.get(length, 0) + part
            left -= length * part
    return chosen


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (how often, {length: copies}) that use up the histogram: the longest remaining length first, and
    with it the multiset that leaves the least slack."""
    left = {n: c for n, c in sorted(histogram.items(), reverse=True) if c > 0}
    patterns = []
    while left:
        longest = next(iter(left))
        rest = {n: c - (n == longest) for n, c in left.items() if n <= capacity - longest and c - (n == longest) > 0}
        copies = best_fill(rest, capacity - longest)
        copies[longest] = copies.get(longest, 0) + 1
        times = min(left[n] // c for n, c in copies.items())
        patterns.append((times, copies))
        for n, c in copies.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
    return patterns


def pack(df: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Encode every whole text (null: empty), add end_id, and pack all ids into windows of at most ``window``.

    Returns one row for each piece: the id column, start (its document's ids before it), length, ids (binary,
    little-endian unsigned 32-bit integers), doc_tokens, sequence_id (from 0 without gaps), offset in the sequence,
    padded (the sequence's length with padding: its fill if that is a power of two, else ``window``). A document with
    n ids has n // window full sequences of its own, and its last n % window ids share one. Empty texts have the end
    id alone; equal and repeated rows are packed apart; an empty table gives no rows. The driver holds the histogram
    of remainders (fewer than ``window`` entries) and the patterns made from it.
    """
    source = two_columns(df, id_col, text_col)
    kind = source.schema["id"].dataType

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        end = np.array([end_id], bpe.type).tobytes()
        part, seen, full = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        for texts in text_blocks(batches, ENCODE_BYTES):
            ids = [x + end for x in bpe.encode(texts)]
            n = np.array([len(x) for x in ids]) // len(end)
            rest, rank, fulls = n % window, [], full + np.cumsum(n // window) - n // window
            for r in rest.tolist():
                rank.append(seen[r])
                seen[r] += 1
            full += int((n // window).sum())
            for a in range(0, len(ids), 256):
                b = min(a + 256, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts.ids[a:b], arrow_type(kind)), pa.array(ids[a:b], pa.binary()), pa.array([part] * (b - a), pa.int32()),
                     pa.array(rest[a:b], pa.int32()), pa.array(rank[a:b], pa.int64()), pa.array(fulls[a:b], pa.int64()),
                     pa.array(n[a:b] // window, pa.int64())], names=["id", "ids", "part", "rest", "rank", "fulls", "full"])

    table = stored(source.mapInArrow(tokens, f"""
        id {kind.simpleString()}, ids binary, part int, rest int, rank bigint, fulls bigint, full bigint"""), "token-ids")
    groups = stored(table.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")), "token-groups")
    histogram = {r["rest"]: r["n"] for r in groups.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    segments: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used, sequences = dict.fromkeys(histogram, 0), 0
    for times, copies in plan_windows(histogram, window):
        fill, offset = sum(n * c for n, c in copies.items()), 0
        for n, c in copies.items():
            segments.setdefault(n, []).append((used[n], c, sequences, offset, fill))
            used[n] += times * c
            offset += n * c
        sequences += times
    places = {n: np.array(rows, np.int64).T for n, rows in segments.items()}
    # how many rows of the same remainder, and how many full windows, lie in earlier partitions
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each input partition
    parts = groups.groupBy("part").agg(F.sum("full").alias("full")).select(
        "part", F.coalesce(F.sum("full").over(earlier), F.lit(0)).alias("full_before"))
    offsets = groups.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = byte_bpe(tokenizer).type
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], small).astype("<u4")
                n, full = len(ids), row["full"]
                first = sequences + row["full_before"] + row["fulls"]
                for k in range(full):
                    out.append((row["id"], k * window, window, ids[k * window:(k + 1) * window].tobytes(), n, first + k, 0, window))
                if rest := row["rest"]:
                    rank = row["rank"] + row["rank_before"]
                    at = places[rest]
                    s = int(np.searchsorted(at[0], rank, "right")) - 1
                    turn, copy = divmod(rank - int(at[0, s]), int(at[1, s]))
                    fill = int(at[4, s])
                    out.append((row["id"], full * window, rest, ids[full * window:].tobytes(), n, int(at[2, s]) + turn,
                                int(at[3, s]) + copy * rest, fill if fill & (fill - 1) == 0 else window))
            columns = list(zip(*out, strict=True)) or [[]] * len(piece_schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, piece_schema, strict=True)], schema=piece_schema)

    piece_schema = pa.schema([("id", arrow_type(kind)), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                              ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("padded", pa.int64())])
    placed = table.join(offsets.join(parts, "part"), ["part", "rest"]).select("id", "ids", "rest", "rank", "fulls", "full", "rank_before", "full_before")
    out = placed.mapInArrow(pieces, f"""id {kind.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint,
        sequence_id bigint, offset bigint, padded bigint""")
    return out.withColumnRenamed("id", id_col)
