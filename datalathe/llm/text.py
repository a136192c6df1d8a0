"""Helpers for operators that work on whole texts in Arrow batches: the bytes of
many texts lie in one numpy buffer, words are spans of it, and equal words are
found by sorting 64-bit hashes (a second hash guards against collisions)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalathe.session import ensure_checkpoint_dir

#: Texts are worked on in blocks of about this many bytes, which bounds a task's memory;
#: a longer text is a block of its own.
BLOCK_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z and leaves all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240607)
_TABLES = _random.integers(1, 2**63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = {_BASE: np.ones(1, np.uint64), pow(_BASE, -1, 2**64): np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    if len(_powers[base]) <= n:
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def earlier(x: np.ndarray, first=False) -> np.ndarray:
    """Each value's left neighbour."""
    return np.concatenate((np.array([first], x.dtype), x[:-1]))[:len(x)]


def later(x: np.ndarray, last=False) -> np.ndarray:
    """Each value's right neighbour."""
    return np.concatenate((x[1:], np.array([last], x.dtype)))[:len(x)]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span lies."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLES[which][buf] * powers(_BASE, len(buf))[:-1], out=sums[1:])
    back = powers(pow(_BASE, -1, 2**64), len(buf))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Texts:
    """Some texts of an Arrow batch: ids (Python values) and one buffer of UTF-8 bytes."""

    ids: list
    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.offsets[i]:self.offsets[i + 1]].tobytes()


def text_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[Texts]:
    """Cut batches of (id, text) into blocks; a null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        ids = batch.column(0).to_pylist()
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
        start = 0
        while start < len(ids):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + block_bytes, "right")) - 1)
            yield Texts(ids[start:stop], data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start])
            start = stop


def runs(inside: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes inside a class; no run crosses a cut (one more value than bytes)."""
    starts = np.flatnonzero(inside & ~(earlier(inside) & ~cut[:-1]))
    ends = np.flatnonzero(inside & ~(later(inside) & ~cut[1:])) + 1
    return starts, ends


def word_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and where each text's words begin (n + 1 values)."""
    inside = ~SPACE[texts.buf]
    cut = np.zeros(len(texts.buf) + 1, bool)
    cut[texts.offsets] = True
    before = earlier(inside) & ~cut[:-1]
    after = later(inside) & ~cut[1:]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, texts.offsets)


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal spans get one number: (a span for each number, number of each span, hash for each number)."""
    one, two = span_hashes(buf, starts, ends), span_hashes(buf, starts, ends, 1)
    order = np.argsort(one)
    same = np.zeros(len(order), bool)
    same[1:] = one[order[1:]] == one[order[:-1]]
    if (two[order[1:]] != two[order[:-1]])[same[1:]].any():  # a collision of the first hash
        order = np.lexsort((two, one))
        same[1:] = (one[order[1:]] == one[order[:-1]]) & (two[order[1:]] == two[order[:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(~same) - 1
    first = order[~same]
    return first, number, one[first]


def gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after another."""
    sizes = ends - starts
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return buf[np.arange(len(shift)) + shift]


def slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    data = buf.tobytes()
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def squeeze(values: np.ndarray) -> bytes:
    """Compress non-negative integers: byte planes, of which the high ones are mostly zero, by zstandard."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = 8 if not len(values) else max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(planes[:used].tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    used = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :used] = planes.T
    return out.view("<i8").reshape(-1)


def arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def two_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, whatever other columns there are."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))


def shards(spark: SparkSession) -> int:
    """As many groups as the session's shuffles have partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the cluster's shared folder and read it again: cuts the lineage, and later stages
    read the same rows even when executors are lost. The shuffles behind it are not needed any more; Spark removes
    their files once the driver has collected its garbage, so that is asked for."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    for tables in _gathering:
        tables.append(table)
    return table


_gathering: list[list[DataFrame]] = []


@contextmanager
def gathered() -> Iterator[list[DataFrame]]:
    """The tables that are stored while this is open."""
    _gathering.append([])
    try:
        yield _gathering[-1]
    finally:
        _gathering.pop()


def forget(*tables: DataFrame) -> None:
    """Remove stored tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
