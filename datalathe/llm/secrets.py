"""Secret scans with corpus-wide ownership: what looks like a credential is counted over all distinct repositories and
owners that hold it. A value many owners hold is a widely copied example; one that a single owner holds looks live.

Rules find the base spans. Long runs of mixed characters are further candidates; they are reported only where their
ownership says that they belong to somebody. Values leave a task as SHA-256 prefixes, never as text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datalathe.llm.text import LOWER, Texts, arrow_type, runs, stored, text_blocks

#: Kinds of spans in the order of the digests; "token" is what ownership adds.
KINDS = ["assign", "access", "hex", "token"]
#: The rule of assignments, and words one of which is in every match (fixed values).
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Words of placeholders: a value with one of them is nobody's credential (fixed values).
PLACEHOLDERS = (b"example", b"placeholder", b"changeme", b"dummy", b"sample", b"your_", b"xxxx", b"0000", b"12345678", b"abcdefgh")


def _class(signs: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(signs, np.uint8)] = True
    return table


_DIGITS, _SMALL, _LARGE = b"0123456789", bytes(range(97, 123)), bytes(range(65, 91))
HEX, UPPER, RUN = _class(_DIGITS + b"abcdef"), _class(_DIGITS + _LARGE), _class(_DIGITS + _SMALL + _LARGE + b"+/_=-")


def entropy(value: bytes) -> float:
    """Bits a character."""
    shares = np.unique(np.frombuffer(value, np.uint8), return_counts=True)[1] / len(value)
    return float(-(shares * np.log2(shares)).sum())


def scan_block(texts: Texts, least: int, longest: int, bits: float) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(document, kind, start, end, value) of each base span and candidate, in bytes of the block."""
    buf, data = texts.buf, texts.buf.tobytes()
    cut = np.zeros(len(buf) + 1, bool)
    cut[texts.offsets] = True
    document = lambda at: int(np.searchsorted(texts.offsets, at, "right")) - 1
    taken: list[tuple[int, int]] = []  # what the rules match, be it valid or refused
    low = LOWER[buf].tobytes()
    bounds = texts.offsets.tolist()
    for i in range(len(texts)):
        a, b = bounds[i], bounds[i + 1]
        if any(low.find(w, a, b) >= 0 for w in ASSIGN_WORDS):
            for m in ASSIGN.finditer(data, a, b):
                taken.append(m.span())
                if len(m[1]) >= LEAST_ASSIGN:
                    yield i, 0, *m.span(), m[1]
    starts, ends = runs(UPPER[buf], cut)
    for a, b in zip(*(x[ends - starts >= LEAST_ACCESS].tolist() for x in (starts, ends)), strict=True):
        at = data.find(b"AKIA", a, b - 1)
        if at >= 0:
            taken.append((at, b))
            if b - at >= LEAST_ACCESS:
                yield document(at), 1, at, b, data[at:b]
    starts, ends = runs(HEX[buf], cut)
    for a, b in zip(*(x[ends - starts >= LEAST_HEX].tolist() for x in (starts, ends)), strict=True):
        taken.append((a, b))
        yield document(a), 2, a, b, data[a:b]
    taken.sort()
    taken_starts = [a for a, _ in taken]
    taken_ends = np.maximum.accumulate([b for _, b in taken] or [0])
    starts, ends = runs(RUN[buf], cut)
    fits = (ends - starts >= least) & (ends - starts <= longest)
    starts, ends = starts[fits], ends[fits]
    for signs in (_DIGITS, _SMALL, _LARGE):
        if not len(starts):
            break
        sums = np.concatenate(([0], np.cumsum(_class(signs)[buf])))
        has = sums[ends] > sums[starts]
        starts, ends = starts[has], ends[has]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        i = document(a)
        before, after = data[max(bounds[i], a - 1):a], data[b:min(bounds[i + 1], b + 2)]
        part_of_name = before in (b"@", b".") or after[:1] == b"@" or (after[:1] == b"." and after[1:].isalnum())
        k = int(np.searchsorted(taken_starts, b)) - 1  # the last rule match that begins before the run ends
        if not part_of_name and (k < 0 or taken_ends[k] <= a) and entropy(data[a:b]) >= bits:
            yield i, 3, a, b, data[a:b]


def scan_secrets(df: DataFrame, owner: Column | str, repository: Column | str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 max_owners: int = 2, least: int = 20, longest: int = 256, bits: float = 3.8) -> DataFrame:
    """Credentials in every whole text.

    Returns one row for each row: the id column, base (array of struct<start, kind, end> of the rules' matches) and found
    (array of struct<start, kind, end, owners, repositories, live>: the base spans and those the method adds), in order of
    start, then kind (a place in KINDS); code points, end exclusive.

    owners and repositories count the distinct ones that hold the span's value anywhere in the table (an assignment's
    value is what is assigned). A span is live if at most ``max_owners`` owners hold the value and it does not read like
    a placeholder; base spans are listed whether live or not, candidates ("token": runs of ``least`` to ``longest``
    characters with digits, small and large letters and ``bits`` bits of entropy a character, outside of every rule's
    match and no part of an address or name) only where live.

    owner, repository: columns of df that say who holds a document; without repository each row is one. Null owners
    together are one owner, null repositories one repository of their owner. Null and empty texts have no spans, repeated
    rows are repeated and count once if their repository is named, an empty table gives no rows, other columns don't matter.

    Blocks of some megabytes count each value once before anything is shuffled, so a value that a third of all rows hold is
    as many rows as there are blocks; the counts are partial sums on all levels.
    """
    owner = F.col(owner) if isinstance(owner, str) else owner
    repository = F.col(repository) if isinstance(repository, str) else repository
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), owner.cast("string").alias("owner"),
                       (F.lit("") if repository is None else repository.cast("string")).alias("repository"))
    kind = source.schema["id"].dataType
    id_type = arrow_type(kind)
    own = repository is None
    spans_type = pa.struct([("document", pa.int32()), ("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int32())])
    holds_type = pa.struct([("value", pa.int32()), ("owner", pa.string()), ("repository", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            owners, repositories, at = batch.column(2).to_pylist(), batch.column(3).to_pylist(), 0
            for texts in text_blocks(iter([batch])):
                found = list(scan_block(texts, least, longest, bits))
                begins = (texts.buf & 0xC0) != 0x80  # first bytes of code points
                points = np.concatenate(([0], np.cumsum(begins)))
                values: dict[bytes, int] = {}
                spans, holds = [], set()
                for i, of, a, b, value in found:
                    number = values.setdefault(value, len(values))
                    zero = points[texts.offsets[i]]
                    spans.append({"document": i, "kind": of, "start": int(points[a] - zero), "end": int(points[b] - zero), "value": number})
                    holds.add((number, owners[at + i], f"{block}-{i}" if own else repositories[at + i]))
                placeholder = [any(p in v.lower() for p in PLACEHOLDERS) or len(set(v)) < 4 for v in values]
                yield pa.RecordBatch.from_arrays([
                    pa.array([block], pa.int64()), pa.array([texts.ids], pa.list_(id_type)), pa.array([spans], pa.list_(spans_type)),
                    pa.array([[hashlib.sha256(v).digest()[:16] for v in values]], pa.list_(pa.binary())), pa.array([placeholder], pa.list_(pa.bool_())),
                    pa.array([[dict(zip(("value", "owner", "repository"), h, strict=True)) for h in sorted(holds, key=str)]], pa.list_(holds_type))],
                    names=["block", "ids", "spans", "values", "placeholder", "holds"])
                block += 1
                at += len(texts)

    span = "array<struct<document:int,kind:int,start:bigint,end:bigint,value:int>>"
    blocks = stored(source.mapInArrow(scan, f"block bigint, ids array<{kind.simpleString()}>, spans {span}, values array<binary>, "
                                            "placeholder array<boolean>, holds array<struct<value:int,owner:string,repository:string>>"), "secret-blocks")

    each = blocks.select("block", "values", F.explode("holds").alias("h"))
    held = each.select(F.element_at("values", F.col("h.value") + 1).alias("hash"), "h.owner", "h.repository").groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    ownership = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    known = blocks.select("block", F.posexplode("values").alias("value", "hash")).join(ownership, "hash").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("value", "owners", "repositories"))).alias("known"))

    base_type = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    found_type = pa.struct([*base_type, ("owners", pa.int64()), ("repositories", pa.int64()), ("live", pa.bool_())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, spans, placeholder, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base, found = [[] for _ in ids], [[] for _ in ids]
                for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
                    of = known[s["value"]]
                    live = of["owners"] <= max_owners and not placeholder[s["value"]]
                    if s["kind"] < 3:
                        base[s["document"]].append({k: s[k] for k in ("start", "kind", "end")})
                    if s["kind"] < 3 or live:
                        found[s["document"]].append({**{k: s[k] for k in ("start", "kind", "end")}, "owners": of["owners"], "repositories": of["repositories"], "live": live})
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(base, pa.list_(base_type)), pa.array(found, pa.list_(found_type))],
                                                 names=["id", "base", "found"])

    one = "start:bigint,kind:int,end:bigint"
    out = blocks.join(known, "block", "left").select("ids", "spans", "placeholder", "known").mapInArrow(
        judge, f"id {kind.simpleString()}, base array<struct<{one}>>, found array<struct<{one},owners:bigint,repositories:bigint,live:boolean>>")
    return out.withColumnRenamed("id", id_col)


def written(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
