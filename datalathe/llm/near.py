"""Near-duplicate groups: MinHash bands give candidates, signatures are compared in batches under a Bayesian bound,
and what survives is verified on full shingle sets.

Documents with equal shingle sets are one node from the start. Nodes that share a band with another are gathered by the
connected components of the bands' buckets, found over stars (each member of a bucket and its smallest), so a bucket of m
members makes m rows and no pairs. A component of bounded size goes into one task once, with its full sets. There its
banded pairs are compared, pruned and verified, and only a spanning forest of the links leaves the task.

A larger component is dealt into blocks of that size first, which joins most of what is linked. Then each of its buckets
that still holds several groups of links goes into a task with all its members. A bucket larger than a block is dealt
once more, and what is not in its largest group by then meets all of its blocks, so no link is lost; the work that is
left there grows with the rest times the bucket."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalathe.llm.text import (LOWER, Texts, arrow_type, forget, mix, span_hashes, stored, text_blocks, two_columns, word_spans)

#: Hashes of a band, and of a step of the sequential comparison.
BAND_ROWS, STEP = 5, 20
#: Nodes and bytes of shingle sets of a block; pairs compared at once; pairs verified one by one.
BLOCK, BLOCK_SET_BYTES, PAIRS, FEW_PAIRS = 4096, 32 << 20, 200_000, 4096
#: Chance that a pair at the threshold is missed by the bands, and by the sequential comparison.
MISS = 1e-6


def bands_for(threshold: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair at the threshold shares one with probability 1 - miss."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def least_matches(threshold: float, hashes: int, miss: float = MISS) -> int:
    """The fewest matches among so many hashes at which a similarity >= threshold keeps a posterior probability of
    ``miss``: under a uniform prior that probability is P(Binomial(hashes + 1, threshold) <= matches)."""
    total = 0.0
    for k in range(hashes + 2):
        total += math.comb(hashes + 1, k) * threshold**k * (1 - threshold) ** (hashes + 1 - k)
        if total >= miss:
            return k
    return hashes + 1


def shingle_sets(texts: Texts, size: int) -> Iterator[np.ndarray]:
    """For each text its set of shingles as sorted 64-bit hashes: windows of ``size`` words, lower-cased A-Z; of
    fewer words all as one."""
    buf = LOWER[texts.buf]
    starts, ends, from_ = word_spans(texts)
    words = span_hashes(buf, starts, ends)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    windows = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        windows += words[k:k + len(windows)] * weights[k]
    windows = mix(windows)
    for a, b in itertools.pairwise(from_.tolist()):
        if b - a >= size:
            yield np.unique(windows[a:b - size + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * weights[:b - a]).sum() + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets of shingles apart."""
    with np.errstate(over="ignore"):
        return np.array([mix(shingles + np.uint64(1)).sum(), mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()], ">u8").tobytes()


def signature(shingles: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> bytes:
    low = np.full(len(factors), 2**32 - 1, np.uint64)
    for a in range(0, len(shingles), 2048):
        hashed = factors[:, None] * shingles[None, a:a + 2048]
        hashed += terms[:, None]
        np.minimum(low, hashed.min(axis=1) >> np.uint64(32), out=low)
    return low.astype("<u4").tobytes()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): the smallest node that can be reached. Alternates large-star and
    small-star steps, each two hash joins, until all edges lead from a leaf to its centre; stars of any size are never
    gathered in one task. Edges that are such stars from the start need no step."""
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        ways = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
            edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        if ways.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a != b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        small = stored(small.where("a != b").distinct(), "small-star")
        forget(edges, large)
        edges = small


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of many pairs of sets, by products of 0/1 matrices over the shingles that two sets
    have in common, a slab of shingles at a time."""
    used, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    held = np.concatenate([sets[i] for i in used.tolist()])
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used.tolist()])
    _, number, times = np.unique(held, return_inverse=True, return_counts=True)
    common = times >= 2
    column = (np.cumsum(common) - 1)[number]
    owner, column = owner[common[number]], column[common[number]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(used), len(used)), np.float32)  # whole numbers below 2^24, exact
    width = max(1, (8 << 20) // len(used))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, (start, start + width))
        slab = np.zeros((len(used), width), np.float32)
        slab[owner[x:y], column[x:y] - start] = 1
        both += slab @ slab.T
    half = len(a)
    return both[place[:half], place[half:]].astype(np.int64)


class Solver:
    """Links within blocks of nodes."""

    def __init__(self, percent: int, miss: float, n_bands: int, factors: np.ndarray, terms: np.ndarray):
        self.percent, self.n_bands, self.factors, self.terms = percent, n_bands, factors, terms
        n_hashes = len(factors)
        self.steps = [*range(STEP, n_hashes, STEP), n_hashes]
        self.bounds = [least_matches(percent / 100, m, miss) for m in self.steps]

    def survivors(self, signatures: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs those that share a band and that no batch of hashes rules out, with their matches."""
        bands = band_values(signatures, self.n_bands)
        kept = []
        for start in range(0, len(a), PAIRS):
            x, y = a[start:start + PAIRS], b[start:start + PAIRS]
            banded = (bands[x] == bands[y]).any(axis=1)
            x, y = x[banded], y[banded]
            matches, done = np.zeros(len(x), np.int64), 0
            for stop, least in zip(self.steps, self.bounds, strict=True):
                matches += (signatures[x, done:stop] == signatures[y, done:stop]).sum(axis=1)
                live = matches >= least
                x, y, matches, done = x[live], y[live], matches[live], stop
            kept.append((x, y, matches))
        return tuple(np.concatenate(c) for c in zip(*kept, strict=True))

    def forest(self, sets: list[np.ndarray], now: np.ndarray, left: np.ndarray | None) -> list[tuple[int, int]]:
        """What links join of what ``now`` keeps apart, as few pairs of nodes as needed: for each group of links the first
        node of every part of it with the first node of all. With ``left`` (a flag for each node) only links with a
        flagged node count."""
        m = len(sets)
        signatures = np.frombuffer(b"".join(signature(s, self.factors, self.terms) for s in sets), "<u4").reshape(m, -1)
        group = np.unique(now, return_inverse=True)[1]
        top = group.tolist()

        def root(g: int) -> int:
            while parent[g] != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        parent = list(range(max(top) + 1))
        rows = max(1, PAIRS * 8 // m)
        for start in range(0, m, rows):  # pairs of some rows with all later nodes
            a = np.repeat(np.arange(start, min(m, start + rows)), m - 1 - np.arange(start, min(m, start + rows)))
            b = np.concatenate([np.arange(i + 1, m) for i in range(start, min(m, start + rows))])
            roots = np.array([root(g) for g in range(len(parent))])[group]
            apart = roots[a] != roots[b]
            if left is not None:
                apart &= left[a] | left[b]
            a, b = a[apart], b[apart]
            if not len(a):
                continue
            a, b, matches = self.survivors(signatures, a, b)
            exact = shared_counts(sets, a, b) if len(a) > FEW_PAIRS else None
            if exact is not None:
                sizes = np.array([len(s) for s in sets])
                linked = 100 * exact >= self.percent * (sizes[a] + sizes[b] - exact)
                a, b, matches = a[linked], b[linked], matches[linked]
            for k in np.argsort(-matches, kind="stable").tolist():
                i, j = int(a[k]), int(b[k])
                x, y = root(top[i]), root(top[j])
                if x == y:
                    continue
                if exact is None:
                    both = np.concatenate((sets[i], sets[j]))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared < self.percent * (len(both) - shared):
                        continue
                parent[x] = y
        centre: dict[int, int] = {}
        out, first = [], set()
        for i, g in enumerate(top):
            if g not in first:
                first.add(g)
                if centre.setdefault(root(g), i) != i:
                    out.append((i, centre[root(g)]))
        return out


def band_values(signatures: np.ndarray, n_bands: int) -> np.ndarray:
    """A 64-bit value for each band of each signature; it holds the band's number."""
    values = signatures.reshape(len(signatures), n_bands, BAND_ROWS).astype(np.uint64)
    hashed = np.zeros(values.shape[:2], np.uint64) + np.arange(n_bands, dtype=np.uint64)
    for k in range(BAND_ROWS):
        hashed = mix(hashed * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return hashed


def near_groups(df: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """Link documents with 100 * intersection >= percent * union of their sets of ``shingle``-word shingles.

    Returns one row for each row: the id column, n_shingles (size of its set), component_id (the smallest id that can
    be reached over links, itself included), kept (id = component_id). Words are runs without ASCII white space,
    lower-cased A-Z; a text with fewer words has one shingle; a null or empty text, or one without words, has none and
    is its own component. Rows with equal sets are linked. A null id is passed over when the smallest is sought; a row
    whose component has only null ids has a null component_id and is kept. Repeated rows are repeated.

    miss: the chance to lose a pair that is just similar enough, of the bands and of the sequential comparison.
    block: nodes that are compared in one task.
    """
    threshold = percent / 100
    n_bands = bands_for(threshold, BAND_ROWS, miss)
    n_hashes = n_bands * BAND_ROWS
    random = np.random.default_rng(7)
    factors = random.integers(1, 2**63, n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = random.integers(0, 2**63, n_hashes, dtype=np.uint64)
    solver = Solver(percent, miss, n_bands, factors, terms)
    source = two_columns(df, id_col, text_col)
    kind = source.schema["id"].dataType
    id_type = arrow_type(kind)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in text_blocks(batches):
            n, keys, bands = [], [], []
            for s in shingle_sets(texts, shingle):
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                bands.append(band_values(np.frombuffer(signature(s, factors, terms), "<u4")[None, :], n_bands).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts.ids, id_type), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.binary())],
                names=["id", "n", "key", "bands"])

    marks = stored(source.mapInArrow(mark, f"id {kind.simpleString()}, n bigint, key binary, bands binary"), "marks")
    nodes = stored(marks.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.first("bands").alias("bands")), "nodes")

    def entries_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), n_bands)))], names=["bucket", "key"])

    entries = nodes.select("key", "bands").mapInArrow(entries_of, "bucket bigint, key binary")
    shared = entries.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low != high")
    stars = entries.join(shared.select("bucket", "low"), "bucket").where("key != low").select(F.col("key").alias("a"), F.col("low").alias("b"))
    gathered = stored(components(stars), "candidates")

    # the full sets of all nodes that share a bucket with another
    holders = nodes.select("key", F.col("id").alias("holder")).join(gathered.select(F.col("node").alias("key")), "key", "left_semi")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in text_blocks(batches, 1 << 20):
            found = [s for s in shingle_sets(texts, shingle) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())],
                                             names=["key", "shingles"])

    texts_near = source.join(holders.select("holder").distinct(), F.col("id").eqNullSafe(F.col("holder")), "left_semi")
    sets = texts_near.mapInArrow(full_sets, "key binary, shingles binary").groupBy("key").agg(F.first("shingles").alias("shingles"))
    sets = stored(sets.join(gathered.select(F.col("node").alias("key"), F.col("label").alias("of")), "key"), "shingle-sets")
    sizes = sets.groupBy("of").agg(F.count(F.lit(1)).alias("m"), F.sum(F.octet_length("shingles")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("bytes") / BLOCK_SET_BYTES)).cast("int")
    large = stored(sizes.select("of", blocks.alias("blocks")).where("blocks > 1"), "large")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (of, block, side, key, now, shingles) in order of of and block, to links (a, b)."""
        now, waiting = None, []

        def links() -> pa.RecordBatch:
            rest = {r[3] for r in waiting if r[2] == 0}
            nodes = [r for _, r in sorted({r[3]: r for r in waiting}.items())]  # so that a star's centre is its smallest key
            left = None if all(r[2] is None for r in waiting) else np.array([r[3] in rest for r in nodes])
            found = solver.forest([np.frombuffer(r[5], np.uint64) for r in nodes], np.array([r[4] for r in nodes], object), left) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i][3] for i, _ in found], pa.binary()), pa.array([nodes[j][3] for _, j in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != now:
                    if waiting:
                        yield links()
                    now, waiting = row[:2], []
                waiting.append(row)
        if waiting:
            yield links()

    def solved(rows: DataFrame) -> DataFrame:
        rows = rows.select("of", "block", "side", "key", "now", "shingles").repartition("of", "block").sortWithinPartitions("of", "block")
        return stored(rows.mapInArrow(solve, "a binary, b binary"), "links")

    def dealt(seed: int) -> F.Column:
        return F.pmod(F.xxhash64("key", F.lit(seed)), F.col("blocks")).cast("string")

    n_large = large.count()
    some = F.broadcast(large) if n_large <= 100_000 else large
    nobody = F.lit(None).cast("int").alias("side")
    links = solved(sets.join(some, "of", "left").fillna(1, ["blocks"]).select(
        F.hex("of").alias("of"), dealt(1).alias("block"), nobody, "key", F.col("key").alias("now"), "shingles"))
    if n_large:
        # in large components the buckets are the groups, where they hold what is not one group of links by now
        inside = sets.join(some, "of").select("key", F.octet_length("shingles").alias("bytes"))

        def with_groups(rows: DataFrame, found: DataFrame) -> DataFrame:
            labels = components(found).select(F.col("node").alias("key"), "label")
            return rows.join(labels, "key", "left").withColumn("now", F.coalesce("label", "key")).drop("label")

        members = nodes.join(inside, "key", "left_semi").select("key", "bands").mapInArrow(entries_of, "bucket bigint, key binary").join(with_groups(inside, links), "key")
        members = stored(members, "bucket-members")
        mixed = members.groupBy("bucket").agg(F.min("now").alias("x"), F.max("now").alias("y"), F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes")).where("x != y")
        mixed = stored(mixed.select("bucket", blocks.alias("blocks")), "mixed-buckets")
        members = members.select("bucket", "key", "now").join(mixed, "bucket").withColumn("of", F.col("bucket").cast("string")).join(sets.select("key", "shingles"), "key")
        links = links.unionByName(solved(members.select("of", dealt(2).alias("block"), nobody, "key", "now", "shingles")))
        if not mixed.where("blocks > 1").isEmpty():
            huge = stored(with_groups(members.where("blocks > 1").drop("now"), links), "huge-buckets")
            groups = huge.groupBy("of", "now").agg(F.count(F.lit(1)).alias("n"))
            main = groups.groupBy("of").agg(F.max(F.struct("n", "now")).alias("m"), F.sum("n").alias("all"))
            share = main.select("of", F.col("m.now").alias("main"), "all", (F.col("all") - F.col("m.n")).alias("left")).where("left > 0")
            huge = huge.join(share, "of").withColumn("rests", F.ceil(F.col("left") * F.col("blocks") / F.col("all")).cast("int"))
            every = huge.withColumn("side", F.lit(1)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rests") - 1))).withColumn("j", dealt(4).cast("int"))
            rest = huge.where("now != main").withColumn("side", F.lit(0)).withColumn("i", F.pmod(F.xxhash64("key", F.lit(3)), F.col("rests")).cast("int")).withColumn(
                "j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            links = links.unionByName(solved(every.unionByName(rest).withColumn("block", F.concat_ws("-", "i", "j"))))

    labels = stored(components(links).select(F.col("node").alias("key"), "label"), "labels")
    forget(sets)
    lowest = labels.join(nodes.select("key", "id"), "key").groupBy("label").agg(F.min("id").alias("lowest"))
    of_key = nodes.select("key", "id").join(labels.join(lowest, "label").select("key", "lowest"), "key", "left")
    of_key = of_key.select("key", F.when(F.col("lowest").isNull(), F.col("id")).otherwise(F.col("lowest")).alias("lowest"))
    out = marks.select("id", "n", "key").join(of_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("lowest"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"))
