"""A prefix trie of conversations by truncation peeling: from the deepest turn upwards, conversations that end at a depth
merge with the nodes that survive from below, the last turn is stripped, and what is left regroups one turn higher.

A turn is a symbol of 24 bytes: a 128-bit hash of role and text, and the text's size. A path is a run of symbols, so
sorting paths brings every node's conversations together. Sorted paths are dealt in blocks over all tasks and each block
is peeled by itself; only nodes on the block's first and last path can go on in another block. Their partial sums are
the next round's paths, some thousand times fewer, until one block holds them all."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datalathe.llm.text import shards, stored

#: Bytes of a symbol; turns of a path: deeper conversations go on in further bands below a stem; paths of a block.
SYMBOL, BAND, BLOCK = 24, 64, 20_000
#: Rows returned by a block: nodes, stems of deeper bands, partial sums, ids of conversations that end at an open node.
NODE, STEM, OPEN, ENDS = range(4)
NOBODY = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, symbol): each conversation's turns numbered from 1 in order of turn (null first), role, text.

    A null role or text counts as empty, repeated rows are repeated turns, rows without a conversation are left out.
    The table is sorted as a whole, so a conversation of any length is numbered by all the tasks it reaches.
    """
    col = lambda c: F.col(f"`{c}`")
    role, text = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    size = F.lpad(F.hex(F.octet_length(text).cast("bigint")), 16, "0")
    rows = turns.where(col(conv_col).isNotNull()).select(
        col(conv_col).cast("bigint").alias("conv"), col(turn_col).alias("turn"), role.alias("role"), text.alias("text"),
        F.unhex(F.concat(said, size)).alias("symbol"), F.monotonically_increasing_id().alias("row"))
    early = F.substring("role", 1, 64)  # what splits a range need not be whole, but must keep the order
    ranged = rows.repartitionByRange(shards(turns.sparkSession), "conv", F.col("turn").asc_nulls_first(), early,
                                     F.when(F.char_length("role") < 64, F.substring("text", 1, 64)), F.when((F.char_length("role") < 64) & (F.char_length("text") < 64), F.col("row")))
    ordered = ranged.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "row").select("conv", "symbol")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            first = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            lengths = np.diff(np.append(first, len(conv)))
            place = np.arange(1, len(conv) + 1) - np.repeat(first, lengths)
            if conv[0] == last:
                place[:lengths[0]] += seen
            last, seen = conv[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place), pa.array(np.full(len(conv), part))], names=["conv", "symbol", "place", "part"])

    rows = stored(ordered.mapInArrow(number, "conv bigint, symbol binary, place bigint, part bigint"), "turns-in-order")
    # a conversation that goes on in another part: at most two of them for each part
    of_conv = Window.partitionBy("conv")
    spans = rows.groupBy("conv", "part").agg(F.max("place").alias("n")).withColumn("parts", F.count(F.lit(1)).over(of_conv)).where("parts > 1")
    before = spans.select("conv", "part", F.coalesce(F.sum("n").over(of_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), ["conv", "part"], "left").select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "symbol")


def peel_block(items: list[tuple], base: int, whole: bool, counts_ends: bool) -> Iterator[tuple]:
    """Peel sorted items (stem, path, conv, n_convs, n_children, n_leaves, saved, ends here?) of one block.

    Yields rows of the block's table. base: depth of the stems; whole: there is no other block; counts_ends: the ids of
    ended conversations are among the items (the first round)."""
    edges = [] if whole else [items[0][:2], items[-1][:2]]
    levels: dict[int, dict[tuple, list]] = {}

    def merge(stem: bytes, path: bytes, conv: int, *sums: int) -> list:
        level = levels.setdefault(len(path) // SYMBOL, {})
        node = level.get((stem, path))
        if node is None:  # conv, n_convs, n_children, n_leaves, saved, ids of those that end here, closed
            node = level[stem, path] = [conv, 0, 0, 0, 0, [], True]
        node[0] = min(node[0], conv)
        for k, x in enumerate(sums, 1):
            node[k] += x
        return node

    for stem, path, conv, n_convs, n_children, n_leaves, saved, ends in items:
        node = merge(stem, path, conv, n_convs, n_children, n_leaves, saved)
        if ends:
            node[5].append(conv)
    done = []
    for d in range(max(levels), -1, -1):
        for (stem, path), node in levels.get(d, {}).items():
            conv, n_convs, n_children, n_leaves, saved, ended, _ = node
            if any(stem == s and p.startswith(path) for s, p in edges):
                node[6] = False
                if n_convs:
                    yield OPEN, None, None, base + d, conv, None, n_convs, n_children, n_leaves, saved, None, stem, path
                if ended:
                    yield ENDS, node_key(stem, path), None, None, ended[0], None, None, None, None, None, ",".join(map(str, ended)), None, None
                continue
            if n_children == 0:
                n_leaves = 1
            if d:  # strip the last turn; what is left meets the others one turn higher
                saved += (n_convs - 1) * int.from_bytes(path[-8:], "big")
                above = merge(stem, path[:-SYMBOL], conv, n_convs, 1, n_leaves, saved)
            else:
                above = None
            done.append((d, stem, path, conv, n_convs, n_children, n_leaves, saved, ended, above))
        if d == 0:
            break
        levels.setdefault(d - 1, {})
    for d, stem, path, conv, n_convs, n_children, n_leaves, saved, ended, above in done:
        sha = hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest() if counts_ends else None
        known = above is not None and above[6]
        yield (NODE if d or not base else STEM, node_key(stem, path), node_key(stem, path[:-SYMBOL]) if d and not known else None, base + d, conv,
               above[0] if known else None, n_convs, n_children, n_leaves, saved, sha, stem, path if not (d or not base) else None)


def node_key(stem: bytes, path: bytes) -> bytes:
    return hashlib.md5(stem + path).digest()


ITEM = ["stem", "path", "conv", "n_convs", "n_children", "n_leaves", "saved", "ends"]
ROW = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()), ("conv", pa.int64()), ("parent", pa.int64()),
                 ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()), ("stem", pa.binary()), ("path", pa.binary())])
ROW_SQL = "kind int, key binary, parent_key binary, depth bigint, conv bigint, parent bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends string, stem binary, path binary"


def peel(items: DataFrame, base: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All rows of the first round, and those of the later rounds, that peeling the items down to their stems gives."""
    rounds, counts_ends = [], True
    while True:
        n = items.count() if rounds else None
        whole = n is not None and n <= block

        def task(batches: Iterator[pa.RecordBatch], whole=whole, counts_ends=counts_ends) -> Iterator[pa.RecordBatch]:
            waiting: list[tuple] = []

            def out() -> Iterator[pa.RecordBatch]:
                rows = list(peel_block(waiting, base, whole, counts_ends))
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a:a + 10_000], strict=True), ROW, strict=True)], schema=ROW)
                waiting.clear()

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    waiting.append(row)
                    if len(waiting) >= block and not whole:
                        yield from out()
            if waiting:
                yield from out()

        parts = shards(items.sparkSession) if n is None else max(1, -(-n // block))
        dealt = items.repartitionByRange(parts, "stem", "path", "conv") if parts > 1 else items.coalesce(1)
        rows = stored(dealt.sortWithinPartitions("stem", "path", "conv").select(*ITEM).mapInArrow(task, ROW_SQL), "trie-rows")
        rounds.append(rows)
        items, counts_ends = rows.where(F.col("kind") == OPEN).withColumn("ends", F.lit(False)), False
        if whole or items.isEmpty():
            break
    later = rounds[0].where(F.lit(False))
    for rows in rounds[1:]:
        later = later.unionByName(rows)
    return rounds[0], later


def digests(chunks: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of each key's id lists, joined in order. The lists stream by, whatever their number."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            keys, shas = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    keys.append(key)
                    shas.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(shas, pa.string())], names=["key", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "sha"])

    return chunks.repartition("key").sortWithinPartitions("key", "conv").select("key", "ends").mapInArrow(task, "key binary, sha string")


def prefix_nodes(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The trie of numbered turns (conv, pos, symbol): one row for each distinct sequence of first turns.

    Returns conv_id (the smallest conversation that begins so; with depth it names the node), depth, parent_conv_id (the
    parent is at depth - 1; null for the root), n_convs, n_children, n_leaves (in its subtree, itself included),
    saved_bytes (text bytes that sharing saves in its subtree: of each node (n_convs - 1) times its last text's size) and
    ends_sha256 (of the ids of conversations of exactly these turns, ascending, joined by commas).

    conversations: a table (conv) of all conversations, those without a turn included; by default those of the turns.
    No conversation, no rows, not even a root. Equal conversations are one leaf; turns are equal where role and text are.

    Conversations longer than 64 turns go on in bands below the stem of their turns so far. A stem of one conversation
    needs no merging: the rest of it is a plain chain, of any length. The number of rounds thus follows the deepest turn
    that two conversations share, by 64.
    """
    if conversations is None:
        conversations = turns.select("conv").distinct()
    band = F.floor((F.col("pos") - 1) / BAND).cast("bigint")
    pieces = turns.groupBy("conv", band.alias("band")).agg(F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("s")).select(
        "conv", "band", F.aggregate("s", F.lit(b""), lambda path, x: F.concat(path, x["symbol"])).alias("path"))
    pieces = stored(pieces, "trie-paths")
    nothing = F.lit(bytes(16))
    top = pieces.where("band = 0")
    deep = pieces.join(pieces.where("band > 0").select("conv").distinct(), "conv", "left_semi")
    ends, going = top.join(deep.select("conv").distinct(), "conv", "left_anti"), None
    outs, laters = [], []
    tails = None
    if not pieces.where("band > 0").isEmpty():
        by_conv = Window.partitionBy("conv").orderBy("band")
        half = lambda n: F.conv(F.substring(F.md5(F.concat(F.col("band").cast("string").cast("binary"), F.col("path"))), n, 15), 16, 10).cast("bigint")
        so_far = lambda n: F.lpad(F.hex(F.bit_xor(half(n)).over(by_conv.rowsBetween(Window.unboundedPreceding, -1))), 16, "0")
        stems = stored(deep.select("*", F.when(F.col("band") == 0, nothing).otherwise(F.unhex(F.concat(so_far(1), so_far(16)))).alias("stem"),
                                   (F.lead("band").over(by_conv).isNull()).alias("last")), "trie-stems")
        members = stems.groupBy("stem", "band").agg(F.count(F.lit(1)).alias("members"))
        going = stems.join(members, ["stem", "band"]).withColumn("alone", (F.col("band") > 0) & (F.col("members") == 1))
        going = stored(going.withColumn("next_alone", F.coalesce(F.lead("alone").over(by_conv), F.lit(False))), "trie-bands")
        tails = going.where("alone")
        symbols = (F.octet_length("path") / SYMBOL).cast("int")
        chain = tails.select("conv", "band", "last", symbols.alias("n"), F.explode(F.sequence(F.lit(1), symbols)).alias("i"))
        at_end = F.col("last") & (F.col("i") == F.col("n"))
        tails = chain.select(F.col("conv").alias("conv_id"), (F.col("band") * BAND + F.col("i")).alias("depth"), F.col("conv").alias("parent_conv_id"),
                             F.lit(1).cast("bigint").alias("n_convs"), F.when(at_end, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
                             F.lit(0).cast("bigint").alias("saved_bytes"), F.when(at_end, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(NOBODY)).alias("ends_sha256"))
        deepest = going.where("not alone").agg(F.max("band")).first()[0]
    else:
        deepest = 0
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("n_children", "n_leaves", "saved")]
    from_below = None
    for k in range(deepest, -1, -1):
        items = None
        if going is not None:
            more = F.col("next_alone").cast("bigint")
            items = going.where((F.col("band") == k) & ~F.col("alone") & (F.col("last") | F.col("next_alone"))).select(
                "stem", "path", "conv", F.lit(1).cast("bigint").alias("n_convs"), more.alias("n_children"), more.alias("n_leaves"), zero[2], F.col("last").alias("ends"))
        if k == 0:
            flat = ends.select(nothing.alias("stem"), "path", "conv").unionByName(
                conversations.join(top, "conv", "left_anti").select(nothing.alias("stem"), F.lit(b"").alias("path"), "conv"))
            flat = flat.select("stem", "path", "conv", F.lit(1).cast("bigint").alias("n_convs"), *zero, F.lit(True).alias("ends"))
            items = flat if items is None else items.unionByName(flat)
        if from_below is not None:
            place = going.where(F.col("band") == k).select("conv", "stem", "path")
            items = items.unionByName(from_below.select("conv", "n_convs", "n_children", "n_leaves", "saved", F.lit(False).alias("ends")).join(place, "conv"))
        first, later = peel(items, k * BAND, block)
        outs.append(first)
        laters.append(later)
        from_below = first.unionByName(later).where(F.col("kind") == STEM) if k else None

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    first, later = union(outs), union(laters)
    shas = digests(first.where(F.col("kind") == ENDS).select("key", "conv", "ends"))
    late = stored(later.where(F.col("kind").isin(NODE, STEM)).drop("ends").join(shas, "key", "left").withColumn("ends", F.coalesce("sha", F.lit(NOBODY))).drop("sha"), "trie-late")
    nodes = first.where(F.col("kind") == NODE).unionByName(late.where(F.col("kind") == NODE))
    # parents that were open, or stems, when their children were done: a few for each block
    parents = late.select(F.col("key").alias("parent_key"), F.col("conv").alias("late_parent")).unionByName(
        first.where(F.col("kind") == STEM).select(F.col("key").alias("parent_key"), F.col("conv").alias("late_parent")))
    out = _with_parents(nodes, parents).select(
        F.col("conv").alias("conv_id"), "depth", F.coalesce("parent", "late_parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_bytes"), F.col("ends").alias("ends_sha256"))
    return out if tails is None else out.unionByName(tails)


def _with_parents(nodes: DataFrame, parents: DataFrame, broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """Nodes with late_parent. A node may have a third of all nodes as children: a short list of parents goes to all
    tasks, a longer one is repeated for each salt."""
    if parents.count() <= broadcast_rows:
        return nodes.join(F.broadcast(parents), "parent_key", "left")
    salt = F.pmod(F.xxhash64("conv"), F.lit(salts)).cast("int")
    return nodes.withColumn("salt", salt).join(parents.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["parent_key", "salt"], "left").drop("salt")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """numbered_turns and prefix_nodes of a table of turns."""
    return prefix_nodes(numbered_turns(turns, conv_col, turn_col, role_col, text_col))


def with_shared_heads(turns: DataFrame, head: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Numbered turns of conversations rebuilt upon another's beginning, and all conversations (conv): the first ``head``
    (8 at most) turns of conversation ``base``, then a conversation's own turns after its first ``head``. Both are
    expressions of ``conv``; a base without turns gives none."""
    convs = turns.where("pos = 1").select("conv", head.cast("bigint").alias("head"), base.alias("base"))
    heads = turns.where("pos <= 8").select(F.col("conv").alias("base"), "pos", "symbol")
    given = convs.join(heads, "base").where("pos <= head").select("conv", "pos", "symbol")
    sizes = heads.groupBy("base").agg(F.max("pos").alias("n"))
    moved = convs.join(sizes, "base", "left").select("conv", (F.col("head") - F.least("head", F.coalesce("n", F.lit(0)))).alias("back")).where("back > 0")
    own = turns.where(F.col("pos") > head).join(moved, "conv", "left").select("conv", (F.col("pos") - F.coalesce("back", F.lit(0))).alias("pos"), "symbol")
    return given.unionByName(own), convs.select("conv")
