"""The conversation trie against plain Python and DuckDB, with odd rows, deep conversations and small blocks."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from datalathe.llm import convtrie, queries
from tests.oracle_harness import compare, duck


def plain(convs):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)} of {conv: [(role, text)]}."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    out = {}
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        row = (min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest())
        assert (min(m), len(k)) not in out
        out[min(m), len(k)] = row
    return out


def grouped(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    out = {r[:2]: r[2:] for r in rows}
    assert len(out) == len(rows)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def odd_rows(seed):
    r = random.Random(seed)
    rows = [(1, None, "user", "é"), (1, 0, None, None), (1, 0, "", ""), (2, 5, "a", "b"), (2, 5, "a", "b"), (None, 1, "x", "y"), (30, 1, "", "ab"), (31, 1, "a", "b"), (9, 1, "u" * 70, "a" * 70)]
    for c in range(40, 200):  # few words, many shared prefixes and copies
        rows += [(c, t, r.choice(["user", "bot"]) if r.random() < 0.2 else "user", r.choice(["a", "bb", "ü"])) for t in range(r.randrange(7))]
    rows += [(c, t, "user", "hot") for c in range(200, 300) for t in range(3)]
    deep = [(t, "user", f"t{t // 3}") for t in range(300)]
    for c, n in ((400, 300), (401, 300), (402, 290), (403, 64), (404, 65), (405, 128), (406, 10), (407, 300)):
        rows += [(c, *x) for x in deep[:n]]
    rows += [(406, 1000 + t, "user", "own") for t in range(200)] + [(407, 1000, "user", "more")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [3, 50, 20_000])
def test_trie_equals_plain_python(spark, block):
    rows = odd_rows(block)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"conv": F.lit(1), "pos": F.lit("x")}).repartition(5)
    if block == 3:  # every path is in a round of its own
        df = df.where("conv_id < 60 or conv_id is null")
        rows = [x for x in rows if x[0] is None or x[0] < 60]
    assert got(convtrie.prefix_nodes(convtrie.numbered_turns(df), block=max(block, 8))) == plain(grouped(rows))


def test_rebuilt_conversations(spark):
    rows = odd_rows(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    turns = convtrie.numbered_turns(df)
    out, convs = convtrie.with_shared_heads(turns, F.crc32(F.col("conv").cast("string").cast("binary")) % 9, F.col("conv") - F.col("conv") % 5)
    assert got(convtrie.prefix_nodes(out, convs, block=100)) == plain(rebuilt(grouped(rows)))


def test_nothing_and_one(spark):
    assert convtrie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(7, 1, "user", "long " * 1_500_000)]
    assert got(convtrie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(grouped(rows))


def test_a_parent_list_too_long_to_broadcast(spark):
    nodes = spark.createDataFrame([(b"a", 1), (b"a", 2), (b"b", 3), (None, 4)], "parent_key binary, conv long")
    parents = spark.createDataFrame([(b"a", 10), (b"b", 20)], "parent_key binary, late_parent long")
    out = convtrie._with_parents(nodes, parents, broadcast_rows=0)
    assert sorted((r.conv, r.late_parent) for r in out.collect()) == [(1, 10), (2, 10), (3, 20), (4, None)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_equals_plain_python(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op11_trie(spark, f"/root/testdata/{sf}")) == plain(rebuilt(grouped(rows)))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    res = compare(spark, "op11_trie", queries.op11_trie, queries.ORACLE["op11_trie"], sf, duck(sf))
    assert res["ok"], res
