"""Row diffs of stored snapshots and the compaction of metadata tables."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from datalathe.plans.history import Workspace, diff_columns, diff_keyed
from tests.plans import plan_of


@pytest.fixture
def ws(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "ws"))


def test_keyed_diff(spark, ws):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 2.0), (3, "z", 3.0), (None, "n", 1.0), (5, "d", 0.0), (5, "e", 0.0), (6, "q", -0.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", None, 9), (2, None, 2.0, 9), (4, "w", 4.0, 9), (None, "n", 1.0, 9), (5, "e", 0.0, 9), (5, "d", 0.0, 9), (6, "q", 0.0, 9)],
                              "k int, s string, v double, extra int")
    pa_, pb = ws.save_snapshot(a, "d"), ws.save_snapshot(b.repartition(3), "d")
    r = ws.diff_rows(pa_, pb, ["k"]).first()
    assert (r.added, r.removed, r.changed, r.unchanged, r.repeated_keys) == (1, 1, 1, 4, 1)
    assert {x.column_name: x.changed for x in ws.diff_rows(pa_, pb, ["k"], columns=True).collect()} == {"s": 1, "v": 0}
    dropped = b.where("not (k = 5 and s = 'd') or k is null")
    assert diff_keyed(a, dropped, ["k"]).first().changed == 2
    assert diff_keyed(a, a.where("false"), ["k"]).first().removed == 6 and diff_keyed(a, a, ["k", "s"]).first().unchanged == 7
    assert diff_columns(a.select("k"), b.select("k"), ["k"]).count() == 0
    with pytest.raises(KeyError):
        diff_keyed(a, b, ["nope"])


def test_nulls_that_swap_columns_are_a_change(spark):
    a = spark.createDataFrame([(1, None, "x")], "k int, s string, t string")
    b = spark.createDataFrame([(1, "x", None)], "k int, s string, t string")
    assert diff_keyed(a, b, ["k"]).first().changed == 1


def test_diff_moves_keys_and_fingerprints(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = plan_of(diff_keyed(docs, docs.withColumn("text", F.upper("text")), ["doc_id"]))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "partial_sum" in plan


def test_one_file_after_a_thousand_appends(spark, ws):
    folder = f"{ws.root}/meta/contracts"
    import os

    os.makedirs(folder)
    schema = pa.schema([("dataset_id", pa.string()), ("contract_json", pa.string()), ("updated_at", pa.timestamp("us")), ("seq", pa.int64())])
    for i in range(1000):
        pq.write_table(pa.Table.from_pylist([{"dataset_id": f"d{i % 10}", "contract_json": f'{{"n": {i}}}', "updated_at": dt.datetime(2024, 1, 1), "seq": i}], schema), f"{folder}/part-{i}.parquet")
    before = sorted(map(tuple, ws.table("contracts").collect()))
    assert ws.file_count("contracts") == 1000 and ws.get_contract("d3") == {"n": 993}
    assert ws.compact("contracts") == 1 and ws.file_count("contracts") == 1
    assert sorted(map(tuple, ws.table("contracts").collect())) == before and ws.get_contract("d3") == {"n": 993}
    ws.save_contract("d3", {"n": -1})
    assert ws.get_contract("d3") == {"n": -1} and ws.file_count("contracts") == 2
    assert ws.compact("contracts") == 2 and ws.table("contracts").count() == 1001
    assert not os.path.exists(folder) and sorted(os.listdir(f"{ws.root}/meta-versions/contracts")) == ["1", "2"]


def test_a_rewrite_cut_short_is_never_read(spark, ws):
    import os

    ws.register_dataset("a", "csv")
    ws.compact("datasets")
    broken = f"{ws.root}/meta-versions/datasets/2"
    os.makedirs(broken)
    pq.write_table(pa.table({"x": [1]}), f"{broken}/part.parquet")  # no marker: not finished
    assert ws.datasets().count() == 1
    ws.register_dataset("b", "csv")
    assert ws.compact("datasets") == 3 and ws.datasets().count() == 2
    assert ws.register_dataset("a", "csv") and ws.datasets().count() == 2


def test_appends_compact_by_themselves(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path / "auto"), compact_after=3)
    for i in range(6):
        ws.save_contract("d", {"n": i})
    assert ws.file_count("contracts") <= 3 and ws.get_contract("d") == {"n": 5} and ws.table("contracts").count() == 6
    empty = Workspace(spark, str(tmp_path / "none"))
    assert empty.table("runs").count() == 0 and empty.file_count("runs") == 0
