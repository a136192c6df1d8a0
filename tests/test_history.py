import pytest
from pyspark.sql import functions as F

from datalathe.plans.history import StepHistory, Workspace, apply_expression, dataset_id_for, diff_frames


@pytest.fixture
def ws(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "ws"))


def test_register_dataset_once(ws):
    a = ws.register_dataset("Monthly Sales", "csv")
    b = ws.register_dataset("Monthly Sales", "csv")
    assert a == b == dataset_id_for("Monthly Sales")
    assert ws.table("datasets").count() == 1


def test_steps_snapshot_undo_redo(ws, spark):
    df = spark.range(10).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS x")
    h = StepHistory(df, workspace=ws, dataset_id="d1")
    h.clean("dropna")
    assert h.current.count() == 6
    h.clean("drop_columns", columns=["x"])
    assert h.steps == ["Loaded Data", "Dropped Missing Values", "Dropped Columns: ['x']"]
    assert h.undo().columns == ["id", "x"]
    assert h.steps[-1] == "Dropped Missing Values"
    assert h.redo().columns == ["id"]
    with pytest.raises(IndexError):
        h.redo()
    # every step wrote one snapshot and one run; undo/redo write none
    snaps = ws.list_snapshots("d1").orderBy("seq").collect()
    assert [r["row_count"] for r in snaps] == [10, 6, 6] and [r["col_count"] for r in snaps] == [2, 2, 1]
    # the history continues from the snapshot read back: the plan is a plain scan
    assert "FileScan parquet" in h.current._jdf.queryExecution().executedPlan().toString()


def test_failed_step_leaves_no_trace(spark):
    h = StepHistory(spark.range(3).toDF("id"))
    with pytest.raises(KeyError):
        h.clean("drop_columns", columns=["nope"])
    assert h.steps == ["Loaded Data"] and not h.undo_stack
    with pytest.raises(IndexError):
        h.undo()


def test_mask_is_a_step_and_replay(spark):
    df = spark.createDataFrame([("abcdefgh",)], "s string")
    h = StepHistory(df)
    h.mask(["s"], "partial")
    assert h.current.first()["s"] == "****efgh" and h.steps[-1] == "Masked columns ['s'] (partial)"
    other = spark.createDataFrame([("123456",)], "s string")
    assert h.replay(other).first()["s"] == "**3456"


def test_diff_and_revert(ws, spark):
    a = spark.range(10).selectExpr("id", "id * 2 AS y")
    b = spark.range(7).selectExpr("id", "'z' AS z")
    d = diff_frames(a, b, values=True).first()
    assert d["added_columns"] == ["z"] and d["removed_columns"] == ["y"] and d["rows_diff"] == -3
    assert d["summary"] == "Row change: -3. Cols added: 1, removed: 1"
    assert (d["only_in_a"], d["only_in_b"]) == (3, 0)
    p = ws.save_snapshot(a, "d2")
    before = ws.run_history("d2", limit=None).count()
    back, newp = ws.revert(p, "d2")
    assert back.count() == 10 and newp != p
    assert ws.run_history("d2", limit=None).count() == before + 1  # one run per revert


def test_contracts_newest_wins(ws):
    ws.save_contract("d", {"columns": {"a": {"unique": True}}})
    ws.save_contract("d", {"columns": {"b": {"nullable": False}}})
    assert ws.get_contract("d") == {"columns": {"b": {"nullable": False}}}
    assert ws.get_contract("other") is None


def test_feature_registry(ws, spark):
    ws.register_feature("net", "price after discount", "1", "price * 0.9")
    ws.register_feature("net", "price after discount", "2", "price * 0.8")
    ws.register_feature("big", "flag", "1", "price > 10")
    feats = ws.list_features().collect()
    assert [(r["name"], r["version"]) for r in feats] == [("big", "1"), ("net", "2"), ("net", "1")]
    df = spark.createDataFrame([(20.0,)], "price double")
    assert ws.apply_feature(df, "net").first()["net"] == pytest.approx(16.0)
    assert ws.apply_feature(df, "net", "1").first()["net"] == pytest.approx(18.0)
    assert apply_expression(df, "half", "price / 2").first()["half"] == 10.0
    with pytest.raises(Exception):
        ws.register_feature("bad", "", "1", "price * (")
    with pytest.raises(KeyError):
        ws.feature_code("net", "9")


def test_workspace_diff_and_health(ws, spark):
    import datetime as dt

    a = spark.range(10).selectExpr("id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts")
    pa = ws.save_snapshot(a, "h")
    ws.log_run("h", a, pa)
    b = a.limit(4).withColumn("extra", a.id * 2)
    pb = ws.save_snapshot(b, "h")
    run_b = ws.log_run("h", b, pb)
    d = ws.diff(pa, pb).first()
    assert d["rows_diff"] == -6 and d["added_columns"] == ["extra"]
    r = ws.check_health(ws.read_snapshot(pb), "h", dt.datetime(2024, 1, 2), current_run=run_b).first()
    # compared with the earlier run only: schema changed, a single earlier run keeps volume stable
    assert (r["schema_status"], r["volume_status"], r["freshness"]) == ("drift_detected", "stable", "ok")
