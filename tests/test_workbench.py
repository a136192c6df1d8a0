import datetime as dt

from datalathe.operators import profile
from datalathe.plans.workbench import Workbench


def test_session_flow(spark, tmp_path):
    p = tmp_path / "sales.csv"
    p.write_text("month,sales,profit\nJan,100,10\nFeb,150,15\nMar,100,12\nMar,100,12\n")
    wb = Workbench(spark, str(tmp_path / "ws"))
    s = wb.load(str(p))
    assert s["shape"] == (4, 3)
    assert wb.quality()["duplicate_rows_pct"] == 25.0
    wb.clean("drop_duplicates")
    assert wb.summary()["shape"] == (3, 3) and wb.steps() == ["Loaded Data", "Dropped Duplicates"]
    wb.mask(["month"], "redact")
    assert {r["month"] for r in wb.df.collect()} == {"*****"}
    wb.undo()
    assert wb.df.filter("month = 'Feb'").count() == 1
    wb.redo()
    kpis = {r["kpi_id"]: r["value"] if r["value"] is not None else r["text_value"] for r in wb.kpis().collect()}
    assert kpis == {"sum_sales": 350.0, "sum_profit": 37.0, "top_month": "***** (3)"}  # redo re-applied the mask
    wb.save_contract({"columns": {"sales": {"type": "int", "nullable": False}}})
    assert wb.validate_contract()["status"] == "passed"
    h = wb.health(dt.datetime(2024, 1, 1)).first()
    assert h["schema_status"] == "stable" and h["current_rows"] == 3
    snaps = wb.snapshots().orderBy("seq").collect()
    assert [r["row_count"] for r in snaps] == [4, 3, 3]
    wb.revert(snaps[0]["snapshot_path"])
    assert wb.summary()["shape"] == (4, 3)
    out = wb.export_csv(str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(out).count() == 4


def test_drift_after_undo_redo_and_revert(spark, tmp_path):
    wb = Workbench(spark, str(tmp_path / "ws"))
    wb.use(spark.createDataFrame([(1, "x")], "a int, b string"), "t")

    def drift():
        return wb.health(dt.datetime(2024, 1, 1)).first()["schema_status"]

    wb.clean("rename_columns", rename_map={"a": "z"})
    assert drift() == "drift_detected"
    wb.undo()
    assert wb.df.columns == ["a", "b"] and drift() == "drift_detected"
    wb.redo()
    assert wb.df.columns == ["z", "b"] and drift() == "drift_detected"
    first = wb.snapshots().orderBy("seq").first()["snapshot_path"]
    wb.revert(first)
    assert wb.df.columns == ["a", "b"] and drift() == "drift_detected"


def test_eda_parts(spark):
    df = spark.range(50).selectExpr("CAST(id AS DOUBLE) AS a", "CAST(id * 2 AS DOUBLE) AS b", "CAST(id % 3 AS STRING) AS s")
    parts = profile.eda(df)
    assert set(parts) == {"description", "correlation", "distributions", "categorical_counts", "scatter_data",
                          "box_plot_data"}
    assert parts["scatter_data"].count() == 50 and parts["correlation"].count() == 4
