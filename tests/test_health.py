import datetime as dt

from datalathe.functions.types import schema_fingerprint
from datalathe.operators import health, widgets


def test_contract_rules(frame):
    df = frame([(1, "a", 1.0), (2, "b", None), (2, None, 3.0), (None, "c", 4.0), (None, "d", 5.0)],
               "id int, s string, x double")
    res = health.contract_check(df, {"columns": {"id": {"type": "int", "unique": True}, "s": {"type": "string",
                                                 "nullable": False, "unique": True},
                                                 "x": {"type": "int"}, "gone": {}}})
    got = {(r["column_name"], r["rule"]): r["passed"] for r in res.collect()}
    assert got == {("id", "type"): True, ("id", "unique"): False, ("s", "type"): True, ("s", "unique"): True,
                   ("s", "nullable"): False, ("x", "type"): False, ("gone", "exists"): False}
    st = health.contract_status(res)
    assert st["status"] == "failed" and "Missing column: gone" in st["violations"]


def test_unique_two_nulls_break_it(frame):
    df = frame([(1,), (None,), (None,)], "a int")
    r = health.contract_check(df, {"columns": {"a": {"unique": True}}}).first()
    assert r["passed"] is False
    df = frame([(1,), (None,)], "a int")
    assert health.contract_check(df, {"columns": {"a": {"unique": True}}}).first()["passed"] is True


def test_volume_states():
    assert health.volume_status(100, [100, 100]) == "stable"
    assert health.volume_status(1000, [100, 100, 100]) == "changed"
    assert health.volume_status(1000, [100, 101, 99, 100]) == "anomaly"
    assert health.volume_status(102, [100, 101, 99, 103]) == "stable"


def test_drift_and_freshness(frame):
    df = frame([(dt.datetime(2024, 1, 10, 12), 1)], "event_time timestamp_ntz, v int")
    assert health.drift_status(df, schema_fingerprint(df)) == "stable"
    assert health.drift_status(df, "0" * 32) == "drift_detected"
    assert health.freshness(df, dt.datetime(2024, 1, 10, 20))["freshness"] == "fresh"
    assert health.freshness(df, dt.datetime(2024, 1, 13))["freshness"] == "ok"
    f = health.freshness(df, dt.datetime(2024, 2, 1))
    assert f["freshness"] == "stale" and f["days_since_last_entry"] == 21


def test_freshness_text_dates_and_unknown(frame):
    df = frame([("2024-01-01",), ("bad",), (None,)], "order_date string")
    assert health.freshness(df, dt.datetime(2024, 1, 3))["days_since_last_entry"] == 2
    assert health.freshness(frame([(1,)], "v int"), dt.datetime(2024, 1, 1))["freshness"] == "unknown"


def test_check_health_row(spark, frame):
    df = frame([(dt.datetime(2024, 1, 1), 1)] * 5, "ts timestamp_ntz, v int")
    runs = spark.createDataFrame([(5, schema_fingerprint(df), dt.datetime(2024, 1, 1)),
                                  (5, schema_fingerprint(df), dt.datetime(2023, 12, 1))],
                                 "row_count long, schema_hash string, ts timestamp_ntz")
    r = health.check_health(df, runs, dt.datetime(2024, 1, 20)).first()
    assert (r["volume_status"], r["current_rows"], r["schema_status"], r["freshness"]) == ("stable", 5, "stable", "stale")


def test_widgets(frame):
    df = frame([("a", 1.0), ("a", 3.0), (None, 5.0), ("", "x"), ("b", None)], "k string, v string")
    avg = {r["name"]: r["value"] for r in widgets.widget_data(df, "k", "v", "avg").collect()}
    assert avg == {"a": 2.0, "Unknown": 2.5, "b": 0.0}
    cnt = [tuple(r) for r in widgets.widget_data(df, "k").collect()]
    assert cnt == [("Unknown", 2.0), ("a", 2.0), ("b", 1.0)]
    sc = widgets.scatter_widget(df.selectExpr("v AS x", "v AS y"), "x", "y").collect()
    assert len(sc) == 4  # "x" is not a number; the null reads 0
    ov = widgets.overview(df).first()
    assert (ov["rows"], ov["columns"], ov["missing_cells"]) == (5, 2, 2)


def test_widgets_nan_reads_like_missing(frame):
    nan = float("nan")
    df = frame([(nan, 2.0), (1.0, nan), (1.0, 4.0)], "k double, v double")
    got = {r["name"]: r["value"] for r in widgets.widget_data(df, "k", "v", "sum").collect()}
    assert got == {"Unknown": 2.0, "1.0": 4.0}
    sc = sorted(tuple(r) for r in widgets.scatter_widget(df, "k", "v").collect())
    assert sc == [(0.0, 2.0, 1.0), (1.0, 0.0, 1.0), (1.0, 4.0, 1.0)]
