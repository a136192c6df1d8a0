import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from datalathe.operators import kpi, profile


@pytest.fixture
def sales(frame):
    # the reference's monthly-sales upload
    return frame([("Jan", 100, 10), ("Feb", 150, 15), ("Mar", 100, 12)], "month string, sales int, profit int")


def test_quality_of_clean_table_is_100(sales):
    q = profile.quality_score(sales)
    assert q["score"] == 100.0 and q["missing_cells_pct"] == 0 and q["duplicate_rows_pct"] == 0


def test_quality_parts_with_nulls_and_duplicates(frame):
    df = frame([(1, "x"), (1, "x"), (None, None), (None, None), (2, None)], "a int, b string")
    q = profile.quality_score(df)
    # 5 missing of 10 cells, 2 duplicate rows of 5, 0 of 2 complete columns
    assert q["missing_cells_pct"] == 50.0 and q["duplicate_rows_pct"] == 40.0
    assert q["score"] == round(0.4 * 50 + 0.3 * 60 + 0.3 * 0, 1)
    assert profile.duplicate_count(df) == 2


def test_quality_empty_table(frame):
    # missing and duplicate parts are 0; every column of an empty table is
    # complete (pandas' all() of nothing is true), so the score is 30
    q = profile.quality_score(frame([], "a int"))
    assert q["score"] == 30.0 and q["rows"] == 0 and q["missing_cells_pct"] == 0


def test_summary_exact_missing(frame):
    df = frame([(1, None), (None, None), (3, "z")], "a int, b string")
    s = profile.table_summary(df)
    assert s["shape"] == (3, 2) and s["missing_values"] == {"a": 1, "b": 2}
    assert s["preview"].count() == 3


def test_describe_numbers_and_text(frame):
    df = frame([(1.0, "a"), (2.0, "b"), (3.0, "b"), (None, None), (10.0, "a")], "x double, s string")
    rows = {r["column_name"]: r for r in profile.describe(df).collect()}
    x = rows["x"]
    assert x["count"] == 4 and x["mean"] == pytest.approx(4.0)
    assert x["std"] == pytest.approx(np.std([1, 2, 3, 10], ddof=1))
    assert (x["p25"], x["p50"], x["p75"]) == tuple(np.quantile([1, 2, 3, 10], [0.25, 0.5, 0.75]))
    s = rows["s"]
    assert (s["count"], s["unique"], s["top"], s["freq"]) == (4, 2, "a", 2)  # tie -> smallest


def test_correlation_constant_is_null_not_error(frame):
    # y = 2 xA, xB constant: ANSI corr would raise DIVIDE_BY_ZERO
    df = frame([(i, 1, 2 * i) for i in range(100)], "xA int, xB int, y int")
    c = {(r["x"], r["y"]): r["value"] for r in profile.correlation(df).collect()}
    assert c[("xA", "y")] == pytest.approx(1.0) and c[("y", "xA")] == pytest.approx(1.0)
    assert c[("xB", "y")] is None and c[("xB", "xB")] is None
    assert len(c) == 9


def test_histogram_matches_numpy_and_lists_empty_bins(frame):
    vals = [0.0, 0.05, 1.0, 1.0, 9.99, 10.0, None]
    df = frame([(v,) for v in vals], "x double")
    h = profile.histogram(df).orderBy("bin").collect()
    counts, edges = np.histogram([v for v in vals if v is not None], bins=10)
    assert [r["count"] for r in h] == list(counts)
    assert [r["range"] for r in h] == [f"{edges[i]:.2f}-{edges[i + 1]:.2f}" for i in range(10)]
    assert sum(r["count"] for r in h) == 6


def test_histogram_constant_widens(frame):
    h = profile.histogram(frame([(5.0,), (5.0,)], "c double")).orderBy("bin").collect()
    assert h[0]["range"] == "4.50-4.60" and sum(r["count"] for r in h) == 2


def test_top_categories_ties_by_value(frame):
    df = frame([("b",), ("a",), ("c",), ("a",), ("b",), (None,)], "s string")
    got = [(r["value"], r["count"]) for r in profile.top_categories(df, k=2).orderBy("rank").collect()]
    assert got == [("a", 2), ("b", 2)]


def test_top_categories_plan_limits_before_shuffle(spark):
    df = spark.range(1000).selectExpr("CAST(id % 37 AS STRING) AS s")
    plan = profile.top_categories(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_boxplot_counts_outliers(frame):
    df = frame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "x double")
    r = profile.boxplot(df).first()
    assert (r["min"], r["q1"], r["median"], r["q3"], r["max"]) == (1.0, 3.0, 5.0, 7.0, 100.0)
    assert r["outliers"] == 1


def test_kpis_monthly_sales(sales):
    rows = [tuple(r) for r in kpi.detect_kpis(sales).collect()]
    assert rows == [("sum_sales", "Total sales", 350.0, None, "currency"),
                    ("sum_profit", "Total profit", 37.0, None, "currency"),
                    ("top_month", "Top month", None, "Feb (1)", "text")]


def test_kpis_none_for_plain_names(frame):
    df = frame([(1, 2, 3)], "feature1 int, feature2 int, target int")
    assert kpi.detect_kpis(df).count() == 0


def test_insights_sentences(frame):
    rows = [(float(i), float(i) * 2 + 1, "k") for i in range(30)] + [(1000.0, 2001.0, None)]
    text = [r["insight"] for r in profile.insights(frame(rows, "a double, b double, s string")).orderBy("idx").collect()]
    assert text[0] == "The dataset contains 31 rows and 3 columns."
    assert text[1] == "Found missing values in 1 columns: s."
    assert "Columns breakdown: 2 numerical, 1 categorical." in text
    assert "Potential outliers detected in: a (1), b (1)." in text
    assert "High correlation detected in columns: b." in text


def test_recommendations_and_group_mean(frame):
    df = frame([("x", 1.0, 2.0), ("y", 3.0, 1.0), ("x", 5.0, 0.0)], "k string, a double, b double")
    recs, data = profile.recommend_charts(df)
    assert [r["chart_id"] for r in recs.collect()] == ["rec_dist", "rec_cat", "rec_corr", "rec_comp"]
    assert [tuple(r) for r in data["rec_comp"].collect()] == [("x", 3.0), ("y", 3.0)]
    assert data["rec_corr"].count() == 3


def test_sample_is_repeatable(spark):
    df = spark.range(1000).toDF("id")
    a = [r[0] for r in profile.sample_rows(df, 20).collect()]
    b = [r[0] for r in profile.sample_rows(df.repartition(7), 20).collect()]
    assert a == b and len(a) == 20


def test_column_profile(frame):
    df = frame([(1, "a"), (1, None), (2, "b")], "n int, s string")
    r = {x["column_name"]: x for x in profile.column_profile(df).collect()}
    assert r["s"]["missing"] == 1 and r["s"]["unique"] == 2 and r["n"]["dtype"] == "int"
    assert r["s"]["missing_pct"] == pytest.approx(100 / 3)


def test_approx_switches(spark):
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS x", "CAST(id % 3 AS STRING) AS s")
    exact = {r["column_name"]: r for r in profile.describe(df).collect()}
    approx = {r["column_name"]: r for r in profile.describe(df, approx=True).collect()}
    assert exact["x"]["p50"] == 499.5 and abs(approx["x"]["p50"] - 499.5) <= 1
    prof = {r["column_name"]: r["unique"] for r in profile.column_profile(df, approx_distinct=True).collect()}
    assert abs(prof["x"] - 1000) < 200 and prof["s"] == 3  # HyperLogLog++, 5% rsd


def test_nan_is_missing_everywhere(frame):
    from datalathe.operators import cleaning, health, query

    df = frame([(1.0, "a"), (float("nan"), "b"), (3.0, "a"), (None, "b"), (100.0, "c")], "x double, s string")
    d = {r["column_name"]: r for r in profile.describe(df).collect()}["x"]
    assert (d["count"], d["max"], d["p50"]) == (3, 100.0, 3.0)
    assert {r["column_name"]: r["missing"] for r in profile.null_counts(df).collect()}["x"] == 2
    assert profile.quality_score(df)["missing_cells_pct"] == 20.0
    h = profile.histogram(df).collect()
    assert sum(r["count"] for r in h) == 3 and "nan" not in h[0]["range"]
    kept = cleaning.remove_outliers(df, ["x"]).count()
    assert kept == 5  # NaN and null are kept, no outlier among three values
    filled = cleaning.fill_strategy(df, "mean").collect()
    assert [r["x"] for r in filled][1] == pytest.approx(104 / 3)
    assert [r["x"] for r in query.filter_rows(df, [{"col": "x", "op": ">", "val": 2}]).collect()] == [3.0, 100.0]
    assert [r["x"] for r in query.sort_rows(df, {"x": "desc"}).collect()][:3] == [100.0, 3.0, 1.0]
    assert health.contract_check(df, {"columns": {"x": {"nullable": False}}}).first()["passed"] is False


def test_histogram_skips_infinite_range(frame):
    df = frame([(1.0, 1.0), (float("inf"), 2.0)], "x double, y double")
    assert {r["column_name"] for r in profile.histogram(df).collect()} == {"y"}
    assert profile.describe(df).filter("column_name = 'x'").first()["max"] == float("inf")


def test_describe_booleans_like_pandas(frame):
    from datalathe.operators import cleaning

    df = frame([(True,), (False,), (True,), (None,)], "b boolean")
    r = profile.describe(df).first()
    assert (r["column_name"], r["count"], r["unique"], r["top"], r["freq"]) == ("b", 3, 2, "True", 2)
    assert cleaning.one_hot(df, ["b"]).columns == ["b_False", "b_True"]
    assert cleaning.fill_strategy(df, "mode").filter("b").count() == 3


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(st.integers(-1000, 1000).map(lambda v: v / 7.0),
                          st.sampled_from([0.0, 0.1, 0.3, 1e-9, -2.5])), min_size=1, max_size=80))
def test_histogram_property_matches_numpy(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r["count"] for r in profile.histogram(df).orderBy("bin").collect()]
    counts, _ = np.histogram(np.array(vals), bins=10)
    assert got == list(counts)


def test_correlation_chunks_wide_tables(spark, monkeypatch):
    monkeypatch.setattr(profile, "CORR_CHUNK", 7)
    df = spark.range(60).selectExpr(*[f"CAST(id * {i + 1} + (id % {i + 2}) AS DOUBLE) AS c{i}" for i in range(6)],
                                     "CASE WHEN id % 5 = 0 THEN NULL ELSE CAST(id % 7 AS DOUBLE) END AS n")
    got = {(r["x"], r["y"]): r["value"] for r in profile.correlation(df).collect()}
    pdf = df.toPandas()
    want = pdf.corr()
    for (a, b), v in got.items():
        assert v == pytest.approx(want.loc[a, b], rel=1e-9, abs=1e-12)


def test_kpi_averages_and_percent(frame):
    df = frame([(4.0, 10.0, 1.0, "x"), (5.0, 30.0, 3.0, "y")], "rating double, win_percent double, other double, s string")
    rows = {r["kpi_id"]: (r["value"], r["format"]) for r in kpi.detect_kpis(df).collect()}
    assert rows["avg_rating"] == (4.5, "number") and rows["avg_win_percent"] == (20.0, "percent")
    assert "top_s" in rows and len(rows) == 3
