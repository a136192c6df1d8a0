import pytest
from pyspark.sql import functions as F

from datalathe.operators import cleaning


@pytest.fixture
def nulls(frame):
    # null and NaN side by side, an all-null column, a string tie for the mode
    return frame([(1, 1.0, "a"), (2, None, "b"), (3, float("nan"), None), (None, 4.0, "b"), (5, 7.0, "a")],
                 "k int, x double, s string")


def test_dropna_all_and_subset(nulls):
    assert cleaning.drop_missing(nulls).count() == 2  # NaN is a value in Spark unless normalised
    assert cleaning.drop_missing(nulls, ["k"]).count() == 4
    with pytest.raises(KeyError):
        cleaning.drop_missing(nulls, ["nope"])


def test_fill_value_per_type(nulls):
    out = cleaning.fill_value(nulls, "0").orderBy(F.col("k").asc_nulls_first()).collect()
    assert out[0]["k"] == 0
    assert out[2]["x"] == 0.0 and out[3]["s"] == "0"
    # a value that does not convert leaves the column alone
    out = cleaning.fill_value(nulls, "abc", ["k"]).filter(F.col("k").isNull()).count()
    assert out == 1


def test_fill_mean_median_cast_int_with_nulls(frame):
    df = frame([(1, 10, 1.0), (2, None, None), (3, 20, 5.0), (4, 31, 6.0)], "id int, a int, b double")
    m = cleaning.fill_strategy(df, "mean")
    assert dict(m.dtypes)["a"] == "double" and dict(m.dtypes)["id"] == "int"
    assert m.filter("id = 2").first()["a"] == pytest.approx(61 / 3)
    med = cleaning.fill_strategy(df, "median").filter("id = 2").first()
    assert med["a"] == 20.0 and med["b"] == 5.0


def test_fill_mode_tie_and_all_null(frame):
    df = frame([("b", None, 2), ("a", None, 1), (None, None, 1), ("b", None, 2), ("a", None, None)],
               "s string, z double, n int")
    out = cleaning.fill_strategy(df, "mode")
    row = out.filter(F.col("s").isNotNull() & F.col("n").isNotNull()).count()
    assert row == 5
    assert out.filter(F.col("z").isNull()).count() == 5  # all-null column untouched
    assert sorted(r["s"] for r in out.collect()) == ["a", "a", "a", "b", "b"]  # tie -> smallest


def test_drop_duplicates_with_nulls(frame):
    df = frame([(1, "x"), (1, "x"), (None, None), (None, None), (2, None)], "a int, b string")
    assert cleaning.drop_duplicates(df).count() == 3


def test_outliers_sequential_keeps_nulls(frame):
    rows = [(float(i), float(i % 5)) for i in range(20)] + [(1000.0, 3.0), (None, 2.0), (5.0, 100.0)]
    df = frame(rows, "x double, y double")
    out = cleaning.remove_outliers(df, ["x", "y"])
    xs = [r["x"] for r in out.collect()]
    assert 1000.0 not in xs and None in xs
    assert out.filter("y = 100").count() == 0


def test_label_encode_text_order_and_nan(frame):
    df = frame([(10, "x"), (2, "y"), (None, "x"), (2, None)], "n int, s string")
    out = cleaning.label_encode(df, ["n", "s"]).collect()
    codes = [(r["n"], r["s"]) for r in out]
    # text order: "10" < "2" < "nan" and "nan" < "x" < "y"
    assert codes == [(0, 1), (1, 2), (2, 1), (1, 0)]


def test_label_encode_large_dictionary(spark, monkeypatch):
    monkeypatch.setattr(cleaning, "DRIVER_DICTIONARY_MAX", 10)
    df = spark.range(0, 500).selectExpr("CAST(id * 7 % 500 AS STRING) AS v", "id").repartition(5)
    out = cleaning.label_encode(df, ["v"])
    got = {r["id"]: r["v"] for r in out.collect()}
    order = sorted(str(i * 7 % 500) for i in range(500))
    want = {i: order.index(str(i * 7 % 500)) for i in range(500)}
    assert got == want


def test_one_hot(frame):
    df = frame([(1, "b"), (2, "a"), (3, None)], "id int, c string")
    out = cleaning.one_hot(df, ["c"])
    assert out.columns == ["id", "c_a", "c_b"]
    assert [(r["c_a"], r["c_b"]) for r in out.orderBy("id").collect()] == [(False, True), (True, False), (False, False)]
    with pytest.raises(ValueError):
        cleaning.one_hot(df, ["c"], max_values=1)


def test_scaling_constant_and_nulls(frame):
    df = frame([(5.0, 1.0), (5.0, 3.0), (5.0, None)], "c double, v double")
    mm = cleaning.minmax_scale(df, ["c", "v"]).collect()
    assert [r["c"] for r in mm] == [0.0, 0.0, 0.0]
    assert [r["v"] for r in mm] == [0.0, 1.0, None]
    st = cleaning.standard_scale(df, ["c", "v"]).collect()
    assert [r["c"] for r in st] == [0.0, 0.0, 0.0]
    assert [r["v"] for r in st] == [-1.0, 1.0, None]


def test_scaled_values_in_unit_interval(spark):
    df = spark.range(0, 200).selectExpr("CAST(id * id % 97 AS DOUBLE) AS x")
    out = cleaning.minmax_scale(df, ["x"]).agg(F.min("x"), F.max("x")).first()
    assert out[0] == 0.0 and out[1] == 1.0


def test_clean_descriptions(nulls):
    _, d = cleaning.clean(nulls, "fillna", strategy="mean")
    assert d == "Filled Missing Values (mean)"
    _, d = cleaning.clean(nulls, "normalize", columns=["x"], strategy="minmax")
    assert d == "Normalized Columns (minmax)"


def test_nan_is_not_a_category(frame):
    nan = float("nan")
    df = frame([(1.0,), (nan,), (nan,), (nan,), (1.0,), (2.0,), (None,)], "x double")
    assert cleaning.one_hot(df, ["x"]).columns == ["x_1.0", "x_2.0"]
    filled = cleaning.fill_strategy(df, "mode").collect()
    # the mode is 1.0 (NaN is not a value); NaN and null both get filled, as pandas fills NaN
    assert [r["x"] for r in filled][-1] == 1.0 and sum(1 for r in filled if r["x"] == 1.0) == 6
