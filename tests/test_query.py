import pytest
from pyspark.sql import functions as F

from datalathe.operators import phrase, query


@pytest.fixture
def orders(frame):
    return frame([(1, "Paris", 5.0, "a"), (2, "paris", 7.5, None), (3, "Rome", None, "b"), (4, None, 5.0, "b"),
                  (5, "Oslo", 2.0, "a")], "id int, city string, x double, tag string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_compare_ops_and_null_passes_not_equal(orders):
    f = lambda op, v: ids(query.filter_rows(orders, [{"col": "x", "op": op, "val": v}]))
    assert f("==", 5) == [1, 4]
    assert f("!=", 5) == [2, 3, 5]  # the null row passes !=
    assert f(">", 5) == [2]
    assert f(">=", 5) == [1, 2, 4]
    assert f("<", 5) == [5]
    assert f("<=", "5") == [1, 4, 5]  # text constant cast to the column type
    assert f("==", "abc") == []  # a bad constant matches nothing, no ANSI error


def test_unknown_column_skipped_and_contains(orders):
    assert ids(query.filter_rows(orders, [{"col": "nope", "op": "==", "val": 1}])) == [1, 2, 3, 4, 5]
    assert ids(query.filter_rows(orders, [{"col": "city", "op": "contains", "val": "PAR"}])) == [1, 2]


def test_group_drops_null_keys_and_counts(orders):
    out = query.query_builder(orders, groupby=["tag"], sort={"tag": "asc"}).collect()
    assert [(r["tag"], r["count"]) for r in out] == [("a", 2), ("b", 2)]
    out = query.query_builder(orders, groupby=["tag"], aggregates={"x": "mean", "id": "nunique"}).orderBy("tag").collect()
    assert out[0]["x"] == pytest.approx(3.5) and out[1]["id"] == 2
    with pytest.raises(ValueError):
        query.query_builder(orders, groupby=["tag"], aggregates={"x": "first"})


def test_sort_first_key_first_nulls_last(orders):
    out = query.query_builder(orders, select=["id", "x", "tag"], sort={"tag": "desc", "x": "asc"}, limit=3).collect()
    assert [r["id"] for r in out] == [4, 3, 5]
    out = query.query_builder(orders, sort={"x": "desc"}).collect()
    assert out[-1]["x"] is None


def test_builder_sql_names_aggregates():
    sql = query.builder_sql(groupby=["tag"], aggregates={"x": "sum"}, filters=[{"col": "x", "op": ">", "val": 1}],
                            sort={"tag": "asc"}, limit=5)
    assert sql == 'SELECT "tag", SUM("x") AS "x" FROM current_data WHERE "x" > 1 GROUP BY "tag" ORDER BY "tag" ASC LIMIT 5'
    quoted = query.builder_sql(select=['a"b'], filters=[{"col": "s", "op": "==", "val": "it's"}])
    assert quoted == """SELECT "a""b" FROM current_data WHERE "s" = 'it''s'"""


@pytest.mark.parametrize("text,want", [
    ("show rows where x > 5", [2]),
    ("x = 5", [1, 4]),
    ("x >= 5", [1, 2, 4]),
    ("x <= 5", [1, 4, 5]),
    ("x != 5", [2, 3, 5]),
    ("x == 5", [1, 4]),
    ("find records where x equals 5", [1, 4]),
    ("x greater than 6", [2]),
    ("city = Paris", [1]),  # the constant keeps its case
    ("X = 5 and city = Paris", [1]),
    ("x < 3 or city = 'Rome'", [3, 5]),
    ("x > 1 and tag = a or id = 3", [1, 3, 5]),
])
def test_phrases(orders, text, want):
    assert ids(phrase.phrase_filter(orders, text)) == want


def test_keyword_fallback(orders):
    assert ids(phrase.phrase_filter(orders, "show rows paris")) == [1, 2]
    assert ids(phrase.keyword_filter(orders, "7.5")) == [2]
    assert ids(phrase.phrase_filter(orders, "nothing matches this")) == []


def test_longest_column_name_first(frame):
    df = frame([(1, 10), (2, 20)], "a int, ab int")
    assert [r["a"] for r in phrase.phrase_filter(df, "ab > 15").collect()] == [2]


def test_filters_pushed_to_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "CAST(id AS DOUBLE) AS x", "'k' AS s").write.parquet(path)
    df = spark.read.parquet(path)
    q = query.query_builder(df, filters=[{"col": "x", "op": ">", "val": 50}], select=["id"])
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(x), GreaterThan(x,50.0)]" in plan
    assert "ReadSchema: struct<id:bigint,x:double>" in plan


def test_run_builder_request(orders):
    res = query.run_builder(orders, {"filters": [{"col": "x", "op": ">=", "val": 5}], "groupby": ["tag"],
                                     "aggregates": {"x": "median"}, "sort": {"tag": "asc"}, "limit": 10})
    assert [tuple(r) for r in res["frame"].collect()] == [("a", 5.0), ("b", 5.0)]
    assert res["summary"]["shape"] == (2, 2)
    assert res["generated_sql"].startswith('SELECT "tag", MEDIAN("x") AS "x" FROM current_data WHERE "x" >= 5')


def test_grouped_median_matches_numpy(spark):
    import numpy as np

    rows = [(k, float(v)) for k in ("hot", "a", "b") for v in range(50 if k == "hot" else 7)] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = {r["k"]: r["v"] for r in query.group_aggregate(df, ["k"], {"v": "median"}).collect()}
    assert out == {"hot": float(np.median(range(50))), "a": 3.0, "b": 3.0}


def test_text_form_like_python(frame):
    from datalathe.functions.types import text_form

    vals = [1e10, 0.5, 1.0, 123456789.25, 1e-05, None]
    df = frame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(text_form("x", df.schema["x"].dataType)).collect()]
    assert got[:4] == [str(v) for v in vals[:4]] and got[5] is None
    assert float(got[4]) == 1e-05


def test_phrase_with_spaced_column_names(frame):
    df = frame([(1, 5.0), (2, 50.0)], "id int, x double").toDF("order id", "unit price")
    assert [r["order id"] for r in phrase.phrase_filter(df, "show rows where unit price > 10").collect()] == [2]


def test_phrase_columns_and_symbols(frame):
    df = frame([(1, 5.0, 3.0), (2, 2.0, 4.0), (3, None, 1.0)], "id int, price double, cost double")
    ids = lambda t: sorted(r["id"] for r in phrase.phrase_filter(df, t).collect())
    assert ids("price > cost") == [1]
    assert ids("price != cost") == [1, 2, 3]
    assert ids("price > 1 & cost > 3") == [2]
    assert ids("price > 4 | cost < 2") == [1, 3]


def test_integer_constants_stay_exact_and_are_pushed(spark, tmp_path):
    from datalathe.operators.phrase import phrase_filter

    big = 2**53 + 1
    spark.createDataFrame([(big,), (big - 1,)], "k long").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = query.filter_rows(df, [{"col": "k", "op": "==", "val": str(big)}])
    assert [r.k for r in got.collect()] == [big]
    for out, pushed in ((got, "EqualTo(k,"), (phrase_filter(df, "show rows where k > 5"), "GreaterThan(k,")):
        assert pushed in out._jdf.queryExecution().toString()


def test_contains_folds_any_letter_and_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("ÉCOLE", None), ("x", 1.0)], "s string, v double")
    assert query.filter_rows(df, [{"col": "s", "op": "contains", "val": "école"}]).count() == 1
    assert {r.s: r.v for r in query.group_aggregate(df, ["s"], {"v": "sum"}).collect()} == {"ÉCOLE": 0.0, "x": 1.0}
