import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from datalathe.functions.quantiles import exact_quantiles
from datalathe.functions.stats import column_modes, mode_counts


def _np(vals, p):
    vals = [v for v in vals if v is not None and not (isinstance(v, float) and math.isnan(v))]
    return float(np.quantile(np.array(vals, dtype=float), p)) if vals else None


def test_matches_numpy_with_narrowing(spark):
    rnd = random.Random(7)
    vals = [float(rnd.choice([rnd.gauss(0, 1) * 1e6, rnd.randint(0, 30), 5.0])) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probs, collect_limit=50, bins=16)["x"]
    for p, g in zip(probs, got):
        assert g == pytest.approx(_np(vals, p), rel=1e-12, abs=1e-9)


def test_nulls_nan_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (3.0, None)], "x double, y double")
    got = exact_quantiles(df, ["x", "y"], [0.5])
    assert got["x"] == [2.0]
    assert got["y"] == [None]


def test_integral_and_many_columns(spark):
    df = spark.range(0, 1001).selectExpr("id", "id * 2 AS twice", "CAST(id % 7 AS INT) AS m")
    got = exact_quantiles(df, ["id", "twice", "m"], [0.25, 0.5], collect_limit=100)
    assert got["id"] == [250.0, 500.0]
    assert got["twice"] == [500.0, 1000.0]
    assert got["m"] == [_np([i % 7 for i in range(1001)], 0.25), 3.0]


def test_skewed_hot_value(spark):
    # a third of the rows hold one value
    vals = [42.0] * 400 + [float(i) for i in range(800)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, ["x"], [0.3, 0.5, 0.7], collect_limit=30, bins=8)["x"]
    assert got == pytest.approx([_np(vals, p) for p in (0.3, 0.5, 0.7)])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float)), min_size=0, max_size=60),
       st.floats(0, 1))
def test_property_any_list(spark, vals, p):
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, ["x"], [p], collect_limit=4, bins=4)["x"][0]
    want = _np(vals, p)
    assert (got is None and want is None) or got == pytest.approx(want)


def test_modes_tie_smallest(spark):
    df = spark.createDataFrame([(10, "b"), (2, "a"), (10, "a"), (2, "b"), (None, None)], "n int, s string")
    assert column_modes(df, ["n", "s"]) == {"n": "2", "s": "a"}
    assert mode_counts(df, ["n"]) == {"n": ("2", 2)}


def test_modes_all_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert column_modes(df, ["x"]) == {"x": None}


def test_infinities(spark):
    inf = float("inf")
    vals = [-inf, 1.0, 2.0, 3.0, inf, inf] + [float(i) for i in range(40)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, ["x"], probs, collect_limit=3, bins=8)["x"]
    want = [float(np.quantile(np.array(vals), p, method="linear")) if p in (0.0, 0.5, 1.0) else None for p in probs]
    assert got[0] == -inf and got[-1] == inf and got[2] == want[2]


def test_grouped_infinities(spark):
    from datalathe.functions.quantiles import grouped_quantiles

    inf = float("inf")
    rows = [("a", v) for v in [-inf, 1.0, 2.0, inf] + [float(i) for i in range(30)]]
    g = grouped_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.0, 0.5, 1.0],
                          collect_limit=3, bins=8).first()
    vals = sorted(v for _, v in rows)
    assert (g["q0"], g["q2"]) == (-inf, inf)
    assert g["q1"] == pytest.approx(float(np.median(np.array(vals))))


def test_hot_group_without_broadcast(spark, monkeypatch):
    """A third of all rows in one key, no broadcast: the join is dealt by salt as well as key, the aggregate by bracket."""
    from datalathe.functions import quantiles
    from tests.plans import plan_of

    monkeypatch.setattr(quantiles, "GROUP_BROADCAST_MAX", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS k", "CAST((id * 7919) % 4001 AS DOUBLE) AS v")
        got = quantiles.grouped_quantiles(df, ["k"], "v", [0.5, 0.9], collect_limit=100)
        plan = plan_of(got)
        assert "hashpartitioning(k#" in plan and "__salt" in plan and "BroadcastHashJoin" not in plan
        joined = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "__salt" in line]
        regrouped = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "lo#" in line and "hi#" in line]
        assert joined and regrouped
        rows = {r.k: (r.q0, r.q1) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = df.toPandas().groupby("k")["v"].quantile([0.5, 0.9]).unstack()
    assert rows == {k: (pytest.approx(a), pytest.approx(b)) for k, (a, b) in zip(want.index, want.to_numpy().tolist())}
