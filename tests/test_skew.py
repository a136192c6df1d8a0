"""One key holding a third of all rows must give whole, exact results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from datalathe.operators import cleaning, profile, query


@pytest.fixture(scope="module")
def skewed(spark):
    # key "hot" holds a third of 3,000 rows, each with a distinct value
    return spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CONCAT('k', CAST(id % 97 AS STRING)) END AS k",
        "CAST(id AS DOUBLE) * 1.5 AS v", "CAST(id % 7 AS STRING) AS s").repartition(6)


def test_grouped_median_hot_key(skewed):
    from datalathe.functions.quantiles import grouped_quantiles

    # a small bracket limit forces narrowing rounds for the hot key only
    g = grouped_quantiles(skewed, ["k"], "v", [0.5, 0.9], collect_limit=100, bins=8)
    out = {r["k"]: (r["q0"], r["q1"]) for r in g.collect()}
    hot = [i * 1.5 for i in range(3000) if i % 3 == 0]
    assert out["hot"] == pytest.approx((float(np.quantile(hot, 0.5)), float(np.quantile(hot, 0.9))))
    assert len(out) == 1 + len({i % 97 for i in range(3000) if i % 3})
    via_builder = {r["k"]: r["v"] for r in query.group_aggregate(skewed, ["k"], {"v": "median"}).collect()}
    assert via_builder["hot"] == pytest.approx(out["hot"][0])


def test_label_join_hot_value(skewed, monkeypatch):
    monkeypatch.setattr(cleaning, "DRIVER_DICTIONARY_MAX", 20)
    monkeypatch.setattr(cleaning, "BROADCAST_MAX_ROWS", 0)  # force the shuffle join
    out = cleaning.label_encode(skewed, ["k"])
    assert out.count() == 3000
    order = sorted({r["k"] for r in skewed.select("k").distinct().collect()})
    assert out.filter(F.col("k") == order.index("hot")).count() == 1000


def test_duplicates_and_top_with_hot_value(skewed):
    df = skewed.select("k")
    assert profile.duplicate_count(df) == 3000 - df.distinct().count()
    top = profile.top_categories(df, k=1).first()
    assert (top["value"], top["count"]) == ("hot", 1000)
