"""Results must not depend on how the input is partitioned."""

import pytest

from datalathe.functions.quantiles import exact_quantiles
from datalathe.operators import cleaning, kpi, profile


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("op", [
    lambda d: profile.histogram(d),
    lambda d: profile.top_categories(d),
    lambda d: profile.boxplot(d),
    lambda d: profile.quality_report(d),
    lambda d: cleaning.label_encode(d, ["event_type"]),
    lambda d: cleaning.remove_outliers(d, ["value", "user_id"]),
    lambda d: kpi.detect_kpis(d),
])
def test_same_result_for_1_and_7_partitions(events, op):
    assert _rows(op(events.coalesce(1))) == _rows(op(events.repartition(7)))


def test_quantiles_partition_free(events):
    a = exact_quantiles(events.coalesce(1), ["value"], [0.1, 0.5, 0.9], collect_limit=10)
    b = exact_quantiles(events.repartition(5), ["value"], [0.1, 0.5, 0.9], collect_limit=10)
    assert a == b
