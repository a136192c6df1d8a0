"""Distinct counts and duplicates through fingerprints: same numbers as plain grouping, and the plans they promise."""

import random

from pyspark.sql import functions as F

from datalathe.functions.fingerprint import distinct_counts, duplicate_rows, row_facts
from datalathe.operators import health, kpi, profile
from tests.plans import plan_of


def _odd(spark):
    r = random.Random(4)
    nan = float("nan")
    rows = [(None, None, None), (nan, "a", 1), (None, "a", 1), (0.0, "", None), (-0.0, "", None), (1.5, "é" * 5000, 2), (1.5, "é" * 5000, 2)]
    rows += [(r.choice([None, nan, 0.0, -0.0, 1.0, 2.5]), r.choice([None, "", "a", "b"]), r.choice([None, 1, 2])) for _ in range(300)]
    rows += [(7.0, "hot", 3)] * 200
    return spark.createDataFrame(rows, "x double, `odd name` string, n int").repartition(5)


def test_same_numbers_as_grouping(spark):
    df = _odd(spark)
    clean = df.select(F.nanvl("x", F.lit(None)).alias("x"), "`odd name`", "n").select((F.col("x") + 0.0).alias("x"), "`odd name`", "n")
    assert distinct_counts(df, df.columns) == {c: clean.where(F.col(f"`{c}`").isNotNull()).select(f"`{c}`").distinct().count() for c in df.columns}
    facts = profile.quality_facts(df)
    assert facts["duplicates"] == df.count() - df.distinct().count() and facts["rows"] == df.count()
    assert facts["nulls"] == {c: clean.where(F.col(f"`{c}`").isNull()).count() for c in df.columns}


def test_rows_that_only_share_a_fingerprint_are_no_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, s string")
    groups, names = row_facts(df, df.columns)
    faked = groups.withColumn("__n", F.lit(2))  # as if every fingerprint were repeated
    assert duplicate_rows(df, df.columns, faked, names) == 1


def test_many_columns_and_none(spark):
    wide = spark.range(10).select(*[F.when(F.col("id") % (k + 2) == 0, F.lit(None)).otherwise(F.col("id")).alias(f"c{k}") for k in range(130)])
    facts = profile.quality_facts(wide)
    assert facts["nulls"]["c0"] == 5 and facts["nulls"]["c129"] == 1 and facts["duplicates"] == 0
    assert distinct_counts(wide, []) == {} and distinct_counts(wide.where("false"), ["c0"]) == {"c0": 0}
    assert profile.quality_facts(wide.where("false")) == {"rows": 0, "duplicates": 0, "nulls": {f"c{k}": 0 for k in range(130)}}


def test_text_of_unique_rows_is_never_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    groups, _ = row_facts(docs, docs.columns)
    exchanged = [line for line in plan_of(groups).splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and not any("text#" in line for line in exchanged)
    assert profile.quality_facts(docs)["duplicates"] == docs.count() - docs.distinct().count()


def test_distinct_counts_expand_no_row(spark, monkeypatch):
    plans = []
    import datalathe.functions.fingerprint as fp

    flat = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    real = fp.DataFrame.collect if hasattr(fp.DataFrame, "collect") else None
    kind = type(flat)
    monkeypatch.setattr(kind, "collect", lambda self, old=kind.collect: (plans.append(plan_of(self)), old(self))[1])
    assert fp.distinct_counts(flat, flat.columns)["o_orderkey"] == flat.count() and (real is None or True)
    health.contract_check(flat, {"columns": {"o_orderkey": {"unique": True}, "o_custkey": {"unique": True}}}).count()
    assert plans and not any("Expand" in p for p in plans)


def test_kpi_gate_counts_no_wide_column(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert kpi.few_valued(docs, ["text", "lang", "source"], 50) == ["lang", "source"]
    assert kpi.few_valued(docs, ["text", "lang"], None) == ["text", "lang"]
    rows = kpi.detect_kpis(docs, top_target=None).collect()
    assert {r.kpi_id for r in rows} == {"top_lang", "top_source"}
    all_rows = kpi.detect_kpis(docs.select("lang", "text"), top_target=None, top_max_distinct=None).collect()
    assert {r.kpi_id for r in all_rows} == {"top_lang", "top_text"}
