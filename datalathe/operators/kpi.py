"""KPI suggestions from column names: totals, averages, top categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalathe.functions.stats import unpivot_text
from datalathe.functions.types import col, num, numeric_columns, string_columns

# Name keywords and formats, as the reference states them.
SUM_KEYWORDS = ["sales", "revenue", "profit", "amount", "cost", "price", "total"]
CURRENCY_KEYWORDS = ["price", "cost", "revenue", "sales", "profit"]
AVG_KEYWORDS = ["rating", "score", "satisfaction", "percent", "rate", "density"]
TOP_MAX_DISTINCT = 50
KPI_TARGET = 4

SCHEMA = "kpi_id string, label string, value double, text_value string, format string"


def kpi_rules(df: DataFrame) -> list[tuple[str, str, str]]:
    """``(kind, column, format)`` for numeric columns by name; driver-side."""
    rules = []
    for c in numeric_columns(df):
        low = c.lower()
        if any(k in low for k in SUM_KEYWORDS):
            fmt = "currency" if any(k in low for k in CURRENCY_KEYWORDS) else "number"
            rules.append(("sum", c, fmt))
        elif any(k in low for k in AVG_KEYWORDS):
            rules.append(("avg", c, "percent" if "percent" in low else "number"))
    return rules


def few_valued(df: DataFrame, columns, fewer_than: int | None) -> list[str]:
    """The columns that may have fewer than so many distinct values, by a HyperLogLog++ sketch of each: one narrow
    aggregate of fixed size. A sketch is off by a few percent, so twice the limit is let through; exact counts decide."""
    if fewer_than is None or not columns:
        return list(columns)
    r = df.agg(*[F.approx_count_distinct(col(c), rsd=0.05).alias(f"a{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if r[f"a{i}"] < 2 * fewer_than]


def detect_kpis(df: DataFrame, top_target: int | None = KPI_TARGET, top_max_distinct: int | None = TOP_MAX_DISTINCT,
                limit: int | None = None) -> DataFrame:
    """Rows ``(kpi_id, label, value, text_value, format)``.

    Numeric totals and averages come from one aggregate. With fewer than
    four, text columns with fewer than 50 distinct values add
    ``"value (count)"`` of their most frequent value (ties: smallest) until
    there are ``top_target``; ``limit`` cuts the list. None lifts any of the three limits. A sketch of every text
    column comes first, so that values of wide or long columns are never counted; distinct counts and modes of the
    others come from one unpivot and two partial aggregates.
    """
    spark = df.sparkSession
    rules = kpi_rules(df)
    kpis = []
    if rules:
        aggs = []
        for i, (kind, c, _fmt) in enumerate(rules):
            x = num(df, c)
            aggs.append((F.coalesce(F.sum(x), F.lit(0.0)) if kind == "sum" else F.avg(x)).alias(f"k{i}"))
        r = df.agg(*aggs).first()
        for i, (kind, c, fmt) in enumerate(rules):
            label = f"Total {c}" if kind == "sum" else f"Avg {c}"
            kpis.append((f"{kind}_{c}", label, r[f"k{i}"], None, fmt))
    if top_target is None or len(kpis) < top_target:
        texts = few_valued(df, string_columns(df), top_max_distinct)
        if texts:
            counts = unpivot_text(df, texts, with_order_key=False).groupBy("i", "s").agg(F.count("*").alias("n"))
            per = counts.groupBy("i").agg(F.count("*").alias("u"),
                                          F.min(F.struct((-F.col("n")).alias("neg"), "s")).alias("m"))
            found = {r["i"]: r for r in per.collect()}
            for i, c in enumerate(texts):
                r = found.get(i)
                if r is None or (top_max_distinct is not None and r["u"] >= top_max_distinct):
                    continue
                kpis.append((f"top_{c}", f"Top {c}", None, f"{r['m']['s']} ({-r['m']['neg']})", "text"))
                if top_target is not None and len(kpis) >= top_target:
                    break
    return spark.createDataFrame(kpis if limit is None else kpis[:limit], SCHEMA)
