"""Profiling: table summary, quality score, describe, correlations,
histograms, top categories, box plots, text insights and chart suggestions.

Plans are written so that one job serves many columns: all scalar
statistics in one ``agg``; all histograms or value counts through one
unpivot and one shuffle; quality facts (rows, duplicates, nulls per column)
from one group-by over row fingerprints.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalathe.functions.fingerprint import MASK_BITS, distinct_counts, duplicate_rows, row_facts
from datalathe.functions.quantiles import exact_quantiles
from datalathe.functions.stats import agg_in_chunks, unpivot_text
from datalathe.functions.types import (
    boolean_columns,
    col,
    dtype_name,
    missing,
    row_text,
    num,
    numeric_columns,
    string_columns,
    value,
)

PREVIEW_ROWS = 50
CORR_CHUNK = 1_500
AGG_CHUNK = 1_500


def _groupable(df: DataFrame) -> list[str]:
    """Columns a row comparison can use (maps are not comparable in Spark)."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]


def null_counts(df: DataFrame) -> DataFrame:
    """Rows ``(column_name, dtype, rows, missing)``, exact at any size, one aggregate."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(missing(df, c)).alias(f"z{i}") for i, c in enumerate(cols)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(dtype_name(df, c)).alias("dtype"),
                 F.col("rows").alias("rows"), F.col(f"z{i}").cast("long").alias("missing"))
        for i, c in enumerate(cols)
    ])
    return agg.select(F.inline(rows))


def table_summary(df: DataFrame) -> dict:
    """Shape, columns, types, the first 50 rows and exact missing counts."""
    facts = null_counts(df).collect()
    n = facts[0]["rows"] if facts else df.count()
    return {
        "shape": (n, len(df.columns)),
        "columns": df.columns,
        "dtypes": {c: dtype_name(df, c) for c in df.columns},
        "preview": df.limit(PREVIEW_ROWS),
        "missing_values": {r["column_name"]: r["missing"] for r in facts},
    }


def quality_facts(df: DataFrame) -> dict:
    """Rows, duplicate rows and nulls per column from one pass over fingerprints.

    Rows are grouped by a 128-bit fingerprint and the bits of their nulls (map-side combined, so a row repeated in a
    third of the table collapses before the shuffle). The group counts give the row count and, weighting each group by
    its size, the nulls of every column. Only where a fingerprint is repeated are the rows read again and compared in
    full; unique rows never leave their task.
    """
    cols = df.columns
    keys = _groupable(df)
    if not cols:
        return {"rows": df.count(), "duplicates": 0, "nulls": {}}
    grouped, masks = row_facts(df, keys)
    aggs = [F.sum("__n").alias("rows"), F.count_if(F.col("__n") > 1).alias("repeated")]
    aggs += [F.sum(F.when(F.col(masks[i // MASK_BITS]).bitwiseAND(F.lit(1 << i % MASK_BITS)) != 0, F.col("__n")).otherwise(0)).alias(f"z{i}")
             for i in range(len(keys))]
    r = grouped.agg(*aggs).first()
    nulls = {c: int(r[f"z{i}"] or 0) for i, c in enumerate(keys)}
    duplicates = duplicate_rows(df, keys, grouped, masks) if r["repeated"] else 0
    extra = [c for c in cols if c not in keys]
    if extra:
        z = df.agg(*[F.count_if(missing(df, c)).alias(f"e{i}") for i, c in enumerate(extra)]).first()
        nulls.update({c: int(z[f"e{i}"]) for i, c in enumerate(extra)})
    return {"rows": int(r["rows"] or 0), "duplicates": duplicates, "nulls": {c: nulls[c] for c in cols}}


def duplicate_count(df: DataFrame) -> int:
    return quality_facts(df)["duplicates"]


def quality_score(df: DataFrame) -> dict:
    """``0.4 (100 - missing cells %) + 0.3 (100 - duplicate rows %) +
    0.3 (complete columns %)``, rounded to one decimal; parts 0 when empty."""
    facts = quality_facts(df)
    rows, ncols = facts["rows"], len(df.columns)
    cells = rows * ncols
    missing = sum(facts["nulls"].values())
    dups = facts["duplicates"]
    missing_score = 100 - missing / cells * 100 if cells else 0
    dup_score = 100 - dups / rows * 100 if rows else 0
    complete = sum(1 for v in facts["nulls"].values() if v == 0)
    completeness = complete / ncols * 100 if ncols else 0
    score = missing_score * 0.4 + dup_score * 0.3 + completeness * 0.3
    return {
        "score": round(score, 1),
        "missing_cells_pct": round(missing / cells * 100, 1) if cells else 0,
        "duplicate_rows_pct": round(dups / rows * 100, 1) if rows else 0,
        "complete_columns_pct": round(completeness, 1),
        "rows": rows,
        "duplicates": dups,
        "missing_cells": missing,
    }


def quality_report(df: DataFrame) -> DataFrame:
    """The quality score as a one-row DataFrame."""
    q = quality_score(df)
    schema = ("score double, missing_cells_pct double, duplicate_rows_pct double, complete_columns_pct double, "
              "rows long, duplicates long, missing_cells long")
    return df.sparkSession.createDataFrame(
        [(float(q["score"]), float(q["missing_cells_pct"]), float(q["duplicate_rows_pct"]),
          float(q["complete_columns_pct"]), q["rows"], q["duplicates"], q["missing_cells"])], schema)


def column_profile(df: DataFrame, *, approx_distinct: bool = False) -> DataFrame:
    """Rows ``(column_name, missing, missing_pct, unique, dtype)``; ``unique`` skips null. Distinct values of all columns
    are counted from one unpivot into fingerprints (no row is expanded with its other columns); ``approx_distinct`` uses
    HyperLogLog++ (fixed memory, no shuffle of values)."""
    cols = [c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]
    spark = df.sparkSession
    schema = "column_name string, missing long, missing_pct double, unique long, dtype string"
    base = [F.count(F.lit(1)).alias("rows"), *[F.count_if(missing(df, c)).alias(f"z{i}") for i, c in enumerate(cols)]]
    if approx_distinct:
        r = agg_in_chunks(df, base + [F.approx_count_distinct(value(df, c)).alias(f"u{i}") for i, c in enumerate(cols)], AGG_CHUNK)
        unique = [r[f"u{i}"] for i in range(len(cols))]
    else:
        r = agg_in_chunks(df, base, AGG_CHUNK)
        unique = list(distinct_counts(df, cols).values())
    rows = r["rows"]
    out = [(c, int(r[f"z{i}"]), (r[f"z{i}"] * 100.0 / rows) if rows else 0.0, int(unique[i]), dtype_name(df, c))
           for i, c in enumerate(cols)]
    return spark.createDataFrame(out, schema)


def describe(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """One row per column. Numbers: count, mean, sample std, min, quartiles,
    max. Text: count, unique, top (ties: smallest), freq."""
    nums = numeric_columns(df)
    texts = string_columns(df) + boolean_columns(df)  # booleans describe like categories, as in pandas
    spark = df.sparkSession
    schema = ("column_name string, count long, mean double, std double, min double, p25 double, p50 double, "
              "p75 double, max double, unique long, top string, freq long")
    if not nums and not texts:
        return spark.createDataFrame([], schema)
    aggs = []
    for i, c in enumerate(nums):
        x = num(df, c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    for j, c in enumerate(texts):
        aggs += [F.count(col(c)).alias(f"tn{j}")]
    r = agg_in_chunks(df, aggs, AGG_CHUNK)
    known = {c: (r[f"n{i}"], r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(nums)}
    quart = exact_quantiles(df, nums, [0.25, 0.5, 0.75], approx=approx, known=known) if nums else {}
    tops = _value_counts_summary(df, texts) if texts else {}
    out = []
    for i, c in enumerate(nums):
        q = quart[c]
        out.append((c, r[f"n{i}"], r[f"m{i}"], r[f"s{i}"], r[f"a{i}"], q[0], q[1], q[2], r[f"b{i}"], None, None, None))
    for j, c in enumerate(texts):
        u, top, freq = tops.get(c, (0, None, None))
        out.append((c, r[f"tn{j}"], None, None, None, None, None, None, None, u, top, freq))
    return spark.createDataFrame(out, schema)


def _value_counts_summary(df: DataFrame, columns) -> dict:
    """``{col: (distinct, top, freq)}`` for text columns: one unpivot, counts
    per (column, value), then per column the distinct count and the most
    frequent value (ties: smallest) as partial aggregates."""
    counts = unpivot_text(df, columns, with_order_key=False).groupBy("i", "s").agg(F.count("*").alias("n"))
    per = counts.groupBy("i").agg(F.count("*").alias("u"), F.min(F.struct((-F.col("n")).alias("neg"), "s")).alias("m"))
    out = {}
    for r in per.collect():
        out[columns[r["i"]]] = (r["u"], r["m"]["s"], -r["m"]["neg"])
    return out


def correlation(df: DataFrame, columns=None) -> DataFrame:
    """Pearson correlation of every ordered pair of numeric columns
    (diagonal included) over pairwise complete rows; null where a side is
    constant.

    Two aggregates of plain sums: the first finds each column's count and
    mean; the second sums products of mean-centred values (centring keeps
    the one-pass formula as accurate as a two-pass one). Sums have one
    buffer field each, so the aggregate stays in whole-stage codegen where
    ``covar_pop``/``stddev_pop`` pairs would not. Pairs with a nullable
    side mask both sides to the rows where both are present.
    """
    cols = list(columns) if columns else numeric_columns(df)
    spark = df.sparkSession
    schema = "x string, y string, value double"
    if not cols:
        return spark.createDataFrame([], schema)
    k = len(cols)
    x = [num(df, c) for c in cols]
    first = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(v).alias(f"n{i}") for i, v in enumerate(x)],
                   *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)]).first()
    rows = first["rows"]
    mean = [first[f"m{i}"] or 0.0 for i in range(k)]
    full = [first[f"n{i}"] == rows for i in range(k)]
    d = [v - F.lit(mean[i]) for i, v in enumerate(x)]
    aggs = []
    for i in range(k):
        aggs += [F.sum(d[i]).alias(f"s{i}"), F.sum(d[i] * d[i]).alias(f"q{i}")]
    for i in range(k):
        for j in range(i + 1, k):
            if full[i] and full[j]:
                aggs.append(F.sum(d[i] * d[j]).alias(f"p{i}_{j}"))
            else:
                both = x[i].isNotNull() & x[j].isNotNull()
                aggs += [F.sum(F.when(both, d[i] * d[j])).alias(f"p{i}_{j}"),
                         F.count_if(both).alias(f"c{i}_{j}"),
                         F.sum(F.when(both, d[i])).alias(f"a{i}_{j}"), F.sum(F.when(both, d[j])).alias(f"b{i}_{j}"),
                         F.sum(F.when(both, d[i] * d[i])).alias(f"aa{i}_{j}"),
                         F.sum(F.when(both, d[j] * d[j])).alias(f"bb{i}_{j}")]
    # wide tables: the pair sums grow as k^2, so they run in chunks of a
    # bounded number of expressions (exact, one scan per chunk)
    r = agg_in_chunks(df, aggs, CORR_CHUNK)

    def pearson(n, sx, sy, sxx, syy, sxy):
        if not n:
            return None
        sx, sy, sxx, syy, sxy = (v or 0.0 for v in (sx, sy, sxx, syy, sxy))
        cov = sxy / n - (sx / n) * (sy / n)
        vx = sxx / n - (sx / n) ** 2
        vy = syy / n - (sy / n) ** 2
        if vx <= 0 or vy <= 0:
            return None
        return max(-1.0, min(1.0, cov / (vx ** 0.5 * vy ** 0.5)))

    value = {}
    for i in range(k):
        value[(i, i)] = pearson(first[f"n{i}"], r[f"s{i}"], r[f"s{i}"], r[f"q{i}"], r[f"q{i}"], r[f"q{i}"])
        for j in range(i + 1, k):
            if full[i] and full[j]:
                value[(i, j)] = pearson(rows, r[f"s{i}"], r[f"s{j}"], r[f"q{i}"], r[f"q{j}"], r[f"p{i}_{j}"])
            else:
                value[(i, j)] = pearson(r[f"c{i}_{j}"], r[f"a{i}_{j}"], r[f"b{i}_{j}"], r[f"aa{i}_{j}"],
                                        r[f"bb{i}_{j}"], r[f"p{i}_{j}"])
    out = [(a, b, value[(min(i, j), max(i, j))]) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return spark.createDataFrame(out, schema)


def histogram_edges(lo: float, hi: float, bins: int = 10) -> list[float]:
    """Bin edges exactly as ``numpy.histogram`` builds them (equal bounds widen by 0.5)."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return [float(e) for e in np.linspace(lo, hi, bins + 1, endpoint=True)]


def histogram(df: DataFrame, columns=None, bins: int = 10) -> DataFrame:
    """Rows ``(column_name, bin, range, count)``: ``bins`` equal bins over
    min..max of every numeric column, last bin closed, nulls dropped, empty
    bins listed. Labels are ``"%.2f-%.2f"`` of the edges.

    One aggregate finds the bounds; one unpivot + group-by counts every
    column's bins in a single shuffle of at most columns x bins groups.
    """
    cols = list(columns) if columns else numeric_columns(df)
    spark = df.sparkSession
    schema = "column_name string, bin int, range string, count long"
    if not cols:
        return spark.createDataFrame([], schema)
    r = agg_in_chunks(df, [F.min(num(df, c)).alias(f"a{i}") for i, c in enumerate(cols)]
                      + [F.max(num(df, c)).alias(f"b{i}") for i, c in enumerate(cols)], AGG_CHUNK)
    grid, items = [], []
    for i, c in enumerate(cols):
        lo, hi = r[f"a{i}"], r[f"b{i}"]
        if lo is None or not (math.isfinite(lo) and math.isfinite(hi)):
            continue  # no values, or a range numpy cannot bin: the column is skipped
        edges = histogram_edges(lo, hi, bins)
        for b in range(bins):
            grid.append((i, c, b, f"{edges[b]:.2f}-{edges[b + 1]:.2f}"))
        x = num(df, c)
        first, last = edges[0], edges[-1]
        norm = bins / (last - first)
        idx = F.least(F.floor((x - F.lit(first)) * F.lit(norm)).cast("int"), F.lit(bins - 1))
        e = F.array(*[F.lit(v) for v in edges])
        # the same two corrections numpy applies after the arithmetic guess
        idx = F.when(x < F.element_at(e, idx + 1), idx - 1).otherwise(idx)
        idx = F.when((x >= F.element_at(e, idx + 2)) & (idx != bins - 1), idx + 1).otherwise(idx)
        items.append(F.when(x.isNotNull(), F.struct(F.lit(i).alias("i"), idx.alias("b"))))
    if not grid:
        return spark.createDataFrame([], schema)
    tagged = df.select(F.explode(F.array(*items)).alias("t")).where(F.col("t").isNotNull()).select("t.*")
    counts = tagged.groupBy("i", "b").agg(F.count("*").alias("n"))
    frame = spark.createDataFrame(grid, "i int, column_name string, bin int, range string")
    # counts holds at most columns x bins rows: a proven bound for broadcast
    out = frame.join(F.broadcast(counts), (frame.i == counts.i) & (frame.bin == counts.b), "left")
    return out.select("column_name", "bin", "range", F.coalesce(counts.n, F.lit(0)).cast("long").alias("count"))


def top_categories(df: DataFrame, columns=None, k: int = 10) -> DataFrame:
    """Rows ``(column_name, value, count, rank)``: the ``k`` most frequent
    values of every text column, nulls dropped, ties by value.

    Counts per (column, value) are map-side combined; the per-column top-k
    is a ``row_number`` filter that Spark turns into a partial
    WindowGroupLimit before the shuffle, so at most k rows per column and
    partition move."""
    cols = list(columns) if columns else string_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, value string, count long, rank int")
    counts = unpivot_text(df, cols, with_order_key=False).groupBy("i", "s").agg(F.count("*").alias("n"))
    w = Window.partitionBy("i").orderBy(F.col("n").desc(), F.col("s").asc())
    ranked = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    names = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("i") + 1)
    return ranked.select(names.alias("column_name"), F.col("s").alias("value"), F.col("n").alias("count"), "rank")


def boxplot(df: DataFrame, columns=None, *, approx: bool = False) -> DataFrame:
    """Rows ``(column_name, min, q1, median, q3, max, outliers)`` per numeric
    column; ``outliers`` counts values outside the 1.5 IQR whiskers."""
    cols = list(columns) if columns else numeric_columns(df)
    spark = df.sparkSession
    schema = "column_name string, min double, q1 double, median double, q3 double, max double, outliers long"
    if not cols:
        return spark.createDataFrame([], schema)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], approx=approx)
    live = [c for c in cols if q[c][0] is not None]
    aggs = []
    for i, c in enumerate(live):
        x = num(df, c)
        q1, _, q3 = q[c]
        iqr = q3 - q1
        aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"),
                 F.count_if((x < F.lit(q1 - 1.5 * iqr)) | (x > F.lit(q3 + 1.5 * iqr))).alias(f"o{i}")]
    r = agg_in_chunks(df, aggs, AGG_CHUNK) if aggs else None
    rows = [(c, r[f"a{i}"], q[c][0], q[c][1], q[c][2], r[f"b{i}"], r[f"o{i}"]) for i, c in enumerate(live)]
    return spark.createDataFrame(rows, schema)


def sample_rows(df: DataFrame, n: int, seed: int = 42, columns=None) -> DataFrame:
    """A repeatable sample of ``n`` rows: the ``n`` smallest row hashes
    (TakeOrderedAndProject keeps n rows per partition, never more)."""
    cols = list(columns) if columns else df.columns
    base = df.select(*[col(c) for c in cols])
    return base.orderBy(F.md5(row_text(cols, seed).cast("binary"))).limit(n)


def group_mean(df: DataFrame, key: str, val: str, groups: int | None = None) -> DataFrame:
    """Mean of ``value`` by ``key``, sorted by mean descending; the ``groups`` highest (None: all). Rows ``(name, value)``; NaN keys are
    missing and dropped."""
    g = (df.filter(~missing(df, key)).groupBy(value(df, key).alias("k"))
         .agg(F.avg(num(df, val)).alias("value")))
    ranked = g.orderBy(F.col("value").desc(), F.col("k"))
    ranked = ranked if groups is None else ranked.limit(groups)
    return ranked.select(F.col("k").cast("string").alias("name"), "value")


def group_mean_chart(df: DataFrame) -> DataFrame:
    """Average of the first numeric column by the first text column."""
    nums, texts = numeric_columns(df), string_columns(df)
    if not nums or not texts:
        return df.sparkSession.createDataFrame([], "name string, value double")
    return group_mean(df, texts[0], nums[0])


def insights(df: DataFrame) -> DataFrame:
    """Plain sentences about shape, missing values, duplicates, types,
    |z| > 3 counts (sample std) and columns
    with |r| > 0.8 against an earlier column. Rows ``(idx, insight)``."""
    facts = quality_facts(df)
    rows, ncols = facts["rows"], len(df.columns)
    nums, texts = numeric_columns(df), string_columns(df)
    lines = [f"The dataset contains {rows} rows and {ncols} columns."]
    missing = [c for c in df.columns if facts["nulls"].get(c, 0) > 0]
    if missing:
        lines.append(f"Found missing values in {len(missing)} columns: " + ", ".join(missing) + ".")
    else:
        lines.append("No missing values found in the dataset.")
    if facts["duplicates"] > 0:
        lines.append(f"Identified {facts['duplicates']} duplicate rows.")
    lines.append(f"Columns breakdown: {len(nums)} numerical, {len(texts)} categorical.")
    notes = [f"{c} ({n})" for c, n in zscore_outliers(df, nums) if n > 0]
    if notes:
        lines.append(f"Potential outliers detected in: {', '.join(notes)}.")
    if len(nums) > 1:
        high = high_correlation_columns(df, nums)
        if high:
            lines.append(f"High correlation detected in columns: {', '.join(high)}.")
    return df.sparkSession.createDataFrame(list(enumerate(lines)), "idx int, insight string")


def zscore_outliers(df: DataFrame, columns) -> list[tuple[str, int]]:
    """``(column, rows with |x - mean| / std > 3)``; columns with at most one
    distinct value or zero spread are skipped. Two small aggregates."""
    cols = list(columns)
    if not cols:
        return []
    r = df.agg(*[F.avg(num(df, c)).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.stddev_samp(num(df, c)).alias(f"s{i}") for i, c in enumerate(cols)],
               *[F.min(num(df, c)).alias(f"a{i}") for i, c in enumerate(cols)],
               *[F.max(num(df, c)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    live = [(i, c) for i, c in enumerate(cols)
            if r[f"a{i}"] is not None and r[f"a{i}"] != r[f"b{i}"] and r[f"s{i}"]]
    if not live:
        return []
    z = df.agg(*[F.count_if(F.abs((num(df, c) - F.lit(r[f"m{i}"])) / F.lit(r[f"s{i}"])) > 3).alias(f"o{i}")
                 for i, c in live]).first()
    return [(c, int(z[f"o{i}"])) for i, c in live]


def high_correlation_columns(df: DataFrame, columns, threshold: float = 0.8) -> list[str]:
    """Columns whose |r| with some *earlier* column exceeds ``threshold``."""
    corr = {(r["x"], r["y"]): r["value"] for r in correlation(df, columns).collect()}
    out = []
    for j, b in enumerate(columns):
        if any(corr.get((a, b)) is not None and abs(corr[(a, b)]) > threshold for a in columns[:j]):
            out.append(b)
    return out


def recommend_charts(df: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Chart suggestions ``(chart_id, kind, title, chart_type, x, y, description)``
    and the data of each as its own DataFrame: a histogram of the first
    numeric column, top 10 of the first text column, a 200-row sample of the
    first two numeric columns, and the group mean."""
    nums, texts = numeric_columns(df), string_columns(df)
    recs, data = [], {}
    if nums:
        c = nums[0]
        recs.append(("rec_dist", "distribution", f"Distribution of {c}", "bar", "range", "count",
                     f"See the spread of values for {c}"))
        data["rec_dist"] = histogram(df, [c]).select("range", "count")
    if texts:
        c = texts[0]
        recs.append(("rec_cat", "categorical", f"Top Categories in {c}", "bar", "name", "count",
                     f"Frequency of top categories in {c}"))
        data["rec_cat"] = top_categories(df, [c]).select(F.col("value").alias("name"), "count")
    if len(nums) >= 2:
        a, b = nums[0], nums[1]
        recs.append(("rec_corr", "correlation", f"{a} vs {b}", "scatter", a, b,
                     f"Correlation relationship between {a} and {b}"))
        data["rec_corr"] = sample_rows(df, 200, columns=[a, b])
    if texts and nums:
        k, v = texts[0], nums[0]
        recs.append(("rec_comp", "comparison", f"Average {v} by {k}", "bar", "name", "value",
                     f"Compare average {v} across top {k} groups"))
        data["rec_comp"] = group_mean(df, k, v)
    schema = "chart_id string, kind string, title string, chart_type string, x string, y string, description string"
    return df.sparkSession.createDataFrame(recs, schema), data


def recommendation_rows(df: DataFrame) -> DataFrame:
    """The suggested charts' data in long form: rows ``(chart_id, title,
    label, value)`` of the histogram, the top categories, the scatter sample
    (label x, value y) and the group means."""
    recs, data = recommend_charts(df)
    parts = []
    if "rec_dist" in data:
        parts.append(data["rec_dist"].select(F.lit("rec_dist").alias("chart_id"), F.col("range").alias("label"),
                                             F.col("count").cast("double").alias("value")))
    if "rec_cat" in data:
        parts.append(data["rec_cat"].select(F.lit("rec_cat").alias("chart_id"), F.col("name").alias("label"),
                                            F.col("count").cast("double").alias("value")))
    if "rec_corr" in data:
        x, y = data["rec_corr"].columns
        parts.append(data["rec_corr"].select(F.lit("rec_corr").alias("chart_id"), col(x).cast("string").alias("label"),
                                             col(y).cast("double").alias("value")))
    if "rec_comp" in data:
        parts.append(data["rec_comp"].select(F.lit("rec_comp").alias("chart_id"), F.col("name").alias("label"),
                                             F.col("value").cast("double").alias("value")))
    if not parts:
        return df.sparkSession.createDataFrame([], "chart_id string, title string, label string, value double")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # the suggestion table has at most four rows
    titles = F.broadcast(recs.select("chart_id", "title"))
    return rows.join(titles, "chart_id").select("chart_id", "title", "label", "value")


def eda(df: DataFrame, *, scatter_rows: int = 500, approx: bool = False) -> dict[str, DataFrame]:
    """The full exploratory report as DataFrames: ``description``,
    ``correlation``, ``distributions`` (histograms), ``categorical_counts``
    (top 10), ``scatter_data`` (a repeatable 500-row sample of the numeric
    columns) and ``box_plot_data``. Each part is its own small plan; the
    caller decides what to materialise."""
    nums = numeric_columns(df)
    out = {
        "description": describe(df, approx=approx),
        "correlation": correlation(df),
        "distributions": histogram(df),
        "categorical_counts": top_categories(df),
        "box_plot_data": boxplot(df, approx=approx),
    }
    if len(nums) >= 2:
        out["scatter_data"] = sample_rows(df, scatter_rows, columns=nums)
    return out
