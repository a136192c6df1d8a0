"""Dashboard widget data over the whole table (not a 50-row preview)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalathe.functions.types import col, missing, text_form
from datalathe.operators.profile import null_counts

UNKNOWN = "Unknown"


def widget_data(df: DataFrame, x: str, y: str | None = None, aggregation: str = "count",
                chart_type: str = "bar", limit: int | None = None) -> DataFrame:
    """Rows ``(name, value)``: rows grouped by the text form of ``x``
    (missing, NaN or empty -> ``Unknown``), then ``count``, ``sum`` or a true
    ``avg`` of ``y`` (values that are not numbers, or NaN, count as 0). Sorted by
    value descending (ties by name) except line charts, which keep key
    order. ``limit`` cuts the rows after sorting (None keeps all)."""
    key = text_form(x, df.schema[x].dataType)
    key = F.when(missing(df, x) | (key == ""), F.lit(UNKNOWN)).otherwise(key)
    if aggregation == "count" or y is None:
        value = F.count(F.lit(1)).cast("double")
    else:
        v = F.coalesce(F.nanvl(col(y).try_cast("double"), F.lit(None).cast("double")), F.lit(0.0))
        if aggregation == "sum":
            value = F.sum(v)
        elif aggregation == "avg":
            value = F.avg(v)
        else:
            raise ValueError(f"unknown widget aggregation {aggregation!r}")
    g = df.groupBy(key.alias("name")).agg(value.alias("value"))
    order = [F.col("name")] if chart_type == "line" else [F.col("value").desc(), F.col("name")]
    out = g.orderBy(*order)
    return out if limit is None else out.limit(limit)


def scatter_widget(df: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    """Rows ``(x, y, z)`` as numbers; missing x/y read 0, z defaults to 1;
    rows whose x or y is not a number are dropped."""
    def num(name, default):
        # missing (null, NaN) reads as the default; text that is not a number stays null and is dropped
        return F.when(missing(df, name), F.lit(default)).otherwise(col(name).try_cast("double"))
    zz = num(z, 1.0) if z else F.lit(1.0)
    out = df.select(num(x, 0.0).alias("x"), num(y, 0.0).alias("y"), zz.alias("z"))
    return out.filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and ``100 - missing %``."""
    facts = null_counts(df)
    ncols = len(df.columns)
    agg = facts.agg(F.max("rows").alias("rows"), F.sum("missing").alias("missing_cells"))
    cells = F.col("rows") * F.lit(ncols)
    return agg.select(
        F.coalesce(F.col("rows"), F.lit(0)).alias("rows"), F.lit(ncols).alias("columns"),
        F.coalesce(F.col("missing_cells"), F.lit(0)).cast("long").alias("missing_cells"),
        F.coalesce(F.lit(100.0) - F.try_divide(F.col("missing_cells") * 100.0, cells), F.lit(100.0)).alias("complete_pct"),
    )
