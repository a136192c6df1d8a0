"""Safe statistics: correlation that never divides by zero under ANSI mode,
column modes with a fixed tie rule, and unpivot helpers that let one shuffle
serve many columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from datalathe.functions.types import col, is_numeric, missing, text_form


def pair_complete(x: Column, y: Column) -> tuple[Column, Column]:
    """Both sides restricted to rows where both are present."""
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over pairwise complete rows; null when a side is
    constant. ``F.corr`` raises DIVIDE_BY_ZERO there in ANSI mode and a
    ``when`` guard around it does not stop that, so the ratio is built from
    ``covar_pop`` and ``stddev_pop`` with ``try_divide``."""
    xx, yy = pair_complete(x, y)
    return F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))


def unpivot_text(df: DataFrame, columns, *, with_order_key: bool = True) -> DataFrame:
    """Rows ``(i, s[, k])`` for every non-null cell of ``columns``: ``i`` the
    column index, ``s`` the value as text, ``k`` a double order key for
    numeric columns (null otherwise). One generator, one pass."""
    items = []
    for i, name in enumerate(columns):
        dtype = df.schema[name].dataType
        s = text_form(name, dtype) if isinstance(dtype, T.BooleanType) else col(name).cast("string")
        fields = [F.lit(i).alias("i"), s.alias("s")]
        if with_order_key:
            k = col(name).cast("double") if is_numeric(dtype) else F.lit(None).cast("double")
            fields.append(k.alias("k"))
        items.append(F.when(~missing(df, name), F.struct(*fields)))  # NaN is missing, as in pandas
    # explode then drop nulls (a lambda filter would leave whole-stage codegen)
    return df.select(F.explode(F.array(*items)).alias("t")).where(F.col("t").isNotNull()).select("t.*")


def column_modes(df: DataFrame, columns) -> dict[str, str | None]:
    """Most frequent non-null value of each column, as text; ties go to the
    smallest value (numbers by number order, text by byte order). Columns
    without values give ``None``.

    Two map-side-combined aggregates: counts per (column, value), then a
    ``min(struct(-count, key, text))`` per column, so no group of values is
    ever gathered in one task (``F.mode`` keeps a full value map per group).
    """
    cols = list(columns)
    if not cols:
        return {}
    counts = unpivot_text(df, cols).groupBy("i", "s", "k").agg(F.count("*").alias("n"))
    best = counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("neg"), "k", "s")).alias("m"))
    out: dict[str, str | None] = {c: None for c in cols}
    for r in best.collect():
        out[cols[r["i"]]] = r["m"]["s"]
    return out


def mode_counts(df: DataFrame, columns) -> dict[str, tuple[str, int] | None]:
    """Like :func:`column_modes` but also returns the count of the mode."""
    cols = list(columns)
    if not cols:
        return {}
    counts = unpivot_text(df, cols).groupBy("i", "s", "k").agg(F.count("*").alias("n"))
    best = counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("neg"), "k", "s")).alias("m"))
    out: dict[str, tuple[str, int] | None] = {c: None for c in cols}
    for r in best.collect():
        out[cols[r["i"]]] = (r["m"]["s"], -r["m"]["neg"])
    return out


def agg_in_chunks(df: DataFrame, exprs, size: int) -> dict:
    """Run a long list of aliased aggregates ``size`` at a time (one scan per
    chunk) and merge the single result rows: bounded plan and buffer size for
    wide tables, same values."""
    out: dict = {}
    exprs = list(exprs)
    for start in range(0, len(exprs), size):
        out.update(df.agg(*exprs[start:start + size]).first().asDict())
    return out
