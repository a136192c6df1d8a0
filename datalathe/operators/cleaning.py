"""Cleaning steps: missing values, duplicates, column edits, IQR outliers,
label / one-hot encoding and scaling.

Statistics that feed a transform (fill values, bounds, scales) are computed
as a handful of rows and applied as literals, so the transform itself is a
narrow projection that pipelines into the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalathe.functions.quantiles import exact_quantiles
from datalathe.functions.stats import agg_in_chunks, column_modes
from datalathe.functions.types import (
    col,
    is_float,
    is_integral,
    is_numeric,
    known_columns,
    missing,
    num,
    numeric_columns,
    require_columns,
    text_form,
    value,
)
from datalathe.session import ensure_checkpoint_dir

# Dictionaries up to this many values are read to the driver and numbered there; larger ones are numbered where they are.
DRIVER_DICTIONARY_MAX = 5_000
# Dictionaries are broadcast as hash tables, and only below these checked bounds.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 256 * 1024 * 1024
ONE_HOT_MAX = 1_000


def drop_missing(df: DataFrame, columns=None) -> DataFrame:
    """Drop rows with a null in any column (or in ``columns``)."""
    if columns:
        require_columns(df, columns)
        return df.dropna(how="any", subset=list(columns))
    return df.dropna(how="any")


def drop_duplicates(df: DataFrame, subset=None) -> DataFrame:
    """Distinct rows (nulls compare equal); map-side combined before the shuffle."""
    if subset:
        require_columns(df, subset)
        return df.dropDuplicates(list(subset))
    return df.dropDuplicates()


def drop_columns(df: DataFrame, columns) -> DataFrame:
    require_columns(df, columns)
    return df.drop(*[col(c) for c in columns])


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    """``{old: new}``; unknown old names are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def _value_for(dtype: T.DataType, value) -> F.Column:
    """The fill value converted to ``dtype``; null when it does not convert.
    Integral columns go through double, since ``try_cast('1.0' AS INT)`` is null."""
    lit = F.lit(None if value is None else str(value))
    if is_integral(dtype):
        d = lit.try_cast("double")
        return F.when(d == F.floor(d), d.try_cast(dtype))
    if isinstance(dtype, T.StringType):
        return lit
    return lit.try_cast(dtype)


def fill_value(df: DataFrame, fill, columns=None) -> DataFrame:
    """Fill nulls (and NaN) with ``fill`` in every column (or ``columns``), each
    converted to the column's type; where it does not convert, the column is
    left as is."""
    targets = set(known_columns(df, columns) if columns else df.columns)
    exprs = []
    for f in df.schema.fields:
        if f.name in targets and not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            exprs.append(F.coalesce(value(df, f.name), _value_for(f.dataType, fill)).alias(f.name))
        else:
            exprs.append(col(f.name))
    return df.select(*exprs)


def fill_strategy(df: DataFrame, strategy: str, columns=None, *, approx: bool = False) -> DataFrame:
    """Fill nulls with each column's mean, median or mode.

    ``mean``/``median`` touch numeric columns; an integral column that holds
    nulls becomes double (as pandas turns it into float). ``mode`` touches
    every column, ties go to the smallest value, all-null columns stay.
    """
    if strategy == "mode":
        targets = known_columns(df, columns) if columns else [
            f.name for f in df.schema.fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        ]
        # only a column that holds nulls needs its mode: one narrow count before any value is counted
        holes = agg_in_chunks(df, [F.count_if(missing(df, c)).alias(f"z{i}") for i, c in enumerate(targets)], 1_500) if targets else {}
        modes = column_modes(df, [c for i, c in enumerate(targets) if holes[f"z{i}"]])
        exprs = []
        for f in df.schema.fields:
            m = modes.get(f.name)
            if m is None:
                exprs.append(col(f.name))
            else:
                exprs.append(F.coalesce(value(df, f.name), F.lit(m).cast(f.dataType)).alias(f.name))
        return df.select(*exprs)

    if strategy not in ("mean", "median"):
        raise ValueError(f"unknown fill strategy {strategy!r}")
    nums = [c for c in (known_columns(df, columns) if columns else numeric_columns(df)) if is_numeric(df.schema[c].dataType)]
    if not nums:
        return df
    aggs = [F.count_if(missing(df, c)).alias(f"z{i}") for i, c in enumerate(nums)]
    if strategy == "mean":
        aggs += [F.avg(value(df, c)).alias(f"m{i}") for i, c in enumerate(nums)]
    row = df.agg(*aggs).first()
    with_nulls = [c for i, c in enumerate(nums) if row[f"z{i}"]]
    if strategy == "mean":
        fills = {c: row[f"m{nums.index(c)}"] for c in with_nulls}
    else:
        med = exact_quantiles(df, with_nulls, [0.5], approx=approx)
        fills = {c: med[c][0] for c in with_nulls}
    exprs = []
    for f in df.schema.fields:
        v = fills.get(f.name)
        if f.name in fills and v is not None:
            base = num(df, f.name) if is_integral(f.dataType) else value(df, f.name)
            exprs.append(F.coalesce(base, F.lit(v).cast(base_type(f.dataType))).alias(f.name))
        else:
            exprs.append(col(f.name))
    return df.select(*exprs)


def base_type(dtype: T.DataType) -> T.DataType:
    return T.DoubleType() if is_integral(dtype) else dtype


def remove_outliers(df: DataFrame, columns, *, approx: bool = False) -> DataFrame:
    """IQR rule per listed numeric column, one after the other: quartiles are
    taken from the rows still left, rows outside ``[Q1-1.5 IQR, Q3+1.5 IQR]``
    go, nulls stay. Text columns are skipped."""
    out = df
    for c in columns or []:
        if c not in out.columns or not is_numeric(out.schema[c].dataType):
            continue
        q1, q3 = exact_quantiles(out, [c], [0.25, 0.75], approx=approx)[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
        x = col(c)  # the raw column keeps the range filter pushable
        keep = x.isNull() | ~((x < F.lit(lo)) | (x > F.lit(hi)))
        if is_float(out.schema[c].dataType):
            keep = keep | F.isnan(x)  # NaN is missing: kept, like null
        out = out.filter(keep)
    return out


def _label_key(df: DataFrame, name: str) -> F.Column:
    """Text form of the value; null is class ``"nan"``."""
    return F.coalesce(text_form(name, df.schema[name].dataType), F.lit("nan"))


def label_dictionary(df: DataFrame, name: str) -> DataFrame | dict:
    """Codes 0..k-1 for the distinct text forms of ``name`` in text order.

    Small dictionaries come back as a Python dict. Large ones are built distributed: a global sort (range partitioned), an
    id that is consecutive inside each partition, a reliable checkpoint so
    both uses see the same partitions, then per-partition offsets (one row
    per partition) turn ids into dense codes. No step gathers the values.
    """
    key = _label_key(df, name)
    distinct = df.select(key.alias("s")).distinct()
    head = [r["s"] for r in distinct.orderBy("s").limit(DRIVER_DICTIONARY_MAX + 1).collect()]
    if len(head) <= DRIVER_DICTIONARY_MAX:
        return {s: i for i, s in enumerate(head)}
    ensure_checkpoint_dir(df.sparkSession)
    ordered = (
        distinct.orderBy("s")
        .select("s", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("mid"))
        .checkpoint(eager=True)
    )
    parts = ordered.groupBy("pid").agg(F.count("*").alias("n"), F.min("mid").alias("m0")).orderBy("pid").collect()
    offsets, acc = [], 0
    for r in parts:
        offsets.append((r["pid"], acc, r["m0"]))
        acc += r["n"]
    spark = df.sparkSession
    off = spark.createDataFrame(offsets, "pid int, base long, m0 long")
    return ordered.join(F.broadcast(off), "pid").select(
        "s", (F.col("mid") - F.col("m0") + F.col("base")).alias("code")
    )


def _apply_dictionary(df: DataFrame, name: str, dictionary, out_type: str = "int") -> DataFrame:
    key = _label_key(df, name)
    if isinstance(dictionary, dict):
        dictionary = df.sparkSession.createDataFrame(list(dictionary.items()), "s string, code long")
    # a hash join whatever the number of codes: broadcast only under checked
    # bounds, else a shuffle join (AQE splits a hot key's partition)
    size = dictionary.agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("b")).first()
    side = dictionary.withColumnRenamed("s", "__key").withColumnRenamed("code", "__code")
    if size["n"] <= BROADCAST_MAX_ROWS and (size["b"] or 0) + 16 * size["n"] <= BROADCAST_MAX_BYTES:
        side = F.broadcast(side)
    cols = df.columns
    joined = df.withColumn("__key", key).join(side, "__key", "left")
    return joined.select(*[F.col("__code").cast(out_type).alias(c) if c == name else col(c) for c in cols])


def label_encode(df: DataFrame, columns) -> DataFrame:
    """Replace each column by codes 0..k-1 of its text form in text order
    (so ``"10"`` < ``"2"``); null is the class ``"nan"``."""
    out = df
    for c in columns or []:
        if c not in out.columns:
            continue
        out = _apply_dictionary(out, c, label_dictionary(out, c))
    return out


def one_hot(df: DataFrame, columns, *, max_values: int | None = ONE_HOT_MAX) -> DataFrame:
    """``{col}_{value}`` boolean columns, sorted by value, appended at the
    end; the source column goes; null gives all false. More than
    ``max_values`` distinct values is an error, not a silent cap (None: no limit)."""
    out = df
    for c in columns or []:
        if c not in out.columns:
            continue
        dtype = out.schema[c].dataType
        distinct = (
            out.where(~missing(out, c)).select(col(c).alias("v"), text_form(c, dtype).alias("t"))
            .groupBy("v", "t").agg(F.lit(1).alias("_")).orderBy("v")
        )
        vals = (distinct if max_values is None else distinct.limit(max_values + 1)).collect()
        if max_values is not None and len(vals) > max_values:
            raise ValueError(f"one-hot of {c!r}: more than {max_values} distinct values")
        keep = [col(x) for x in out.columns if x != c]
        dummies = [F.coalesce(col(c) == F.lit(r["v"]).cast(dtype), F.lit(False)).alias(f"{c}_{r['t']}") for r in vals]
        out = out.select(*keep, *dummies)
    return out


def minmax_scale(df: DataFrame, columns) -> DataFrame:
    """``(x - min) / (max - min)``; zero range gives 0; nulls stay null."""
    cols = [c for c in known_columns(df, columns) if is_numeric(df.schema[c].dataType)]
    if not cols:
        return df
    row = df.agg(*[F.min(num(df, c)).alias(f"a{i}") for i, c in enumerate(cols)],
                 *[F.max(num(df, c)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    scaled = {}
    for i, c in enumerate(cols):
        lo, hi = row[f"a{i}"], row[f"b{i}"]
        x = num(df, c)
        if lo is None:
            scaled[c] = x
        elif hi == lo:
            scaled[c] = F.when(x.isNotNull(), F.lit(0.0))
        else:
            scaled[c] = (x - F.lit(lo)) / F.lit(hi - lo)
    return df.select(*[scaled[c].alias(c) if c in scaled else col(c) for c in df.columns])


def standard_scale(df: DataFrame, columns) -> DataFrame:
    """``(x - mean) / population std``; zero std gives 0; nulls stay null."""
    cols = [c for c in known_columns(df, columns) if is_numeric(df.schema[c].dataType)]
    if not cols:
        return df
    row = df.agg(*[F.avg(num(df, c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(num(df, c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    scaled = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        x = num(df, c)
        if m is None:
            scaled[c] = x
        elif not s:
            scaled[c] = F.when(x.isNotNull(), F.lit(0.0))
        else:
            scaled[c] = (x - F.lit(m)) / F.lit(s)
    return df.select(*[scaled[c].alias(c) if c in scaled else col(c) for c in df.columns])


# The step descriptions written into the step list.
STEP_TEXT = {
    "dropna": "Dropped Missing Values",
    "drop_duplicates": "Dropped Duplicates",
    "remove_outliers": "Removed Outliers",
}


def clean(df: DataFrame, operation: str, columns=None, value=None, strategy=None, rename_map=None, max_values: int | None = ONE_HOT_MAX):
    """One cleaning request as the reference's ``/clean`` takes it; returns
    ``(frame, description)``. ``max_values``: the most columns that one-hot
    encoding may make of one (None: any number)."""
    if operation == "dropna":
        return drop_missing(df, columns), STEP_TEXT["dropna"]
    if operation == "fillna":
        out = fill_value(df, value, columns) if value is not None else fill_strategy(df, strategy, columns)
        return out, f"Filled Missing Values ({value or strategy})"
    if operation == "drop_duplicates":
        return drop_duplicates(df), STEP_TEXT["drop_duplicates"]
    if operation == "drop_columns":
        return (drop_columns(df, columns) if columns else df), f"Dropped Columns: {list(columns or [])}"
    if operation == "rename_columns":
        return (rename_columns(df, rename_map) if rename_map else df), "Performed rename_columns"
    if operation == "remove_outliers":
        return remove_outliers(df, columns), STEP_TEXT["remove_outliers"]
    if operation == "encode_columns":
        if strategy == "label":
            out = label_encode(df, columns)
        elif strategy == "onehot":
            out = one_hot(df, columns, max_values=max_values)
        else:
            out = df
        return out, f"Encoded Columns ({strategy})"
    if operation == "normalize":
        if strategy == "minmax":
            out = minmax_scale(df, columns)
        elif strategy == "standard":
            out = standard_scale(df, columns)
        else:
            out = df
        return out, f"Normalized Columns ({strategy})"
    raise ValueError(f"unknown cleaning operation {operation!r}")
