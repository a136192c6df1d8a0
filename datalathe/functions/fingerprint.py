"""Fingerprints: 128-bit hashes that stand for values or whole rows, so that counting distinct values and finding
repeated rows shuffles sixteen bytes instead of the text itself.

A fingerprint is two 64-bit hashes with different seeds. Numbers of eight bytes keep their identity under either alone;
for longer values two different ones agree with a chance of 2^-128, and :func:`duplicate_rows` compares the rows behind
repeated fingerprints in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalathe.functions.types import col, is_fractional, missing, value

SEEDS = (0x5EED, 0xFACE)
#: Repeated fingerprints up to this many rows (16 bytes each) go to every task.
BROADCAST_ROWS = 1_000_000
#: Null flags in one long.
MASK_BITS = 62


def comparable(df: DataFrame, name: str) -> Column:
    """The value with NaN as null and without negative zero, as grouping sees it."""
    x = value(df, name)
    return x + F.lit(0.0).cast(df.schema[name].dataType) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else x


def value_fingerprint(df: DataFrame, name: str) -> tuple[Column, Column]:
    return tuple(F.xxhash64(F.lit(seed), comparable(df, name)) for seed in SEEDS)


def null_masks(df: DataFrame, columns) -> list[Column]:
    """Longs whose bits say which of ``columns`` are missing in a row."""
    columns = list(columns)
    masks = []
    for start in range(0, len(columns), MASK_BITS):
        mask = F.lit(0).cast("bigint")
        for k, c in enumerate(columns[start:start + MASK_BITS]):
            mask = mask.bitwiseOR(F.when(missing(df, c), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
        masks.append(mask)
    return masks


def distinct_counts(df: DataFrame, columns) -> dict[str, int]:
    """Distinct non-missing values of each column, exact up to the fingerprint, from one pass.

    Cells become rows (column number, fingerprint), which collapse before the shuffle and are counted by column after
    it. No row is expanded with its other columns, and a long text moves as sixteen bytes.
    """
    columns = [c for c in columns]
    out = dict.fromkeys(columns, 0)
    if not columns:
        return out
    cells = []
    for i, c in enumerate(columns):
        one, two = value_fingerprint(df, c)
        cells.append(F.when(~missing(df, c), F.struct(F.lit(i).alias("i"), one.alias("one"), two.alias("two"))))
    flat = df.select(F.explode(F.array(*cells)).alias("c")).where(F.col("c").isNotNull()).select("c.*")
    counts = flat.groupBy("i", "one", "two").agg(F.lit(1).alias("_")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    for r in counts.collect():
        out[columns[r["i"]]] = r["n"]
    return out


def row_facts(df: DataFrame, columns) -> tuple[DataFrame, list[str]]:
    """``(fingerprinted groups, mask names)``: one row for each distinct fingerprint of ``columns`` with its null masks
    and the number ``__n`` of rows that have it."""
    columns = list(columns)
    masks = null_masks(df, columns)
    names = [f"__m{i}" for i in range(len(masks))]
    values = [comparable(df, c) for c in columns]
    prints = df.select(*[F.xxhash64(F.lit(seed), *values).alias(f"__h{i}") for i, seed in enumerate(SEEDS)],
                       *[m.alias(n) for m, n in zip(masks, names)])
    return prints.groupBy("__h0", "__h1", *names).agg(F.count(F.lit(1)).alias("__n")), names


def duplicate_rows(df: DataFrame, columns, groups: DataFrame, names: list[str]) -> int:
    """Rows beyond the first of each set of equal rows. Only rows whose fingerprint is repeated are read again, and
    compared column by column."""
    columns = list(columns)
    repeated = groups.where("__n > 1").select("__h0", "__h1", *names)
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    values = [comparable(df, c) for c in columns]
    tagged = df.select(*[col(c) for c in columns], *[F.xxhash64(F.lit(seed), *values).alias(f"__h{i}") for i, seed in enumerate(SEEDS)],
                       *[m.alias(n) for m, n in zip(null_masks(df, columns), names)])
    again = tagged.join(repeated, ["__h0", "__h1", *names], "left_semi").groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("__n"))
    return int(again.agg(F.sum(F.col("__n") - 1)).first()[0] or 0)
