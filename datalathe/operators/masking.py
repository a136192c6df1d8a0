"""Personal data: a one-pass scan for four patterns, and masking by
redaction, hashing or keeping the last four characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datalathe.functions.types import col, string_columns, text_form

# The four personal-data patterns, as the reference states them.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b(?:\+?1[-. ]?)?\(?([0-9]{3})\)?[-. ]?([0-9]{3})[-. ]?([0-9]{4})\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
}

# Necessary conditions of the patterns, checked first so the full regex only
# runs on rows that can match: every e-mail holds "@", and the SSN, phone and
# card patterns each hold three consecutive ASCII digits (Java's \d).
_NEEDS_AT = {"email"}
_DIGITS3 = "[0-9]{3}"

# Fixed value: the redaction text.
REDACTED = "*****"


def pii_scan(df: DataFrame, columns=None, *, include_zero: bool = False) -> DataFrame:
    """Rows ``(column_name, pii_type, matches)``: how many rows of each text
    column match each pattern. Every column x pattern is one ``count_if`` in
    a single aggregate, so the whole table is scanned once."""
    cols = list(columns) if columns else string_columns(df)
    spark = df.sparkSession
    schema = "column_name string, pii_type string, matches long"
    if not cols:
        return spark.createDataFrame([], schema)
    aggs, keys = [], []
    for c in cols:
        x = col(c)
        for kind, pattern in PII_PATTERNS.items():
            guard = (F.instr(x, "@") > 0) if kind in _NEEDS_AT else x.rlike(_DIGITS3)
            aggs.append(F.count_if(F.coalesce(guard & x.rlike(pattern), F.lit(False))).alias(f"m{len(keys)}"))
            keys.append((c, kind))
    counts = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("pii_type"),
                              F.col(f"m{i}").cast("long").alias("matches")) for i, (c, k) in enumerate(keys)])
    out = counts.select(F.inline(rows))
    return out if include_zero else out.filter(F.col("matches") > 0)


def pii_report(df: DataFrame, columns=None) -> dict[str, list[str]]:
    """``{column: [types]}`` like the reference's scan response."""
    report: dict[str, list[str]] = {}
    for r in pii_scan(df, columns).collect():
        report.setdefault(r["column_name"], []).append(r["pii_type"])
    return report


def mask_expr(df: DataFrame, name: str, strategy: str) -> F.Column:
    dtype = df.schema[name].dataType
    text = text_form(name, dtype)
    if strategy == "redact":
        return F.lit(REDACTED)
    if strategy == "hash":
        # empty text stays empty; null stays null (the reference hashes "nan")
        return F.when(text == "", text).otherwise(F.sha2(text, 256))
    if strategy == "partial":
        n = F.char_length(text)
        return F.when(n <= 4, text).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(text, F.lit(4))))
    raise ValueError(f"unknown mask strategy {strategy!r}")


def mask(df: DataFrame, columns, strategy: str) -> DataFrame:
    """Mask listed columns in place; unknown columns are skipped."""
    targets = {c for c in columns if c in df.columns}
    return df.select(*[mask_expr(df, c, strategy).alias(c) if c in targets else col(c) for c in df.columns])
