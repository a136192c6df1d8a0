"""Data contracts and health checks: volume anomalies, schema drift, freshness."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalathe.functions.fingerprint import distinct_counts
from datalathe.functions.types import col, dtype_name, is_datetime, is_integral, missing, schema_fingerprint

CONTRACT_SCHEMA = "column_name string, rule string, passed boolean, message string"
HISTORY_RUNS = 10


def contract_check(df: DataFrame, contract: dict) -> DataFrame:
    """Rows ``(column_name, rule, passed, message)`` for every rule of a
    contract ``{"columns": {name: {type, unique, nullable}}}``.

    Presence and type are schema checks on the driver. Nulls of all rules come
    from one aggregate, distinct values of all ``unique`` columns from one
    unpivot into fingerprints: ``unique`` counts nulls as values (two nulls
    break it), like pandas' ``is_unique``.
    """
    spec = contract.get("columns", {})
    results, aggs, pending = [], [], []
    for name, rules in spec.items():
        if name not in df.columns:
            results.append((name, "exists", False, f"Missing column: {name}"))
            continue
        dtype = df.schema[name].dataType
        if "type" in rules:
            want = rules["type"]
            got = dtype_name(df, name)
            if want == "int":
                ok = is_integral(dtype)
                results.append((name, "type", ok, None if ok else f"Column {name} expected int, got {got}"))
            elif want == "string":
                ok = isinstance(dtype, T.StringType)
                results.append((name, "type", ok, None if ok else f"Column {name} expected string, got {got}"))
        if rules.get("unique") is True:
            i = len(pending)
            aggs += [F.count(F.lit(1)).alias(f"r{i}"), F.count_if(missing(df, name)).alias(f"z{i}")]
            pending.append((name, "unique", i))
        if rules.get("nullable") is False:
            i = len(pending)
            aggs.append(F.count_if(missing(df, name)).alias(f"z{i}"))
            pending.append((name, "nullable", i))
    if aggs:
        r = df.agg(*aggs).first()
        distinct = distinct_counts(df, [name for name, rule, _ in pending if rule == "unique"])
        for name, rule, i in pending:
            if rule == "unique":
                ok = r[f"r{i}"] == distinct[name] + min(1, r[f"z{i}"])
                results.append((name, "unique", ok, None if ok else f"Column {name} contains duplicates"))
            else:
                ok = r[f"z{i}"] == 0
                results.append((name, "nullable", ok, None if ok else f"Column {name} contains nulls"))
    return df.sparkSession.createDataFrame(results, CONTRACT_SCHEMA)


def contract_status(results: DataFrame) -> dict:
    """``{"status": passed|failed, "violations": [...]}`` from the check rows."""
    bad = [r["message"] for r in results.filter(~F.col("passed")).collect()]
    return {"status": "passed" if not bad else "failed", "violations": bad}


def volume_status(current_rows: int, previous_counts: list[int]) -> str:
    """``anomaly`` when the count is more than 3 population std from the mean
    of earlier counts (those equal to the current one are left out),
    ``changed`` when earlier counts never varied but this one differs, else
    ``stable``."""
    prev = [c for c in previous_counts if c != current_rows]
    if not prev:
        return "stable"
    mean = sum(prev) / len(prev)
    std = math.sqrt(sum((c - mean) ** 2 for c in prev) / len(prev))
    if std > 0 and abs(current_rows - mean) > 3 * std:
        return "anomaly"
    if std == 0 and abs(current_rows - mean) > 0:
        return "changed"
    return "stable"


def drift_status(df: DataFrame, previous_hash: str | None) -> str:
    if previous_hash is None:
        return "stable"
    return "drift_detected" if previous_hash != schema_fingerprint(df) else "stable"


def date_column(df: DataFrame) -> str | None:
    """First column with ``date`` or ``time`` in its name, or of a date/time type."""
    for f in df.schema.fields:
        low = f.name.lower()
        if "date" in low or "time" in low or is_datetime(f.dataType):
            return f.name
    return None


def freshness(df: DataFrame, as_of: dt.datetime) -> dict:
    """Days since the newest value of the date column: under 1 ``fresh``,
    under 7 ``ok``, else ``stale``; no usable column ``unknown``."""
    name = date_column(df)
    out = {"column_name": name, "last_value": None, "days_since_last_entry": None, "freshness": "unknown"}
    if name is None:
        return out
    dtype = df.schema[name].dataType
    c = col(name)
    if isinstance(dtype, T.StringType):
        c = F.try_to_timestamp(c)
    elif not is_datetime(dtype):
        return out
    last = df.agg(F.max(c.cast("timestamp_ntz")).alias("m")).first()["m"]
    if last is None:
        return out
    if isinstance(last, dt.datetime) and last.tzinfo is not None:
        last = last.replace(tzinfo=None)
    if not isinstance(last, dt.datetime):
        last = dt.datetime(last.year, last.month, last.day)
    days = (as_of - last).days
    out.update(last_value=last, days_since_last_entry=days,
               freshness="fresh" if days < 1 else "ok" if days < 7 else "stale")
    return out


def freshness_report(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    f = freshness(df, as_of)
    return df.sparkSession.createDataFrame(
        [(f["column_name"], f["last_value"], f["days_since_last_entry"], f["freshness"])],
        "column_name string, last_value timestamp_ntz, days_since_last_entry int, freshness string")


def check_health(df: DataFrame, history: DataFrame | None, as_of: dt.datetime,
                 current_rows: int | None = None) -> DataFrame:
    """One row ``(volume_status, current_rows, schema_status, freshness,
    days_since_last_entry)``. ``history`` holds earlier runs
    ``(row_count, schema_hash, ts)`` of *other* run ids (the newest is the
    drift baseline); only its newest ten rows are read."""
    n = df.count() if current_rows is None else current_rows
    prev_counts, prev_hash, n_hist = [], None, 0
    if history is not None:
        recent = history.orderBy(F.col("ts").desc()).limit(HISTORY_RUNS).collect()
        n_hist = len(recent)
        prev_counts = [r["row_count"] for r in recent]
        prev_hash = recent[0]["schema_hash"] if recent else None
    volume = volume_status(n, prev_counts) if n_hist > 1 else "stable"
    fresh = freshness(df, as_of)
    return df.sparkSession.createDataFrame(
        [(volume, n, drift_status(df, prev_hash), fresh["freshness"], fresh["days_since_last_entry"])],
        "volume_status string, current_rows long, schema_status string, freshness string, days_since_last_entry int")
