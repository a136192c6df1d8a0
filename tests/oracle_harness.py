"""Run each registered query on Spark and its oracle SQL on DuckDB over the
same parquet files; compare row count, column names and an
order-insensitive hash of the values (floats compared after rounding)."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys

import duckdb

import os

# STRICT=1 compares floats exactly as returned (both sides already round)
STRICT = os.environ.get("STRICT") == "1"

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        r = v if STRICT else round(v, 3)
        return str(int(r)) if r == int(r) else repr(r)
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(columns, rows) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest()


DUCK_TO_SPARK = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                 "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float", "SMALLINT": "smallint",
                 "VARCHAR[]": "array<string>", "DATE": "date"}


def duck_types(con, sql):
    rel = con.sql(sql)
    return {c: DUCK_TO_SPARK.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}


def compare(spark, name, fn, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    if sql is None:
        return {"name": name, "rows": len(s_rows), "oracle": None}
    cur = con.execute(sql)
    o_cols = [d[0] for d in cur.description]
    o_rows = cur.fetchall()
    res = {"name": name, "rows": len(s_rows), "oracle_rows": len(o_rows),
           "cols_ok": sorted(s_cols) == sorted(o_cols),
           "hash_ok": digest(s_cols, s_rows) == digest(o_cols, o_rows)}
    res["ok"] = res["cols_ok"] and res["hash_ok"] and len(s_rows) == len(o_rows)
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    o_types = duck_types(con, sql)
    bad_types = {c: (s_types[c], o_types.get(c)) for c in s_types if o_types.get(c) != s_types[c]}
    if bad_types:
        res["type_diff"] = bad_types
    if not res["cols_ok"]:
        res["spark_cols"], res["oracle_cols"] = s_cols, o_cols
    if res["cols_ok"] and not res["hash_ok"]:
        order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        o_order = sorted(range(len(o_cols)), key=lambda i: o_cols[i])
        a = sorted("|".join(_norm(r[i]) for i in order) for r in s_rows)
        b = sorted("|".join(_norm(r[i]) for i in o_order) for r in o_rows)
        res["spark_only"] = [x for x in a if x not in set(b)][:3]
        res["oracle_only"] = [x for x in b if x not in set(a)][:3]
    return res


def main(argv):
    sys.path.insert(0, "/root/repo")
    import time

    import __spark_entry__ as E
    from datalathe.session import get_spark

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = get_spark()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            res = compare(spark, name, fn, sqls.get(name), sf_dir, con)
        except Exception as e:  # report and continue
            res = {"name": name, "error": repr(e)[:600]}
        res["sec"] = round(time.time() - t, 2)
        if not res.get("ok", res.get("oracle", 1) is None and "error" not in res):
            bad += 1
        print(res, flush=True)
    print("BAD", bad)


if __name__ == "__main__":
    main(sys.argv)
