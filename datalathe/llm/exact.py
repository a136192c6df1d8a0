"""Exact deduplication by a content sort, in DataFrame functions only: sampled splitters range-partition the rows, an
external sort places equal normalised texts side by side, and neighbours are compared in full."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datalathe.llm.text import shards, stored

#: Characters of a text's beginning and end that route it to its range partition.
ROUTE_CHARS = 64
#: A route with more rows than a partition's share divided by HOT_PARTS, and than HOT_LEAST, is salted. Heads of salted
#: texts up to BROADCAST_HEADS (some 60 bytes each) go to every task.
HOT_PARTS, HOT_LEAST, BROADCAST_HEADS = 4, 64, 500_000


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. In a text of one-byte characters lower() does just that, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_rows: bool = False) -> DataFrame:
    """Groups of texts that are identical after lower-casing A-Z; null counts as empty.

    Returns one row for each row: the id column, keep_id (the largest id of the group), group_size, kept (exactly one
    row of each group, also when ids are repeated or null; a null id is smaller than any other), text_sha256 (of the
    normalised text), and with ``with_rows`` the whole input row as the struct ``row``.

    Splitters sampled from routes (a text's beginning, length and end) deal the rows out; equal texts have equal routes
    and meet in one partition. There the rows are sorted by route and whole normalised text; a run of equal neighbours
    is a group, its first row by descending id is the one that stays. Whole texts move once.

    A route that holds more than a part of a partition's share of all rows is salted by id, so that one text which a third
    of all rows hold is sorted by many tasks. Such a text has a run for each salt; each run sends one head (the text's
    SHA-256, its largest id and its size), heads of one text are summed, and the sums come back to the salted rows.
    """
    n = shards(df.sparkSession)
    given = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if with_rows else F.struct(F.col(f"`{text_col}`"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), given.alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    route = {"head": lower_ascii(F.substring(text, 1, ROUTE_CHARS)), "size": F.octet_length(text),
             "tail": lower_ascii(F.right(text, F.lit(ROUTE_CHARS)))}
    # hot routes: at most HOT_PARTS for each partition, so they fit every task
    per_route = rows.select(F.xxhash64(*route.values()).alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("rows"))
    total = df.count()
    hot = per_route.where(F.col("rows") > max(HOT_LEAST, total // (n * HOT_PARTS))).select(
        "route", F.least(F.lit(n), F.ceil(F.col("rows") * n * HOT_PARTS / F.lit(max(1, total)))).cast("int").alias("salts"))
    routed = rows.select("*", *[c.alias(k) for k, c in route.items()], F.xxhash64(*route.values()).alias("route")).join(F.broadcast(hot), "route", "left")
    salt = F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("salts")))
    dealt = routed.withColumn("salt", salt.cast("int")).drop("route").repartitionByRange(n, "head", "size", "tail", "salt")
    run = Window.partitionBy("head", "size", "tail", "salt", "norm").orderBy(F.col("id").desc_nulls_last())
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sorted_ = dealt.withColumn("norm", lower_ascii(text)).select(
        "id", "salts", *(["row"] if with_rows else []), F.row_number().over(run).alias("place"), F.first("id").over(whole).alias("largest"),
        F.count(F.lit(1)).over(whole).alias("rows"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    if hot.isEmpty():
        marked = sorted_.withColumns({"keep_id": F.col("largest"), "group_size": F.col("rows")})
    else:
        heads = sorted_.where("salts is not null and place = 1").groupBy("text_sha256").agg(F.max("largest").alias("all_largest"), F.sum("rows").alias("all_rows"))
        heads = stored(heads, "exact-heads")
        side = F.broadcast(heads) if heads.count() <= BROADCAST_HEADS else heads
        joined = sorted_.join(side.withColumnRenamed("text_sha256", "of"), F.when(F.col("salts").isNotNull(), F.col("text_sha256")) == F.col("of"), "left")
        marked = joined.withColumns({"keep_id": F.when(F.col("of").isNull(), F.col("largest")).otherwise(F.col("all_largest")),
                                     "group_size": F.coalesce("all_rows", "rows")})
    return marked.select(F.col("id").alias(id_col), "keep_id", "group_size",
                         # equal ids have equal salts, so the largest id comes first in one run only
                         ((F.col("place") == 1) & F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256",
                         *(["row"] if with_rows else []))
