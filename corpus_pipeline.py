"""A training-data pipeline over ``documents``: quality rules, exact and near deduplication, removal of personal data,
packing into token windows. Each stage works on the whole table that the one before it kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datalathe.llm.exact import exact_groups
from datalathe.llm.near import near_groups
from datalathe.llm.packing import pack
from datalathe.llm.pii import find_personal, redacted
from datalathe.llm.quality import quality_rules
from datalathe.llm.text import forget, gathered, stored


#: Tables that earlier stages stored on their way. A stage's rows are written before the next one begins, so these are
#: removed then, unless the next stage's documents read them.
_left: list[DataFrame] = []


def stage(function: Callable[..., DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes what the stages before it no longer need."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        folder = lambda t: t.stored_at.split(":")[-1].lstrip("/")  # noqa: E731  files are named with another scheme prefix
        done = [t for t in _left if t.sparkSession is spark and not any(folder(t) in f for f in read)]
        forget(*done)
        _left[:] = [t for t in _left if t.sparkSession is spark and t not in done]
        with gathered() as tables:
            out = function(spark, docs, sf_dir)
        _left.extend(tables)
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules(docs, with_rows=True).where("kept").select("row.*")


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id."""
    return exact_groups(docs, with_rows=True).where("kept").select("row.*")


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id (five-word shingles, similarity 0.8).

    Rows are told apart by a stored number behind the id, as ids may be repeated or null; null ids come last."""
    number = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.monotonically_increasing_id().alias("place"))
    rows = stored(docs.select(number.alias("number"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "near-rows")
    groups = near_groups(rows.select("number", "row.text"), shingle=5, percent=80, id_col="number")
    # the places of dropped rows are the short list
    return rows.join(groups.where("not kept").select("number.place"), F.col("number.place") == F.col("place"), "left_anti").select("row.*")


@stage
def remove_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the kind in brackets, n_chars counted anew."""
    found = find_personal(docs, with_rows=True).withColumn("clean", redacted(F.col("row.text"), "found"))
    new = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast("bigint")}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, with their ids."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("remove_personal", remove_personal), ("packing", packing)]

#: Tokens have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
