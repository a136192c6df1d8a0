"""Database and warehouse sources: JDBC (PostgreSQL, Redshift), MongoDB,
Snowflake and BigQuery through their Spark connectors, behind one
read-only guard.

Connector jars are not bundled; each reader only names the format and
options, so it runs wherever the cluster provides the connector.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Statement words the read-only guard refuses.
FORBIDDEN_WORDS = ["INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE"]
_FORBIDDEN = re.compile(r"\b(?:" + "|".join(FORBIDDEN_WORDS) + r")\b", re.IGNORECASE)


def read_only_guard(query: str) -> str:
    """Refuse text holding a writing statement word (matched as a word, so
    a column named ``created_at`` passes)."""
    if not query or not query.strip():
        raise ValueError("Query is required for SQL databases")
    if _FORBIDDEN.search(query):
        raise PermissionError("Only SELECT queries are allowed (Read-only mode)")
    return query


def read_jdbc(spark: SparkSession, url: str, query: str, *, user: str | None = None, password: str | None = None,
              driver: str | None = None, partition_column: str | None = None, lower_bound=None, upper_bound=None,
              num_partitions: int | None = None, fetch_size: int = 10_000) -> DataFrame:
    """Run a SELECT over JDBC. With ``partition_column`` and bounds the read
    is split into ``num_partitions`` parallel range queries (the query is
    wrapped as a subquery, since Spark cannot partition ``query=``)."""
    read_only_guard(query)
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    for k, v in (("user", user), ("password", password), ("driver", driver)):
        if v is not None:
            reader = reader.option(k, v)
    if partition_column:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partitioned JDBC reads need lower_bound, upper_bound and num_partitions")
        reader = (reader.option("dbtable", f"({query}) AS q").option("partitionColumn", partition_column)
                  .option("lowerBound", lower_bound).option("upperBound", upper_bound)
                  .option("numPartitions", num_partitions))
    else:
        reader = reader.option("query", query)
    return reader.load()


def read_mongodb(spark: SparkSession, uri: str, collection: str, *, database: str | None = None,
                 limit: int | None = None) -> DataFrame:
    """A MongoDB collection (needs the MongoDB Spark connector), ``_id`` dropped."""
    if not collection:
        raise ValueError("Collection is required for MongoDB")
    reader = spark.read.format("mongodb").option("connection.uri", uri).option("collection", collection)
    if database:
        reader = reader.option("database", database)
    df = reader.load()
    if limit is not None:
        df = df.limit(limit)
    return df.drop("_id") if "_id" in df.columns else df


def read_snowflake(spark: SparkSession, query: str, *, options: dict) -> DataFrame:
    """Run a SELECT on Snowflake (needs the Snowflake Spark connector); the
    query is pushed to Snowflake whole."""
    read_only_guard(query)
    return spark.read.format("snowflake").options(**options).option("query", query).load()


def read_bigquery(spark: SparkSession, query: str, *, project: str | None = None,
                  materialization_dataset: str | None = None, options: dict | None = None) -> DataFrame:
    """Run a SELECT on BigQuery (needs the BigQuery Spark connector)."""
    read_only_guard(query)
    reader = spark.read.format("bigquery").options(**(options or {})).option("viewsEnabled", "true")
    if project:
        reader = reader.option("parentProject", project)
    if materialization_dataset:
        reader = reader.option("materializationDataset", materialization_dataset)
    return reader.option("query", query).load()


def connect(spark: SparkSession, db_type: str, **kw) -> DataFrame:
    """One entry point by source type, as the reference's connect call."""
    if db_type in ("postgresql", "redshift"):
        if not kw.get("url"):
            raise ValueError("Connection string is required")
        return read_jdbc(spark, kw.pop("url"), kw.pop("query", ""), **kw)
    if db_type == "mongodb":
        return read_mongodb(spark, kw.pop("uri"), kw.pop("collection", None), **kw)
    if db_type == "snowflake":
        return read_snowflake(spark, kw.pop("query", ""), options=kw.get("options", {}))
    if db_type == "bigquery":
        return read_bigquery(spark, kw.pop("query", ""), **kw)
    raise ValueError(f"Unsupported database type {db_type!r}")
