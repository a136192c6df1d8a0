"""Sources and sinks: CSV (delimiter and encoding detection), Parquet, JSON
records, CSV export, and JDBC / MongoDB / Snowflake / BigQuery readers behind
a read-only guard."""
