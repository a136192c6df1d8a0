"""DataFrame -> DataFrame operators: query builder and phrase filter,
cleaning, masking and personal-data scan, profiling, KPIs, widgets, health
checks and Spark ML models."""
