"""Column-level helpers shared by every operator: type families, NaN rules,
exact distributed quantiles, modes and safe statistics."""

from datalathe.functions.quantiles import exact_quantiles
from datalathe.functions.stats import column_modes, safe_corr
from datalathe.functions.types import (
    col,
    nan_to_null,
    numeric_columns,
    schema_fingerprint,
    string_columns,
)

__all__ = [
    "col",
    "column_modes",
    "exact_quantiles",
    "nan_to_null",
    "numeric_columns",
    "safe_corr",
    "schema_fingerprint",
    "string_columns",
]
