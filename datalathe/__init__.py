"""datalathe: data profiling, cleaning and analysis operators on Spark DataFrames.

Every operator takes a DataFrame and returns a DataFrame (or a handful of
aggregated rows), so Catalyst plans the work and the executors run it.
"""

from datalathe.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
