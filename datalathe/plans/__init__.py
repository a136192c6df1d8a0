"""Multi-step plans over one table: Parquet snapshots and the run log,
registries (datasets, contracts, features), diff/revert, a step history with
undo/redo, and the Workbench session that ties them together."""
