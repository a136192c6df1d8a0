"""A working session over one table, as the analysed service keeps one:
load, clean and mask with undo/redo, every step snapshotted and logged, and
the reports (summary, quality, EDA, KPIs, health) on the current frame.
Only orchestration lives here; every piece of work is an operator."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from datalathe.operators import health, kpi, masking, profile
from datalathe.plans.history import StepHistory, Workspace, dataset_id_for
from datalathe.sources import files


class Workbench:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.workspace = Workspace(spark, root)
        self.history: StepHistory | None = None
        self.dataset_id: str | None = None

    # ----------------------------------------------------------------- load
    def load(self, path: str, file_type: str = "csv", name: str | None = None, **options) -> dict:
        """Load a file, register it (id = md5 of the path), snapshot it and
        start a fresh step history (stacks and step list reset)."""
        df = files.require_rows(files.load(self.spark, path, file_type, **options))
        return self.use(df, name or path, source_type=file_type, dataset_id=dataset_id_for(path))

    def use(self, df: DataFrame, name: str, source_type: str = "dataframe", dataset_id: str | None = None) -> dict:
        self.dataset_id = self.workspace.register_dataset(name, source_type, dataset_id)
        self.history = StepHistory(df, workspace=self.workspace, dataset_id=self.dataset_id)
        return self.summary()

    @property
    def df(self) -> DataFrame:
        if self.history is None:
            raise RuntimeError("No data loaded")
        return self.history.current

    # ---------------------------------------------------------------- steps
    def clean(self, operation: str, **kw) -> dict:
        self.history.clean(operation, **kw)
        return self.summary()

    def mask(self, columns, strategy: str) -> dict:
        self.history.mask(columns, strategy)
        return self.summary()

    def undo(self) -> dict:
        self.history.undo()
        return self.summary()

    def redo(self) -> dict:
        self.history.redo()
        return self.summary()

    def steps(self) -> list[str]:
        return list(self.history.steps)

    def revert(self, snapshot_path: str) -> dict:
        """Back to a snapshot: saved as a new version, stacks cleared."""
        df, _, run = self.workspace.snapshot(self.workspace.read_snapshot(snapshot_path), self.dataset_id)
        self.history = StepHistory(df, description="Reverted")
        self.history.workspace, self.history.dataset_id, self.history.last_run = self.workspace, self.dataset_id, run
        return self.summary()

    def export_csv(self, path: str) -> str:
        return files.write_csv(self.df, path)

    # -------------------------------------------------------------- reports
    def summary(self) -> dict:
        return profile.table_summary(self.df)

    def quality(self) -> dict:
        return {**profile.quality_score(self.df), "column_profile": profile.column_profile(self.df)}

    def eda(self) -> dict:
        return profile.eda(self.df)

    def kpis(self) -> DataFrame:
        return kpi.detect_kpis(self.df)

    def pii(self) -> dict:
        return masking.pii_report(self.df)

    def health(self, as_of: dt.datetime | None = None) -> DataFrame:
        """Compared with this dataset's earlier runs (the current step's run is left out)."""
        return self.workspace.check_health(self.df, self.dataset_id, as_of or dt.datetime.now(),
                                           current_run=self.history.last_run)

    def save_contract(self, contract: dict) -> None:
        self.workspace.save_contract(self.dataset_id, contract)

    def validate_contract(self) -> dict:
        contract = self.workspace.get_contract(self.dataset_id)
        if contract is None:
            raise KeyError("No contract found")
        return health.contract_status(health.contract_check(self.df, contract))

    def snapshots(self) -> DataFrame:
        return self.workspace.list_snapshots(self.dataset_id)
