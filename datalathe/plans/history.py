"""Versioned Parquet snapshots, a run log, small metadata registries, and a
step history with undo/redo.

Everything lives under one shared ``root`` folder (HDFS, S3, ABFS or a
local path in tests). Metadata tables are append-only Parquet folders;
readers take the newest record per key, so no transaction layer is needed
with one writer. Appends leave one small file each; :meth:`Workspace.compact`
writes a table's rows as the next version and drops the one before, so that
one version is live at any time. Snapshots double as lineage cuts: after a step is
snapshotted, the step history continues from the Parquet read back, so a
long chain of steps never grows one huge plan.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import itertools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException, ParseException

from datalathe.functions.fingerprint import SEEDS, comparable, null_masks
from datalathe.functions.types import col, require_columns, schema_fingerprint
from datalathe.operators import cleaning, masking

SCHEMAS = {
    "datasets": "dataset_id string, name string, source_type string, created_at timestamp_ntz, seq long",
    "runs": ("run_id string, dataset_id string, row_count long, col_count int, schema_hash string, "
             "columns_json string, ts timestamp_ntz, seq long, snapshot_path string"),
    "contracts": "dataset_id string, contract_json string, updated_at timestamp_ntz, seq long",
    "features": "feature_id string, name string, description string, created_at timestamp_ntz, seq long",
    "feature_versions": "feature_id string, version string, logic_code string, created_at timestamp_ntz, seq long",
}
HISTORY_LIMIT = 10
SNAPSHOT_LIST_LIMIT = 50
_SEQ = itertools.count()


def dataset_id_for(name: str) -> str:
    """Dataset ids are the md5 of the path or name."""
    return hashlib.md5(name.encode()).hexdigest()


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _seq() -> int:
    # time-ordered sequence: microseconds since epoch plus a process counter
    return int(_now().timestamp() * 1_000_000) * 1000 + next(_SEQ) % 1000


def newest(df: DataFrame, key: str) -> DataFrame:
    """Newest record per key (partial aggregate on ``max(struct(seq, row))``)."""
    others = [c for c in df.columns if c not in (key, "seq")]
    best = df.groupBy(key).agg(F.max(F.struct("seq", *others)).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in others], F.col("__r.seq").alias("seq"))


class Workspace:
    """Snapshots and metadata tables under one shared folder.

    ``compact_after``: an append to a metadata table that finds more files than this compacts it (None: never by itself).
    """

    def __init__(self, spark: SparkSession, root: str, compact_after: int | None = 500):
        self.spark = spark
        self.root = root.rstrip("/")
        self.compact_after = compact_after

    # ---------------------------------------------------------------- tables
    def _files(self, folder: str) -> list[tuple[str, bool]]:
        """``(name, is folder)`` of what lies in a folder, by the session's own file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _version(self, table: str) -> int:
        """The live version of a table: the last one whose rewrite was finished; 0 before any compaction."""
        folder = f"{self.root}/meta-versions/{table}"
        found = [int(name) for name, is_folder in self._files(folder) if is_folder and name.isdigit()]
        return max((v for v in found if ("_SUCCESS", False) in self._files(f"{folder}/{v}")), default=0)

    def _path(self, table: str, version: int | None = None) -> str:
        version = self._version(table) if version is None else version
        return f"{self.root}/meta-versions/{table}/{version}" if version else f"{self.root}/meta/{table}"

    def file_count(self, table: str) -> int:
        """Data files of a table's live version."""
        return sum(not is_folder and not name.startswith(("_", ".")) for name, is_folder in self._files(self._path(table)))

    def compact(self, table: str) -> int:
        """Rewrite a metadata table as one file and return its new version. The rewrite lies beside the live version and
        takes its place with the marker that Spark writes last; a rewrite cut short is never read. The version before
        stays until the next compaction, for readers that have begun with it."""
        old = self._version(table)
        leftovers = [int(n) for n, is_folder in self._files(f"{self.root}/meta-versions/{table}") if is_folder and n.isdigit()]
        new = max([old, *leftovers]) + 1
        self.table(table).coalesce(1).write.parquet(self._path(table, new))
        for v in {0, *leftovers} - {old, new}:
            self._delete(self._path(table, v) if v else f"{self.root}/meta/{table}")
        return new

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMAS[name]).parquet(self._path(name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # a table that is there but cannot be read is no empty table
                raise
            return self.spark.createDataFrame([], SCHEMAS[name])

    def _append(self, name: str, rows: list[tuple]) -> None:
        self._write(name, self.spark.createDataFrame(rows, SCHEMAS[name]))

    def _write(self, name: str, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(self._path(name))
        if self.compact_after is not None and self.file_count(name) > self.compact_after:
            self.compact(name)

    # -------------------------------------------------------------- datasets
    def register_dataset(self, name: str, source_type: str, dataset_id: str | None = None) -> str:
        """Insert a dataset record unless its id is already there."""
        did = dataset_id or dataset_id_for(name)
        new = self.spark.createDataFrame([(did, name, source_type, _now(), _seq())], SCHEMAS["datasets"])
        fresh = new.join(self.table("datasets").select("dataset_id"), "dataset_id", "left_anti")
        if not fresh.isEmpty():
            self._write("datasets", fresh)
        return did

    def datasets(self) -> DataFrame:
        return newest(self.table("datasets"), "dataset_id")

    # ------------------------------------------------------------- snapshots
    def save_snapshot(self, df: DataFrame, dataset_id: str) -> str:
        # the row count is read back from the written files (an Observation on
        # the write would save that job, but once used it leaves the session's
        # ML models unserialisable in Spark 4.1)
        stamp = _now().strftime("%Y%m%d_%H%M%S_%f")
        path = f"{self.root}/snapshots/{dataset_id}/{stamp}_{uuid.uuid4().hex[:8]}"
        df.write.mode("errorifexists").parquet(path)
        return path

    def read_snapshot(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def log_run(self, dataset_id: str, df: DataFrame, snapshot_path: str | None = None,
                row_count: int | None = None) -> str:
        """Append one run record; the row count of a snapshot comes from
        reading it back (Parquet footers), else from counting ``df``."""
        if row_count is None:
            row_count = (self.read_snapshot(snapshot_path) if snapshot_path else df).count()
        run_id = uuid.uuid4().hex
        self._append("runs", [(run_id, dataset_id, int(row_count), len(df.columns), schema_fingerprint(df),
                               json.dumps(df.columns), _now(), _seq(), snapshot_path)])
        return run_id

    def run_history(self, dataset_id: str, limit: int | None = HISTORY_LIMIT,
                    exclude_run: str | None = None) -> DataFrame:
        runs = self.table("runs").filter(F.col("dataset_id") == dataset_id)
        if exclude_run:
            runs = runs.filter(F.col("run_id") != exclude_run)
        runs = runs.orderBy(F.col("seq").desc())
        return runs.limit(limit) if limit else runs

    def list_snapshots(self, dataset_id: str, limit: int | None = SNAPSHOT_LIST_LIMIT) -> DataFrame:
        """The newest snapshots first; ``limit=None`` lists all of them."""
        runs = (self.run_history(dataset_id, limit=None).filter(F.col("snapshot_path").isNotNull())
                .select("row_count", "col_count", "ts", "snapshot_path", "seq"))
        return runs if limit is None else runs.limit(limit)

    def snapshot(self, df: DataFrame, dataset_id: str) -> tuple[DataFrame, str, str]:
        """Write a snapshot, log its run, and return the frame read back
        (a lineage cut), the path and the run id."""
        path = self.save_snapshot(df, dataset_id)
        back = self.read_snapshot(path)
        run = self.log_run(dataset_id, back, path)
        return back, path, run

    def revert(self, snapshot_path: str, dataset_id: str) -> tuple[DataFrame, str]:
        """Read a snapshot and save it as a new version with one run record."""
        df = self.read_snapshot(snapshot_path)
        back, path, _ = self.snapshot(df, dataset_id)
        return back, path

    def diff(self, path_a: str, path_b: str, *, values: bool = False) -> DataFrame:
        """Schema and row-count difference of two snapshots (row counts come
        from the Parquet footers)."""
        return diff_frames(self.read_snapshot(path_a), self.read_snapshot(path_b), values=values)

    def diff_rows(self, path_a: str, path_b: str, keys, *, columns: bool = False) -> DataFrame:
        """Rows added, removed and changed between two stored snapshots, told apart by ``keys``."""
        diff = diff_columns if columns else diff_keyed
        return diff(self.read_snapshot(path_a), self.read_snapshot(path_b), keys)

    def check_health(self, df: DataFrame, dataset_id: str, as_of: dt.datetime,
                     current_run: str | None = None) -> DataFrame:
        """Volume, drift and freshness of ``df`` against this dataset's newest
        runs, leaving out ``current_run`` (the run logged for ``df`` itself)."""
        from datalathe.operators.health import check_health

        history = self.run_history(dataset_id, limit=None, exclude_run=current_run)
        return check_health(df, history, as_of)

    # ------------------------------------------------------------- contracts
    def save_contract(self, dataset_id: str, contract: dict) -> None:
        self._append("contracts", [(dataset_id, json.dumps(contract), _now(), _seq())])

    def get_contract(self, dataset_id: str) -> dict | None:
        rows = newest(self.table("contracts").filter(F.col("dataset_id") == dataset_id), "dataset_id").collect()
        return json.loads(rows[0]["contract_json"]) if rows else None

    # -------------------------------------------------------------- features
    def register_feature(self, name: str, description: str, version: str, logic_code: str) -> str:
        """A named feature with many versions; the code is a Spark SQL
        expression, checked by parsing it before it is stored."""
        check_expression(self.spark, logic_code)
        fid = dataset_id_for("feature:" + name)
        known = self.table("features").filter(F.col("feature_id") == fid).limit(1).count()
        if not known:
            self._append("features", [(fid, name, description, _now(), _seq())])
        self._append("feature_versions", [(fid, str(version), logic_code, _now(), _seq())])
        return fid

    def list_features(self) -> DataFrame:
        """Every feature with every version, newest version first per name."""
        feats = newest(self.table("features"), "feature_id")
        vers = self.table("feature_versions")
        return (feats.join(vers, "feature_id", "inner")
                .select("name", "description", "version", F.col("logic_code").alias("logic"),
                        vers["created_at"].alias("created_at"), vers["seq"].alias("seq"))
                .orderBy("name", F.col("seq").desc()))

    def feature_code(self, name: str, version: str | None = None) -> str:
        rows = self.list_features().filter(F.col("name") == name)
        if version is not None:
            rows = rows.filter(F.col("version") == str(version))
        got = rows.limit(1).collect()
        if not got:
            raise KeyError(f"feature {name!r} version {version!r} not found")
        return got[0]["logic"]

    def apply_feature(self, df: DataFrame, name: str, version: str | None = None) -> DataFrame:
        return apply_expression(df, name, self.feature_code(name, version))


def check_expression(spark: SparkSession, code: str) -> None:
    """Raise ``ParseException`` on text that is not a Spark SQL expression;
    unknown column names are fine (they belong to the table it is applied to)."""
    try:
        spark.range(0).select(F.expr(code)).schema
    except ParseException:
        raise
    except AnalysisException:
        pass


def apply_expression(df: DataFrame, name: str, code: str) -> DataFrame:
    """Add (or replace) column ``name`` computed by a Spark SQL expression."""
    return df.withColumn(name, F.expr(code))


def diff_frames(df_a: DataFrame, df_b: DataFrame, *, values: bool = False) -> DataFrame:
    """One row: columns added and removed from ``a`` to ``b``, the row-count
    change and a sentence. ``values=True`` adds rows only in ``a`` / only in
    ``b`` (``exceptAll`` both ways on the shared columns: a shuffle of both)."""
    added = sorted(set(df_b.columns) - set(df_a.columns))
    removed = sorted(set(df_a.columns) - set(df_b.columns))
    rows_diff = df_b.count() - df_a.count()
    summary = f"Row change: {rows_diff}. Cols added: {len(added)}, removed: {len(removed)}"
    rec = [added, removed, rows_diff, summary]
    schema = "added_columns array<string>, removed_columns array<string>, rows_diff long, summary string"
    if values:
        shared = [c for c in df_a.columns if c in set(df_b.columns)]
        a, b = df_a.select(*shared), df_b.select(*shared)
        rec += [a.exceptAll(b).count(), b.exceptAll(a).count()]
        schema += ", only_in_a long, only_in_b long"
    return df_a.sparkSession.createDataFrame([tuple(rec)], schema)


def _both_sides(df_a: DataFrame, df_b: DataFrame, keys, groups: dict[str, list[str]]) -> DataFrame:
    """One row per key of either side: rows ``n0``, ``n1`` and the sums of fingerprints of each group of columns. Sums
    make repeated keys compare as bags of rows, and let both sides collapse before the one shuffle, which moves keys and
    fingerprints only."""
    keys = list(keys)
    parts = []
    for side, df in enumerate((df_a, df_b)):
        prints = []
        for g, columns in enumerate(groups.values()):
            seeds = [F.xxhash64(F.lit(seed), *null_masks(df, columns), *[comparable(df, c) for c in columns]) for seed in SEEDS]
            prints += [h.cast("decimal(38,0)").alias(f"h{g}_{i}") for i, h in enumerate(seeds)]
        parts.append(df.select(*[col(k) for k in keys], *prints, *[F.lit(int(s == side)).cast("bigint").alias(f"n{s}") for s in (0, 1)]))
    both = parts[0].unionByName(parts[1])
    sums = [F.sum(F.col(f"h{g}_{i}") * F.col(f"n{s}")).alias(f"s{s}_{g}_{i}") for g in range(len(groups)) for i in range(len(SEEDS)) for s in (0, 1)]
    return both.groupBy(*[col(k) for k in keys]).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *sums)


def _differs(g: int):
    out = F.lit(False)
    for i in range(len(SEEDS)):
        out = out | (F.col(f"s0_{g}_{i}") != F.col(f"s1_{g}_{i}"))
    return out


def diff_keyed(df_a: DataFrame, df_b: DataFrame, keys) -> DataFrame:
    """One row ``(added, removed, changed, unchanged, repeated_keys)``: keys of ``b`` only, of ``a`` only, of both with
    other values in the shared columns or another number of rows, and the rest; keys that occur twice on a side are also
    counted as repeated. Null is a key like others. Rows are compared by 128-bit fingerprints."""
    require_columns(df_a, keys)
    require_columns(df_b, keys)
    shared = [c for c in df_a.columns if c in df_b.columns and c not in keys]
    both = _both_sides(df_a, df_b, keys, {"row": shared})
    n0, n1 = F.col("n0"), F.col("n1")
    same = ~_differs(0) & (n0 == n1)
    held = (n0 > 0) & (n1 > 0)
    return both.agg(F.count_if(n0 == 0).alias("added"), F.count_if(n1 == 0).alias("removed"), F.count_if(held & ~same).alias("changed"),
                    F.count_if(held & same).alias("unchanged"), F.count_if(F.greatest(n0, n1) > 1).alias("repeated_keys"))


def diff_columns(df_a: DataFrame, df_b: DataFrame, keys) -> DataFrame:
    """Rows ``(column_name, changed)``: of the keys on both sides, how many hold other values in each shared column."""
    require_columns(df_a, keys)
    require_columns(df_b, keys)
    shared = [c for c in df_a.columns if c in df_b.columns and c not in keys]
    if not shared:
        return df_a.sparkSession.createDataFrame([], "column_name string, changed long")
    both = _both_sides(df_a, df_b, keys, {c: [c] for c in shared}).where("n0 > 0 and n1 > 0")
    counts = both.agg(*[F.count_if(_differs(g) | (F.col("n0") != F.col("n1"))).alias(f"c{g}") for g in range(len(shared))])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{g}").alias("changed")) for g, c in enumerate(shared)])))


class StepHistory:
    """The working table, its steps and undo/redo.

    Each step is a function ``DataFrame -> DataFrame``; a step is recorded
    only after its frame is built (a failing step leaves no trace). With a
    workspace every step is snapshotted and the history continues from the
    Parquet read back.
    """

    def __init__(self, df: DataFrame, *, workspace: Workspace | None = None, dataset_id: str | None = None,
                 description: str = "Loaded Data"):
        self.workspace = workspace
        self.dataset_id = dataset_id
        self.current = df
        # each entry keeps its frame's run id, so that drift never compares a frame with its own run
        self.undo_stack: list[tuple[DataFrame, str | None]] = []
        self.redo_stack: list[tuple[DataFrame, str | None, str, Callable | None]] = []
        self.steps: list[str] = [description]
        self.transforms: list[Callable[[DataFrame], DataFrame]] = []
        self.last_run: str | None = None
        if workspace is not None and dataset_id is not None:
            self.current, _, self.last_run = workspace.snapshot(df, dataset_id)

    def apply(self, fn: Callable[[DataFrame], DataFrame], description: str) -> DataFrame:
        return self._record(fn(self.current), description, fn)

    def clean(self, operation: str, **kw) -> DataFrame:
        """One cleaning request; its description comes from the operator."""
        new, desc = cleaning.clean(self.current, operation, **kw)
        return self._record(new, desc, lambda df: cleaning.clean(df, operation, **kw)[0])

    def mask(self, columns, strategy: str) -> DataFrame:
        def step(df):
            return masking.mask(df, columns, strategy)
        return self._record(step(self.current), f"Masked columns {list(columns)} ({strategy})", step)

    def _record(self, new: DataFrame, description: str, fn: Callable) -> DataFrame:
        run = None
        if self.workspace is not None and self.dataset_id is not None:
            new, _, run = self.workspace.snapshot(new, self.dataset_id)
        self.undo_stack.append((self.current, self.last_run))
        self.last_run = run
        self.redo_stack.clear()
        self.current = new
        self.steps.append(description)
        self.transforms.append(fn)
        return new

    def undo(self) -> DataFrame:
        if not self.undo_stack:
            raise IndexError("Nothing to undo")
        prev, run = self.undo_stack.pop()
        self.redo_stack.append((self.current, self.last_run, self.steps.pop() if len(self.steps) > 1 else "",
                                self.transforms.pop() if self.transforms else None))
        self.current, self.last_run = prev, run
        return prev

    def redo(self) -> DataFrame:
        if not self.redo_stack:
            raise IndexError("Nothing to redo")
        nxt, run, desc, fn = self.redo_stack.pop()
        self.undo_stack.append((self.current, self.last_run))
        self.current, self.last_run = nxt, run
        if desc:
            self.steps.append(desc)
        if fn is not None:
            self.transforms.append(fn)
        return nxt

    def replay(self, df: DataFrame) -> DataFrame:
        """Run the recorded steps, in order, on another DataFrame."""
        for fn in self.transforms:
            df = df.transform(fn)
        return df

    def reset(self, df: DataFrame, description: str = "Loaded Data") -> None:
        """A new load clears both stacks and the step list."""
        self.__init__(df, workspace=self.workspace, dataset_id=self.dataset_id, description=description)
