"""

``entry(spark)`` runs the flagship query on sf0.001; ``queries()`` maps
every implemented operator to a callable ``(spark, sf_dir) -> DataFrame``;
``oracle_sql()`` gives, for each query that SQL can express, the same
rounded on both sides (summation order differs between engines).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalathe.operators import cleaning, health, kpi, masking, models, phrase, profile, query, widgets
from datalathe.plans.history import StepHistory, Workspace, diff_frames
from datalathe.session import ensure_checkpoint_dir
from datalathe.sources import files

SF0001 = "/root/testdata/sf0.001"
DIGITS = 4

# Fixed parameters of the registered queries.
SHIP_CUTOFF = "1998-09-02"
AS_OF = dt.datetime(2024, 2, 5)
HISTORY_COUNTS = [9000, 9100, 8950, 9050]
OLD_SCHEMA_HASH = "0" * 32
CONTRACT = {
    "columns": {
        "o_orderkey": {"type": "int", "unique": True, "nullable": False},
        "o_custkey": {"type": "int", "unique": True},
        "o_orderstatus": {"type": "string", "nullable": False},
        "o_totalprice": {"type": "int"},
        "o_comment": {"nullable": False},
    }
}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column (both sides of the oracle do)."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f"`{f.name}`") for f in df.schema.fields
    ])


def _docs_labels(spark, sf):
    """Documents with their labels (left join: unlabelled documents get nulls)."""
    return _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")


# --------------------------------------------------------------------- queries

def q_builder_pricing_summary(spark, sf):
    li = _t(spark, sf, "lineitem")
    out = query.query_builder(
        li,
        filters=[{"col": "l_shipdate", "op": "<=", "val": SHIP_CUTOFF}],
        groupby=["l_returnflag", "l_linestatus"],
        aggregates=[("l_quantity", "sum", "sum_qty"), ("l_extendedprice", "sum", "sum_base_price"),
                    ("l_quantity", "mean", "avg_qty"), ("l_extendedprice", "mean", "avg_price"),
                    ("l_discount", "mean", "avg_disc"), ("l_orderkey", "count", "count_order")],
        sort={"l_returnflag": "asc", "l_linestatus": "asc"},
    )
    return _r(out)


def q_builder_contains_top(spark, sf):
    out = query.query_builder(
        _t(spark, sf, "part"), filters=[{"col": "p_type", "op": "contains", "val": "^s"},
                                        {"col": "p_size", "op": ">=", "val": 10}],
        groupby=["p_brand"], sort={"count": "desc", "p_brand": "asc"}, limit=10)
    return out


def q_builder_select_sort(spark, sf):
    return _r(query.query_builder(
        _t(spark, sf, "orders"),
        filters=[{"col": "o_orderstatus", "op": "!=", "val": "F"}, {"col": "o_totalprice", "op": ">=", "val": 100000}],
        select=["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"],
        sort={"o_totalprice": "desc", "o_orderkey": "asc"}, limit=100))


def q_group_count(spark, sf):
    return query.query_builder(_t(spark, sf, "orders"), groupby=["o_orderpriority", "o_orderstatus"], limit=None)


def q_group_stats(spark, sf):
    out = query.query_builder(
        _t(spark, sf, "lineitem"), groupby=["l_returnflag"],
        aggregates=[("l_quantity", "std", "std_qty"), ("l_quantity", "var", "var_qty"),
                    ("l_partkey", "nunique", "parts"), ("l_discount", "min", "min_disc"),
                    ("l_discount", "max", "max_disc"), ("l_tax", "median", "median_tax")], limit=None)
    return _r(out)


def q_keyword_search(spark, sf):
    return _r(phrase.keyword_filter(_t(spark, sf, "customer"), "furn"))


def q_nl_filter(spark, sf):
    return _r(phrase.phrase_filter(_t(spark, sf, "orders"), "show rows where o_totalprice > 400000 and o_orderstatus = 'O'"))


def q_nl_filter_or(spark, sf):
    return _r(phrase.phrase_filter(_t(spark, sf, "orders"),
                                   "find records where o_orderpriority equals 1-URGENT or o_totalprice >= 450000"))


def q_dropna(spark, sf):
    return cleaning.drop_missing(_docs_labels(spark, sf))


def q_drop_columns(spark, sf):
    return cleaning.drop_columns(_docs_labels(spark, sf), ["text", "source"])


def q_rename(spark, sf):
    return cleaning.rename_columns(_docs_labels(spark, sf), {"lang": "language", "n_chars": "length", "nope": "x"})


def q_fill_mean(spark, sf):
    return _r(cleaning.fill_strategy(_docs_labels(spark, sf), "mean"))


def q_fill_median(spark, sf):
    return _r(cleaning.fill_strategy(_docs_labels(spark, sf), "median"))


def q_fill_mode(spark, sf):
    return cleaning.fill_strategy(_docs_labels(spark, sf), "mode")


def q_fill_value(spark, sf):
    return cleaning.fill_value(_docs_labels(spark, sf), "0")


def q_drop_duplicates_docs(spark, sf):
    return cleaning.drop_duplicates(_t(spark, sf, "documents").select("text", "lang"))


def q_drop_duplicates_lineitem(spark, sf):
    return cleaning.drop_duplicates(_t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate"))


def q_iqr_outliers(spark, sf):
    return _r(cleaning.remove_outliers(_t(spark, sf, "events"), ["value", "user_id"]))


def q_label_encode(spark, sf):
    return _r(cleaning.label_encode(_t(spark, sf, "orders"), ["o_orderpriority", "o_custkey"]))


def q_one_hot(spark, sf):
    return _r(cleaning.one_hot(_t(spark, sf, "orders"), ["o_orderstatus"]))


def q_minmax(spark, sf):
    return _r(cleaning.minmax_scale(_t(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]))


def q_zscore(spark, sf):
    return _r(cleaning.standard_scale(_t(spark, sf, "customer"), ["c_acctbal"]))


def q_mask_redact(spark, sf):
    return _r(masking.mask(_t(spark, sf, "customer"), ["c_name"], "redact"))


def q_mask_hash(spark, sf):
    return _r(masking.mask(_t(spark, sf, "customer"), ["c_name", "missing_column"], "hash"))


def q_mask_partial(spark, sf):
    return masking.mask(_t(spark, sf, "customer"), ["c_name", "c_mktsegment", "c_acctbal"], "partial")


def q_summary(spark, sf):
    return profile.null_counts(_t(spark, sf, "events"))


def q_quality(spark, sf):
    return _r(profile.quality_report(_docs_labels(spark, sf)))


def q_quality_lineitem(spark, sf):
    return _r(profile.quality_report(_t(spark, sf, "lineitem")))


def q_column_profile(spark, sf):
    return _r(profile.column_profile(_docs_labels(spark, sf)))


def q_describe(spark, sf):
    return _r(profile.describe(_t(spark, sf, "lineitem")))


def q_correlation(spark, sf):
    return _r(profile.correlation(_t(spark, sf, "lineitem")), 6)


def q_histogram(spark, sf):
    return profile.histogram(_t(spark, sf, "events"))


def q_top_categories(spark, sf):
    return profile.top_categories(_t(spark, sf, "events"))


def q_boxplot(spark, sf):
    return _r(profile.boxplot(_t(spark, sf, "events")))


def q_kpis(spark, sf):
    return _r(kpi.detect_kpis(_t(spark, sf, "orders")), 2)


def q_kpis_lineitem(spark, sf):
    return _r(kpi.detect_kpis(_t(spark, sf, "lineitem")), 2)


def q_kpis_average(spark, sf):
    """A column whose name asks for an average, and text columns with few values until there are four."""
    events = _t(spark, sf, "events").withColumnsRenamed({"value": "score"})
    return _r(kpi.detect_kpis(events))


def q_insights(spark, sf):
    return profile.insights(_t(spark, sf, "events"))


def q_chart_group_mean(spark, sf):
    return _r(profile.group_mean_chart(_t(spark, sf, "orders")))


def q_recommend_charts(spark, sf):
    return _r(profile.recommendation_rows(_t(spark, sf, "orders")))


def q_sample_rows(spark, sf):
    return profile.sample_rows(_t(spark, sf, "lineitem"), 200)


def q_widget_avg(spark, sf):
    return _r(widgets.widget_data(_t(spark, sf, "events"), "event_type", "value", "avg"))


def q_widget_sum(spark, sf):
    return _r(widgets.widget_data(_t(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "sum"), 2)


def q_widget_line(spark, sf):
    return widgets.widget_data(_t(spark, sf, "events"), "user_id", None, "count", chart_type="line")


def q_scatter_widget(spark, sf):
    return _r(widgets.scatter_widget(_t(spark, sf, "events"), "user_id", "value"))


def q_overview(spark, sf):
    return _r(widgets.overview(_docs_labels(spark, sf)))


def q_pii_scan(spark, sf):
    return masking.pii_scan(_t(spark, sf, "documents"), include_zero=True)


def q_contract_check(spark, sf):
    return health.contract_check(_t(spark, sf, "orders"), CONTRACT)


def q_freshness(spark, sf):
    return health.freshness_report(_t(spark, sf, "events"), AS_OF)


def q_freshness_text(spark, sf):
    """Dates that are text, some of them no dates."""
    orders = _t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, F.lit("unknown")).otherwise(
        F.col("o_orderdate").cast("string")).alias("order_date"))
    return health.freshness_report(orders, AS_OF)


def q_health(spark, sf):
    runs = spark.createDataFrame(
        [(c, OLD_SCHEMA_HASH, dt.datetime(2024, 1, 1 + i)) for i, c in enumerate(HISTORY_COUNTS)],
        "row_count long, schema_hash string, ts timestamp_ntz")
    return health.check_health(_t(spark, sf, "events"), runs, AS_OF)


def q_health_history(spark, sf):
    """Health of each stored version of a growing table against the runs logged before it."""
    ws = Workspace(spark, _scratch(spark, "workspace"))
    did = ws.register_dataset("events", "parquet")
    events = _t(spark, sf, "events")
    versions = [events.where(F.col("event_id") % 10 < k) for k in (5, 5, 6, 10)]
    versions.append(versions[-1].drop("props"))
    out = None
    for i, version in enumerate(versions):
        stored, _, run = ws.snapshot(version, did)
        row = ws.check_health(stored, did, AS_OF, current_run=run).select(F.lit(i).alias("version"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def q_contract_stored(spark, sf):
    """The contract comes back from the workspace's registry; a newer one replaces an older."""
    ws = Workspace(spark, _scratch(spark, "workspace"))
    did = ws.register_dataset("orders", "parquet")
    ws.save_contract(did, {"columns": {"o_orderkey": {"type": "string"}}})
    ws.save_contract(did, CONTRACT)
    ws.compact("contracts")
    return health.contract_check(_t(spark, sf, "orders"), ws.get_contract(did))


def _orders_changed(spark, sf):
    o = _t(spark, sf, "orders")
    return (o.where("o_orderkey % 11 != 0")
            .withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
            .withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")))
            .unionByName(o.where("o_orderkey % 5 = 0").withColumn("o_orderkey", -F.col("o_orderkey"))))


def _two_snapshots(spark, sf):
    ws = Workspace(spark, _scratch(spark, "workspace"))
    did = ws.register_dataset("orders", "parquet")
    return ws, did, ws.snapshot(_t(spark, sf, "orders"), did)[1], ws.snapshot(_orders_changed(spark, sf), did)[1]


def q_snapshot_rows_diff(spark, sf):
    ws, _, before, after = _two_snapshots(spark, sf)
    return ws.diff_rows(before, after, ["o_orderkey"])


def q_snapshot_columns_diff(spark, sf):
    ws, _, before, after = _two_snapshots(spark, sf)
    return ws.diff_rows(before, after, ["o_orderkey"], columns=True)


def q_snapshot_revert(spark, sf):
    """A revert is a new version with the old version's rows."""
    ws, did, before, _ = _two_snapshots(spark, sf)
    back, path = ws.revert(before, did)
    listed = ws.list_snapshots(did, limit=None).orderBy("seq")
    same = ws.diff_rows(before, path, ["o_orderkey"]).select(F.col("unchanged").alias("unchanged_rows"), F.col("changed").alias("changed_rows"))
    versions = listed.agg(F.sort_array(F.collect_list(F.struct("seq", "row_count"))).alias("v")).select(F.col("v.row_count").alias("row_counts"))
    return versions.join(F.broadcast(same)).withColumn("price", F.lit(back.agg(F.round(F.sum("o_totalprice"), 2)).first()[0]))


def q_drivers(spark, sf):
    li = _t(spark, sf, "lineitem")
    return _r(models.key_drivers(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag",
                                                          "l_linestatus"]))


def q_drivers_top(spark, sf):
    return _r(models.key_drivers(_t(spark, sf, "orders"), "o_orderstatus",
                                 ["o_totalprice", "o_orderpriority", "o_custkey"], impute=False, top=5))


def q_train_regression(spark, sf):
    res = models.train_compare(_t(spark, sf, "lineitem"), "regression", ["linear", "ridge", "lasso", "dt", "svr"],
                               "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return _r(res["comparison"])


def q_train_classification(spark, sf):
    res = models.train_compare(_t(spark, sf, "orders"), "classification", ["logistic", "nb", "dt", "knn"],
                               "o_orderstatus", ["o_totalprice", "o_orderpriority"])
    return _r(res["comparison"])


def q_train_test_split(spark, sf):
    """Many equal rows: every combination lands on both sides."""
    train, test = models.hash_split(_t(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))
    both = train.select("*", F.lit("train").alias("part")).unionByName(test.select("*", F.lit("test").alias("part")))
    return both.groupBy("o_orderstatus", "o_orderpriority", "part").agg(F.count(F.lit(1)).alias("n"))


def q_ols(spark, sf):
    return _r(models.ols_report(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"]))


def q_ols_two(spark, sf):
    return _r(models.ols_report(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]))


def q_feature_strength(spark, sf):
    return _r(models.feature_strength(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_partkey"]), 6)


def _rated(spark, sf):
    """Labelled documents with a plain rule's guess of their quality."""
    docs = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id")
    return docs.select("quality", ((F.col("n_chars") >= 400) & (F.instr("text", "#") == 0)).cast("int").alias("guess"))


def q_confusion(spark, sf):
    return models.confusion(_rated(spark, sf), "quality", "guess")


def q_class_report(spark, sf):
    return _r(models.class_report(_rated(spark, sf), "quality", "guess"), 6)


def q_kmeans(spark, sf):
    return models.kmeans(_t(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], k=3)["sizes"]


def q_pca(spark, sf):
    return _r(models.pca(_t(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"]))


def q_silhouette(spark, sf):
    return _r(models.silhouette(_t(spark, sf, "part"), ["p_size", "p_retailprice"], "p_brand"))


def q_suggest_config(spark, sf):
    return models.suggest_model_frame(_t(spark, sf, "orders"), "Predict o_custkey")


def _scratch(spark, kind: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def q_snapshot_diff(spark, sf):
    o = _t(spark, sf, "orders")
    changed = (o.filter(F.col("o_orderstatus") != "P").drop("o_orderpriority")
               .withColumn("o_year", F.year("o_orderdate")))
    return diff_frames(o, changed)


def q_feature_apply(spark, sf):
    ws = Workspace(spark, _scratch(spark, "workspace"))
    ws.register_feature("net_price", "price without tax", "1", "o_totalprice * (1 - 0.2)")
    ws.register_feature("net_price", "price without tax", "2", "o_totalprice * (1 - 0.1)")
    return _r(ws.apply_feature(_t(spark, sf, "orders"), "net_price").select("o_orderkey", "net_price"))


def q_feature_versions(spark, sf):
    """Every stored version of every feature, applied to the table."""
    ws = Workspace(spark, _scratch(spark, "workspace"))
    ws.register_feature("net_price", "price without tax", "1", "o_totalprice * (1 - 0.2)")
    ws.register_feature("net_price", "price without tax", "2", "o_totalprice * (1 - 0.1)")
    ws.register_feature("order_year", "year of the order", "1", "year(o_orderdate)")
    orders, out = _t(spark, sf, "orders"), None
    for f in ws.list_features().collect():  # the registry's rows, a few
        total = ws.apply_feature(orders, f["name"], f["version"]).agg(F.round(F.sum(F.col(f["name"]).cast("double")), 2).alias("total"))
        row = total.select(F.lit(f["name"]).alias("name"), F.lit(f["version"]).alias("version"), F.lit(f["logic"]).alias("logic"), "total")
        out = row if out is None else out.unionByName(row)
    return out


def q_csv_roundtrip(spark, sf):
    path = files.write_csv(_t(spark, sf, "orders"), _scratch(spark, "csv"))
    return _r(files.load_csv(spark, path)).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


def q_csv_documents(spark, sf):
    """Texts with quotes, commas and newlines, through the default writer and reader."""
    path = files.write_csv(_t(spark, sf, "documents"), _scratch(spark, "csv"))
    return files.load_csv(spark, path)


def q_csv_split(spark, sf):
    """The same through the reader that gives each split of a file to a task of its own."""
    path = files.write_csv(_t(spark, sf, "documents"), _scratch(spark, "csv"))
    return files.load_csv(spark, path, split=True)


def q_csv_latin1(spark, sf):
    """Repeated header names and the fallback encoding."""
    path = _scratch(spark, "csv")
    docs = _t(spark, sf, "documents")
    cells = [F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(["doc_id", "lang", "text", "source", "n_chars"])]
    header = F.struct(*[F.lit(h).alias(f"_c{i}") for i, h in enumerate(["doc_id", "lang", "text", "lang", "n_chars"])])
    # Spark's writer refuses a header with repeated names, so it is a row: the first one of each file, that is of each task
    numbered = docs.select(F.struct(*cells).alias("row"), (F.monotonically_increasing_id() % (1 << 33) == 0).alias("first"))
    rows = numbered.select(F.inline(F.when(F.col("first"), F.array(header, "row")).otherwise(F.array("row"))))
    for part in (spark.range(1, numPartitions=1).select(header.alias("h")).select("h.*"), rows):  # a table without rows has its header, too
        (part.write.mode("append").option("sep", ";").option("encoding", "ISO-8859-1").option("quoteAll", True)
         .option("quote", '"').option("escape", '"').csv(path))
    return files.load_csv(spark, path, sep=";")


def q_csv_semicolons(spark, sf):
    """The delimiter is found."""
    path = _scratch(spark, "csv")
    _t(spark, sf, "customer").write.option("sep", ";").option("header", True).csv(path)
    return _r(files.load_csv(spark, path))


def q_json_roundtrip(spark, sf):
    path = _scratch(spark, "json")
    _t(spark, sf, "customer").write.json(path)
    return _r(files.load(spark, path, "json").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))


def q_json_object(spark, sf):
    """One object with nested fields becomes one row with dotted names."""
    path = _scratch(spark, "json")
    one = _t(spark, sf, "orders").agg(F.count(F.lit(1)).alias("rows"), F.struct(
        F.max("o_orderkey").alias("highest"), F.struct(F.min("o_orderstatus").alias("first"), F.max("o_orderstatus").alias("last")).alias("status")).alias("keys"))
    one.coalesce(1).write.json(path)
    return files.load_json_records(spark, path)


def q_json_list(spark, sf):
    """One object that holds a list of objects becomes that list."""
    path = _scratch(spark, "json")
    nations = _t(spark, sf, "nation")
    one = nations.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("items"))
    one.coalesce(1).write.json(path)
    return files.load_json_records(spark, path)


def q_step_history(spark, sf):
    ws = Workspace(spark, _scratch(spark, "workspace"))
    did = ws.register_dataset("events", "parquet")
    hist = StepHistory(_t(spark, sf, "events"), workspace=ws, dataset_id=did)
    hist.clean("remove_outliers", columns=["value"])
    hist.clean("drop_columns", columns=["props"])
    hist.undo()
    hist.redo()
    runs = ws.list_snapshots(did).orderBy("seq")
    steps = spark.createDataFrame(list(enumerate(hist.steps)), "step int, description string")
    # the run log holds one row per step: a tiny, bounded window
    numbered = runs.select(F.row_number().over(Window.orderBy("seq")).cast("int").alias("step"),
                           "row_count", "col_count")
    return numbered.select((F.col("step") - 1).alias("step"), "row_count", "col_count").join(steps, "step", "left")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "builder_pricing_summary": q_builder_pricing_summary,
    "builder_contains_top": q_builder_contains_top,
    "builder_select_sort": q_builder_select_sort,
    "group_count": q_group_count,
    "group_stats": q_group_stats,
    "keyword_search": q_keyword_search,
    "nl_filter": q_nl_filter,
    "nl_filter_or": q_nl_filter_or,
    "dropna": q_dropna,
    "drop_columns": q_drop_columns,
    "rename": q_rename,
    "fill_mean": q_fill_mean,
    "fill_median": q_fill_median,
    "fill_mode": q_fill_mode,
    "fill_value": q_fill_value,
    "drop_duplicates_docs": q_drop_duplicates_docs,
    "drop_duplicates_lineitem": q_drop_duplicates_lineitem,
    "iqr_outliers": q_iqr_outliers,
    "label_encode": q_label_encode,
    "one_hot": q_one_hot,
    "minmax": q_minmax,
    "zscore": q_zscore,
    "mask_redact": q_mask_redact,
    "mask_hash": q_mask_hash,
    "mask_partial": q_mask_partial,
    "summary": q_summary,
    "quality": q_quality,
    "quality_lineitem": q_quality_lineitem,
    "column_profile": q_column_profile,
    "describe": q_describe,
    "correlation": q_correlation,
    "histogram": q_histogram,
    "top_categories": q_top_categories,
    "boxplot": q_boxplot,
    "kpis": q_kpis,
    "kpis_lineitem": q_kpis_lineitem,
    "kpis_average": q_kpis_average,
    "insights": q_insights,
    "chart_group_mean": q_chart_group_mean,
    "recommend_charts": q_recommend_charts,
    "sample_rows": q_sample_rows,
    "widget_avg": q_widget_avg,
    "widget_sum": q_widget_sum,
    "widget_line": q_widget_line,
    "scatter_widget": q_scatter_widget,
    "overview": q_overview,
    "pii_scan": q_pii_scan,
    "contract_check": q_contract_check,
    "freshness": q_freshness,
    "freshness_text": q_freshness_text,
    "health": q_health,
    "drivers": q_drivers,
    "drivers_top": q_drivers_top,
    "train_regression": q_train_regression,
    "train_classification": q_train_classification,
    "kmeans": q_kmeans,
    "pca": q_pca,
    "silhouette": q_silhouette,
    "train_test_split": q_train_test_split,
    "ols": q_ols,
    "ols_two": q_ols_two,
    "feature_strength": q_feature_strength,
    "confusion": q_confusion,
    "class_report": q_class_report,
    "suggest_config": q_suggest_config,
    "snapshot_diff": q_snapshot_diff,
    "snapshot_rows_diff": q_snapshot_rows_diff,
    "snapshot_columns_diff": q_snapshot_columns_diff,
    "snapshot_revert": q_snapshot_revert,
    "health_history": q_health_history,
    "contract_stored": q_contract_stored,
    "feature_apply": q_feature_apply,
    "feature_versions": q_feature_versions,
    "csv_roundtrip": q_csv_roundtrip,
    "csv_documents": q_csv_documents,
    "csv_split": q_csv_split,
    "csv_latin1": q_csv_latin1,
    "csv_semicolons": q_csv_semicolons,
    "json_roundtrip": q_json_roundtrip,
    "json_object": q_json_object,
    "json_list": q_json_list,
    "step_history": q_step_history,
}


# ---------------------------------------------------------------------- oracle

def _round(expr: str, digits: int = DIGITS) -> str:
    return f"round({expr}, {digits})"


def _docs_labels_sql() -> str:
    return "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax"]
LINEITEM_ALL = [*LINEITEM_NUM, "l_returnflag", "l_linestatus", "l_shipdate"]
EVENTS_NUM = ["event_id", "user_id", "value"]


def _describe_sql() -> str:
    parts = []
    for c in LINEITEM_NUM:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count({c}) AS count, {_round(f'avg({x})')} AS mean, "
            f"{_round(f'stddev_samp({x})')} AS std, {_round(f'min({x})')} AS min, "
            f"{_round(f'quantile_cont({x}, 0.25)')} AS p25, {_round(f'quantile_cont({x}, 0.5)')} AS p50, "
            f"{_round(f'quantile_cont({x}, 0.75)')} AS p75, {_round(f'max({x})')} AS max, "
            f"CAST(NULL AS BIGINT) AS unique, CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM lineitem")
    for c in ["l_returnflag", "l_linestatus"]:
        parts.append(
            f"SELECT '{c}', (SELECT count({c}) FROM lineitem), NULL, NULL, NULL, NULL, NULL, NULL, NULL, "
            f"(SELECT count(DISTINCT {c}) FROM lineitem), t.v, t.n FROM "
            f"(SELECT {c} AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) t")
    return " UNION ALL ".join(parts)


def _corr_sql() -> str:
    parts = []
    for a in LINEITEM_NUM:
        for b in LINEITEM_NUM:
            parts.append(f"SELECT '{a}' AS x, '{b}' AS y, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS value FROM lineitem")
    return " UNION ALL ".join(parts)


def _hist_sql() -> str:
    parts = []
    for i, c in enumerate(EVENTS_NUM):
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""
        SELECT '{c}' AS column_name, CAST(g.b AS INTEGER) AS bin,
               printf('%.2f-%.2f', s.lo + g.b * ((s.hi - s.lo) / 10),
                      CASE WHEN g.b = 9 THEN s.hi ELSE s.lo + (g.b + 1) * ((s.hi - s.lo) / 10) END) AS range,
               coalesce(c.n, 0) AS count
        FROM range(10) g(b)
        CROSS JOIN (SELECT min({x}) AS lo, max({x}) AS hi FROM events) s
        LEFT JOIN (SELECT least(9, CAST(floor(({x} - s2.lo) * (10 / (s2.hi - s2.lo))) AS BIGINT)) AS b, count(*) AS n
                   FROM events, (SELECT min({x}) AS lo, max({x}) AS hi FROM events) s2
                   WHERE {c} IS NOT NULL GROUP BY 1) c ON c.b = g.b""")
    return " UNION ALL ".join(parts)


def _boxplot_sql() -> str:
    parts = []
    for c in EVENTS_NUM:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""
        SELECT '{c}' AS column_name, round(min({x}), 4) AS min, round(s.q1, 4) AS q1, round(s.q2, 4) AS median,
               round(s.q3, 4) AS q3, round(max({x}), 4) AS max,
               count(*) FILTER (WHERE {x} < s.q1 - 1.5 * (s.q3 - s.q1) OR {x} > s.q3 + 1.5 * (s.q3 - s.q1)) AS outliers
        FROM events, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS q2,
                             quantile_cont({x}, 0.75) AS q3 FROM events) s
        GROUP BY s.q1, s.q2, s.q3""")
    return " UNION ALL ".join(parts)


def _top_sql() -> str:
    parts = [f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM events "
             f"WHERE {c} IS NOT NULL GROUP BY 1, 2" for c in ["event_type", "props"]]
    return ("SELECT column_name, value, count, rank FROM (SELECT *, CAST(row_number() OVER "
            "(PARTITION BY column_name ORDER BY count DESC, value) AS INTEGER) AS rank FROM ("
            + " UNION ALL ".join(parts) + ")) WHERE rank <= 10")


def _profile_sql() -> str:
    cols = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
            ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int")]
    base = _docs_labels_sql()
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS missing, "
        f"round(100.0 * count(*) FILTER (WHERE {c} IS NULL) / count(*), 4) AS missing_pct, "
        f"count(DISTINCT {c}) AS unique, '{t}' AS dtype FROM {base}" for c, t in cols)


def _summary_sql() -> str:
    cols = [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
            ("value", "double"), ("props", "string")]
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS missing "
        f"FROM events" for c, t in cols)


def _quality_sql(table: str, cols: list[str]) -> str:
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    complete = " + ".join(f"CASE WHEN count(*) FILTER (WHERE {c} IS NULL) = 0 THEN 1 ELSE 0 END" for c in cols)
    k = len(cols)
    return f"""
    WITH b AS (SELECT * FROM {table}),
    f AS (SELECT count(*) AS rows, {nulls} AS miss, {complete} AS complete FROM b),
    d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM b))
    SELECT round(0.4 * (100 - f.miss * 100.0 / (f.rows * {k})) + 0.3 * (100 - (f.rows - d.n) * 100.0 / f.rows)
                 + 0.3 * (f.complete * 100.0 / {k}), 1) AS score,
           round(f.miss * 100.0 / (f.rows * {k}), 1) AS missing_cells_pct,
           round((f.rows - d.n) * 100.0 / f.rows, 1) AS duplicate_rows_pct,
           round(f.complete * 100.0 / {k}, 1) AS complete_columns_pct,
           f.rows AS rows, f.rows - d.n AS duplicates, f.miss AS missing_cells
    FROM f, d"""


def _pii_sql() -> str:
    parts = []
    for c in ["text", "lang", "source"]:
        for kind, pattern in masking.PII_PATTERNS.items():
            p = pattern.replace("'", "''")
            parts.append(f"SELECT '{c}' AS column_name, '{kind}' AS pii_type, "
                         f"count(*) FILTER (WHERE regexp_matches({c}, '{p}')) AS matches FROM documents")
    return " UNION ALL ".join(parts)


def _health_sql() -> str:
    counts = ", ".join(f"({c})" for c in HISTORY_COUNTS)
    return f"""
    WITH h AS (SELECT * FROM (VALUES {counts}) v(c)),
    cur AS (SELECT count(*) AS n FROM events),
    p AS (SELECT avg(c) AS m, stddev_pop(c) AS s, count(*) AS k FROM h, cur WHERE h.c <> cur.n),
    fr AS (SELECT CAST(floor((epoch(TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}') - epoch(max(ts))) / 86400) AS INTEGER) AS days FROM events)
    SELECT CASE WHEN p.k = 0 THEN 'stable'
                WHEN p.s > 0 AND abs(cur.n - p.m) > 3 * p.s THEN 'anomaly'
                WHEN p.s = 0 AND abs(cur.n - p.m) > 0 THEN 'changed' ELSE 'stable' END AS volume_status,
           cur.n AS current_rows, 'drift_detected' AS schema_status,
           CASE WHEN fr.days < 1 THEN 'fresh' WHEN fr.days < 7 THEN 'ok' ELSE 'stale' END AS freshness,
           fr.days AS days_since_last_entry
    FROM cur, p, fr"""


def _kpi_sql(table: str, sum_col: str, texts: list[str]) -> str:
    parts = [f"SELECT 'sum_{sum_col}' AS kpi_id, 'Total {sum_col}' AS label, round(sum({sum_col}), 2) AS value, "
             f"CAST(NULL AS VARCHAR) AS text_value, 'currency' AS format FROM {table}"]
    for c in texts:
        parts.append(f"SELECT 'top_{c}', 'Top {c}', NULL, v || ' (' || n || ')', 'text' FROM "
                     f"(SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)")
    return " UNION ALL ".join(parts)


def _insights_sql() -> str:
    cols = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    nums = EVENTS_NUM
    z = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS z_{c}" for c in cols)
    any_null = " + ".join(f"z_{c}" for c in cols)
    n_null = " + ".join(f"CASE WHEN z_{c} > 0 THEN 1 ELSE 0 END" for c in cols)
    names = ", ".join(f"CASE WHEN z_{c} > 0 THEN '{c}' END" for c in cols)
    st = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_samp(CAST({c} AS DOUBLE)) AS s_{c}, "
                   f"min({c}) AS a_{c}, max({c}) AS b_{c}" for c in nums)
    zc = ", ".join(f"count(*) FILTER (WHERE abs((CAST({c} AS DOUBLE) - m_{c}) / s_{c}) > 3) AS o_{c}" for c in nums)
    live = {c: f"(a_{c} <> b_{c} AND s_{c} > 0 AND o_{c} > 0)" for c in nums}
    outl = ", ".join(f"CASE WHEN {live[c]} THEN '{c} (' || o_{c} || ')' END" for c in nums)
    pairs = [(a, b) for j, b in enumerate(nums) for a in nums[:j]]
    corr = ", ".join(f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r_{a}_{b}" for a, b in pairs)
    high = {b: " OR ".join(f"abs(r_{a}_{b}) > 0.8" for a in nums[:j]) for j, b in enumerate(nums) if j}
    high_names = ", ".join(f"CASE WHEN {cond} THEN '{b}' END" for b, cond in high.items())
    any_high = " OR ".join(f"({c})" for c in high.values())
    return f"""
    WITH n AS (SELECT count(*) AS rows, {z} FROM events),
    d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM events)),
    s AS (SELECT {st} FROM events),
    o AS (SELECT {zc} FROM events, s),
    c AS (SELECT {corr} FROM events),
    lines AS (
      SELECT 1 AS k, 'The dataset contains ' || rows || ' rows and {len(cols)} columns.' AS insight FROM n
      UNION ALL SELECT 2, CASE WHEN {any_null} = 0 THEN 'No missing values found in the dataset.'
                          ELSE 'Found missing values in ' || ({n_null}) || ' columns: ' || concat_ws(', ', {names}) || '.' END FROM n
      UNION ALL SELECT 3, 'Identified ' || (n.rows - d.k) || ' duplicate rows.' FROM n, d WHERE n.rows - d.k > 0
      UNION ALL SELECT 4, 'Columns breakdown: {len(nums)} numerical, 2 categorical.'
      UNION ALL SELECT 5, 'Potential outliers detected in: ' || concat_ws(', ', {outl}) || '.' FROM s, o
                WHERE {" OR ".join(live.values())}
      UNION ALL SELECT 6, 'High correlation detected in columns: ' || concat_ws(', ', {high_names}) || '.' FROM c
                WHERE {any_high})
    SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS idx, insight FROM lines"""


def _charts_sql() -> str:
    x = "CAST(o_orderkey AS DOUBLE)"
    return f"""
    SELECT 'rec_dist' AS chart_id, 'Distribution of o_orderkey' AS title,
           printf('%.2f-%.2f', s.lo + g.b * ((s.hi - s.lo) / 10),
                  CASE WHEN g.b = 9 THEN s.hi ELSE s.lo + (g.b + 1) * ((s.hi - s.lo) / 10) END) AS label,
           CAST(coalesce(c.n, 0) AS DOUBLE) AS value
    FROM range(10) g(b)
    CROSS JOIN (SELECT min({x}) AS lo, max({x}) AS hi FROM orders) s
    LEFT JOIN (SELECT least(9, CAST(floor(({x} - s2.lo) * (10 / (s2.hi - s2.lo))) AS BIGINT)) AS b, count(*) AS n
               FROM orders, (SELECT min({x}) AS lo, max({x}) AS hi FROM orders) s2
               WHERE o_orderkey IS NOT NULL GROUP BY 1) c ON c.b = g.b
    UNION ALL
    SELECT 'rec_cat', 'Top Categories in o_orderstatus', v, CAST(n AS DOUBLE) FROM (
      SELECT o_orderstatus AS v, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL
      GROUP BY 1 ORDER BY n DESC, v LIMIT 10)
    UNION ALL
    SELECT 'rec_comp', 'Average o_orderkey by o_orderstatus', name, round(value, 4) FROM (
      SELECT CAST(o_orderstatus AS VARCHAR) AS name, avg(CAST(o_orderkey AS DOUBLE)) AS value FROM orders
      WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 10)
    UNION ALL
    SELECT 'rec_corr', 'o_orderkey vs o_custkey', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS DOUBLE) FROM (
      SELECT o_orderkey, o_custkey FROM orders ORDER BY {_row_md5(['o_orderkey', 'o_custkey'])} LIMIT 200)"""


def _row_md5(columns: list[str], seed: int = 42, extra: str = "") -> str:
    """The MD5 of a row's text, as ``row_text`` writes it."""
    return "md5('" + str(seed) + "'" + "".join(f" || '|' || coalesce(CAST({c} AS VARCHAR), '\\N')" for c in columns) + extra + ")"


def _changed_sql() -> str:
    return """(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
                      CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
               FROM orders WHERE o_orderkey % 11 <> 0
               UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 5 = 0)"""


def _health_history_sql() -> str:
    """Each version against the ones before it; its own run is left out."""
    sizes = " UNION ALL ".join(
        f"SELECT {i} AS v, count(*) AS n, {int(i == 4)} AS other, CAST(floor((epoch(TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}') - epoch(max(ts))) / 86400) AS INTEGER) AS days "
        f"FROM events WHERE event_id % 10 < {k}" for i, k in enumerate((5, 5, 6, 10, 10)))
    return f"""
    WITH s AS ({sizes}),
    p AS (SELECT a.v, a.n, a.days, count(b.v) AS runs, count(b.v) FILTER (WHERE b.n <> a.n) AS k, avg(b.n) FILTER (WHERE b.n <> a.n) AS m,
                 stddev_pop(b.n) FILTER (WHERE b.n <> a.n) AS d, max(a.other) AS other FROM s a LEFT JOIN s b ON b.v < a.v GROUP BY a.v, a.n, a.days)
    SELECT CAST(v AS INTEGER) AS version, CASE WHEN runs <= 1 OR k = 0 THEN 'stable' WHEN d > 0 AND abs(n - m) > 3 * d THEN 'anomaly'
                WHEN d = 0 AND n <> m THEN 'changed' ELSE 'stable' END AS volume_status, n AS current_rows,
           CASE WHEN other = 1 THEN 'drift_detected' ELSE 'stable' END AS schema_status,
           CASE WHEN days < 1 THEN 'fresh' WHEN days < 7 THEN 'ok' ELSE 'stale' END AS freshness, days AS days_since_last_entry FROM p"""


def _rated_sql() -> str:
    return "(SELECT quality, CAST(n_chars >= 400 AND instr(text, '#') = 0 AS INTEGER) AS guess FROM documents JOIN labels USING (doc_id))"


def _ols_sql() -> str:
    x, y = "CAST(l_quantity AS DOUBLE)", "CAST(l_extendedprice AS DOUBLE)"
    parts = {"intercept": f"regr_intercept({y}, {x})", "l_quantity": f"regr_slope({y}, {x})", "r2": f"regr_r2({y}, {x})",
             "rmse": f"sqrt((1 - regr_r2({y}, {x})) * var_pop({y}))", "n": "CAST(count(*) AS DOUBLE)"}
    return " UNION ALL ".join(f"SELECT '{t}' AS term, round({e}, 4) AS value FROM lineitem" for t, e in parts.items())


def _ols_two_sql() -> str:
    return """
    WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb,
                      covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS bby,
                      var_pop(l_extendedprice) AS yy FROM lineitem),
    f AS (SELECT *, (ay * bb - bby * ab) / (aa * bb - ab * ab) AS p, (bby * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM s),
    g AS (SELECT *, yy - p * ay - q * bby AS rest FROM f)
    SELECT 'intercept' AS term, round(my - p * ma - q * mb, 4) AS value FROM g UNION ALL SELECT 'l_quantity', round(p, 4) FROM g
    UNION ALL SELECT 'l_discount', round(q, 4) FROM g UNION ALL SELECT 'r2', round(1 - rest / yy, 4) FROM g
    UNION ALL SELECT 'rmse', round(sqrt(rest), 4) FROM g UNION ALL SELECT 'n', CAST(n AS DOUBLE) FROM g"""


def _contract_sql() -> str:
    return """
            SELECT 'o_orderkey' AS column_name, 'type' AS rule, true AS passed, CAST(NULL AS VARCHAR) AS message
            UNION ALL SELECT 'o_orderkey', 'unique', count(*) = count(DISTINCT o_orderkey) + least(1, count(*) FILTER (WHERE o_orderkey IS NULL)),
                   CASE WHEN count(*) = count(DISTINCT o_orderkey) + least(1, count(*) FILTER (WHERE o_orderkey IS NULL)) THEN NULL
                        ELSE 'Column o_orderkey contains duplicates' END FROM orders
            UNION ALL SELECT 'o_orderkey', 'nullable', count(*) FILTER (WHERE o_orderkey IS NULL) = 0,
                   CASE WHEN count(*) FILTER (WHERE o_orderkey IS NULL) = 0 THEN NULL ELSE 'Column o_orderkey contains nulls' END FROM orders
            UNION ALL SELECT 'o_custkey', 'type', true, NULL
            UNION ALL SELECT 'o_custkey', 'unique', count(*) = count(DISTINCT o_custkey) + least(1, count(*) FILTER (WHERE o_custkey IS NULL)),
                   CASE WHEN count(*) = count(DISTINCT o_custkey) + least(1, count(*) FILTER (WHERE o_custkey IS NULL)) THEN NULL
                        ELSE 'Column o_custkey contains duplicates' END FROM orders
            UNION ALL SELECT 'o_orderstatus', 'type', true, NULL
            UNION ALL SELECT 'o_orderstatus', 'nullable', count(*) FILTER (WHERE o_orderstatus IS NULL) = 0,
                   CASE WHEN count(*) FILTER (WHERE o_orderstatus IS NULL) = 0 THEN NULL ELSE 'Column o_orderstatus contains nulls' END FROM orders
            UNION ALL SELECT 'o_totalprice', 'type', false, 'Column o_totalprice expected int, got double'
            UNION ALL SELECT 'o_comment', 'exists', false, 'Missing column: o_comment'"""


def oracle_sql() -> dict[str, str]:
    return _own_sql() | LLM_ORACLE


def _own_sql() -> dict[str, str]:
    dl = _docs_labels_sql()
    return {
        "builder_pricing_summary": f"""
            SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty,
                   round(sum(l_extendedprice), 4) AS sum_base_price, round(avg(l_quantity), 4) AS avg_qty,
                   round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc,
                   count(l_orderkey) AS count_order
            FROM lineitem WHERE l_shipdate <= TIMESTAMP '{SHIP_CUTOFF}'
            GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus LIMIT 1000""",
        "builder_contains_top": """
            SELECT p_brand, count(*) AS count FROM part
            WHERE regexp_matches(p_type, '^s', 'i') AND p_size >= 10
            GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 10""",
        "builder_select_sort": """
            SELECT o_orderkey, o_custkey, round(o_totalprice, 4) AS o_totalprice, o_orderdate FROM orders
            WHERE (o_orderstatus IS DISTINCT FROM 'F') AND o_totalprice >= 100000
            ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
        "group_count": """
            SELECT o_orderpriority, o_orderstatus, count(*) AS count FROM orders
            WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 1, 2""",
        "group_stats": """
            SELECT l_returnflag, round(stddev_samp(l_quantity), 4) AS std_qty, round(var_samp(l_quantity), 4) AS var_qty,
                   count(DISTINCT l_partkey) AS parts, round(min(l_discount), 4) AS min_disc,
                   round(max(l_discount), 4) AS max_disc, round(median(l_tax), 4) AS median_tax
            FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1""",
        "keyword_search": """
            SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer
            WHERE regexp_matches(CAST(c_custkey AS VARCHAR), 'furn', 'i') OR regexp_matches(c_name, 'furn', 'i')
               OR regexp_matches(CAST(c_nationkey AS VARCHAR), 'furn', 'i')
               OR regexp_matches(CAST(c_acctbal AS VARCHAR), 'furn', 'i') OR regexp_matches(c_mktsegment, 'furn', 'i')""",
        "nl_filter": """
            SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority
            FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'O'""",
        "nl_filter_or": """
            SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority
            FROM orders WHERE o_orderpriority = '1-URGENT' OR o_totalprice >= 450000""",
        "dropna": f"SELECT * FROM {dl} WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL "
                  f"AND source IS NOT NULL AND n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL",
        "drop_columns": f"SELECT doc_id, lang, n_chars, quality, toxic FROM {dl}",
        "rename": f"SELECT doc_id, text, lang AS language, source, n_chars AS length, quality, toxic FROM {dl}",
        "fill_mean": f"""
            SELECT doc_id, text, lang, source, n_chars,
                   round(coalesce(CAST(quality AS DOUBLE), avg(quality) OVER ()), 4) AS quality,
                   round(coalesce(CAST(toxic AS DOUBLE), avg(toxic) OVER ()), 4) AS toxic FROM {dl}""",
        "fill_median": f"""
            SELECT doc_id, text, lang, source, n_chars,
                   round(coalesce(CAST(quality AS DOUBLE), quantile_cont(quality, 0.5) OVER ()), 4) AS quality,
                   round(coalesce(CAST(toxic AS DOUBLE), quantile_cont(toxic, 0.5) OVER ()), 4) AS toxic FROM {dl}""",
        "fill_mode": f"""
            SELECT doc_id, text, lang, source, n_chars,
                   coalesce(quality, (SELECT quality FROM {dl} WHERE quality IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS quality,
                   coalesce(toxic, (SELECT toxic FROM {dl} WHERE toxic IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS toxic
            FROM {dl}""",
        "fill_value": (f"SELECT doc_id, coalesce(text, '0') AS text, coalesce(lang, '0') AS lang, "
                       f"coalesce(source, '0') AS source, n_chars, coalesce(quality, 0) AS quality, "
                       f"coalesce(toxic, 0) AS toxic FROM {dl}"),
        "drop_duplicates_docs": "SELECT DISTINCT text, lang FROM documents",
        "drop_duplicates_lineitem": "SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate FROM lineitem",
        "iqr_outliers": """
            WITH b1 AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
            s1 AS (SELECT e.* FROM events e, b1 WHERE e.value IS NULL OR NOT (e.value < b1.q1 - 1.5 * (b1.q3 - b1.q1)
                   OR e.value > b1.q3 + 1.5 * (b1.q3 - b1.q1))),
            b2 AS (SELECT quantile_cont(CAST(user_id AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(user_id AS DOUBLE), 0.75) AS q3 FROM s1)
            SELECT event_id, ts, user_id, event_type, round(value, 4) AS value, props FROM s1, b2
            WHERE user_id IS NULL OR NOT (user_id < b2.q1 - 1.5 * (b2.q3 - b2.q1) OR user_id > b2.q3 + 1.5 * (b2.q3 - b2.q1))""",
        "label_encode": """
            SELECT o_orderkey,
                   CAST(dense_rank() OVER (ORDER BY coalesce(CAST(o_custkey AS VARCHAR), 'nan')) - 1 AS INTEGER) AS o_custkey,
                   o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate,
                   CAST(dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'nan')) - 1 AS INTEGER) AS o_orderpriority
            FROM orders""",
        "one_hot": """
            SELECT o_orderkey, o_custkey, round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority,
                   coalesce(o_orderstatus = 'F', false) AS o_orderstatus_F, coalesce(o_orderstatus = 'O', false) AS o_orderstatus_O,
                   coalesce(o_orderstatus = 'P', false) AS o_orderstatus_P FROM orders""",
        "minmax": """
            SELECT c_custkey, c_name,
                   round((c_nationkey - min(c_nationkey) OVER ()) * 1.0 / (max(c_nationkey) OVER () - min(c_nationkey) OVER ()), 4) AS c_nationkey,
                   round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 4) AS c_acctbal,
                   c_mktsegment FROM customer""",
        "zscore": """
            SELECT c_custkey, c_name, c_nationkey,
                   round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 4) AS c_acctbal,
                   c_mktsegment FROM customer""",
        "mask_redact": "SELECT c_custkey, '*****' AS c_name, c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer",
        "mask_hash": """
            SELECT c_custkey, CASE WHEN c_name = '' THEN c_name ELSE sha256(c_name) END AS c_name, c_nationkey,
                   round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer""",
        "mask_partial": """
            SELECT c_custkey,
                   CASE WHEN length(c_name) <= 4 THEN c_name ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END AS c_name,
                   c_nationkey,
                   CASE WHEN length(CAST(c_acctbal AS VARCHAR)) <= 4 THEN CAST(c_acctbal AS VARCHAR)
                        ELSE repeat('*', length(CAST(c_acctbal AS VARCHAR)) - 4) || right(CAST(c_acctbal AS VARCHAR), 4) END AS c_acctbal,
                   CASE WHEN length(c_mktsegment) <= 4 THEN c_mktsegment
                        ELSE repeat('*', length(c_mktsegment) - 4) || right(c_mktsegment, 4) END AS c_mktsegment
            FROM customer""",
        "summary": _summary_sql(),
        "quality": _quality_sql(dl, ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]),
        "quality_lineitem": _quality_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                                      "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                                                      "l_linestatus", "l_shipdate"]),
        "column_profile": _profile_sql(),
        "describe": _describe_sql(),
        "correlation": _corr_sql(),
        "histogram": _hist_sql(),
        "top_categories": _top_sql(),
        "boxplot": _boxplot_sql(),
        "kpis": _kpi_sql("orders", "o_totalprice", ["o_orderstatus", "o_orderpriority"]),
        "kpis_lineitem": _kpi_sql("lineitem", "l_extendedprice", ["l_returnflag", "l_linestatus"]),
        "chart_group_mean": """
            SELECT name, round(value, 4) AS value FROM (
              SELECT CAST(o_orderstatus AS VARCHAR) AS name, avg(CAST(o_orderkey AS DOUBLE)) AS value FROM orders
              WHERE o_orderstatus IS NOT NULL GROUP BY 1) ORDER BY value DESC, name""",
        "widget_avg": """
            SELECT CASE WHEN event_type IS NULL OR event_type = '' THEN 'Unknown' ELSE event_type END AS name,
                   round(avg(coalesce(TRY_CAST(value AS DOUBLE), 0.0)), 4) AS value
            FROM events GROUP BY 1 ORDER BY value DESC, name""",
        "widget_sum": """
            SELECT CASE WHEN o_orderpriority IS NULL OR o_orderpriority = '' THEN 'Unknown' ELSE o_orderpriority END AS name,
                   round(sum(coalesce(TRY_CAST(o_totalprice AS DOUBLE), 0.0)), 2) AS value
            FROM orders GROUP BY 1 ORDER BY value DESC, name""",
        "widget_line": """
            SELECT CAST(user_id AS VARCHAR) AS name, CAST(count(*) AS DOUBLE) AS value FROM events
            GROUP BY 1""",
        "scatter_widget": """
            SELECT coalesce(CAST(user_id AS DOUBLE), 0.0) AS x, round(coalesce(value, 0.0), 4) AS y, CAST(1.0 AS DOUBLE) AS z FROM events""",
        "overview": f"""
            SELECT count(*) AS rows, 7 AS columns,
                   count(*) FILTER (WHERE quality IS NULL) + count(*) FILTER (WHERE toxic IS NULL)
                   + count(*) FILTER (WHERE doc_id IS NULL) + count(*) FILTER (WHERE text IS NULL)
                   + count(*) FILTER (WHERE lang IS NULL) + count(*) FILTER (WHERE source IS NULL)
                   + count(*) FILTER (WHERE n_chars IS NULL) AS missing_cells,
                   round(100.0 - (count(*) FILTER (WHERE quality IS NULL) + count(*) FILTER (WHERE toxic IS NULL)
                   + count(*) FILTER (WHERE doc_id IS NULL) + count(*) FILTER (WHERE text IS NULL)
                   + count(*) FILTER (WHERE lang IS NULL) + count(*) FILTER (WHERE source IS NULL)
                   + count(*) FILTER (WHERE n_chars IS NULL)) * 100.0 / (count(*) * 7), 4) AS complete_pct
            FROM {dl}""",
        "pii_scan": _pii_sql(),
        "contract_check": _contract_sql(),
        "contract_stored": _contract_sql(),
        "freshness": f"""
            SELECT 'ts' AS column_name, max(ts) AS last_value,
                   CAST(floor((epoch(TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}') - epoch(max(ts))) / 86400) AS INTEGER) AS days_since_last_entry,
                   CASE WHEN floor((epoch(TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}') - epoch(max(ts))) / 86400) < 1 THEN 'fresh'
                        WHEN floor((epoch(TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}') - epoch(max(ts))) / 86400) < 7 THEN 'ok'
                        ELSE 'stale' END AS freshness
            FROM events""",
        "freshness_text": f"""
            SELECT 'order_date' AS column_name, max(o_orderdate) AS last_value,
                   CAST(floor((epoch(TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}') - epoch(max(o_orderdate))) / 86400) AS INTEGER) AS days_since_last_entry,
                   CASE WHEN floor((epoch(TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}') - epoch(max(o_orderdate))) / 86400) < 1 THEN 'fresh'
                        WHEN floor((epoch(TIMESTAMP '{AS_OF:%Y-%m-%d %H:%M:%S}') - epoch(max(o_orderdate))) / 86400) < 7 THEN 'ok' ELSE 'stale' END AS freshness
            FROM orders WHERE o_orderkey % 9 <> 0""",
        "kpis_average": """
            SELECT 'avg_score' AS kpi_id, 'Avg score' AS label, round(avg(value), 4) AS value, CAST(NULL AS VARCHAR) AS text_value, 'number' AS format FROM events
            UNION ALL SELECT 'top_event_type', 'Top event_type', NULL, v || ' (' || n || ')', 'text' FROM
                (SELECT event_type AS v, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
            WHERE (SELECT count(DISTINCT event_type) FROM events) < 50
            UNION ALL SELECT 'top_props', 'Top props', NULL, v || ' (' || n || ')', 'text' FROM
                (SELECT props AS v, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
            WHERE (SELECT count(DISTINCT props) FROM events) < 50""",
        "pca": """
            WITH s AS (SELECT var_samp(l_extendedprice) AS a, var_samp(l_quantity) AS d, covar_samp(l_extendedprice, l_quantity) AS b FROM lineitem),
            e AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b) AS hi, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b) AS lo FROM s),
            v AS (SELECT 1 AS component, hi AS variance, b AS x, hi - a AS y, a + d AS total FROM e UNION ALL SELECT 2, lo, b, lo - a, a + d FROM e),
            w AS (SELECT component, variance, variance / total AS share, x / sqrt(x * x + y * y) * CASE WHEN x + y >= 0 THEN 1 ELSE -1 END AS p,
                         y / sqrt(x * x + y * y) * CASE WHEN x + y >= 0 THEN 1 ELSE -1 END AS q FROM v)
            SELECT CAST(component AS INTEGER) AS component, round(variance, 4) AS variance, round(share, 4) AS share, 'l_extendedprice' AS feature, round(p, 4) AS weight FROM w
            UNION ALL SELECT CAST(component AS INTEGER), round(variance, 4), round(share, 4), 'l_quantity', round(q, 4) FROM w""",
        "silhouette": """
            WITH d AS (SELECT row_number() OVER () AS i, p_brand AS c, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
            p AS (SELECT a.i, a.c, b.c AS other, sum((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS s, count(*) AS n FROM d a, d b GROUP BY ALL),
            q AS (SELECT i, c, max(s / (n - 1)) FILTER (WHERE other = c AND n > 1) AS own, min(s / n) FILTER (WHERE other <> c) AS near FROM p GROUP BY i, c)
            SELECT c AS cluster, count(*) AS size, round(avg(CASE WHEN own IS NULL OR near IS NULL OR greatest(own, near) = 0 THEN 0.0
                   ELSE (near - own) / greatest(own, near) END), 4) AS silhouette FROM q GROUP BY c""",
        "json_object": """
            SELECT max(o_orderkey) AS "keys.highest", min(o_orderstatus) AS "keys.status.first", max(o_orderstatus) AS "keys.status.last", count(*) AS rows FROM orders""",
        "json_list": "SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation",
        "health": _health_sql(),
        "health_history": _health_history_sql(),
        "sample_rows": f"SELECT * FROM lineitem ORDER BY {_row_md5(LINEITEM_ALL)} LIMIT 200",
        "train_test_split": f"""
            WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority) - 1 AS k FROM orders)
            SELECT o_orderstatus, o_orderpriority, CASE WHEN ('0x' || substr({_row_md5(['o_orderstatus', 'o_orderpriority'], extra=" || '|' || k")}, 1, 8))::BIGINT % 10000 < 2000
                   THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM k GROUP BY ALL""",
        "ols": _ols_sql(),
        "ols_two": _ols_two_sql(),
        "feature_strength": " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(regr_r2(CAST(l_extendedprice AS DOUBLE), CAST({c} AS DOUBLE)), 6) AS r2, "
            f"round(regr_slope(CAST(l_extendedprice AS DOUBLE), CAST({c} AS DOUBLE)), 6) AS slope FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax", "l_partkey")),
        "confusion": f"SELECT quality AS actual, guess AS predicted, count(*) AS n FROM {_rated_sql()} WHERE quality IS NOT NULL GROUP BY ALL",
        "class_report": f"""
            WITH r AS (SELECT * FROM {_rated_sql()} WHERE quality IS NOT NULL AND guess IS NOT NULL),
            l AS (SELECT quality AS label FROM r UNION SELECT guess FROM r),
            c AS (SELECT label, count(*) FILTER (WHERE quality = label) AS support, count(*) FILTER (WHERE guess = label) AS chosen,
                         count(*) FILTER (WHERE quality = label AND guess = label) AS hit FROM l, r GROUP BY label)
            SELECT label, support, round(CASE WHEN chosen > 0 THEN hit / chosen ELSE 0.0 END, 6) AS precision,
                   round(CASE WHEN support > 0 THEN hit / support ELSE 0.0 END, 6) AS recall, round(2 * hit / (chosen + support), 6) AS f1 FROM c""",
        "suggest_config": """
            SELECT 'o_custkey' AS target_column, problem AS problem_type, 'rf' AS algorithm,
                   ['o_orderkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'] AS feature_columns,
                   'Goal: ''Predict o_custkey''. Column ''o_custkey'' holds ' || CASE problem WHEN 'regression' THEN 'continuous' ELSE 'categorical' END
                   || ' values, which asks for a ' || problem || ' model.' AS explanation
            FROM (SELECT CASE WHEN count(DISTINCT o_custkey) < 20 THEN 'classification' ELSE 'regression' END AS problem FROM orders)""",
        "snapshot_rows_diff": f"""
            SELECT count(*) FILTER (WHERE a.o_orderkey IS NULL) AS added, count(*) FILTER (WHERE b.o_orderkey IS NULL) AS removed,
                   count(*) FILTER (WHERE a.o_orderkey = b.o_orderkey AND (a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice <> b.o_totalprice)) AS changed,
                   count(*) FILTER (WHERE a.o_orderkey = b.o_orderkey AND a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND a.o_totalprice = b.o_totalprice) AS unchanged,
                   0::BIGINT AS repeated_keys FROM orders a FULL JOIN {_changed_sql()} b ON a.o_orderkey = b.o_orderkey""",
        "snapshot_columns_diff": " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE a.{c} IS DISTINCT FROM b.{c}) AS changed FROM orders a JOIN {_changed_sql()} b ON a.o_orderkey = b.o_orderkey"
            for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
        "snapshot_revert": f"""
            SELECT [(SELECT count(*) FROM orders), (SELECT count(*) FROM {_changed_sql()}), (SELECT count(*) FROM orders)] AS row_counts,
                   count(*) AS unchanged_rows, 0::BIGINT AS changed_rows, round(sum(o_totalprice), 2) AS price FROM orders""",
        "feature_versions": """
            SELECT 'net_price' AS name, '1' AS version, 'o_totalprice * (1 - 0.2)' AS logic, round(sum(o_totalprice * (1 - 0.2)), 2) AS total FROM orders
            UNION ALL SELECT 'net_price', '2', 'o_totalprice * (1 - 0.1)', round(sum(o_totalprice * (1 - 0.1)), 2) FROM orders
            UNION ALL SELECT 'order_year', '1', 'year(o_orderdate)', CAST(sum(year(o_orderdate)) AS DOUBLE) FROM orders""",
        "csv_split": ("SELECT CAST(doc_id AS INTEGER) AS doc_id, text, lang, source, CAST(n_chars AS INTEGER) AS n_chars "
                      "FROM documents"),
        "csv_semicolons": ("SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer"),
        "csv_latin1": "SELECT CAST(doc_id AS INTEGER) AS doc_id, lang AS lang1, text, source AS lang3, CAST(n_chars AS INTEGER) AS n_chars FROM documents",
        "insights": _insights_sql(),
        "recommend_charts": _charts_sql(),
        "snapshot_diff": """
            SELECT ['o_year'] AS added_columns, ['o_orderpriority'] AS removed_columns,
                   (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') - (SELECT count(*) FROM orders) AS rows_diff,
                   'Row change: ' || ((SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') - (SELECT count(*) FROM orders))
                   || '. Cols added: 1, removed: 1' AS summary""",
        "feature_apply": "SELECT o_orderkey, round(o_totalprice * (1 - 0.1), 4) AS net_price FROM orders",
        "csv_roundtrip": """
            SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus,
                   round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority FROM orders""",
        "csv_documents": ("SELECT CAST(doc_id AS INTEGER) AS doc_id, text, lang, source, CAST(n_chars AS INTEGER) AS n_chars "
                          "FROM documents"),
        "json_roundtrip": ("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, "
                           "round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer"),
        "step_history": """
            WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
            kept AS (SELECT count(*) AS n FROM events, b WHERE value IS NULL OR NOT (value < q1 - 1.5 * (q3 - q1)
                     OR value > q3 + 1.5 * (q3 - q1)))
            SELECT 0 AS step, (SELECT count(*) FROM events) AS row_count, 6 AS col_count, 'Loaded Data' AS description
            UNION ALL SELECT 1, (SELECT n FROM kept), 6, 'Removed Outliers'
            UNION ALL SELECT 2, (SELECT n FROM kept), 5, 'Dropped Columns: [''props'']'""",
    }


try:  # the corpus operators are an optional subpackage
    from datalathe.llm.queries import ORACLE as LLM_ORACLE
    from datalathe.llm.queries import QUERIES as LLM_QUERIES
except ImportError:
    LLM_ORACLE, LLM_QUERIES = {}, {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | LLM_QUERIES


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the query builder's pricing summary on sf0.001."""
    return q_builder_pricing_summary(spark, SF0001)
