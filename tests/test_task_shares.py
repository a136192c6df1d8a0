"""What one task writes or reads of a table does not grow with the table."""

import pytest

import __spark_entry__ as entry
from datalathe.operators import models


def test_latin1_files_are_as_many_as_tasks(spark, tmp_path):
    texts = ["é;\"x\"", "two\nlines", None, "", "plain"] * 8
    rows = [(i, t, "fr", f"s{i}", 5) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    # files this small are read together otherwise
    spark.conf.set("spark.sql.files.openCostInBytes", str(64 << 20))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(64 << 20))
    try:
        got = entry.q_csv_latin1(spark, str(tmp_path))
        assert got.columns == ["doc_id", "lang1", "text", "lang3", "n_chars"]
        assert {(r.doc_id, r.text) for r in got.collect()} == {(i, t or None) for i, t in enumerate(texts)} and got.count() == len(rows)
        assert len(got.inputFiles()) > 4
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_latin1_of_an_empty_table_keeps_its_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.q_csv_latin1(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang1", "text", "lang3", "n_chars"] and got.count() == 0


@pytest.mark.parametrize("impute", [True, False])
def test_a_forests_task_has_a_bounded_share(spark, monkeypatch, impute):
    seen, balanced = [], models.balanced

    def watched(*args):
        seen.append(balanced(*args).rdd.getNumPartitions())
        return balanced(*args)

    monkeypatch.setattr(models, "ROWS_A_TASK", 100, raising=False)
    monkeypatch.setattr(models, "balanced", watched)
    df = spark.range(2000).selectExpr("id % 7 AS a", "cast(id AS double) AS b", "if(id % 2 = 0, 'x', 'y') AS y")
    rows = models.key_drivers(df, "y", ["a", "b"], impute=impute, num_trees=2, depth=2).collect()
    assert seen == [20] and {r.feature for r in rows} == {"a", "b"}
