"""Quoted CSV over many splits equals Spark's own reader of whole files."""

import csv
import random

import pytest

from datalathe.sources import files


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def odd_text(r):
    kinds = ["plain", 'say "hi"', "two\nlines", "a,b", '5" pipe', "", "é\r\nü", '"', '""', "\n\n", 'x",\n"y', "NA", "it's ; | \t"]
    return "".join(r.choice(kinds) for _ in range(r.randrange(4)))


def write(path, rows, **options):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, **options).writerows(rows)


def same(spark, path, **options):
    one = files.load_csv(spark, str(path), split=False, **options)
    many = files.load_csv(spark, str(path), split=True, **options)
    assert one.dtypes == many.dtypes
    assert sorted(map(repr, one.collect())) == sorted(map(repr, many.collect()))
    return many


@pytest.mark.parametrize("seed", range(4))
def test_rows_equal_the_whole_file_reader(spark, small_splits, tmp_path, seed):
    r = random.Random(seed)
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        rows = [("n", "text", "more", "x")] + [(i, odd_text(r), odd_text(r), r.random()) for i in range(60)]
        if seed == 1:
            rows.insert(40, (999, "long\n" * 600, "one field over many splits", 0.5))
        write(folder / f"{k}.csv", rows, quoting=csv.QUOTE_ALL if seed == 2 else csv.QUOTE_MINIMAL)
    many = same(spark, folder)
    assert many.count() == 120 + 2 * (seed == 1)


def test_quotes_inside_plain_fields_open_nothing(spark, small_splits, tmp_path):
    lines = ["a,b"] + [f'{i},5" pipe {i}' if i % 3 else f'"{i}",6"' for i in range(300)] + ['7,"open\nto the end,']
    (tmp_path / "q.csv").write_text("\n".join(lines))
    same(spark, tmp_path / "q.csv")


def test_one_file_is_read_by_many_tasks(spark, small_splits, tmp_path):
    write(tmp_path / "t.csv", [("a", "b")] + [(i, "two\nlines") for i in range(500)])
    records = files.quoted_records(spark, str(tmp_path / "t.csv"), ",")
    assert records.rdd.getNumPartitions() > 5
    assert records.count() == 501 and records.where("first").count() == 1
    assert files._needs_splits(spark, str(tmp_path / "t.csv"))
    assert files.load_csv(spark, str(tmp_path / "t.csv")).count() == 500


def test_crlf_latin1_header_and_blank_lines(spark, small_splits, tmp_path):
    text = "name,name,\r\n" + "\r\n".join(f'Jos\xe9 {i},"K\xf6ln,\r\nx",{i}' for i in range(100)) + "\r\n\r\n"
    (tmp_path / "l.csv").write_bytes(text.encode("latin-1"))
    many = files.load_csv(spark, str(tmp_path / "l.csv"), split=True)
    assert many.columns == ["name0", "name1", "_c2"] and many.count() == 100
    row = many.where("_c2 = 7").first()
    assert (row["name0"], row["name1"]) == ("José 7", "Köln,\nx")
    assert files.load_csv(spark, str(tmp_path / "l.csv"), split=True, header=False).count() == 101


def test_nothing(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    got = files.load_csv(spark, str(tmp_path / "e.csv"), split=True)
    assert got.columns == ["a", "b"] and got.count() == 0


def test_states():
    assert files._quote_state('a,"b', ",", False) and not files._quote_state('a,"b"', ",", False)
    assert files._quote_state('x""y', ",", True) and not files._quote_state('x",y', ",", True)
    assert files._quote_state('x","y', ",", True) and not files._quote_state('5" a', ",", False)
    assert not files._quote_state("", ",", False) and files._quote_state("", ",", True)


def test_types_from_kinds(spark, tmp_path):
    write(tmp_path / "k.csv", [list("abcdefgh"), ["1", "9999999999", "1", "true", "2024-01-02", "2024-01-02", "x", "NA"],
                               ["2", "3", "2.5", "FALSE", "2024-02-30", "2024-01-02 03:04:05", "1", ""],
                               [" 3 ", "4", "1e5", "", "", "", "2024-01-01", "null"]])
    assert dict(files.load_csv(spark, str(tmp_path / "k.csv")).dtypes) == {
        "a": "int", "b": "bigint", "c": "double", "d": "boolean", "e": "string", "f": "timestamp", "g": "string", "h": "string"}


def test_json_list_of_one_object_keeps_its_fields(spark, tmp_path):
    (tmp_path / "j.json").write_text('[{"a": 1, "tags": [{"t": "x"}, {"t": "y"}]}]')
    row = files.load_json_records(spark, str(tmp_path / "j.json")).collect()
    assert len(row) == 1 and row[0].a == 1 and len(row[0].tags) == 2
