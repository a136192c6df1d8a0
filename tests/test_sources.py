import json

import pytest

from datalathe.sources import databases, files


def test_sniff():
    assert files.sniff_delimiter(["a\tb\tc", "1\t2\t3"]) == "\t"
    assert files.sniff_delimiter(["a;b", "1;2", "3;4"]) == ";"
    assert files.sniff_delimiter(["a,b|c", "1,2|3"]) == ","
    assert files.sniff_delimiter(["plain", "text"]) == ","


def test_tab_survey_header_repeats(spark, tmp_path):
    # no header line: the first line becomes the header, repeated names get renamed
    p = tmp_path / "survey.csv"
    p.write_text("a\t1\t1\t2\t2\tz\nb\t3\t4\t5\t6\ty\nc\t7\t8\t9\t10\tx\n")
    df = files.load_csv(spark, str(p))
    assert df.count() == 2 and len(df.columns) == 6 and len(set(df.columns)) == 6
    assert files.load_csv(spark, str(p), header=False).count() == 3


def test_monthly_sales_types(spark, tmp_path):
    p = tmp_path / "s.csv"
    p.write_text("month,sales,profit\nJan,100,10\nFeb,150,15\nMar,100,12\n")
    df = files.load_csv(spark, str(p))
    assert dict(df.dtypes) == {"month": "string", "sales": "int", "profit": "int"}


def test_latin1_fallback(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_bytes("name,city\nJos\xe9,K\xf6ln\n".encode("latin-1"))
    row = files.load_csv(spark, str(p)).first()
    assert (row["name"], row["city"]) == ("José", "Köln")


def test_json_shapes(spark, tmp_path):
    a = tmp_path / "a.json"
    a.write_text(json.dumps([{"x": 1, "y": "a"}, {"x": 2, "y": "b"}]))
    assert files.load_json_records(spark, str(a)).count() == 2
    b = tmp_path / "b.json"
    b.write_text(json.dumps({"meta": {"n": 2}, "items": [{"x": 1}, {"x": 2}, {"x": 3}]}))
    assert [r["x"] for r in files.load_json_records(spark, str(b)).collect()] == [1, 2, 3]
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"id": 7, "owner": {"name": "ann", "team": {"code": "t1"}}}))
    df = files.load_json_records(spark, str(c))
    assert sorted(df.columns) == ["id", "owner.name", "owner.team.code"]


def test_csv_sink_roundtrip(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "CAST(id AS DOUBLE) / 2 AS half")
    out = files.write_csv(df, str(tmp_path / "out"))
    back = files.load_csv(spark, out)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_empty_result(spark):
    with pytest.raises(ValueError):
        files.require_rows(spark.range(0))


def test_read_only_guard():
    assert databases.read_only_guard("SELECT created_at, updated FROM t")
    for q in ["DROP TABLE t", "select 1; delete from t", "INSERT INTO t VALUES (1)", "grant all on t to u"]:
        with pytest.raises(PermissionError):
            databases.read_only_guard(q)
    with pytest.raises(ValueError):
        databases.read_only_guard("  ")
    with pytest.raises(ValueError):
        databases.connect(None, "postgresql", query="select 1")


def test_csv_quotes_newlines_and_missing_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,t\n1,"two\nlines"\nNA,"say ""hi"", ok"\n2.5,plain\n')
    got = files.load_csv(spark, str(tmp_path / "a.csv"))
    assert dict(got.dtypes) == {"n": "double", "t": "string"}
    assert sorted(map(tuple, got.fillna(0.0).collect())) == [(0.0, 'say "hi", ok'), (1.0, "two\nlines"), (2.5, "plain")]


def test_csv_bad_byte_far_down(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes(b"x,y\n" + b"a,1\n" * 100_500 + "é,2\n".encode("latin-1"))
    got = files.load_csv(spark, str(tmp_path / "b.csv"))
    assert got.where("y = 2").first().x == "é"


def test_json_lines_by_default(spark, tmp_path):
    (tmp_path / "c.json").write_text("".join(f'{{"a": {i}}}\n' for i in range(5)))
    (tmp_path / "d.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert files.load(spark, str(tmp_path / "c.json"), "json").count() == 5
    assert files.load(spark, str(tmp_path / "d.json"), "json").count() == 2
