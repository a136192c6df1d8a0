"""File sources and sinks: CSV (delimiter and encoding detection), Parquet,
JSON records, and a CSV writer."""

from __future__ import annotations

import csv
import io
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datalathe.functions.stats import agg_in_chunks
from datalathe.functions.types import col, nan_to_null, string_columns

# Delimiters tried, in order of preference, and how much text
# the detection reads.
DELIMITERS = [",", ";", "\t", "|"]
SNIFF_CHARS = 1024
SNIFF_LINES = 50
# Texts that read as missing, as pandas has them.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
             "NaN", "None", "n/a", "nan", "null"]
REPLACEMENT_CHAR = "\ufffd"
FALLBACK_ENCODING = "ISO-8859-1"
# Encodings in which a newline, a quote and a separator are single bytes of their own.
SPLITTABLE = ("UTF-8", "ISO-8859-1", "US-ASCII")


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that occurs the same non-zero number of times on every
    sampled line (the most often, if several do); ``,`` when none does."""
    lines = [ln for ln in lines if ln.strip()]
    if len(lines) > 1:
        lines = lines[:-1] if sum(len(x) for x in lines) >= SNIFF_CHARS else lines  # last line may be cut
    best, best_n = None, 0
    for d in DELIMITERS:
        counts = {ln.count(d) for ln in lines}
        if len(counts) == 1:
            n = counts.pop()
            if n > best_n:
                best, best_n = d, n
    if best is not None:
        return best
    # no delimiter is even on every line: take the one present on most lines
    scored = [(sum(1 for ln in lines if d in ln), -i, d) for i, d in enumerate(DELIMITERS)]
    top = max(scored)
    return top[2] if top[0] > 0 else ","


def _head_lines(spark: SparkSession, path: str) -> list[str]:
    """At most ~1 KB of leading lines; ``limit`` stops after the first split."""
    rows = spark.read.text(path).limit(SNIFF_LINES).collect()
    out, total = [], 0
    for r in rows:
        out.append(r[0])
        total += len(r[0]) + 1
        if total >= SNIFF_CHARS:
            break
    return out


# Kinds of a text value, one bit each; a column's type follows from the kinds its values have.
INT, BIGINT, DOUBLE, BOOLEAN, DATE, TIMESTAMP, OTHER = (1 << k for k in range(7))
_TYPES = [("int", INT), ("bigint", INT | BIGINT), ("double", INT | BIGINT | DOUBLE), ("boolean", BOOLEAN), ("date", DATE), ("timestamp", DATE | TIMESTAMP)]


def _kind(c):
    """The narrowest kind of one value; the tests stop at the first that holds. A number with an exponent or a fraction
    is no integer, whatever a cast makes of it."""
    whole, dated = c.rlike(r"^\s*[+-]?\d+\s*$"), c.rlike(r"^\d{4}-\d{2}-\d{2}")
    return (F.when(whole, F.when(c.try_cast("int").isNotNull(), INT).when(c.try_cast("bigint").isNotNull(), BIGINT).otherwise(DOUBLE))
            .when(dated, F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & c.try_cast("date").isNotNull(), DATE)
                  .when(c.try_cast("timestamp").isNotNull(), TIMESTAMP).otherwise(OTHER))
            .when(c.try_cast("double").isNotNull(), DOUBLE).when(F.lower(c).isin("true", "false"), BOOLEAN).otherwise(OTHER))


def _infer(raw: DataFrame, bad_marks: bool = True) -> tuple[dict[str, str], bool]:
    """The narrowest type that every value of a text column has, and whether any text holds U+FFFD: one aggregate
    over the whole table, one bit set a column."""
    names, aggs = raw.columns, []
    for i, name in enumerate(names):
        c = col(name)
        aggs.append(F.bit_or(F.when(c.isNotNull(), _kind(c))).alias(f"k{i}"))
        if bad_marks:
            aggs.append(F.max(F.instr(c, REPLACEMENT_CHAR) > 0).alias(f"bad{i}"))
    if not names:
        return {}, False
    r = agg_in_chunks(raw, aggs, 1_000)
    types = {}
    for i, name in enumerate(names):
        seen = r[f"k{i}"]
        types[name] = "string" if not seen else next((t for t, allowed in _TYPES if seen | allowed == allowed), "string")
    return types, bad_marks and any(r[f"bad{i}"] for i in range(len(names)))


def _quote_state(line: str, sep: str, inside: bool) -> bool:
    """Whether a line ends inside quotes, if it begins so or not. A quote opens only at the start of a field; within
    quotes two are one; after the closing quote the field goes on to the next separator."""
    at, n = 0, len(line)
    while True:
        if not inside:
            while at < n and line[at] != '"':  # a field without quotes
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
            if at >= n:
                return False
            at += 1
        at = line.find('"', at)
        while at >= 0 and line.startswith('"', at + 1):
            at = line.find('"', at + 2)
        if at < 0:
            return True
        at = line.find(sep, at + 1)
        if at < 0:
            return False
        at, inside = at + len(sep), False


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines of all files with the split that each begins in; splits are read by tasks of their own."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    # the text source keeps bytes as they are: what is no UTF-8 becomes U+FFFD here, as in Spark's CSV reader
    return raw.withColumn("value", F.make_valid_utf8("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding))


def _splits(batches):
    """``((file, split), lines)`` of the runs of one split within Arrow batches."""
    for batch in batches:
        files, splits, lines = (c.to_pylist() for c in (batch.column("file"), batch.column("split"), batch.column("value")))
        start = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or splits[k] != splits[start] or files[k] != files[start]:
                yield (files[start], splits[start]), lines[start:k]
                start = k


def quoted_records(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> DataFrame:
    """Rows ``(record, first)`` of CSV files whose fields in quotes may hold newlines, read by as many tasks as the files
    have splits; ``first`` marks a file's first record.

    A split cannot know whether it begins inside quotes. The first pass therefore finds for each split how it would end
    from either state. These functions compose along a file (one row for each split), which gives the state that every
    split really begins in. The second pass puts lines together to records. What reaches over the end of a split, a piece
    or two for each, is joined with the pieces of the following splits.
    """
    lines = _lines(spark, path, encoding)

    def ends(batches):
        now, state = None, None
        out = []
        for split, texts in _splits(batches):
            if split != now:
                if now is not None:
                    out.append((*now, *state))
                now, state = split, [False, True]
            for text in texts:
                if '"' in text:
                    state = [_quote_state(text, sep, s) for s in state]
        if now is not None:
            out.append((*now, *state))
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "split", "from_outside", "from_inside"), r)) for r in out],
                                         schema=pa.schema([("file", pa.string()), ("split", pa.int64()), ("from_outside", pa.bool_()), ("from_inside", pa.bool_())]))

    found = lines.mapInArrow(ends, "file string, split bigint, from_outside boolean, from_inside boolean")
    # the state before a split: what the last split with one answer for both states said, turned round by every later
    # split that swaps them; before any such split, the file's own beginning (outside) counts
    along = Window.partitionBy("file").orderBy("split")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    sure = F.when(F.col("from_outside") == F.col("from_inside"), F.struct(F.col("from_outside").alias("state"), F.col("swaps")))
    swaps = F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    start = found.withColumn("swaps", swaps).withColumn("last", F.last(sure, ignorenulls=True).over(before)).withColumn("so_far", F.lag("swaps", 1, 0).over(along))
    state = F.coalesce(F.col("last.state"), F.lit(False)).cast("int") + F.col("so_far") - F.coalesce(F.col("last.swaps"), F.lit(0))
    start = start.select("file", "split", (state % 2 == 1).alias("inside"))
    if start.isEmpty():
        return spark.createDataFrame([], "record string, first boolean")
    begun = lines.join(F.broadcast(start), ["file", "split"])  # a row for each split: a terabyte has some eight thousand

    def assemble(batches):
        """part 0: a whole record, 1: the end of one that began before, 2: the beginning of one, 3: all inside of one."""
        schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("part", pa.int32()), ("record", pa.string()), ("first", pa.bool_())])

        def rows(split, found):
            return pa.RecordBatch.from_arrays([pa.array([split[0]] * len(found), pa.string()), pa.array([split[1]] * len(found), pa.int64()),
                                               pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string()),
                                               pa.array([f[2] for f in found], pa.bool_())], schema=schema)

        now, waiting, inside, goes_on, first = None, [], False, False, False
        for batch in batches:
            states = batch.column("inside").to_pylist()
            at = 0
            for split, texts in _splits([batch]):
                found = []
                if split != now:
                    if waiting:
                        yield rows(now, [(3 if goes_on else 2, "\n".join(waiting), first)])
                    now, waiting, inside, goes_on, first = split, [], states[at], states[at], split[1] == 0
                at += len(texts)
                for text in texts:
                    if '"' in text:
                        inside = _quote_state(text, sep, inside)
                    waiting.append(text)
                    if not inside:
                        found.append((1 if goes_on else 0, "\n".join(waiting), first))
                        waiting, goes_on, first = [], False, False
                if found:
                    yield rows(now, found)
        if waiting:
            yield rows(now, [(3 if goes_on else 2, "\n".join(waiting), first)])

    parts = begun.mapInArrow(assemble, "file string, split bigint, part int, record string, first boolean")
    whole = parts.where("part = 0").select("record", "first")
    # a beginning opens a record; the pieces after it, up to the next beginning, belong to it
    in_order = Window.partitionBy("file").orderBy("split", F.col("part") == 2).rowsBetween(Window.unboundedPreceding, 0)
    torn = parts.where("part > 0").withColumn("number", F.sum((F.col("part") == 2).cast("int")).over(in_order))
    joined = torn.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("split", "record", "first"))).alias("pieces")).select(
        F.array_join(F.col("pieces.record"), "\n").alias("record"), F.element_at("pieces", 1)["first"].alias("first"))
    return whole.unionByName(joined)


def _columns_of(names: list[str]) -> list[str]:
    """Header cells as column names: empty ones by position, repeated ones with their position behind."""
    low = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _split_csv(spark: SparkSession, path: str, sep: str, header: bool, encoding: str) -> DataFrame:
    """All columns of quoted CSV as text, through :func:`quoted_records`."""
    records = quoted_records(spark, path, sep, encoding)
    head = records.where("first").orderBy("record").limit(1).collect()
    if head and head[0]["record"].endswith("\r"):  # lines end with \r\n: as Spark's reader does, one within quotes becomes \n
        records = records.select(F.regexp_replace(F.regexp_replace("record", "\r$", ""), "\r\n", "\n").alias("record"), "first")
        head = [{"record": head[0]["record"][:-1].replace("\r\n", "\n")}]
    records = records.where(F.col("record") != "")
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if not head:
        return spark.createDataFrame([], T.StructType([]))
    cells = next(csv.reader(io.StringIO(head[0]["record"]), delimiter=sep))
    names = _columns_of(cells) if header else [f"_c{i}" for i in range(len(cells))]
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = records.where(~F.col("first")) if header else records
    parsed = rows.select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def _split_bytes(spark: SparkSession) -> int:
    """``spark.sql.files.maxPartitionBytes`` in bytes."""
    text = spark.conf.get("spark.sql.files.maxPartitionBytes", "128m").strip().lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(text[-1:], 1)
    return int(text.rstrip("kmgt")) * unit


def _needs_splits(spark: SparkSession, path: str) -> bool:
    """Whether a file is larger than one task should read. Sizes come from the listing; no file is opened."""
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0
    return largest > _split_bytes(spark)


def load_csv(spark: SparkSession, path: str, *, sep: str | None = None, header: bool = True,
             infer_schema: bool = True, encoding: str | None = None, schema=None,
             nan_as_null: bool = True, multi_line: bool = True, na_values=NA_TOKENS, split: bool | None = None) -> DataFrame:
    """Read CSV with the first line as header and inferred types.

    ``sep=None`` detects the delimiter from the first kilobyte. Fields in quotes may hold newlines and doubled quotes;
    ``multi_line=False`` promises that none holds a newline. Spark's reader gives a file with such fields to one task;
    ``split=True`` reads it in parallel through :func:`quoted_records`, and by default that is done as soon as a file is
    larger than a task's share (``spark.sql.files.maxPartitionBytes``). Rows are the same either way.

    ``na_values`` read as null, before types are inferred. Spark does not fail on bad UTF-8 (it writes U+FFFD), so without
    an explicit ``encoding`` a table with U+FFFD anywhere is read again as ISO-8859-1. Repeated header names get Spark's
    position suffix (pandas writes ``.1``). Types and encoding are found by one pass over the whole table; pass ``schema``
    and ``encoding`` to save it.
    """
    sep = sep or sniff_delimiter(_head_lines(spark, path))
    reader = (spark.read.option("header", header).option("sep", sep).option("mode", "PERMISSIVE").option("multiLine", multi_line)
              .option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if split is None:
        split = multi_line and schema is None and (encoding or "UTF-8") in SPLITTABLE and _needs_splits(spark, path)
    if schema is not None:
        df = reader.schema(schema).option("encoding", encoding or "UTF-8").csv(path)
        if encoding is None and _infer(df.select(*[col(c) for c in string_columns(df)]))[1]:
            df = reader.option("encoding", FALLBACK_ENCODING).csv(path)
        return nan_to_null(df) if nan_as_null else df

    def text(code: str) -> DataFrame:
        raw = _split_csv(spark, path, sep, header, code) if split else reader.option("encoding", code).csv(path)
        return raw.select(*[F.when(~F.trim(col(c)).isin(list(na_values)), col(c)).alias(c) for c in raw.columns]) if nan_as_null else raw

    raw = text(encoding or "UTF-8")
    types, bad = _infer(raw, bad_marks=encoding is None) if infer_schema or encoding is None else ({}, False)
    if encoding is None and bad:
        raw = text(FALLBACK_ENCODING)
        types = _infer(raw, bad_marks=False)[0] if infer_schema else {}
    df = raw.select(*[col(c).cast(types[c]).alias(c) if infer_schema and types[c] != "string" else col(c) for c in raw.columns])
    return nan_to_null(df) if nan_as_null else df


def load_parquet(spark: SparkSession, path: str, *, nan_as_null: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df) if nan_as_null else df


def _first_record_array(schema: T.StructType) -> str | None:
    for f in schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            return f.name
    return None


def _flatten(schema: T.StructType, prefix: str = "") -> list:
    out = []
    for f in schema.fields:
        name = prefix + f.name
        if isinstance(f.dataType, T.StructType):
            out += _flatten(f.dataType, name + ".")
        else:
            out.append(F.col("`" + "`.`".join(name.split(".")) + "`").alias(name))
    return out


def records_frame(df: DataFrame, is_array: bool = False) -> DataFrame:
    """Shape JSON read by Spark into a table, as the reference shapes an API
    response: a list of objects is the table (``is_array``, or more than one
    row); a single object holding a list of objects becomes that list
    (exploded; "first" is the first such field in Spark's alphabetical schema
    order); any other single object is one row with nested fields flattened to
    dotted names. A list of one object is a table of one row."""
    if is_array or df.limit(2).count() != 1:
        return df
    key = _first_record_array(df.schema)
    if key is not None:
        return df.select(F.explode(F.col(f"`{key}`")).alias("__r")).select("__r.*")
    return df.select(*_flatten(df.schema))


def _first_text(spark: SparkSession, path: str) -> str:
    """The first line that is not blank."""
    return next((ln.strip() for ln in _head_lines(spark, path) if ln.strip()), "")


def _is_lines(first: str) -> bool:
    """JSON Lines if the first line that is not blank is a whole object; an array or a cut object is one document."""
    if not first.startswith("{"):
        return False
    try:
        json.loads(first)
    except ValueError:
        return False
    return True


def load_json_records(spark: SparkSession, path: str, *, multi_line: bool | None = None) -> DataFrame:
    """JSON records. JSON Lines stay splittable; ``multi_line=None`` tells them from a document by the first line."""
    first = _first_text(spark, path)
    lines = _is_lines(first) if multi_line is None else not multi_line
    df = spark.read.option("multiLine", not lines).json(path)
    return nan_to_null(records_frame(df, is_array=first.startswith("[")))


def load(spark: SparkSession, path: str, file_type: str = "csv", **options) -> DataFrame:
    """Load by type: ``csv``, ``parquet`` or ``json``. Excel has no Spark
    reader; convert it to CSV or Parquet first."""
    if file_type == "csv":
        return load_csv(spark, path, **options)
    if file_type == "parquet":
        return load_parquet(spark, path, **options)
    if file_type == "json":
        return load_json_records(spark, path, **options)
    raise ValueError(f"unsupported file type {file_type!r}")


def require_rows(df: DataFrame) -> DataFrame:
    """Error on an empty result (the reference refuses to load one)."""
    if df.isEmpty():
        raise ValueError("Query returned no data")
    return df


def write_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> str:
    """Whole table as CSV with a header, one file per partition, no index; quotes in texts are doubled."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path
