"""One query for each operator, over its whole table with production parameters, and SQL where it can say the same.

Numbers 1, 2, 4, 5, 6 and 10 have no SQL: tokens need the tokenizers library's tables, byte ranges and learnt spans or
models have no plain SQL. tests/llm compares them with brute force. Number 3's verdict rests on distances whose SQL
would repeat the operator; its base figures are tested by brute force as well."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import datalathe
from datalathe.llm import bpe, chat, convtrie, counts, exact, lm, near, packing, pii, quality, ranking, secrets, suffix

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package: once for each application, as any job with modules of its own."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top, data = Path(datalathe.__file__).parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    handle, path = tempfile.mkstemp(suffix=".zip", prefix="datalathe-")  # the driver serves it to the executors
    with os.fdopen(handle, "wb") as f:
        f.write(data.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    out = bpe.encode_decode(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    out = packing.pack(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_suffix(spark: SparkSession, sf: str) -> DataFrame:
    out = suffix.repeated_strings(documents(spark, sf), depth=200)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def counted(kinds: list[str]) -> list[Column]:
    """How many base spans each kind has. Spark gives a function of two parameters the place as the second one, so the
    kind comes from a function around it."""
    of = lambda k: lambda s: s["kind"] == k
    return [F.size(F.filter("base", of(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(kinds)]


def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    out = pii.find_personal(documents(spark, sf))
    return out.select("doc_id", *counted(pii.KINDS[:4]), F.sha2(pii.written("base").cast("binary"), 256).alias("base_sha256"), pii.written("found").alias("spans"))


def op6_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.count_tokens(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op7_exact(spark: SparkSession, sf: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf))


def op8_near(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_groups(documents(spark, sf), shingle=3, percent=85)


def op9_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are a pair, the even one chosen."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    out = chat.format_preferences(turns, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0)
    said = lambda mask: F.array_join(F.transform(mask, lambda m: F.concat_ws(":", m["length"], m["learn"].cast("int"))), ",")
    return out.select("pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", said("chosen_mask").alias("chosen_mask"), said("rejected_mask").alias("rejected_mask"))


def op10_lm(spark: SparkSession, sf: str) -> DataFrame:
    return lm.lm_scores(documents(spark, sf))


def op11_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations rebuilt upon the first turns of every fifth one, so that they share prefixes."""
    ship(spark)
    turns = convtrie.numbered_turns(spark.read.parquet(f"{sf}/conversations.parquet"))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    rebuilt, convs = convtrie.with_shared_heads(turns, head, F.col("conv") - F.col("conv") % 5)
    return convtrie.prefix_nodes(rebuilt, convs).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                                                        F.col("saved_bytes").alias("saved_tokens"), "ends_sha256")


def op12_ranking(spark: SparkSession, sf: str) -> DataFrame:
    index = ranking.build_index(documents(spark, sf))
    return ranking.rank(index, spark.read.parquet(f"{sf}/benchmark.parquet"), k=50).select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op13_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """A document's source is its owner; each document is a repository."""
    out = secrets.scan_secrets(documents(spark, sf), owner="source")
    return out.select("doc_id", *counted(secrets.KINDS[:3]), F.sha2(secrets.written("base").cast("binary"), 256).alias("base_sha256"), secrets.written("found").alias("spans"),
                      F.size(F.filter("found", lambda s: s["live"])).cast("bigint").alias("n_live"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return corpus_pipeline.run(spark, sf)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_packing, op3_quality, op4_suffix, op5_pii, op6_counts, op7_exact, op8_near, op9_chat, op10_lm, op11_trie, op12_ranking, op13_secrets, pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RENDER = "lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)"
_MASK = """lambda x: (length(x.role) + 13) || ':0,' || (length(x.text) + 11) || ':' || (CASE WHEN x.role = 'assistant' THEN 1 ELSE 0 END)"""

ORACLE = {
    "op7_exact": f"""
        WITH n AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)""",
    "op8_near": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        one AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.c = l.a)
        SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(r.c) AS component_id, s.doc_id = min(r.c) AS kept
        FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id""",
    "op9_chat": f"""
        WITH p AS (
            SELECT conv_id // 2 AS pair_id,
                   coalesce(list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn, role, text) FILTER (WHERE conv_id % 2 = 0), []) AS a,
                   coalesce(list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn, role, text) FILTER (WHERE conv_id % 2 = 1), []) AS b
            FROM conversations GROUP BY 1),
        q AS (SELECT *, list_position(list_transform(range(1, greatest(len(a), len(b)) + 1),
                  lambda i: coalesce(a[i].role = b[i].role AND a[i].text = b[i].text, false)), false) AS differ FROM p),
        r AS (SELECT *, CAST(CASE WHEN coalesce(differ, 0) = 0 THEN len(a) ELSE differ - 1 END AS INTEGER) AS n FROM q)
        SELECT pair_id, n AS n_prompt_turns,
               coalesce(array_to_string(list_transform(a[1:n], {_RENDER}), ''), '') AS prompt,
               coalesce(array_to_string(list_transform(a[n + 1:], {_RENDER}), ''), '') AS chosen,
               coalesce(array_to_string(list_transform(b[n + 1:], {_RENDER}), ''), '') AS rejected,
               coalesce(array_to_string(list_transform(a[n + 1:], {_MASK}), ','), '') AS chosen_mask,
               coalesce(array_to_string(list_transform(b[n + 1:], {_MASK}), ','), '') AS rejected_mask FROM r""",
}
_CRC_STEP = "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                       lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {_CRC_STEP})))"""
ORACLE["op11_trie"] = f"""
    WITH t AS (
        SELECT conv_id AS c, [coalesce(role, ''), coalesce(text, '')] AS x,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
        FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, list(x ORDER BY p) AS s FROM t GROUP BY c),
    h AS (SELECT c, s, {_CRC} % 9 AS h FROM own),
    r AS (SELECT h.c, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN own b ON b.c = h.c - h.c % 5),
    e AS (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r),
    n AS (SELECT d, s[1:d] AS k, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(s) = d), '') AS ends
          FROM e GROUP BY ALL),
    m AS (SELECT n.*, coalesce(y.n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(k[d][2]) END AS saved
          FROM n LEFT JOIN (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL) y USING (d, k))
    SELECT a.conv_id, a.d AS depth, (SELECT z.conv_id FROM n z WHERE z.d = a.d - 1 AND z.k = a.k[1:a.d - 1]) AS parent_conv_id, a.n_convs,
           CAST(a.n_children AS BIGINT) AS n_children, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
    FROM m a JOIN m b ON b.d >= a.d AND b.k[1:a.d] = a.k GROUP BY ALL"""
_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE["op12_ranking"] = f"""
    WITH t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
    p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
    c AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term, nd),
    i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) AS BIGINT) AS score
          FROM i JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), c GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50"""
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
