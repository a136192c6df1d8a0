"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram over character classes and its histogram over common
words are compared with references of several languages by the Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1). The references are
the summed histograms of the documents that pass the base rules, by language.
A document is rejected only if it is far from every language."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datalathe.llm.text import stored

#: Common words that tell languages apart (fixed values).
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se"],
}
#: ASCII white space, and further character classes as regular expressions; lower-case letters, characters outside
#: ASCII and white space are three more classes.
SPACE = r"[\x20\x09-\x0D]+"
CLASSES = {"digit": "[0-9]+", "upper": "[A-Z]+", "stop": "[.,;:!?'\"()-]+", "sign": r"[#*$%&|<>=+/@\\_{}\[\]^~]+"}

#: The limit for words stays below the ceiling itself by this factor.
MOST_SHARE = 0.98


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  char_distance: float = 0.29, word_share: float = 0.25, word_noise: float = 7.0, min_chars: int = 200, min_words: int = 50,
                  with_rows: bool = False) -> DataFrame:
    """Base figures, distances and verdict of every whole text.

    Returns one row for each row: the id column, n_words (runs without ASCII white space), word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed (under 50 words, or more than half of them in repeated three-word
    windows), char_jsd and word_jsd (distance to the nearest language; null below the length guards or without any
    reference), kept, and with ``with_rows`` the input row as the struct ``row``. A text's words are far from a language
    if their distance is over ``word_share`` + ``word_noise`` / sqrt(n_words) of the language's ceiling, the distance of
    a text without any common word; the second part is what chance alone does to a short text, and a text without any
    common word is always far. A reference without common words tells nothing about words. A null text has no words and fails the
    base rules. References come from documents that pass the base rules and whose ``lang`` is one of COMMON_WORDS (at
    most four rows on the driver); an empty table gives no rows. Repeated rows are repeated.
    """
    vocabulary = list(dict.fromkeys(w for own in COMMON_WORDS.values() for w in own))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"), F.col(f"`{lang_col}`").alias("lang"),
                     *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if with_rows else []))
    length = F.char_length
    one = rows.select("*", F.array_remove(F.split("t", SPACE), "").alias("words_"),
                      F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines_"))
    two = one.select(
        "*", F.expr("slice(transform(words_, (w, i) -> xxhash64(w, get(words_, i + 1), get(words_, i + 2))), 1, greatest(size(words_) - 2, 0))").alias("windows_"),
        F.array_join("words_", "").alias("joined_"),
        F.concat(F.lit(" "), F.array_join(F.filter("words_", lambda w: w.isin(vocabulary)), "  "), F.lit(" ")).alias("padded_"))
    three = two.select("*", F.expr("size(array_distinct(windows_)) < size(windows_)").alias("again_"),
                       F.regexp_replace("joined_", "[a-z\u00df-\u00ff]+", "").alias("short_"))
    # only where a window occurs again: sorted by hash, equal neighbours, their places in order
    four = three.select("*", F.expr("if(again_, sort_array(transform(windows_, (h, i) -> named_struct('h', h, 'i', i))), null)").alias("sorted_"))
    five = four.select("*", F.expr("""sort_array(transform(filter(transform(sorted_, (e, k) -> named_struct('i', e.i, 'twice',
        e.h <=> get(sorted_, k - 1).h or e.h <=> get(sorted_, k + 1).h)), e -> e.twice), e -> e.i))""").alias("places_"))
    hits = [(F.octet_length("padded_") - F.octet_length(F.replace("padded_", F.lit(f" {w} ")))) / (len(w.encode()) + 2) for w in vocabulary]
    counts = [length("short_") - length(F.regexp_replace("short_", p, "")) for p in CLASSES.values()]
    wide = F.octet_length("joined_") - length("joined_")
    lower = length("joined_") - wide
    for c in counts:
        lower = lower - c
    figures = five.select(
        "id", "lang", *(["row"] if with_rows else []), F.size("words_").cast("bigint").alias("n_words"),
        length("joined_").cast("bigint").alias("word_chars"),
        (length("short_") - length(F.regexp_replace("short_", "[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("bigint").alias("n_dup_lines"),
        F.expr("""if(again_, aggregate(transform(places_, (p, k) -> least(3, coalesce(get(places_, k + 1) - p, 3))),
            0L, (s, x) -> s + x), 0L)""").alias("n_repeat_words"),
        length("t").cast("bigint").alias("chars"),
        F.array(*[F.greatest(c, F.lit(0)).cast("double") for c in (lower, wide, length("t") - length("joined_"), *counts)]).alias("char_counts"),
        F.array(*hits).alias("word_hits"))
    figures = figures.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    figures = figures.withColumn("word_counts", F.concat("word_hits", F.array(
        F.col("n_words").cast("double") - F.aggregate("word_hits", F.lit(0.0), lambda s, x: s + x)))).drop("word_hits")
    figures = stored(figures, "quality-figures")

    n_chars, n_common = len(CLASSES) + 3, len(vocabulary) + 1
    references = figures.where(~F.col("base_failed") & F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(
        F.array(*[F.sum(F.get("char_counts", F.lit(i))) for i in range(n_chars)]).alias("c"),
        F.array(*[F.sum(F.get("word_counts", F.lit(i))) for i in range(n_common)]).alias("w")).collect()

    def nearest(distances: list[Column]) -> Column:
        return F.least(*distances, F.lit(1.0)) if distances else F.lit(None).cast("double")

    char_shares, word_shares = ([[x / sum(r[k]) for x in r[k]] for r in references if sum(r[k]) > 0] for k in "cw")
    word_shares = [s for s in word_shares if s[-1] < 1]
    ceilings = [ceiling(s) for s in word_shares]
    char_jsd = F.when(F.col("chars") >= min_chars, nearest([distance("char_counts", s) for s in char_shares]))
    distances = F.when(F.col("n_words") >= min_words, F.array(*[distance("word_counts", s) for s in word_shares]).cast("array<double>"))
    judged = figures.select("*", char_jsd.alias("char_jsd"), distances.alias("distances_"))
    each = [F.get("distances_", F.lit(i)) for i in range(len(word_shares))]
    judged = judged.select("*", F.when(F.col("distances_").isNotNull(), nearest(each)).alias("word_jsd"),
                           nearest([d / c for d, c in zip(each, ceilings, strict=True)]).alias("word_part_"))
    limit = F.least(F.lit(word_share) + F.lit(word_noise) / F.sqrt(F.col("n_words")), F.lit(MOST_SHARE))
    far = F.coalesce(F.col("char_jsd") > char_distance, F.lit(False)) \
        | F.coalesce(F.col("distances_").isNotNull() & (F.col("word_part_") > limit), F.lit(False))
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "char_jsd", "word_jsd", (~F.col("base_failed") & ~far).alias("kept"), *(["row"] if with_rows else []))


def ceiling(reference: list[float]) -> float:
    """The Jensen-Shannon distance to word shares of a text that has none of the common words."""
    rest = reference[-1]
    return math.sqrt((math.log2(2 / (1 + rest)) + (1 - rest) + (rest * math.log2(2 * rest / (1 + rest)) if rest > 0 else 0.0)) / 2)


def distance(counts: str, reference: list[float]) -> Column:
    """Jensen-Shannon distance between an array of counts and reference shares."""
    shares = F.array(*[F.lit(float(x)) for x in reference])
    total = F.expr(f"aggregate({counts}, 0D, (s, x) -> s + x)")

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    parts = F.zip_with(F.transform(F.col(counts), lambda x: x / F.greatest(total, F.lit(1e-9))), shares,
                       lambda p, q: part(p, (p + q) / 2) + part(q, (p + q) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2))
