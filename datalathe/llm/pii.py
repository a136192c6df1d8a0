"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

E-mail addresses, IP addresses, card and phone numbers found by rule are the
seeds. The words before a seed or an identifier-like token are lexical
patterns; patterns and their instances form a graph on which scores spread
from the seeds until they stay the same: a pattern scores as its instances do,
an unknown token half of what its best pattern does. Tokens behind patterns of
a high score are reported as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datalathe.llm.text import forget, stored

#: Rules of the seeds (fixed values), without backtracking over long runs. A match may start right after another.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*RULES, "id"]
#: A word with a digit, an underscore or an at sign in it.
TOKEN = r"(?<!\S)[^\s0-9_@]*+[0-9_@]\S*+"
#: What must be in a text for a rule to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "id": None}
#: What an unknown token takes of its best pattern's score, and the change at which the scores count as settled.
SHARE, SETTLED = 0.5, 0.005


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: Column, found: Column) -> Column:
    """Whether a match passes its kind's further test."""
    digits, n = _digits(found), F.char_length(_digits(found))
    octet = lambda x: F.regexp_replace(x, "^0+", "")
    ip = F.forall(F.split(found, r"\."), lambda x: (F.char_length(octet(x)) <= 3) & (F.coalesce(octet(x).try_cast("int"), F.lit(0)) <= 255))
    figure = lambda i: F.substring(digits, n - i + 1, F.lit(1)).try_cast("int")
    luhn = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda s, i: s + F.when(
        i % 2 == 0, 2 * F.coalesce(figure(i), F.lit(0)) - F.when(figure(i) > 4, 9).otherwise(0)).otherwise(F.coalesce(figure(i), F.lit(0))))
    return (F.when(kind == "ip", ip).when(kind == "card", n.between(14, 19) & F.when(n.between(14, 19), luhn % 10 == 0))
            .when(kind == "phone", n.between(10, 15)).otherwise(True))


def find_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_rows: bool = False, least_score: float = 0.75,
                  least_seeds: int = 5, least_length: int = 7, least_digits: int = 4) -> DataFrame:
    """Personal data in every whole text.

    Returns one row for each row: the id column, base and found (arrays of struct<start, kind, end>, code points, end
    exclusive, in order; kind is a place in KINDS), and with ``with_rows`` the input row as the struct ``row``. ``base``
    holds the rules' matches, leftmost and non-overlapping for each kind, that pass the further tests; ``found`` adds
    tokens (kind "id") discovered by context, which never overlap a rule's match, be it valid or refused. A null or empty
    text has none; repeated rows are repeated, and count once as evidence for each distinct token. An empty table gives no
    rows.

    A pattern is the last word, or the last two, before an instance, in lower case. With k distinct seeds among its n
    distinct instances, whose other instances stand behind no better pattern, it settles at k / (n - SHARE * (n - k) + 0.2).
    Patterns with fewer than ``least_seeds`` distinct seeds say nothing. A token is reported behind a pattern of
    ``least_score`` or more if it has ``least_length`` characters and ``least_digits`` digits, or an underscore or at sign.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"),
                     *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if with_rows else []))
    has_digit = F.col("t").rlike("[0-9]")
    hits = []
    for kind in KINDS:
        rule = RULES.get(kind, TOKEN)
        gaps = F.split("t", rule, -1)
        tried = F.col("t").rlike("[0-9_@]") if kind == "id" else has_digit if NEEDS[kind] is None else F.contains("t", F.lit(NEEDS[kind])) & (has_digit if kind != "email" else F.lit(True))
        # the words before a match: the end of the gap, two words at most
        before = F.transform(gaps, lambda g: F.lower(F.regexp_extract(g, r"(?:(?<!\S)(\S++\s++))?(?<!\S)\S++\s++$", 0)))
        hits.append(F.when(tried, F.struct(
            F.lit(kind).alias("kind"), F.transform(gaps, F.char_length).alias("gaps"), F.regexp_extract_all("t", F.lit(rule), 0).alias("found"),
            before.alias("before"))))
    scanned = stored(rows.select(
        F.monotonically_increasing_id().alias("rid"), "id", *(["row"] if with_rows else []),
        F.filter(F.array(*hits), lambda h: F.size(h["found"]) > 0).alias("hits")), "pii-hits")

    # one row for each match; its place is the length of all gaps and matches before it
    each = scanned.select("rid", F.inline("hits")).select("rid", "kind", F.posexplode(F.arrays_zip("gaps", "found", "before")).alias("at", "m")).select(
        "rid", "kind", "at", F.col("m.gaps").alias("gap"), F.col("m.found").alias("text"), F.trim(F.regexp_replace("m.before", r"\s+", " ")).alias("pattern"))
    order = Window.partitionBy("rid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.where("text is not null").withColumn("end", F.sum(F.col("gap") + F.char_length("text")).over(order)) \
        .withColumn("start", F.col("end") - F.char_length("text")).withColumn("valid", F.coalesce(_valid(F.col("kind"), F.col("text")), F.lit(False))) \
        .where((F.col("kind") != "card") | F.char_length(_digits(F.col("text"))).between(14, 19))
    # a token without the punctuation around it
    core = F.regexp_extract("text", r"[A-Za-z0-9](?:.*[A-Za-z0-9])?", 0)
    lead = F.char_length(F.regexp_extract("text", r"^[^A-Za-z0-9]*", 0))
    is_id = F.col("kind") == "id"
    placed = placed.withColumn("start", F.when(is_id, F.col("start") + lead).otherwise(F.col("start"))) \
        .withColumn("text", F.when(is_id, core).otherwise(F.col("text"))).withColumn("end", F.col("start") + F.char_length("text"))
    # of one kind no two matches of a text begin at one place, so both orders are whole and mirror each other
    line = Window.partitionBy("rid").orderBy("start", is_id.cast("int"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("rid").orderBy(F.desc("start"), is_id.cast("int").desc(), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)

    def touches(what: Column) -> Column:
        """Whether such a match overlaps the row's span."""
        ends, starts = F.when(what, F.col("end")), F.when(what, F.col("start"))
        return F.coalesce(F.max(ends).over(line) > F.col("start"), F.lit(False)) | F.coalesce(F.min(starts).over(back) < F.col("end"), F.lit(False))

    spans = stored(placed.withColumns({"seed": touches(~is_id & F.col("valid")), "refused": touches(~is_id & ~F.col("valid"))})
                   .where("valid").select("rid", "kind", "start", "end", "text", "pattern", "seed", "refused"), "pii-spans")

    # the last two words before an instance are one pattern, the last word alone another; what a rule takes is no token
    is_seed = F.col("kind") != "id"
    instances = spans.where("pattern != '' and text != ''").where(is_seed | ~(F.col("seed") | F.col("refused")))
    last = F.substring_index("pattern", " ", -1)
    patterned = instances.select(is_seed.alias("seed"), "text", F.explode(F.array_distinct(F.array("pattern", last))).alias("pattern"))
    edges = patterned.groupBy("pattern", "text").agg(F.max("seed").alias("seed"))
    strong = edges.groupBy("pattern").agg(F.count_if(F.col("seed")).alias("seeds")).where(F.col("seeds") >= least_seeds)
    edges = stored(edges.join(strong.select("pattern"), "pattern", "left_semi"), "pii-edges")
    first = F.max("seed").cast("double").alias("score")
    scores, rounds = edges.groupBy("text").agg(first), []
    while True:
        patterns = edges.join(scores, "text").groupBy("pattern").agg((F.sum("score") / (F.count(F.lit(1)) + F.lit(0.2))).alias("of_pattern"))
        best = edges.join(patterns, "pattern").groupBy("text").agg(F.max("seed").alias("known"), F.max("of_pattern").alias("best"))
        new = stored(best.select("text", "known", "best", F.when(F.col("known"), F.lit(1.0)).otherwise(SHARE * F.col("best")).alias("score")), "pii-scores")
        change = new.join(scores.select("text", F.col("score").alias("old")), "text").agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        forget(*rounds)
        scores, rounds = new, [new]
        if change is None or change < SETTLED:
            break
    shaped = (F.char_length(_digits(F.col("text"))) >= least_digits) | F.col("text").rlike("[_@]")
    unseen = instances.where(~is_seed & (F.char_length("text") >= least_length) & shaped) \
        .join(scores.where(~F.col("known") & (F.col("best") >= least_score)), "text", "left_semi")
    number = F.create_map(*[F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)])
    span = F.struct("start", number[F.col("kind")].alias("kind"), "end")
    taken = spans.where("kind != 'id'").unionByName(unseen.select(spans.columns))
    lists = taken.groupBy("rid").agg(F.sort_array(F.collect_list(F.when(F.col("kind") != "id", span))).alias("base"),
                                     F.sort_array(F.collect_list(span)).alias("found"))
    empty = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    return scanned.drop("hits").join(lists, "rid", "left").select(
        F.col("id").alias(id_col), F.coalesce("base", empty).alias("base"), F.coalesce("found", empty).alias("found"), *(["row"] if with_rows else []))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: str) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.struct(F.lit(1).cast("bigint").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.col(spans), zero, lambda s, x: F.when(x["start"] + 1 < s["at"], s).otherwise(F.struct(
        (x["end"] + 1).alias("at"), F.concat(s["out"], F.substring(text, s["at"], x["start"] + 1 - s["at"]), F.get(names, x["kind"])).alias("out"))))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"], F.char_length(text))))
