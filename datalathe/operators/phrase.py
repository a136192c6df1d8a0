"""Plain-language filter: ``"show rows where price >= 5 and city = Paris"``
becomes a Column; a phrase that does not read as conditions falls back to a
keyword search over every column.

The grammar is deliberately small: conditions ``column op value`` or
``column op column`` joined by ``and`` / ``or`` / ``&`` / ``|`` (``and``
binds tighter). Column names are matched longest first and in any case;
constants keep their case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datalathe.functions.types import flat_columns, text_form, value
from datalathe.operators.query import compare

# Filler words removed from a phrase, and the spellings of
# each comparison.
FILLER_WORDS = ["show", "rows", "where", "find", "data", "records"]
OPERATORS = [
    (">=", ">="), ("<=", "<="), ("!=", "!="), ("==", "=="), ("<>", "!="),
    ("=", "=="), (">", ">"), ("<", "<"),
    ("is not equal to", "!="), ("not equal to", "!="), ("not equals", "!="),
    ("is greater than", ">"), ("greater than", ">"), ("is less than", "<"), ("less than", "<"),
    ("equals", "=="), ("equal to", "=="), ("equal", "=="), ("is", "=="),
]

_FILLER = re.compile(r"\b(?:" + "|".join(FILLER_WORDS) + r")\b\s*", re.IGNORECASE)
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$")


def strip_filler(phrase: str) -> str:
    return re.sub(r"\s+", " ", _FILLER.sub("", phrase)).strip()


class PhraseError(ValueError):
    pass


def _split_bool(text: str) -> list[list[str]]:
    """``a and b or c`` -> ``[[a, b], [c]]`` (OR of ANDs), outside quotes;
    ``&`` and ``|`` are read as ``and`` / ``or`` as in pandas' query."""
    parts = re.split(r"""\s*(?:\s(and|or)\s|(&|\|))\s*(?=(?:[^'"]*['"][^'"]*['"])*[^'"]*$)""", text,
                     flags=re.IGNORECASE)
    # re.split gives [text, word-or-None, symbol-or-None, text, ...]; fold to [text, op, text, ...]
    folded = [parts[0]]
    for i in range(1, len(parts), 3):
        op = (parts[i] or {"&": "and", "|": "or"}[parts[i + 1]])
        folded += [op, parts[i + 2]]
    parts = folded
    groups, cur = [], [parts[0]]
    for i in range(1, len(parts), 2):
        if parts[i].lower() == "and":
            cur.append(parts[i + 1])
        else:
            groups.append(cur)
            cur = [parts[i + 1]]
    groups.append(cur)
    return groups


def _value(token: str):
    t = token.strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "'\"":
        return t[1:-1]
    if _NUMBER.match(t):
        f = float(t)
        return int(f) if re.fullmatch(r"[-+]?\d+", t) else f
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    return t


def _condition(df: DataFrame, text: str, names: list[str]) -> Column:
    low = text.lower()
    for name in names:  # longest first
        n = name.lower()
        if not low.startswith(n):
            continue
        rest = text[len(name):].strip()
        rest_low = rest.lower()
        for spelling, op in OPERATORS:
            if rest_low.startswith(spelling):
                tail = rest[len(spelling):]
                if spelling[0].isalpha() and tail and not tail[0].isspace():
                    continue
                rhs = tail.strip()
                if not rhs:
                    raise PhraseError(f"no value after {spelling!r}")
                other = next((c for c in names if c.lower() == rhs.lower()), None)
                if other is not None and other != name:
                    return _compare_columns(df, name, op, other)
                return compare(df, name, op, _value(rhs))
    raise PhraseError(f"cannot read condition {text!r}")


def _compare_columns(df: DataFrame, left: str, op: str, right: str) -> Column:
    """``column op column`` (pandas' query allows it); NaN and null match
    nothing except ``!=``."""
    a, b = value(df, left), value(df, right)
    if op == "==":
        return a == b
    if op == "!=":
        return ~a.eqNullSafe(b)
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def phrase_condition(df: DataFrame, phrase: str) -> Column:
    """The Column a phrase stands for; raises :class:`PhraseError`."""
    text = strip_filler(phrase)
    if not text:
        raise PhraseError("empty phrase")
    names = sorted(df.columns, key=len, reverse=True)
    cond = None
    for group in _split_bool(text):
        part = None
        for item in group:
            c = _condition(df, item.strip(), names)
            part = c if part is None else part & c
        cond = part if cond is None else cond | part
    return cond  # a filter drops null as it drops false, and a bare condition can be pushed to the scan


def keyword_filter(df: DataFrame, keyword: str) -> DataFrame:
    """Rows where any column's text form matches ``keyword`` (regex, any
    case); null never matches."""
    cols = flat_columns(df)
    cond = None
    for c in cols:
        m = F.coalesce(text_form(c, df.schema[c].dataType).rlike("(?iu)" + keyword), F.lit(False))
        cond = m if cond is None else cond | m
    return df.filter(cond) if cond is not None else df.limit(0)


def phrase_filter(df: DataFrame, phrase: str) -> DataFrame:
    """Filter by a plain-language phrase, else keyword search on the phrase
    with filler words removed."""
    try:
        return df.filter(phrase_condition(df, phrase))
    except PhraseError:
        return keyword_filter(df, strip_filler(phrase))
