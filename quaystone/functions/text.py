"""Text normalisation and shape. Column expressions, but for NFKC, which Spark SQL lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F


# Tokens that say nothing of a topic.
GENERIC = ("it", "就活", "新卒", "方法")


def nfkc(c: Column) -> Column:
    """Compatibility normalisation, in Arrow batches."""

    def normalize(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(normalize, "string")(c)


def normalize_keyword(c: Column, unicode: bool = True) -> Column:
    """NFKC, trimmed, lower case, one space for each run. ``unicode=False`` leaves NFKC out for text known to be in that form."""
    return F.trim(F.regexp_replace(F.lower(nfkc(c) if unicode else c), r"\s+", " "))


def compact(c: Column, unicode: bool = True) -> Column:
    """F1 without spaces."""
    return F.regexp_replace(normalize_keyword(c, unicode), r"\s+", "")


def evidence_key(c: Column, unicode: bool = True) -> Column:
    """lower case without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(nfkc(c) if unicode else c), r"[\s\p{P}\p{S}]+", "")


def replace_all(c: Column, table: dict[str, str]) -> Column:
    """lexical replacements, in the order of the table."""
    for a, b in table.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def alias(c: Column, table: dict[str, str]) -> Column:
    """a token's alias, or itself."""
    if not table:
        return c
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c], c)


def grams(c: Column, n: int = 2) -> Column:
    """the set of character n-grams; shorter texts have none. ``c`` is bound in an array of one, so that it is worked out once and not for each gram."""

    def made(t: Column) -> Column:
        return F.when(F.char_length(t) >= n, F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(c), made)[0]


def jaccard(a: Column, b: Column) -> Column:
    """F16: 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2 * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def overlap_min(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def tokens(c: Column, compounds: tuple[str, ...] = ()) -> Column:
    """X11, default analyser: runs of letters and digits in lower case; adjacent parts of a compound are joined, longest first."""
    c = F.lower(c)
    for x in sorted(compounds, key=len, reverse=True):
        c = F.replace(c, F.lit(x.lower()), F.lit(x.lower().replace(" ", "")))
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def hashtags(c: Column) -> Column:
    """hashtags in their order."""
    return F.regexp_extract_all(c, F.lit(r"#[\p{L}\p{N}_]+"), F.lit(0))


def shape(c: Column, main: Column) -> dict[str, Column]:
    """flags of a title or heading."""
    at = F.instr(F.lower(c), F.lower(main))
    return {
        "char_count": F.char_length(c),
        "has_question": c.rlike(r"[?？]"),
        "has_number": c.rlike(r"[0-9]"),
        "has_bracket": c.rlike(r"[\[\]()【】「」]"),
        "has_separator": c.rlike(r"[|:：\-–]"),
        "main_position": F.when(at == 1, "leading").when(at > 1, "included").otherwise("absent"),
    }


def mention(text: Column, term: Column) -> Column:
    """F21 for spaced scripts: at word boundaries, inside a word only, or absent."""
    low, t = F.lower(text), F.lower(term)
    bounded = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return F.when(F.contains(bounded, F.concat(F.lit(" "), t, F.lit(" "))), "word_boundary").when(F.contains(low, t), "substring_only").otherwise("absent")


def sort_number(c: Column) -> Column:
    """the number in a cell such as 1,200 pcs or ¥300; null if there is none."""
    return F.regexp_replace(F.regexp_extract(c, r"-?[0-9][0-9,]*(\.[0-9]+)?", 0), ",", "").try_cast("double")
