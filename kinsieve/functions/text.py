"""Words, word n-grams and small string rules, all as built-in expressions.

A word is a maximal run of Unicode letters, digits and underscores of the lower-cased text. Null texts have no words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Characters at which a text is divided into lines.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def ngrams(tokens: Column, n: int) -> Column:
    """The distinct runs of n words, each joined by blanks (words hold none); empty for fewer than n words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def let(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def lines(text: Column) -> Column:
    """Lines without their breaks; no last empty line."""
    def whole(parts):
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    return let(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), whole)


def stripped(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one blank."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def joined_fields(*fields: Column | str) -> Column:
    """Fields joined by single blanks; a null field counts as empty and keeps its blank."""
    return F.concat_ws(" ", *[F.coalesce(F.col(f) if isinstance(f, str) else f, F.lit("")) for f in fields])


def ratio_label(part: Column, whole: Column) -> Column:
    return F.concat(part.cast("string"), F.lit(" of "), whole.cast("string"))
