"""Text expressions: normalization, keys, length features, n-gram similarity."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from itemloom import CHOICES


# Characters that their compatibility form leaves alone, next to whatever other character of this list.
COMPATIBLE = (
    r"\x00-\x9F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E"
    r"\u0400-\u0481\u048A-\u052F\u2012-\u2016\u2018-\u2023\u20A9\u20AC\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF\uAC00-\uD7A3"
)


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return pa.array((unicodedata.normalize("NFKC", v.as_py()) if v.is_valid else None for v in values), pa.string())


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; Spark has no built-in for it, so texts that may change, and only these, go to Python."""
    beyond_ascii = F.regexp_replace(text, r"[\x00-\x7F]++", "")
    return F.coalesce(_nfkc(F.when(beyond_ascii.rlike(f"[^{COMPATIBLE}]"), text)), text)


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White-space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """Missing becomes empty, then NFKC, then squeezed white space."""
    return squeeze(nfkc(F.coalesce(text, F.lit(""))))


def compact_key(text: Column) -> Column:
    """Lower-cased letters and digits only: the key on which two answers count as the same."""
    return F.lower(F.regexp_replace(text, r"(?U)[\s\W_]+", ""))


def stem_key(path: Column) -> Column:
    """File stem in lower case: ``dev/dev_1.jpg`` gives ``dev_1``."""
    base = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.lower(F.regexp_replace(base, r"^(.+)\.[^.]+$", "$1"))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9A-Za-z_\-]", "_")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def pattern_share(text: Column, pattern: str) -> Column:
    """Matches of a one-character pattern divided by text length; 0.0 on empty text."""
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(
        F.regexp_count(text, F.lit(pattern)) / F.length(text)
    )


def has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


# The characters a number-like option may consist of (digits, marks, currency and unit letters).
NUMERIC_LIKE = r"[\d\s.,:%+\-~/₩$€£원개명시분초cmkgmlL]+"


def numeric_like(text: Column) -> Column:
    return text.rlike(rf"(?iuU)\A{NUMERIC_LIKE}\z")


def letters(text: Column) -> Column:
    return F.split(text, "")


def char_ngrams(text: Column, n: int) -> Column:
    """All runs of n characters, one for each start, in one pass over the text; none when the text is shorter.

    No run starts in the middle of a character that takes two units.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?![\uDC00-\uDFFF])(?=(.{{{n}}}))"), F.lit(1))


def ngram_set(text: Column, n: int = 2) -> Column:
    """Distinct n-grams of the lower-cased, blank-free text, which is to be normalized before; shorter text is its own only gram."""
    t = F.lower(F.regexp_replace(text, r"(?U)\s+", ""))
    return (
        F.when(F.length(t) == 0, F.array().cast("array<string>"))
        .when(F.length(t) < n, F.array(t))
        .otherwise(F.array_distinct(char_ngrams(t, n)))
    )


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two sets given as arrays: 1.0 when both are empty, 0.0 when one is."""
    both_empty = (F.size(left) == 0) & (F.size(right) == 0)
    union = F.size(F.array_union(left, right))
    return F.when(both_empty, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(left, right)) / F.greatest(union, F.lit(1))
    )


def char_overlap(left: Column, right: Column) -> Column:
    """Shared characters over all characters; 0.0 when there are none at all."""
    a, b = F.array_distinct(letters(left)), F.array_distinct(letters(right))
    a, b = (F.filter(s, lambda ch: ch != "") for s in (a, b))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def problem_text(question: str = "question", choices=CHOICES) -> Column:
    """Question and lettered options on one line."""
    parts = [F.col(question)]
    for letter, name in zip("ABCD", choices):
        parts += [F.lit(f" [{letter}] "), F.col(name)]
    return F.concat(*parts)


def problem_signature(question: str = "question", choices=CHOICES) -> Column:
    return F.concat_ws(" || ", F.col(question), *[F.col(c) for c in choices])


def option_of(answer: Column, choices=CHOICES) -> Column:
    """The option text an answer letter points at."""
    out = F.when(answer == "a", F.col(choices[0]))
    for letter, name in zip("bcd", choices[1:]):
        out = out.when(answer == letter, F.col(name))
    return out
