"""Answer and cell-value expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemloom import CHOICES
from itemloom.functions.text import strip


def normalize_answer(raw: Column, options: list[Column]) -> Column:
    """Letter in any case, ``(a)`` form, number 1-4, or the text of an option; otherwise null."""
    s = strip(raw.cast("string"))
    low = F.lower(s)
    blank = (s == "") | (low == "nan")
    bracketed = F.regexp_extract(low, r"^\(?([abcd])\)?$", 1)
    by_number = F.when(s.isin("1", "2", "3", "4"), F.element_at(F.array(*map(F.lit, CHOICES)), s.cast("int")))
    # first option whose trimmed text equals the answer
    position = F.array_position(F.array(*[F.coalesce(strip(o.cast("string")), F.lit("")) for o in options]), s)
    by_text = F.when(position > 0, F.element_at(F.array(*map(F.lit, CHOICES)), position.cast("int")))
    return F.when(
        s.isNotNull() & ~blank,
        F.coalesce(F.when(bracketed != "", bracketed), by_number, by_text),
    )


def letter_index(letter: Column) -> Column:
    """1-based slot of an answer letter; null for anything else."""
    pos = F.array_position(F.array(*map(F.lit, CHOICES)), letter)
    return F.when(pos > 0, pos.cast("int"))


def same_value(left: Column, right: Column) -> Column:
    """Equal after trimming, or equal as numbers."""
    a, b = strip(left.cast("string")), strip(right.cast("string"))
    as_number = a.try_cast("double") == b.try_cast("double")
    not_nan = ~F.isnan(a.try_cast("double"))
    return (a == b) | F.coalesce(as_number & not_nan, F.lit(False))


def mirror_letter(letter: Column) -> Column:
    return F.translate(letter, "abcd", "dcba")
