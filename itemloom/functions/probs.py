"""Four-way probability arrays: softmax, arg-max, margins, entropies, permutations."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from itemloom import CHOICES

# Latin-square display orders used first, and the cyclic shifts in use order.
LATIN_ORDERS = [(0, 1, 2, 3), (1, 3, 0, 2), (2, 0, 3, 1), (3, 2, 1, 0)]
CYCLIC_SHIFTS = [0, 2, 1, 3]


def display_orders(n: int) -> list[tuple[int, ...]]:
    """The first n display orders: Latin square first, then the rest in lexicographic order."""
    rest = sorted(set(itertools.permutations(range(4))) - set(LATIN_ORDERS))
    return (LATIN_ORDERS + rest)[:n]


def shift_orders(shifts=CYCLIC_SHIFTS) -> list[tuple[int, ...]]:
    return [tuple((j + s) % 4 for j in range(4)) for s in shifts]


def slot(array: Column, i: int) -> Column:
    return F.element_at(array, i + 1)


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(shifted, F.array_repeat(total, 4), lambda x, t: x / t)


def argmax_letter(probs: Column) -> Column:
    """First maximum wins, as in array arg-max."""
    best = F.array_position(probs, F.array_max(probs)).cast("int")
    return F.element_at(F.array(*map(F.lit, CHOICES)), best)


def prob_of(probs: Column, letter: Column) -> Column:
    out = F.when(letter == "a", slot(probs, 0))
    for i, c in enumerate("bcd", start=1):
        out = out.when(letter == c, slot(probs, i))
    return out


def confidence(probs: Column) -> Column:
    return F.array_max(probs)


def margin(probs: Column) -> Column:
    ranked = F.sort_array(probs, asc=False)
    return F.element_at(ranked, 1) - F.element_at(ranked, 2)


def _clipped(p: Column, floor: float) -> Column:
    return F.least(F.greatest(p, F.lit(floor)), F.lit(1.0))


def entropy_unit(probs: Column) -> Column:
    """Natural-log entropy divided by ln 4, so that uniform is 1."""
    total = F.aggregate(probs, F.lit(0.0), lambda acc, p: acc + p * F.ln(_clipped(p, 1e-12)))
    return -total / F.ln(F.lit(4.0))


def entropy_bits(probs: Column) -> Column:
    return -F.aggregate(probs, F.lit(0.0), lambda acc, p: acc + p * F.log2(_clipped(p, 1e-12)))


def blend(first: Column, second: Column, weight: float) -> Column:
    return F.zip_with(first, second, lambda p, q: (1.0 - weight) * p + weight * q)


def permute(values: Column, order: Column) -> Column:
    """Show original slot ``order[j]`` in display slot j."""
    return F.transform(order, lambda o: F.element_at(values, o + 1))


def unpermute(shown: Column, order: Column) -> Column:
    """Bring display-slot values back to original slots."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda k: F.element_at(shown, F.array_position(order, k).cast("int")),
    )
