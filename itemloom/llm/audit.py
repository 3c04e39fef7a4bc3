"""Filter interaction audit: what every order of a few filters removes, and what each filter does on its own.

Every document gets a mask of the filters that it fails. Tests of a text are column expressions; the copy test fails
a document whose text some smaller id has anywhere in the table. Documents are counted by (part, mask), which leaves at
most 2**k cells for each part whatever the input. A Gray-code walk over the subsets of filters then toggles one filter
at a time: each cell counts the active filters that it fails, the running survivors change by the cells whose count
leaves or reaches zero, and the survivors of all 2**k subsets are kept. Every figure of every order is a difference of
two of these states.

Copies are counted without moving texts: equal texts have equal digests (SHA-256) and equal masks, so rows are first
summed by (digest, part, mask, labels) with map-side combining, and of these sums only the least id of a digest passes.

Defined results: a null text is empty; a null part is the empty string; a document with a null id never fails the copy
test and makes no other fail it, and has no labels; rows that repeat an id and its text are counted one by one and are no
copies of each other; several label rows of an id count as one that has the greatest of their marks; columns other than
the named ones are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"


def short_text(text: Column, words: Column) -> Column:
    """Under 100 words."""
    return F.size(words) < 100


def repetitive(text: Column, words: Column) -> Column:
    """Fewer than 80 distinct words in a hundred."""
    return 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)


def shouting(text: Column, words: Column) -> Column:
    """More than one character in ten is an ASCII capital."""
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text)


def marked_up(text: Column, words: Column) -> Column:
    """Holds one of six symbols."""
    return text.rlike(r"[#$%&*|]")


#: Tests of the text and its words in the order of their letters; the letter after them is the copy test.
TESTS: dict[str, Callable[[Column, Column], Column]] = {"A": short_text, "B": repetitive, "C": shouting, "D": marked_up}


def cells(
    docs: DataFrame, labels: DataFrame, tests: dict[str, Callable[[Column, Column], Column]], part: str = "lang",
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail. Bit i is test i, the bit after them the copy test."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)).alias("words"),
    )
    mask = sum((test(F.col("text"), F.col("words")).cast("int") * (1 << i) for i, test in enumerate(tests.values())), F.lit(0))
    light = rows.select("id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))
    single = light.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col(id_column).alias("l_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("l_good"), F.max((F.col("toxic") == 1).cast("int")).alias("l_toxic")
    )
    known = single.join(marks, F.col("id") == F.col("l_id"), "left").withColumns({
        "good": F.coalesce("l_good", F.lit(0)), "toxic": F.coalesce("l_toxic", F.lit(0)),
    })
    # the rows of the least id in each sum are all that may pass the copy test, besides rows without id
    sums = known.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("n_low"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    first = F.min("low").over(Window.partitionBy("digest"))
    parted = sums.withColumn("first", first).withColumn("passes", F.col("n_null") + F.when(F.col("low") == F.col("first"), F.col("n_low")).otherwise(0))
    both = parted.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("passes").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(tests))).alias("mask"), (F.col("n") - F.col("passes")).alias("n")),
    )).alias("cell"))
    return both.groupBy("part", "cell.mask").agg(
        F.sum("cell.n").alias("n"), F.sum(F.col("cell.n") * F.col("good")).alias("good"), F.sum(F.col("cell.n") * F.col("toxic")).alias("toxic"),
    )


def subset_survivors(table: np.ndarray) -> np.ndarray:
    """What passes each subset of filters: row s sums the rows of ``table`` (by mask) that share no bit with s."""
    masks = np.arange(len(table))
    failures, alive = np.zeros(len(table), np.int64), table.sum(axis=0)
    states, active = np.empty_like(table), 0
    states[0] = alive
    for step in range(1, len(table)):
        toggled = step & -step  # the bit in which neighbouring Gray codes differ
        touched = masks & toggled > 0
        if active & toggled:
            failures[touched] -= 1
            alive = alive + table[touched & (failures == 0)].sum(axis=0)
        else:
            alive = alive - table[touched & (failures == 0)].sum(axis=0)
            failures[touched] += 1
        active ^= toggled
        states[active] = alive
    return states


def orders(states: np.ndarray, letters: str) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique, good lost, toxic lost, removed over all orders) of every order and step."""
    whole, steps, total = len(states) - 1, [], dict.fromkeys(letters, 0)
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            gone = states[before] - states[before | bit]
            fails, alone = states[0] - states[bit], states[whole ^ bit] - states[whole]
            steps.append(("".join(order), step, states[before | bit][0], gone[0], fails[0] - gone[0], alone[0], gone[1], gone[2], letter))
            total[letter] += int(gone[0])
            before |= bit
    for row in steps:
        yield (*map(int, row[2:8]), total[row[8]], row[0], row[1])


FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def walked(counts: DataFrame, letters: str) -> DataFrame:
    """One row per part, order and step from :func:`cells`; a part has at most 2**k rows, and parts are independent."""

    def walk(group: pa.Table) -> pa.Table:
        table = np.zeros((1 << len(letters), 3), np.int64)
        table[group["mask"].to_numpy()] = np.column_stack([group[c].to_numpy() for c in ("n", "good", "toxic")])
        rows = list(zip(*orders(subset_survivors(table), letters), strict=True))
        columns = [pa.array([group["part"][0].as_py()] * len(rows[0])), pa.array(rows[7]), pa.array(rows[8], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[:7])]
        return pa.table(columns, names=["part", "filter_order", "step", *FIGURES])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in FIGURES)
    return counts.groupBy("part").applyInArrow(walk, schema)


def audited(docs: DataFrame, labels: DataFrame, part: str = "lang", tests: dict[str, Callable[[Column, Column], Column]] = TESTS, copies: str = "E") -> DataFrame:
    """The audit of all orders of ``tests`` and the copy test, whose letter is ``copies``."""
    return walked(cells(docs, labels, tests, part), "".join(tests) + copies)
