"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is a sequence of lines; some start with a speaker marker, others do not. The hidden state of a line is its
role and whether it opens a turn or goes on with one. What is seen is the marker, whether the line asks, and its length
class. Transitions and emissions are counted on labelled lines (at most ``max_labelled``, those with the smallest hashes
of transcript and block) with add-one smoothing; the most likely states follow by Viterbi.

Lines are worked on in blocks of ``BLOCK``. A block first gives its 6 x 6 table of best scores between the state before
it and its last state; the few tables of a transcript are chained, which fixes the state at every border; then each
block is decoded between its borders. So a transcript of any length is shared out over tasks and decoded exactly.

Defined results: null text is an empty line; an empty line has no marker; lines that share a number are ordered by their
text; a null transcript id is a transcript of its own; repeated rows are lines of their own; an empty table gives no
rows. Ties between states go to the first in the order of ``STATES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.store import stored

ROLES = ("system", "user", "assistant")
STATES = [(role, opens) for role in ROLES for opens in (True, False)]
#: Words that may stand before a colon at the start of a line.
MARKERS = {"system": ("system", "instructions"), "user": ("user", "human", "q", "customer"), "assistant": ("assistant", "ai", "bot", "a")}
BLOCK = 512
SYMBOLS = 4 * 2 * 3
_ANY = r"(?i)^\s*[\[<#*]*\s*(?:{})\s*[\]>*]*\s*:\s*"


def marker(text: Column) -> Column:
    """Number of the role whose marker the line starts with, or 3."""
    found = F.lit(3)
    for i, role in reversed(list(enumerate(ROLES))):
        found = F.when(F.rlike(text, F.lit(_ANY.format("|".join(MARKERS[role])))), i).otherwise(found)
    return found


def symbol(text: Column) -> Column:
    """Observation of a line: marker, question, length class."""
    long = F.when(F.length(text) < 60, 0).when(F.length(text) < 200, 1).otherwise(2)
    return (marker(text) * 6 + F.rlike(text, F.lit(r"\?\s*$")).cast("int") * 3 + long).cast("int")


def observed(lines: DataFrame, id_column: str, order: list[str], text_column: str, *more: str) -> DataFrame:
    """(id, place, block, text, symbol, *more) of every line; the place in its transcript counts from 0."""
    rows = lines.select(F.col(id_column).alias("id"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.coalesce(F.col(text_column), F.lit("")).alias("text"), *more)
    # line numbers of one transcript are dealt out in ranges first, so that no task numbers a whole long transcript
    keys = [f"o{i}" for i in range(len(order))]
    ranges = stored(rows.repartitionByRange("id", *keys, "text").withColumn("part", F.spark_partition_id()), "lines")
    counts = ranges.groupBy("id", "part").agg(F.count("*").alias("n"))
    before = counts.select(
        F.col("id").alias("c_id"), F.col("part").alias("c_part"),
        F.coalesce(F.sum("n").over(Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skipped"),
    )
    nth = F.row_number().over(Window.partitionBy("id", "part").orderBy(*keys, "text")) - 1
    placed = ranges.withColumn("nth", nth).join(before, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("part") == F.col("c_part")))
    place = (F.col("nth") + F.col("skipped")).cast("long")
    out = placed.select("id", place.alias("place"), "text", *more)
    return stored(out.withColumns({"block": F.floor(F.col("place") / BLOCK), "symbol": symbol(F.col("text"))}), "observed")


def fitted(seen: DataFrame, role: str, opens: str, max_labelled: int) -> np.ndarray:
    """Log scores: six rows of transitions, one of first states, and ``SYMBOLS`` rows of emissions, for six states."""
    labelled = seen.filter(F.col(role).isin(*ROLES))
    key = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "block")
    labelled = labelled.withColumn("key", key).orderBy("key", "place").limit(max_labelled)
    number = F.lit(0)
    for i, (name, first) in enumerate(STATES):
        number = F.when((F.col(role) == name) & (F.col(opens) == F.lit(first)), i).otherwise(number)
    now = labelled.select("id", "block", "place", "symbol", number.alias("state"))
    before = F.lag("state").over(Window.partitionBy("id", "block").orderBy("place"))
    counts = now.withColumn("before", F.coalesce(before, F.when(F.col("place") == 0, 6))).groupBy("before", "state", "symbol").agg(F.count("*").alias("n"))
    table = np.ones((7 + SYMBOLS, 6))
    for r in counts.collect():  # at most 7 * 6 * 24 rows
        if r["before"] is not None:
            table[r["before"], r["state"]] += r["n"]
        table[7 + r["symbol"], r["state"]] += r["n"]
    table[:7] /= table[:7].sum(axis=1, keepdims=True)
    table[7:] /= table[7:].sum(axis=0, keepdims=True)
    return np.log(table)


def _steps(model: np.ndarray, symbols: list[int], start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best scores after the last line from scores before the first (rows: several starts), and where they came from."""
    score, came = start, []
    for s in symbols:
        ways = score[:, :, None] + model[None, :6, :]
        came.append(ways.argmax(axis=1))
        score = ways.max(axis=1) + model[7 + s]
    return score, came


def _entry(model: np.ndarray, symbols: list[int]) -> tuple[np.ndarray, list[int]]:
    """Scores after the first line of a transcript, and the rest of its symbols."""
    return (model[6] + model[7 + symbols[0]])[None, :], symbols[1:]


def _table(model: np.ndarray, first: bool, symbols: list[int]) -> np.ndarray:
    if first:
        score, rest = _entry(model, symbols)
        return np.repeat(_steps(model, rest, score)[0], 6, axis=0)
    start = np.full((6, 6), -np.inf)
    np.fill_diagonal(start, 0.0)
    return _steps(model, symbols, start)[0]


def _path(model: np.ndarray, first: bool, symbols: list[int], before: int, last: int) -> list[int]:
    if first:
        score, rest = _entry(model, symbols)
    else:
        score, rest = np.full((1, 6), -np.inf), symbols
        score[0, before] = 0.0
    _, came = _steps(model, rest, score)
    states = [last]
    for c in reversed(came):
        states.append(int(c[0, states[-1]]))
    states.reverse()
    return states if first else states[1:]


def decoded(seen: DataFrame, model: np.ndarray) -> DataFrame:
    """(id, place, state) of every line."""
    kind = seen.schema["id"].dataType.simpleString()
    # at most BLOCK numbers in a cell
    blocks = seen.groupBy("id", "block").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "symbol"))), lambda x: x["symbol"]).alias("symbols"))
    blocks = stored(blocks, "blocks")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_table(model, b == 0, s).ravel().tolist() for b, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["id", "block", "best"])

    def chain(rows):
        rows = rows.sort_values("block")
        best = [np.array(b).reshape(6, 6) for b in rows["best"]]
        score, came = best[0][0], []
        for t in best[1:]:
            ways = score[:, None] + t
            came.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        ends = [int(score.argmax())]
        for c in reversed(came):
            ends.append(int(c[ends[-1]]))
        ends.reverse()
        return rows[["id", "block"]].assign(before=[0, *ends[:-1]], last=ends)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, symbols, before, last = (batch.column(i) for i in range(5))
            found = [_path(model, b == 0, *x) for b, *x in zip(numbers.to_pylist(), symbols.to_pylist(), before.to_pylist(), last.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, numbers, pa.array(found, pa.list_(pa.int32()))], ["id", "block", "states"])

    best = blocks.mapInArrow(tables, f"id {kind}, block long, best array<double>")
    ends = best.groupBy("id").applyInPandas(chain, f"id {kind}, block long, before int, last int")
    ends = stored(ends, "ends").withColumnsRenamed({"id": "e_id", "block": "e_block"})
    both = blocks.join(ends, F.col("id").eqNullSafe(F.col("e_id")) & (F.col("block") == F.col("e_block"))).select("id", "block", "symbols", "before", "last")
    out = both.mapInArrow(paths, f"id {kind}, block long, states array<int>")
    return out.select("id", "block", F.posexplode("states").alias("nth", "state")).select("id", "block", (F.col("block") * BLOCK + F.col("nth")).alias("place"), "state")


def formatted(seen: DataFrame, model: np.ndarray, *more: str) -> DataFrame:
    """(id, place, role, turn, rendered, *more) of every line of ``observed`` lines.

    A line that opens a turn loses its marker and begins with ``<|role|>`` and a line break; a turn's last line ends
    with ``<|end|>``. The lines of a turn, joined by line breaks, are the canonical turn.
    """
    states = decoded(seen, model).withColumnsRenamed({"id": "d_id", "place": "d_place", "block": "d_block"})
    rows = seen.join(states, F.col("id").eqNullSafe(F.col("d_id")) & (F.col("place") == F.col("d_place"))).drop("d_id", "d_place", "d_block")
    # a turn opens where the model says so, where the role changes, and at the first line
    local = Window.partitionBy("id", "block").orderBy("place")
    rows = stored(rows.withColumns({"role_no": F.floor(F.col("state") / 2).cast("int"), "said": F.col("state") % 2 == 0}), "states")
    edges = rows.groupBy("id", "block").agg(F.max_by("role_no", "place").alias("last_role"), F.min_by(F.struct("role_no", "said"), "place").alias("first"))
    over = Window.partitionBy("id").orderBy("block")
    edges = stored(edges.select(
        F.col("id").alias("b_id"), F.col("block").alias("b_block"), F.lag("last_role").over(over).alias("role_before"), F.lead("first").over(over).alias("after"),
    ), "edges")
    rows = rows.join(edges, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("block") == F.col("b_block")))
    previous = F.coalesce(F.lag("role_no").over(local), "role_before")
    rows = rows.withColumn("opens", F.col("said") | previous.isNull() | (previous != F.col("role_no")))
    next_opens = F.coalesce(F.lead("opens").over(local), F.col("after.said") | (F.col("after.role_no") != F.col("role_no")), F.lit(True))
    rows = stored(rows.withColumn("closes", next_opens).drop("role_before", "after", "b_id", "b_block"), "turns")
    starts = rows.groupBy("id", "block").agg(F.sum(F.col("opens").cast("long")).alias("n"))
    earlier = starts.select(
        F.col("id").alias("b_id"), F.col("block").alias("b_block"),
        F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("turns_before"),
    )
    rows = rows.join(earlier, F.col("id").eqNullSafe(F.col("b_id")) & (F.col("block") == F.col("b_block")))
    turn = F.sum(F.col("opens").cast("long")).over(local.rowsBetween(Window.unboundedPreceding, 0)) + F.col("turns_before") - 1
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("role_no") + 1)
    plain = F.regexp_replace("text", _ANY.format("|".join(m for r in ROLES for m in MARKERS[r])), "")
    body = F.when(F.col("opens"), F.concat(F.lit("<|"), role, F.lit("|>\n"), plain)).otherwise(F.col("text"))
    return rows.select("id", "place", role.alias("role"), turn.alias("turn"), F.when(F.col("closes"), F.concat(body, F.lit("<|end|>"))).otherwise(body).alias("rendered"), *more)
