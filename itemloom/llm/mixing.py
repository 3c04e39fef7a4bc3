"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed in cells (source, language, topic). The weight of every cell is raked to the targets of one marginal
after the other until the table of cells agrees with all of them; then each document is sampled with a probability in
proportion to its cell's weight per token. The scale is calibrated so that the expected number of tokens is ``budget``
of all: cells whose probability would pass 1 are taken whole and the others share the rest.

Targets are shares per value. By default they are the observed shares to the power of a temperature below 1, which
lifts what is rare. Only the table of cells is raked, a few rows per source; documents are read once to sum the cells
and once to be sampled, and are joined with their cell's probability.

Random numbers follow the md5 of seed and id, so every run takes the same documents.

Defined results: a null source or language is a value of its own, null or empty text has topic ``empty`` and no tokens;
rows without tokens carry no weight and are not taken; a null id has one random number; rows that share an id share
it as well; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.store import shielded, stored

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURES = {"source": 0.7, "lang": 0.7, "topic": 0.8}
_NULL = "\x00"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from marks in the text; the first that fits."""
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(F.contains(text, F.lit("ights reserved")) | F.contains(text, F.lit("icense")), "legal")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("+1 (")), "contact")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("?")), "questions")
        .otherwise("prose")
    )


def measured(docs: DataFrame, text_column: str, source_column: str, lang_column: str) -> DataFrame:
    """``docs`` with mix_source, mix_lang, mix_topic and mix_tokens."""
    text = F.col(text_column)
    return docs.withColumns({
        "mix_source": F.coalesce(F.col(source_column).cast("string"), F.lit(_NULL)),
        "mix_lang": F.coalesce(F.col(lang_column).cast("string"), F.lit(_NULL)),
        "mix_topic": topic_of(text), "mix_tokens": word_count(text),
    })


def _targets(cells: DataFrame, name: str, temperature: float, given: dict[str, float] | None) -> Column:
    """Share of the total that each cell's value should get."""
    of_value = F.sum("n").over(Window.partitionBy(name))
    if given is None:
        wanted = F.pow(of_value, F.lit(temperature))
    else:
        pairs = [c for k, v in given.items() for c in (F.lit(k), F.lit(float(v)))]
        wanted = F.coalesce(F.element_at(F.create_map(*pairs), F.col(name)), F.lit(0.0))
    return wanted


def raked(
    cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temperatures: dict[str, float] | None = None,
    rounds: int = 20, at_once: int = 5, tolerance: float = 0.0,
) -> DataFrame:
    """Add ``w`` to cells (source, lang, topic, n): token weights whose marginals are the targets, in sum the tokens.

    Stops after ``rounds``, or when no marginal is off by more than ``tolerance`` of its target.
    """
    table = cells.filter("n > 0")
    for name in DIMENSIONS:
        table = table.withColumn(f"raw_{name}", _targets(table, name, (temperatures or TEMPERATURES)[name], (targets or {}).get(name)))
    table = stored(table, "cells")
    for name in DIMENSIONS:
        # one number per marginal: the sum of what its values should get
        whole = table.groupBy(name).agg(F.max(f"raw_{name}").alias("v")).agg(F.sum("v")).first()[0] or 1.0
        tokens = table.agg(F.sum("n")).first()[0] or 0
        table = table.withColumn(f"t_{name}", F.col(f"raw_{name}") / F.lit(float(whole)) * F.lit(float(tokens)))
    table = table.withColumn("w", F.col("n").cast("double"))
    for first in range(0, rounds, at_once):
        for _ in range(min(at_once, rounds - first)):
            for name in DIMENSIONS:
                table = table.withColumn("w", F.col("w") * F.col(f"t_{name}") / F.sum("w").over(Window.partitionBy(name)))
        table = stored(table.withColumn("w", F.coalesce("w", F.lit(0.0))), "raked")
        if tolerance:
            off = [
                table.groupBy(name).agg(F.sum("w").alias("s"), F.max(f"t_{name}").alias("t")).agg(F.max(F.abs(F.col("s") / F.col("t") - 1))).first()[0] or 0
                for name in DIMENSIONS
            ]
            if max(off) <= tolerance:
                break
    return table.select(*DIMENSIONS, "n", "w")


def calibrated(cells: DataFrame, budget: float) -> DataFrame:
    """Add ``probability`` to raked cells so that ``budget`` of the tokens are expected to be taken."""
    ratio = F.col("w") / F.col("n")
    total = cells.agg(F.sum("n")).first()[0] or 0
    scale, before = 0.0, None
    while True:  # the set of cells taken whole only grows
        whole = ratio * F.lit(scale) >= 1
        got = cells.agg(F.sum(F.when(whole, F.col("n"))).alias("n"), F.sum(F.when(~whole, F.col("w"))).alias("w"), F.count(F.when(whole, 1)).alias("k")).first()
        if before == got["k"] or not got["w"]:
            break
        before = got["k"]
        scale = max(0.0, budget * total - (got["n"] or 0)) / got["w"]
    return cells.withColumn("probability", F.least(F.lit(1.0), ratio * F.lit(scale)))


def sampled(
    docs: DataFrame, budget: float = 0.8, seed: str = "mix", id_column: str = "doc_id", text_column: str = "text",
    source_column: str = "source", lang_column: str = "lang", targets: dict[str, dict[str, float]] | None = None,
    temperatures: dict[str, float] | None = None, rounds: int = 20,
) -> DataFrame:
    """``docs`` with mix_topic, mix_tokens, mix_probability and mix_taken (columns with these names are replaced).

    No row is dropped.
    """
    rows = measured(docs, text_column, source_column, lang_column)
    sums = rows.groupBy("mix_source", "mix_lang", "mix_topic").agg(F.sum("mix_tokens").alias("n"))
    cells = stored(sums.toDF(*DIMENSIONS, "n"), "sums")
    odds = stored(calibrated(raked(cells, targets, temperatures, rounds), budget).select(*[F.col(d).alias(f"o_{d}") for d in DIMENSIONS], "probability"), "odds")
    odds = odds.withColumnRenamed("probability", "o_probability")
    on = [F.col(f"mix_{d}") == F.col(f"o_{d}") for d in DIMENSIONS]
    chance = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    known = F.coalesce("o_probability", F.lit(0.0))
    return rows.join(odds, on, "left").withColumns({
        "mix_probability": known, "mix_taken": chance / F.lit(float(2**52)) < known,
    }).drop("mix_source", "mix_lang", *[f"o_{d}" for d in DIMENSIONS], "o_probability")


def taken(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", lang_column: str = "lang", **options
) -> DataFrame:
    """The sampled rows of ``docs``; same columns."""
    inner, place, back = shielded(docs)
    columns = {"id_column": id_column, "text_column": text_column, "source_column": source_column, "lang_column": lang_column}
    return back(sampled(inner, **{k: place[v] for k, v in columns.items()}, **options).filter("mix_taken"))
