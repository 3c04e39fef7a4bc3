"""Model output: display orders, run averaging, uncertainty, blending, submissions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom import CHOICES
from itemloom.functions import probs as pr
from itemloom.session import cut_lineage


def fan_out_orders(df: DataFrame, orders: Sequence[Sequence[int]], choices: Sequence[str] = CHOICES) -> DataFrame:
    """One row per item and display order, with the options as shown; no shuffle and no join."""
    table = F.array(*[F.array(*[F.lit(int(j)) for j in o]) for o in orders])
    options = F.array(*[F.col(c) for c in choices])
    out = df.select("*", F.posexplode(table).alias("run", "order"))
    return out.withColumn("shown", pr.permute(options, F.col("order")))


def score(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], keys: str) -> DataFrame:
    """Run a user's scorer over Arrow batches: the model is built once per task and returns four logits per row.

    ``make_model()`` gives a function from a batch to a frame with columns l_a, l_b, l_c, l_d and ``mass`` (the
    share of probability the model puts on the four letters). ``keys`` is the schema text of columns to keep.
    """
    names = [part.split()[0] for part in keys.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            out = model(batch)
            yield pd.concat([batch[names].reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    return df.mapInPandas(run, f"{keys}, l_a double, l_b double, l_c double, l_d double, mass double")


def scored_probs(scored: DataFrame, order: str | None = None) -> DataFrame:
    """Softmax of the four logits, moved back to the original slots when a display order is given."""
    shown = pr.softmax(F.array("l_a", "l_b", "l_c", "l_d"))
    return scored.withColumn("probs", shown if order is None else pr.unpermute(shown, F.col(order)))


def mass_check(scored: DataFrame, floor: float = 0.3) -> DataFrame:
    """Mean letter mass and whether it is suspiciously low."""
    return scored.agg(F.avg("mass").alias("mean_mass"), F.min("mass").alias("min_mass"), F.count("*").alias("n")).withColumn(
        "too_low", F.col("mean_mass") < floor
    )


def average_runs(runs: DataFrame, id_col: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """Mean probabilities and arg-max agreement over runs: one shuffle, fixed-size state per item."""
    pred = pr.argmax_letter(F.col("probs"))
    tagged = runs.withColumn("__pred", pred)
    out = tagged.groupBy(id_col).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in keep],
        F.count("*").alias("runs"),
        F.array(*[F.avg(pr.slot(F.col("probs"), i)) for i in range(4)]).alias("probs"),
        F.greatest(*[F.count_if(F.col("__pred") == c) for c in CHOICES]).alias("__top"),
    )
    return out.withColumn("agreement", F.col("__top") / F.col("runs")).drop("__top")


def uncertainty(averaged: DataFrame) -> DataFrame:
    """Confidence, margin, scaled entropy and the combined score."""
    p = F.col("probs")
    out = averaged.withColumns({"confidence": pr.confidence(p), "margin": pr.margin(p), "entropy": pr.entropy_unit(p)})
    # Weights of the four parts of the score.
    return out.withColumn(
        "unc_score",
        0.40 * (1 - F.col("margin")) + 0.30 * F.col("entropy") + 0.15 * (1 - F.col("confidence"))
        + 0.15 * (1 - F.col("agreement")),
    )


def prediction_table(averaged: DataFrame, items: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """Answer, four probabilities and uncertainty, with question and type when items are given."""
    table = uncertainty(averaged).withColumns({
        "answer": pr.argmax_letter(F.col("probs")),
        **{f"p_{c}": pr.slot(F.col("probs"), i) for i, c in enumerate(CHOICES)},
    })
    wanted = [id_col, "answer", *[f"p_{c}" for c in CHOICES], "confidence", "margin", "entropy", "agreement", "unc_score"]
    extra = [c for c in table.columns if c not in wanted and c not in ("probs", "runs")]
    table = table.select(*wanted, *extra)
    return table if items is None else table.join(items.select(id_col, "qtype", "question"), id_col, "left")


def quantile_value(df: DataFrame, column: str, q: float) -> Column:
    """One exact quantile of a column as a scalar expression."""
    from itemloom.operators.distribution import pooled_quantiles

    return pooled_quantiles(df, [column], {"q": q}).select("q").scalar()


def accuracy_report(predictions: DataFrame, gold: str, kind: str) -> DataFrame:
    """Accuracy over all rows, per type, and for the most uncertain quarter against the rest."""
    predictions = cut_lineage(predictions.select("answer", gold, kind, "unc_score"))  # read several times below
    cut = quantile_value(predictions, "unc_score", 0.75)
    tagged = predictions.withColumn("ok", (F.col("answer") == F.col(gold)).cast("int"))
    tagged = tagged.withColumn("part", F.when(F.col("unc_score") >= cut, "top25_uncertain").otherwise("rest"))
    sections = F.array(
        F.struct(F.lit("overall").alias("section"), F.lit("all").alias("value")),
        F.struct(F.lit("type").alias("section"), F.col(kind).cast("string").alias("value")),
        F.struct(F.lit("uncertainty").alias("section"), F.col("part").alias("value")),
    )
    return tagged.select(F.inline(sections), "ok").groupBy("section", "value").agg(
        F.avg("ok").alias("accuracy"), F.count("*").alias("n")
    )


def group_accuracy(predictions: DataFrame, gold: str, kind: str) -> DataFrame:
    return predictions.groupBy(kind).agg(
        F.avg((F.col("answer") == F.col(gold)).cast("int")).alias("accuracy"), F.count("*").alias("n")
    )


def prediction_overview(predictions: DataFrame, low_margin: float = 0.15) -> DataFrame:
    """Answer shares, mean margin and number of low-margin rows in one row."""
    return predictions.agg(
        *[F.avg((F.col("answer") == c).cast("int")).alias(f"share_{c}") for c in CHOICES],
        F.avg("margin").alias("mean_margin"), F.count_if(F.col("margin") < low_margin).alias("low_margin"),
    )


def uncertain_ids(predictions: DataFrame, low_margin: float = 0.15, q: float = 0.8) -> DataFrame:
    predictions = cut_lineage(predictions)  # read several times below
    cut = quantile_value(predictions, "unc_score", q)
    return predictions.filter((F.col("margin") < low_margin) | (F.col("unc_score") >= cut))


def align_models(primary: DataFrame, secondary: DataFrame, id_col: str = "id") -> DataFrame:
    """Primary rows with the secondary's probabilities; uncovered rows fall back to the primary's own."""
    second = secondary.select(
        F.col(id_col).alias("__id"), F.col("probs").alias("__p2"), F.col("agreement").alias("__a2"), F.col("runs").alias("__r2")
    )
    joined = primary.join(second, F.col(id_col) == F.col("__id"), "left")
    covered = F.col("__id").isNotNull()
    return joined.select(
        *[c for c in primary.columns if c not in ("probs", "agreement", "runs")],
        F.col("probs").alias("p1"), F.coalesce("__p2", "probs").alias("p2"), covered.alias("covered"),
        F.when(covered & (F.col("__r2") > 1), F.col("__a2")).otherwise(F.lit(1.0)).alias("agree2"),
    )


def gate(gate_margin: float, min_conf: float, min_agree: float, max_gap: float) -> Column:
    """Whether the secondary may speak: covered, primary unsure, secondary sure, small support gap."""
    p1, p2 = F.col("p1"), F.col("p2")
    gap = pr.prob_of(p1, pr.argmax_letter(p1)) - pr.prob_of(p1, pr.argmax_letter(p2))
    return (
        F.col("covered") & (pr.margin(p1) < gate_margin) & (pr.confidence(p2) >= min_conf)
        & (F.col("agree2") >= min_agree) & (gap <= max_gap)
    )


def blend_models(
    aligned: DataFrame,
    strategy: str = "gated",
    weight: float | Column = 0.5,
    gate_margin: float = 0.15,
    min_conf: float = 0.0,
    min_agree: float = 0.0,
    min_margin: float = 0.3,
    max_gap: float = 1.0,
) -> DataFrame:
    """Blend two aligned models: ``weighted`` on covered rows, ``gated`` mix, or ``replace`` by the secondary."""
    p1, p2 = F.col("p1"), F.col("p2")
    mixed = pr.blend(p1, p2, weight)
    if strategy == "weighted":
        applied, value = F.col("covered"), mixed
    elif strategy in ("gated", "replace"):
        applied, value = gate(gate_margin, min_conf, min_agree, max_gap), mixed
        if strategy == "replace":
            applied, value = applied & (pr.margin(p2) >= min_margin), p2
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    out = aligned.withColumns({"applied": applied, "probs": F.when(applied, value).otherwise(p1)})
    return out.withColumns({
        "pred": pr.argmax_letter(F.col("probs")), "changed": pr.argmax_letter(F.col("probs")) != pr.argmax_letter(p1),
    })


def blend_by_type(aligned: DataFrame, weights: DataFrame, kind: str) -> DataFrame:
    """Weighted blend with one weight per type; types without a weight keep the primary."""
    joined = aligned.join(weights, kind, "left").withColumn("__w", F.coalesce("weight", F.lit(0.0)))
    return blend_models(joined, "weighted", F.col("__w")).drop("__w", "weight")


def diversity(aligned: DataFrame, worth: float = 0.08) -> DataFrame:
    """How often the secondary disagrees on covered rows, and whether that makes blending worthwhile."""
    differs = (pr.argmax_letter(F.col("p1")) != pr.argmax_letter(F.col("p2"))).cast("int")
    return aligned.agg(F.avg(F.when(F.col("covered"), differs)).alias("disagreement"), F.count_if("covered").alias("covered")).withColumn(
        "worth_blending", F.col("disagreement") >= worth
    )


def change_report(blended: DataFrame) -> DataFrame:
    """Rows touched, answers changed, and the size below which a score gain is noise."""
    return blended.agg(
        F.count("*").alias("rows"), F.count_if("covered").alias("covered"), F.count_if("applied").alias("applied"),
        F.count_if("changed").alias("changed"),
    ).withColumn("noise_threshold", F.floor(F.sqrt("changed")))


def submission(predictions: DataFrame, sample: DataFrame, id_col: str = "id", answer: str = "answer", position: str = "pos") -> DataFrame:
    """Predictions in the order, id type and letter case of the sample file; fails when one is missing."""
    numeric = dict(sample.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint", "double", "float") or dict(
        sample.dtypes
    )[id_col].startswith("decimal")
    wanted = sample.select(F.col(position), F.col(id_col).alias("__raw"), F.col(id_col).cast("string").alias("__id"))
    have = predictions.select(F.col(id_col).cast("string").alias("__id"), F.col(answer).alias("__answer"))
    joined = wanted.join(have, "__id", "left")
    if answer in sample.columns:
        upper = sample.agg(
            F.avg(F.regexp_like(F.trim(F.col(answer).cast("string")), F.lit("^[ABCD]$")).cast("int")) > 0.5
        ).scalar()
        value = F.when(F.coalesce(upper, F.lit(False)), F.upper("__answer")).otherwise(F.col("__answer"))
    else:
        value = F.col("__answer")
    checked = F.when(
        F.col("__answer").isNull(), F.raise_error(F.concat(F.lit("no prediction for "), F.col("__id")))
    ).otherwise(value)
    return joined.select(position, F.col("__raw" if numeric else "__id").alias(id_col), checked.alias(answer))


def soft_export(averaged: DataFrame, gold: str | None = None, id_col: str = "id") -> DataFrame:
    """Probabilities per letter with the arg-max letter and, when known, the right answer."""
    columns = [F.col(id_col), *[pr.slot(F.col("probs"), i).alias(c) for i, c in enumerate(CHOICES)]]
    columns.append(pr.argmax_letter(F.col("probs")).alias("pred"))
    if gold:
        columns.append(F.col(gold).alias("answer"))
    return averaged.select(*columns)


def rotation_stability(runs: DataFrame, gold: str = "gold", id_col: str = "id") -> DataFrame:
    """Share of items right in every run, in any run, and on average."""
    ok = (pr.argmax_letter(F.col("probs")) == F.col(gold)).cast("int")
    per = runs.withColumn("__ok", ok).groupBy(id_col).agg(
        F.min("__ok").alias("every"), F.max("__ok").alias("some"), F.avg("__ok").alias("mean")
    )
    return per.agg(
        F.avg("every").alias("all_runs_right"), F.avg("some").alias("any_run_right"), F.avg("mean").alias("mean_run_accuracy")
    )


def learnable_screen(averaged: DataFrame, gold: str) -> DataFrame:
    """Items whose right answer is not among the two likeliest: candidates for hand labelling."""
    p_gold = pr.prob_of(F.col("probs"), F.col(gold))
    above = F.size(F.filter("probs", lambda p: p > p_gold))
    return averaged.withColumn("gold_rank", above + 1).filter(F.col("gold_rank") > 2)
