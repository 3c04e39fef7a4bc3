"""Comparing models: summaries, paired tests, disagreements, difficulty tiers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from itemloom import CHOICES
from itemloom.functions import probs as pr


def graded(predictions: DataFrame, gold: str = "gold") -> DataFrame:
    """Add ``pred``, ``correct`` and ``p_gold`` to rows with probabilities and a right answer."""
    return predictions.withColumns({
        "pred": pr.argmax_letter(F.col("probs")),
        "p_gold": pr.prob_of(F.col("probs"), F.col(gold)),
    }).withColumn("correct", F.col("pred") == F.col(gold))


def variant_summary(scored: DataFrame, gold: str = "gold", variant: str = "variant") -> DataFrame:
    """Accuracy, log loss, Brier score and confidence in the right answer, four decimals."""
    p = F.least(F.greatest("p_gold", F.lit(1e-9)), F.lit(1.0))
    brier = sum(
        ((pr.slot(F.col("probs"), i) - (F.col(gold) == c).cast("int")) ** 2 for i, c in enumerate(CHOICES)), F.lit(0.0)
    )
    return scored.groupBy(variant).agg(
        F.count_if("correct").alias("correct"),
        F.round(F.avg(F.col("correct").cast("int")), 4).alias("accuracy"),
        F.round(F.avg(-F.ln(p)), 4).alias("nll"),
        F.round(F.avg(brier), 4).alias("brier"),
        F.round(F.avg(p), 4).alias("mean_p_gold"),
        F.round(F.avg(F.when(~F.col("correct"), p)), 4).alias("mean_p_gold_on_wrong"),
    )


def by_variant(scored: DataFrame, variants: Sequence[str], variant: str = "variant", id_col: str = "id", fields=("pred", "correct")) -> DataFrame:
    """One row per item with ``<field>_<variant>`` columns; the variant list bounds the width."""
    return scored.groupBy(id_col).agg(*[
        F.max(F.when(F.col(variant) == v, F.col(f))).alias(f"{f}_{v}") for v in variants for f in fields
    ])


@F.pandas_udf(DoubleType())
def mcnemar_exact(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided McNemar p-value from the two discordant counts."""
    return pd.Series([_mcnemar(int(x), int(y)) for x, y in zip(b, c)], dtype="float64")


def _mcnemar(b: int, c: int) -> float:
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)
    tail, ratio, i = 0.0, 1.0, k
    while i >= 0 and ratio > 1e-18:  # terms shrink from k downwards, so the sum stops early
        tail += ratio
        ratio *= i / (n - i + 1)
        i -= 1
    return min(1.0, 2 * math.exp(log_term) * tail)


def pairwise_comparison(scored: DataFrame, variants: Sequence[str], variant: str = "variant", id_col: str = "id") -> DataFrame:
    """For every pair of variants: differing predictions, one-sided wins, both wrong differently, McNemar p."""
    wide = by_variant(scored, variants, variant, id_col)
    measures = {}
    for a, b in combinations(variants, 2):
        pa, pb, ca, cb = (F.col(f"{f}_{v}") for f in ("pred", "correct") for v in (a, b))
        measures[(a, b)] = F.struct(
            F.lit(a).alias("A"), F.lit(b).alias("B"),
            F.count_if(pa != pb).alias("pred_diff"),
            F.count_if(ca & ~cb).alias("A_only_correct"),
            F.count_if(~ca & cb).alias("B_only_correct"),
            F.count_if(~ca & ~cb & (pa != pb)).alias("both_wrong_diff_pred"),
        )
    table = wide.agg(F.array(*measures.values()).alias("rows")).select(F.inline("rows"))
    return table.withColumn("mcnemar_p", F.round(mcnemar_exact("A_only_correct", "B_only_correct"), 4))


def disagreements(scored: DataFrame, items: DataFrame, variants: Sequence[str], variant: str = "variant", id_col: str = "id") -> DataFrame:
    """Items on which predictions differ: who is right, each prediction, and its probabilities."""
    rows = scored.withColumn("p_pred", F.array_max("probs"))
    wide = by_variant(rows, variants, variant, id_col, ("pred", "correct", "p_gold", "p_pred"))
    first = F.col(f"pred_{variants[0]}")
    differs = F.lit(False)
    for v in variants[1:]:
        differs = differs | (F.col(f"pred_{v}") != first)
    right = F.concat_ws(",", *[F.when(F.col(f"correct_{v}"), v) for v in variants])
    table = wide.filter(differs).withColumn("correct_by", F.when(right == "", "none").otherwise(right))
    shown = [
        F.round(f"{f}_{v}", 3).alias(f"{f}_{v}") if f.startswith("p_") else F.col(f"{f}_{v}")
        for v in variants for f in ("pred", "p_gold", "p_pred")
    ]
    return table.select(id_col, "correct_by", *shown).join(items, id_col).orderBy("correct_by", id_col)


# Tier names in report order.
TIERS = ["Easy", "Medium", "Medium-Hard", "Hard", "Inconsistent"]


def tier(correct: Column, models: int) -> Column:
    """Difficulty tier from correctness ordered from the smallest to the largest model."""
    first = F.array_position(correct, F.lit(True)).cast("int")
    steady = F.forall(F.slice(correct, F.greatest(first, F.lit(1)), models), lambda c: c)
    medium = (first == 2) | F.lit(models == 2)
    return (
        F.when(F.forall(correct, lambda c: c), "Easy")
        .when(first == 0, "Hard")
        .when(~steady, "Inconsistent")
        .when(medium, "Medium")
        .otherwise("Medium-Hard")
    )


def difficulty_table(scored: DataFrame, models: Sequence[str], weights: dict[str, float] | None = None, model: str = "model", id_col: str = "id", keep: Sequence[str] = ()) -> DataFrame:
    """One row per item scored by every model: predictions, P(correct), entropy, tier and difficulty."""
    rows = scored.withColumns({"p_correct": F.col("p_gold"), "entropy": pr.entropy_bits(F.col("probs"))})
    fields = ("pred", "correct", "p_correct", "entropy")
    wide = rows.groupBy(id_col).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in keep],
        *[F.max(F.when(F.col(model) == m, F.col(f))).alias(f"{f}_{m}") for m in models for f in fields],
        F.countDistinct(F.when(F.col(model).isin(*models), F.col(model))).alias("__seen"),
    ).filter(F.col("__seen") == len(models)).drop("__seen")
    w = weights or {m: 1.0 for m in models}
    total = sum(w[m] for m in models)
    correct = F.array(*[F.col(f"correct_{m}") for m in models])
    return wide.withColumns({
        "n_correct": F.size(F.filter(correct, lambda c: c)),
        "tier": tier(correct, len(models)),
        "difficulty": 1 - sum((F.col(f"p_correct_{m}") * (w[m] / total) for m in models), F.lit(0.0)),
    })


def probe_summary(table: DataFrame, models: Sequence[str], group: str) -> DataFrame:
    """Per group and model: rows, accuracy, mean P(correct), mean entropy."""
    rows = F.array(*[
        F.struct(
            F.lit(m).alias("model"), F.col(f"correct_{m}").cast("int").alias("c"), F.col(f"p_correct_{m}").alias("p"),
            F.col(f"entropy_{m}").alias("h"),
        )
        for m in models
    ])
    return table.select(group, F.inline(rows)).groupBy(group, "model").agg(
        F.count("*").alias("n"), F.avg("c").alias("accuracy"), F.avg("p").alias("p_correct_mean"), F.avg("h").alias("entropy_mean")
    )


def expectation_check(summary: DataFrame, group: str, easy: str, hard: str) -> DataFrame:
    """Whether the easy group beats the hard one on accuracy, P(correct) and entropy, per model."""
    def pick(g, c):
        return F.max(F.when(F.col(group) == g, F.col(c)))
    return summary.groupBy("model").agg(
        (
            (pick(easy, "accuracy") > pick(hard, "accuracy"))
            & (pick(easy, "p_correct_mean") > pick(hard, "p_correct_mean"))
            & (pick(easy, "entropy_mean") < pick(hard, "entropy_mean"))
        ).alias("as_expected")
    )


def tier_counts(table: DataFrame) -> DataFrame:
    """Count and percent per tier that occurs, with its report position."""
    total = table.agg(F.count("*")).scalar()
    order = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    return table.groupBy("tier").agg(F.count("*").alias("count")).select(
        order.cast("int").alias("position"), "tier", "count", F.round(F.col("count") / total * 100, 2).alias("percent")
    )


def difficulty_by_type(table: DataFrame, kind: str, models: Sequence[str]) -> DataFrame:
    return table.groupBy(kind).agg(
        F.count("*").alias("n"), F.round(F.avg("difficulty"), 3).alias("difficulty"),
        F.round(F.avg((F.col("tier") == "Hard").cast("int")) * 100, 3).alias("hard_pct"),
        *[F.round(F.avg(F.col(f"correct_{m}").cast("int")), 3).alias(f"acc_{m}") for m in models],
    ).orderBy(F.desc("difficulty"), kind)


def any_model_right(scored: DataFrame, id_col: str = "id") -> DataFrame:
    """Upper bound: share of items at least one model gets right."""
    per = scored.groupBy(id_col).agg(F.max(F.col("correct").cast("int")).alias("any"))
    return per.agg(F.avg("any").alias("upper_bound"), F.count("*").alias("n"))


def hedge_choice(pairwise: DataFrame, best: str, min_distance: int = 30) -> DataFrame:
    """Candidates at least ``min_distance`` items from the best one, the closest to all others first."""
    both = pairwise.select(F.inline(F.array(
        F.struct(F.col("A").alias("candidate"), F.col("B").alias("other"), F.col("pred_diff").alias("d")),
        F.struct(F.col("B").alias("candidate"), F.col("A").alias("other"), F.col("pred_diff").alias("d")),
    )))
    table = both.filter(F.col("candidate") != best).groupBy("candidate").agg(
        F.max(F.when(F.col("other") == best, F.col("d"))).alias("distance_to_best"), F.avg("d").alias("mean_distance")
    )
    return table.filter(F.col("distance_to_best") >= min_distance).orderBy("mean_distance", "candidate").limit(1)


def experiment_comparison(results: DataFrame, baseline: str = "raw", variant: str = "variant", accuracy: str = "accuracy") -> DataFrame:
    """Accuracy difference from a baseline variant in percentage points."""
    base = results.filter(F.col(variant) == baseline).agg(F.max(accuracy)).scalar()
    return results.withColumn("delta_pp", F.round((F.col(accuracy) - base) * 100, 2))
