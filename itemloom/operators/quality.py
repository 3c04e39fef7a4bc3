"""Quality checks, contracts, filters and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom import CHOICES
from itemloom.functions import text as tx


class ContractError(ValueError):
    """A dataset breaks a stated rule."""


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, one row per column."""
    names = list(columns or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return one.unpivot([], names, "column", "missing")


def blank_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that are missing or empty after trimming, one row per column."""
    one = df.agg(*[F.count_if(tx.strip(F.coalesce(F.col(c), F.lit(""))) == "").alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "blank")


def duplicate_ids(df: DataFrame, column: str = "id") -> DataFrame:
    """Rows beyond the first of each id; all missing ids count as one value."""
    per_id = df.groupBy(column).agg(F.count("*").alias("n"))
    return per_id.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))


def in_split_duplicates(df: DataFrame, split_col: str, suffix: str = "_norm") -> DataFrame:
    """Repeated questions and repeated whole problems inside each split."""
    signature = tx.problem_signature(f"question{suffix}", [f"{c}{suffix}" for c in CHOICES])
    keys = df.select(split_col, F.explode(F.array(
        F.struct(F.lit("question").alias("kind"), F.col(f"question{suffix}").alias("key")),
        F.struct(F.lit("problem").alias("kind"), signature.alias("key")),
    )).alias("k")).select(split_col, "k.*")
    extra = keys.groupBy(split_col, "kind", "key").agg((F.count("*") - 1).alias("extra"))
    return extra.groupBy(split_col).agg(
        F.sum(F.when(F.col("kind") == "question", F.col("extra")).otherwise(0)).alias("duplicate_questions"),
        F.sum(F.when(F.col("kind") == "problem", F.col("extra")).otherwise(0)).alias("duplicate_problems"),
    )


def file_inventory(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Compare listed paths with found files: ``status`` is ok, missing, extra or unreadable.

    ``found`` has ``path`` and ``readable``; both sides are reduced to one row per path first.
    """
    left = listed.select("path").distinct().withColumn("listed", F.lit(True))
    right = found.groupBy("path").agg(F.max("readable").alias("readable"))
    both = left.join(right, "path", "full")
    status = (
        F.when(F.col("readable").isNull(), "missing")
        .when(F.col("listed").isNull(), "extra")
        .when(~F.col("readable"), "unreadable")
        .otherwise("ok")
    )
    return both.select("path", status.alias("status"))


def label_violations(df: DataFrame, column: str = "answer", domain: Sequence[str] = CHOICES) -> DataFrame:
    return df.agg(F.count_if(~F.coalesce(F.col(column).isin(*domain), F.lit(False))).alias("bad_labels"))


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ContractError(f"{name}: missing columns {absent}")
    return df


def contract_counts(df: DataFrame) -> DataFrame:
    """Bad labels, blank options and repeated ids in one row."""
    rowwise = df.agg(
        F.count_if(~F.coalesce(F.col("answer").isin(*CHOICES), F.lit(False))).alias("bad_labels"),
        *[F.count_if(tx.strip(F.coalesce(F.col(c), F.lit(""))) == "").alias(f"blank_{c}") for c in CHOICES],
    )
    return rowwise.withColumn("duplicate_ids", duplicate_ids(df).scalar())


def enforce_contract(df: DataFrame, name: str) -> DataFrame:
    """Raise when any contract count is above zero."""
    found = contract_counts(df).first().asDict()
    broken = {k: v for k, v in found.items() if v}
    if broken:
        raise ContractError(f"{name}: {broken}")
    return df


def key_set_comparison(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sizes of the intersection and of both differences of two key sets."""
    a = left.select(key).distinct().withColumn("__l", F.lit(1))
    b = right.select(key).distinct().withColumn("__r", F.lit(1))
    both = a.join(b, key, "full")
    return both.agg(
        F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("common"),
        F.count_if(F.col("__r").isNull()).alias("only_left"),
        F.count_if(F.col("__l").isNull()).alias("only_right"),
    ).withColumns({
        "disjoint": F.col("common") == 0,
        "equal": (F.col("only_left") == 0) & (F.col("only_right") == 0),
    })


def text_overlap(df: DataFrame, split_col: str, left: str, right: str, keys: dict[str, Column]) -> DataFrame:
    """Number of distinct keys present in both splits, one row per key kind."""
    tagged = df.filter(F.col(split_col).isin(left, right)).select(
        split_col, F.inline(F.array(*[F.struct(F.lit(n).alias("kind"), k.alias("key")) for n, k in keys.items()]))
    )
    per_key = tagged.groupBy("kind", "key").agg(
        F.max((F.col(split_col) == left).cast("int")).alias("l"), F.max((F.col(split_col) == right).cast("int")).alias("r")
    )
    return per_key.groupBy("kind").agg(F.sum(F.col("l") * F.col("r")).alias("shared"))


def external_rejections(df: DataFrame, options: Sequence[str] = ("A", "B", "C", "D"), answer: str = "answer") -> DataFrame:
    """Add ``reason``: the first rule an imported four-choice row breaks, or null."""
    trimmed = [tx.strip(F.col(o).cast("string")) for o in options]
    missing = F.lit(False)
    for t in trimmed:
        missing = missing | t.isNull() | t.isin("", "nan", "None")
    label = F.upper(tx.strip(F.coalesce(F.col(answer).cast("string"), F.lit(""))))
    return df.withColumn(
        "reason",
        F.when(missing, "missing_option")
        .when(~label.isin("A", "B", "C", "D"), "bad_answer")
        .when(F.size(F.array_distinct(F.array(*trimmed))) < 4, "duplicate_option"),
    )


def free_form_filter(df: DataFrame, max_answer_chars: int = 40) -> DataFrame:
    """Keep usable question-answer rows and add the compact answer key."""
    kept = df.filter(
        (F.length("question") > 0) & (F.length("answer_text") > 0) & (F.length("answer_text") <= max_answer_chars)
    )
    return kept.withColumn("norm", tx.compact_key(F.col("answer_text"))).filter(F.length("norm") > 0)


def alignment_report(left: DataFrame, right: DataFrame, position: str = "pos", key: str = "id") -> DataFrame:
    """Rows, and positions at which two ordered id lists differ."""
    a = left.select(F.col(position).alias("p"), F.col(key).alias("l"))
    b = right.select(F.col(position).alias("p"), F.col(key).alias("r"))
    return a.join(b, "p", "full").agg(
        F.count("l").alias("left_rows"), F.count("r").alias("right_rows"),
        F.count_if(~F.col("l").eqNullSafe(F.col("r"))).alias("mismatches"),
    )


def accuracy_agreement(recomputed: DataFrame, logged: DataFrame, key: str = "variant", tolerance: float = 5e-4) -> DataFrame:
    """Join recomputed and logged accuracies and flag differences of at least the tolerance."""
    return recomputed.join(logged, key).withColumn("agrees", F.abs(F.col("accuracy") - F.col("logged_accuracy")) < tolerance)


def metric_completeness(items: DataFrame, metrics: DataFrame, keys: Sequence[str], exempt: Sequence[str] = ()) -> DataFrame:
    """Missing metric values per column after a left join; exempt columns may be missing."""
    columns = [c for c in metrics.columns if c not in keys and c not in exempt]
    joined = items.join(metrics, list(keys), "left")
    return missing_counts(joined, columns)


def config_differences(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Keys whose values differ between two (key, value) frames."""
    both = stored.withColumnRenamed("value", "stored").join(current.withColumnRenamed("value", "current"), "key", "full")
    return both.filter(~F.col("stored").eqNullSafe(F.col("current")))
