"""Annotator votes: wide and long forms, agreement features, vote vectors and patterns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom import CHOICES
from itemloom.functions import text as tx

# Column-name templates for vote counts and the names of one-column vote strings, in search order.
VOTE_COLUMN_TEMPLATES = [
    "vote_{c}", "votes_{c}", "{c}_vote", "{c}_votes", "count_{c}", "{c}_count", "n_{c}", "{c}_cnt", "cnt_{c}",
]
VOTE_STRING_COLUMNS = ["human_votes", "votes", "vote", "vote_dist", "vote_counts", "distribution", "dist"]


def pivot_votes(long: DataFrame, item: str, annotator: str, vote: str, annotators: Sequence[int]) -> DataFrame:
    """One row per item with ``answer<k>`` columns.

    Conditional maxima keep a fixed-size state per item and combine before the shuffle, however many rows an
    item has.
    """
    return long.groupBy(item).agg(
        *[F.max(F.when(F.col(annotator) == k, F.col(vote))).alias(f"answer{k}") for k in annotators]
    )


def _entropy_bits(counts: Column, total: Column) -> Column:
    return -F.aggregate(counts, F.lit(0.0), lambda acc, n: acc + (n / total) * F.log2(n / total)) + F.lit(0.0)


def vote_features(df: DataFrame, columns: Sequence[str], tie: str = "first", restrict: bool = False) -> DataFrame:
    """Agreement features from annotator columns, computed inside each row.

    ``tie="first"`` gives the tied vote that appears first in annotator order; ``tie="joined"`` joins the tied
    letters with ``/``. ``restrict`` normalizes votes and keeps only a-d.
    """
    raw = F.array(*[F.col(c) for c in columns])
    if restrict:
        raw = F.transform(raw, lambda v: F.lower(tx.strip(v)))
        votes = F.filter(raw, lambda v: v.isin(*CHOICES))
    else:
        votes = F.filter(raw, lambda v: v.isNotNull())
    out = df.withColumn("__v", votes)
    out = out.withColumn("__u", F.array_distinct("__v"))
    out = out.withColumn("__n", F.transform("__u", lambda u: F.size(F.filter("__v", lambda v: v == u))))
    total, top = F.size("__v"), F.coalesce(F.array_max("__n"), F.lit(0))
    winners = F.filter("__u", lambda u, i: F.element_at(F.col("__n"), i + 1) == F.array_max("__n"))
    winner = F.get(winners, F.lit(0)) if tie == "first" else F.array_join(F.array_sort(winners), "/")
    some = total > 0
    return out.withColumns({
        "vote_count": total,
        "top_vote_count": top,
        "n_unique_votes": F.size("__u"),
        "is_tie": F.size(winners) > 1,
        "majority_answer": F.when(some, winner),
        "consensus_ratio": F.when(some, top / total),
        "vote_entropy": F.when(some, _entropy_bits(F.col("__n"), total)),
    }).drop("__v", "__u", "__n")


def vote_letter(value: Column) -> Column:
    """A letter a-d from a letter in any case or the codes 1-4 and 1.0-4.0; blank is null, others stay as they are."""
    t = F.lower(tx.strip(value.cast("string")))
    code = F.regexp_extract(t, r"^([1-4])(?:\.0)?$", 1)
    return F.when(t == "", None).when(code != "", F.element_at(F.array(*map(F.lit, CHOICES)), code.try_cast("int"))).otherwise(t)


def _tally(letters: Column) -> Column:
    def count_of(letter: str) -> Column:
        return F.size(F.filter(letters, lambda v: v == letter))

    return F.array(*[count_of(c) for c in CHOICES])


def annotator_vector(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``votes`` (counts for a-d) and ``unknown_votes`` (values that are neither blank nor readable)."""
    letters = F.array(*[vote_letter(F.col(c)) for c in columns])
    unknown = F.size(F.filter(letters, lambda v: v.isNotNull() & ~v.isin(*CHOICES)))
    return df.withColumns({"votes": _tally(letters), "unknown_votes": unknown})


def detect_vote_spec(columns: Sequence[str]) -> tuple[str, object] | None:
    """Which columns carry votes: annotator columns, four count columns, or one string column."""
    numbered = sorted((int(m.group(1)), c) for c in columns if (m := re.match(r"^answer(\d+)$", c)))
    if numbered:
        return "annotators", [c for _, c in numbered]
    present = set(columns)
    for template in VOTE_COLUMN_TEMPLATES:
        names = {c: template.format(c=c) for c in CHOICES}
        if present.issuperset(names.values()):
            return "counts", names
    found = next((c for c in VOTE_STRING_COLUMNS if c in present), None)
    return ("string", found) if found else None


def parse_vote_string(value: Column) -> Column:
    """Counts for a-d from ``A|B|B``, a JSON or Python mapping, or a list of four; null when unreadable."""
    s = tx.strip(value.cast("string"))
    letters = F.transform(F.split(s, r"\|"), lambda t: F.lower(tx.strip(t)))
    quoted = F.regexp_replace(F.regexp_replace(s, r"^\((.*)\)$", "[$1]"), "'", '"')
    mapping = F.from_json(quoted, "map<string,string>")
    lowered = F.transform_keys(mapping, lambda k, v: F.lower(tx.strip(k)))
    as_map = F.array(*[F.coalesce(F.try_element_at(lowered, F.lit(c)).try_cast("double").cast("int"), F.lit(0)) for c in CHOICES])
    items = F.from_json(quoted, "array<string>")
    as_list = F.transform(items, lambda x: x.try_cast("double").cast("int"))
    return (
        F.when(s.isNull() | (s == ""), F.array(*[F.lit(0)] * 4))
        .when(s.contains("|"), _tally(letters))
        .when(quoted.startswith("{") & mapping.isNotNull(), as_map)
        .when(quoted.startswith("[") & (F.size(items) == 4), as_list)
    )


def count_vector(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Vote counts from four columns; blanks count as zero."""
    cells = [F.coalesce(F.col(names[c]).cast("string").try_cast("double").cast("int"), F.lit(0)) for c in CHOICES]
    return df.withColumn("votes", F.array(*cells))


def vote_vector(df: DataFrame) -> DataFrame:
    """Detect the vote columns and add ``votes``."""
    spec = detect_vote_spec(df.columns)
    if spec is None:
        raise ValueError(f"no vote columns in {df.columns}")
    kind, where = spec
    if kind == "annotators":
        return annotator_vector(df, where)
    if kind == "counts":
        return count_vector(df, where)
    return df.withColumn("votes", parse_vote_string(F.col(where)))


def vote_pattern(votes: Column) -> Column:
    """Positive counts, largest first, as ``3:1:1``."""
    positive = F.sort_array(F.filter(votes, lambda n: n > 0), asc=False)
    return F.array_join(F.transform(positive, lambda n: n.cast("string")), ":")


def majority_from_vector(votes: Column) -> Column:
    """Lowest letter among the most voted."""
    best = F.array_position(votes, F.array_max(votes)).cast("int")
    return F.element_at(F.array(*map(F.lit, CHOICES)), best)


def top_is_unique(votes: Column) -> Column:
    top = F.array_max(votes)
    return (top > 0) & (F.size(F.filter(votes, lambda n: n == top)) == 1)


def with_patterns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "vote_pattern": vote_pattern(F.col("votes")),
        "human_answer": majority_from_vector(F.col("votes")),
        "top_unique": top_is_unique(F.col("votes")),
    })


def keep_patterns(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Rows of the wanted vote patterns."""
    for p in patterns:
        counts = [int(x) for x in p.split(":")]
        if len(counts) > 1 and counts[0] == counts[1]:
            raise ValueError(f"pattern {p} has tied leaders")
    return df.filter(F.col("vote_pattern").isin(*patterns))


def agreement_distribution(features: DataFrame) -> DataFrame:
    """How many items have each top count, agreement ratio and number of different votes."""
    return features.select(F.inline(F.array(
        F.struct(F.lit("top_vote_count").alias("measure"), F.col("top_vote_count").cast("double").alias("value")),
        F.struct(F.lit("consensus_ratio").alias("measure"), F.round("consensus_ratio", 6).alias("value")),
        F.struct(F.lit("n_unique_votes").alias("measure"), F.col("n_unique_votes").cast("double").alias("value")),
    ))).groupBy("measure", "value").agg(F.count("*").alias("n"))
