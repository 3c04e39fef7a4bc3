"""Group-aware, stratified splitting and seeded sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom import CHOICES
from itemloom.functions.hashing import key_bucket, seeded_key
from itemloom.operators.ordering import rank_by_key, running_sums


def first_fit(groups: DataFrame, stratum: str, size: str, key: str, fraction: float) -> DataFrame:
    """Flag groups taken, per stratum in key order, while the rows taken so far are below the target.

    The target is the rounded share (half to even) of the stratum's rows.
    """
    sums = running_sums(groups, [stratum], [key], {"__cum": size}, key_bucket(F.col(key)))
    targets = groups.groupBy(stratum).agg(F.bround(F.sum(size) * F.lit(float(fraction)), 0).alias("__target"))
    joined = sums.join(targets, stratum)
    return joined.withColumn("taken", F.col("__cum") - F.col(size) < F.col("__target")).drop("__cum", "__target")


def stratified_group_split(
    df: DataFrame, fraction: float = 0.1, seed: int = 42, group: str = "gid", stratum: str = "answer", position: str = "pos"
) -> DataFrame:
    """Add ``is_validation`` so that no group is divided; a group's stratum is that of its first row."""
    groups = df.groupBy(group).agg(F.min_by(stratum, position).alias("__s"), F.count("*").alias("__size"))
    keyed = groups.withColumn("__key", seeded_key(seed, F.col(group)))
    taken = first_fit(keyed, "__s", "__size", "__key", fraction).select(group, F.col("taken").alias("is_validation"))
    return df.join(taken, group)


def split_metadata(split: DataFrame, group: str = "gid", label: str = "answer", domain: Sequence[str] = CHOICES) -> DataFrame:
    """Sizes, groups, multi-row groups and answer ratios of a split in one row."""
    held = F.col("is_validation")
    groups = split.groupBy(group).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("n") > 1).alias("n_multi_groups")
    ).select(F.struct("n_groups", "n_multi_groups")).scalar()
    def ratio(part: Column, c: str) -> Column:
        return F.round(F.count_if(part & (F.col(label) == c)) / F.count_if(part), 4)
    one = split.agg(
        F.count("*").alias("n_original"), F.count_if(~held).alias("n_train"), F.count_if(held).alias("n_validation"),
        *[ratio(~held, c).alias(f"ratio_train_{c}") for c in domain],
        *[ratio(held, c).alias(f"ratio_validation_{c}") for c in domain],
    )
    return one.withColumn("__g", groups).select(*one.columns, "__g.n_groups", "__g.n_multi_groups")


def group_split(df: DataFrame, fraction: float, seed: int = 42, group: str = "group_key") -> DataFrame:
    """Add ``is_validation`` for the first rounded share of groups in seeded order, at least one."""
    if fraction <= 0:
        return df.withColumn("is_validation", F.lit(False))
    groups = df.groupBy(group).agg(F.lit(1).alias("__one")).withColumn("__key", seeded_key(seed, F.col(group)))
    wanted = groups.agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(float(fraction)), 0)).cast("long")).scalar()
    ranked = rank_by_key(groups, "__key", "__rank")
    flags = ranked.select(group, (F.col("__rank") <= wanted).alias("is_validation"))
    return df.join(flags, group)


def sample_rows(df: DataFrame, n: int, seed: int = 42, id_col: str = "id", by: list[str] | None = None) -> DataFrame:
    """The first n rows in seeded order, over all rows or within each ``by`` group."""
    keyed = df.withColumn("__key", seeded_key(seed, F.col(id_col)))
    return rank_by_key(keyed, "__key", "__rank", by, upto=n).drop("__key", "__rank")


def head_rows(df: DataFrame, n: int, position: str = "pos") -> DataFrame:
    return df.orderBy(position).limit(n)


def assign_folds(df: DataFrame, folds: int, stratum: str, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Add ``fold``: seeded order within each stratum, dealt round robin."""
    keyed = df.withColumn("__key", seeded_key(seed, F.col(id_col)))
    ranked = rank_by_key(keyed, "__key", "__rank", [stratum])
    return ranked.withColumn("fold", ((F.col("__rank") - 1) % folds).cast("int")).drop("__key", "__rank")


def shuffled(df: DataFrame, seed: int = 42, id_col: str = "id", position: str = "position") -> DataFrame:
    """Add a 1-based position in seeded order."""
    keyed = df.withColumn("__key", seeded_key(seed, F.col(id_col)))
    return rank_by_key(keyed, "__key", position).drop("__key")
