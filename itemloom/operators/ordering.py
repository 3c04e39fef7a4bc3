"""Distributed running sums, ranks and exact quantiles.

A plain window over a whole table (or over one of four classes) sorts everything in one task. Here rows are
first put into buckets that follow the sort order, each bucket is summed on its own, and the few bucket totals
are summed up to give every bucket its starting offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions.hashing import key_bucket
from itemloom.session import shuffle_width

_BUCKET = "__bucket"


# Share of rows looked at for bucket bounds. Bounds only balance the buckets: results are exact for any bounds.
BOUND_SAMPLE = 0.02


def numeric_bucket(
    df: DataFrame, column: str, by: str | None = None, buckets: int | None = None, of: str | None = None
) -> Column:
    """Order-preserving bucket number from approximate quantiles (one light pass, a few numbers on the driver).

    ``by`` names a column with few values, such as a metric name; each value gets its own bounds. ``of`` names the
    column to put into buckets when the bounds come from a cheaper table with the same value range.
    """
    value = F.col(of or column)
    n = buckets or shuffle_width(df.sparkSession)
    bounds = F.percentile_approx(column, [i / n for i in range(1, n)], 20 * n).alias("bounds")
    some = df.sample(fraction=BOUND_SAMPLE, seed=1)
    if by is None:
        found = some.agg(bounds).first()["bounds"]
        return bucket_of(value, sorted(set(found or [])))
    cases = None
    for row in some.groupBy(by).agg(bounds).collect():
        level = bucket_of(value, sorted(set(row["bounds"] or [])))
        hit = F.col(by) == row[by]
        cases = F.when(hit, level) if cases is None else cases.when(hit, level)
    return F.lit(0) if cases is None else F.coalesce(cases, F.lit(0))


def bucket_of(value: Column, cuts: list) -> Column:
    """Number of cuts below a value: nested comparisons that compile for few cuts, a filtered array for many."""
    if len(cuts) > 128:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda b: b < value))

    def halve(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value > F.lit(cuts[mid]), halve(mid + 1, high)).otherwise(halve(low, mid))

    return halve(0, len(cuts))


def running_sums(
    df: DataFrame,
    by: list[str],
    order: list,
    sums: dict[str, str | Column],
    bucket: Column,
    below: Column | int | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Add inclusive running sums in ``order`` within ``by``.

    ``few_groups`` states that ``by`` takes few values by construction (metric names, splits, answer letters, or
    nothing); then the bucket offsets, one row per group and bucket, are broadcast. Otherwise they are joined.

    ``bucket`` must follow ``order``. With ``below``, only rows of buckets whose first running sum (of the first
    entry) starts under that value are kept, which cuts a top-k to the buckets that can matter.
    """
    values = {name: (F.col(v) if isinstance(v, str) else v) for name, v in sums.items()}
    tagged = df.withColumn(_BUCKET, bucket)
    keys = [*by, _BUCKET]
    totals = tagged.groupBy(*keys).agg(*[F.sum(v).alias(f"__t_{k}") for k, v in values.items()])
    before = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in values],
    )
    if below is not None:
        offsets = offsets.filter(F.col(f"__o_{next(iter(values))}") < below)
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    joined = tagged.join(F.broadcast(offsets) if few_groups or not by else offsets, same)
    local = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.select(
        *df.columns,
        *[(F.sum(v).over(local) + F.col(f"__o_{k}")).alias(k) for k, v in values.items()],
    )
    return out


def rank_by_key(
    df: DataFrame, key: str, name: str, by: list[str] | None = None, upto: int | None = None, few_groups: bool = False
) -> DataFrame:
    """1-based rank by a hex-hash key within ``by``; with ``upto``, only the first rows are kept."""
    one = {name: F.lit(1).cast("long")}
    out = running_sums(df, by or [], [key], one, key_bucket(F.col(key)), below=upto, few_groups=few_groups)
    return out if upto is None else out.filter(F.col(name) <= upto)


def rank_pick(rank: Column, cumulative: Column, count: Column, value: Column) -> Column:
    """Aggregate: the value holding a 0-based rank, from distinct values with counts and running counts."""
    return F.max(F.when((cumulative > rank) & (cumulative - count <= rank), value))


def quantile_of(total: Column, q: float, cumulative: Column, count: Column, value: Column) -> Column:
    """Aggregate: exact quantile with linear interpolation from running counts of distinct values."""
    h = (total - 1) * F.lit(float(q))
    lo = rank_pick(F.floor(h), cumulative, count, value)
    hi = rank_pick(F.ceil(h), cumulative, count, value)
    part = F.max(h - F.floor(h))
    return lo + (hi - lo) * part
