"""Comparing the distributions of splits: moments, quantiles, SMD, KS, TV, JS, histograms, rank correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.operators.ordering import bucket_of, numeric_bucket, quantile_of, running_sums
from itemloom.session import cut_lineage, shuffle_width

QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def long_metrics(df: DataFrame, metrics: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (kept columns, metric, value); missing and NaN values are dropped."""
    typed = df.select(*keep, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = typed.unpivot(list(keep), list(metrics), "metric", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def _in_split(split_col: str, split: str) -> Column:
    return F.col(split_col) == split


def _moments(df: DataFrame, split_col: str, splits: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Count, mean, deviation and extremes per metric: one wide aggregate, turned into one row per metric."""
    def value(m, s):
        return F.when(_in_split(split_col, s) & ~F.isnan(m), F.col(m))
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[fn(value(m, s)).alias(f"{p}_{s}_{i}") for i, m in enumerate(metrics) for s in splits for p, fn in parts.items()])
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), *[F.col(f"{p}_{s}_{i}").alias(f"{p}_{s}") for s in splits for p in parts])
        for i, m in enumerate(metrics)
    ])
    return wide.select(F.inline(rows))


def _counted_moments(splits: Sequence[str]) -> list[Column]:
    """The same moments from distinct values with their counts; sums are taken about ``pivot``, so large offsets cost no digits."""
    found = []
    for s in splits:
        n, gap = F.col(f"n_{s}"), F.col("value") - F.col("pivot")
        total, first, second = F.max(f"total_{s}"), F.sum(n * gap), F.sum(n * gap * gap)
        mean = F.when(total > 0, F.max("pivot") + first / total)
        spread = F.when(total > 1, F.sqrt(F.greatest(second - first * first / total, F.lit(0.0)) / (total - 1)))
        own = F.when(n > 0, F.col("value"))
        found += [total.alias(f"count_{s}"), mean.alias(f"mean_{s}"), spread.alias(f"std_{s}"), F.min(own).alias(f"min_{s}"), F.max(own).alias(f"max_{s}")]
    return found


def _running_counts(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """Distinct values of each metric with running counts ``c_<name>`` of ``n_<name>``, totals ``total_<name>`` and a ``pivot``.

    The bounds of the buckets are quantiles of a mergeable sketch of the written distinct values, one row per metric
    name. They balance the work and nothing else.
    """
    n = shuffle_width(counts.sparkSession)
    ranks = F.array(*[F.lit(i / n) for i in range(1, n)])
    sketched = counts.groupBy("metric").agg(F.kll_sketch_agg_double("value").alias("sketch"), *[F.sum(f"n_{s}").alias(f"total_{s}") for s in names])
    table = sketched.select("metric", F.kll_sketch_get_quantile_double("sketch", ranks).alias("cuts"), *[f"total_{s}" for s in names]).collect()
    if not table:
        return counts.select("*", *[F.col(f"n_{s}").alias(a) for s in names for a in (f"c_{s}", f"total_{s}")], F.col("value").alias("pivot"))

    def per_metric(of) -> Column:
        cases = None
        for row in table:
            hit = F.col("metric") == row["metric"]
            cases = F.when(hit, of(row)) if cases is None else cases.when(hit, of(row))
        return cases
    bucket = per_metric(lambda row: bucket_of(F.col("value"), sorted(set(row["cuts"]))))
    running = running_sums(counts, ["metric"], ["value"], {f"c_{s}": f"n_{s}" for s in names}, bucket, few_groups=True)
    totals = {f"total_{s}": per_metric(lambda row, s=s: F.lit(row[f"total_{s}"])) for s in names}
    return running.withColumns(totals | {"pivot": per_metric(lambda row: F.lit(row["cuts"][n // 2 - 1]))})


def metric_profile(
    df: DataFrame,
    split_col: str,
    splits: Sequence[str],
    metrics: Sequence[str],
    quantiles: dict[str, float] | None = None,
    ks_pairs: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """One row per metric: ``count_/mean_/std_/min_/max_<split>``, quantiles and ``ks_<a>_<b>``.

    One scan: equal values are counted first and written, so a value shared by a third of the rows is one row
    afterwards, and bucket bounds, moments, exact quantiles and the KS distance all come from these counts.
    Metrics without any value are left out then.
    """
    quantiles = QUARTILES if quantiles is None else quantiles
    typed = df.filter(F.col(split_col).isin(*splits)).select(split_col, *[F.col(m).cast("double").alias(m) for m in metrics])
    if not quantiles and not ks_pairs:
        return _moments(typed, split_col, splits, metrics)
    long = long_metrics(typed, metrics, [split_col])
    counts = cut_lineage(long.groupBy("metric", "value").agg(*[F.count(F.when(_in_split(split_col, s), 1)).alias(f"n_{s}") for s in splits]))
    sized = _running_counts(counts, splits)
    picks = [
        quantile_of(F.col(f"total_{s}"), q, F.col(f"c_{s}"), F.col(f"n_{s}"), F.col("value")).alias(f"{name}_{s}")
        for s in splits for name, q in quantiles.items()
    ]
    gaps = [
        F.max(F.abs(F.col(f"c_{a}") / F.col(f"total_{a}") - F.col(f"c_{b}") / F.col(f"total_{b}"))).alias(f"ks_{a}_{b}")
        for a, b in ks_pairs
    ]
    return sized.groupBy("metric").agg(*_counted_moments(splits), *picks, *gaps)


def smd(profile_base: str, profile_other: str) -> Column:
    """Standardized mean difference, other minus base; 0 when the pooled deviation is 0."""
    pooled = F.sqrt((F.col(f"std_{profile_base}") ** 2 + F.col(f"std_{profile_other}") ** 2) / 2)
    gap = F.col(f"mean_{profile_other}") - F.col(f"mean_{profile_base}")
    return F.when(pooled == 0, F.lit(0.0)).otherwise(gap / pooled)


def numeric_summary(profile: DataFrame, splits: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Long form of a profile: one row per metric and split with the chosen fields."""
    rows = F.array(*[
        F.struct(F.lit(s).alias("split"), *[F.col(f"{f}_{s}").alias(f) for f in fields]) for s in splits
    ])
    return profile.select("metric", F.inline(rows))


def numeric_comparison(
    df: DataFrame, split_col: str, base: str, other: str, metrics: Sequence[str], sign: int = 1
) -> DataFrame:
    """Means, mean difference, SMD and KS of two splits per metric; ``sign=-1`` gives base minus other."""
    profile = metric_profile(df, split_col, [base, other], metrics, quantiles={}, ks_pairs=[(base, other)])
    return profile.select(
        "metric",
        F.col(f"mean_{base}").alias("base_mean"),
        F.col(f"mean_{other}").alias("other_mean"),
        ((F.col(f"mean_{other}") - F.col(f"mean_{base}")) * sign).alias("mean_difference"),
        (smd(base, other) * sign).alias("standardized_mean_difference"),
        F.col(f"ks_{base}_{other}").alias("ks_statistic"),
    )


def shift_table(df: DataFrame, split_col: str, base: str, others: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """SMD and KS of one split against several others, rounded to four places."""
    profile = metric_profile(df, split_col, [base, *others], metrics, quantiles={}, ks_pairs=[(o, base) for o in others])
    columns = [F.col("metric")]
    for o in others:
        columns.append(F.round(smd(o, base), 4).alias(f"smd_{base}_{o}"))
        columns.append(F.round(F.col(f"ks_{o}_{base}"), 4).alias(f"ks_{base}_{o}"))
    return profile.select(*columns)


def describe_splits(df: DataFrame, split_col: str, splits: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    profile = metric_profile(df, split_col, splits, metrics)
    return numeric_summary(profile, splits, ["count", "mean", "std", "min", "p25", "median", "p75", "max"])


def ks_p_value(statistic: float, n: int, m: int) -> float:
    """Two-sided asymptotic p-value of the two-sample KS statistic."""
    if n == 0 or m == 0:
        return float("nan")
    x = statistic * math.sqrt(n * m / (n + m))
    if x < 0.2:
        return 1.0
    if x < 1.18:  # the theta-function form converges fast for small x
        terms = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 8))
        return max(0.0, min(1.0, 1 - math.sqrt(2 * math.pi) / x * terms))
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def numeric_tests(df: DataFrame, split_col: str, base: str, other: str, metrics: Sequence[str]) -> DataFrame:
    """Comparison with the KS p-value, largest statistic first (one row per metric)."""
    profile = metric_profile(df, split_col, [base, other], metrics, quantiles={}, ks_pairs=[(base, other)])

    def with_p(batches):
        for pdf in batches:
            pdf["ks_p_value"] = [ks_p_value(s, n, m) for s, n, m in zip(pdf.ks_statistic, pdf.n_base, pdf.n_other)]
            yield pdf

    table = profile.select(
        "metric", F.col(f"count_{base}").alias("n_base"), F.col(f"count_{other}").alias("n_other"),
        (-smd(base, other)).alias("smd_base_minus_other"), F.col(f"ks_{base}_{other}").alias("ks_statistic"),
    )
    schema = "metric string, n_base long, n_other long, smd_base_minus_other double, ks_statistic double, ks_p_value double"
    return table.mapInPandas(with_p, schema).orderBy(F.desc("ks_statistic"), "metric")


def category_counts(df: DataFrame, split_col: str, splits: Sequence[str], category: str) -> DataFrame:
    """Counts of each category in each split, one row per category."""
    return df.groupBy(category).agg(*[F.count(F.when(_in_split(split_col, s), 1)).alias(f"n_{s}") for s in splits]).filter(
        F.greatest(*[F.col(f"n_{s}") for s in splits], F.lit(0)) > 0
    )


def _shares(counts: DataFrame, splits: Sequence[str]) -> DataFrame:
    totals = counts.agg(*[F.sum(f"n_{s}").alias(s) for s in splits])
    struct = totals.select(F.struct(*splits)).scalar()
    return counts.withColumn("__t", struct).select(
        *counts.columns, *[(F.col(f"n_{s}") / F.col(f"__t.{s}")).alias(f"share_{s}") for s in splits]
    )


def total_variation(df: DataFrame, split_col: str, base: str, other: str, category: str) -> DataFrame:
    shares = _shares(category_counts(df, split_col, [base, other], category), [base, other])
    return shares.agg((F.sum(F.abs(F.col(f"share_{base}") - F.col(f"share_{other}"))) * 0.5).alias("total_variation"))


def jensen_shannon(df: DataFrame, split_col: str, base: str, other: str, category: str) -> DataFrame:
    """Jensen-Shannon distance (square root of the divergence, base 2)."""
    p, q = F.col(f"share_{base}"), F.col(f"share_{other}")
    mid = (p + q) / 2
    def part(x):
        return F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0)
    shares = _shares(category_counts(df, split_col, [base, other], category), [base, other])
    return shares.agg(F.sqrt(F.greatest(F.sum(part(p) + part(q)) / 2, F.lit(0.0))).alias("js_distance"))


def share_table(df: DataFrame, split_col: str, splits: Sequence[str], category: str) -> DataFrame:
    """Percent of each category per split, two decimals, absent combinations 0."""
    shares = _shares(category_counts(df, split_col, splits, category), splits)
    return shares.select(category, *[F.round(F.col(f"share_{s}") * 100, 2).alias(f"pct_{s}") for s in splits])


def pooled_quantiles(df: DataFrame, metrics: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles per metric over all rows."""
    tagged = df.select(F.lit("all").alias("__s"), *metrics)
    profile = metric_profile(tagged, "__s", ["all"], metrics, quantiles)
    return profile.select("metric", *[F.col(f"{q}_all").alias(q) for q in quantiles])


def _pooled_quantiles(counts: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Exact quantiles per metric from counts of (metric, value, split)."""
    sized = _running_counts(cut_lineage(counts.groupBy("metric", "value").agg(F.sum("n").alias("n_all"))), ["all"])
    return sized.groupBy("metric").agg(*[
        quantile_of(F.col("total_all"), q, F.col("c_all"), F.col("n_all"), F.col("value")).alias(name) for name, q in quantiles.items()
    ])


def density_histogram(
    df: DataFrame,
    split_col: str,
    metrics: Sequence[str],
    bins: int = 40,
    low_q: float | None = 0.005,
    high_q: float = 0.995,
    mode: str = "clip",
) -> DataFrame:
    """Density per (metric, split, bin) between pooled quantiles.

    ``mode="clip"`` moves outliers into the end bins; ``mode="filter"`` drops values above the upper quantile and
    uses each split's own minimum and maximum as edges. Edges and bins come from the same counts of equal values.
    """
    if mode not in ("clip", "filter"):
        raise ValueError(f"unknown mode {mode!r}")
    typed = df.select(split_col, *[F.col(m).cast("double").alias(m) for m in metrics])
    counts = cut_lineage(long_metrics(typed, metrics, [split_col]).groupBy("metric", "value", split_col).agg(F.count("*").alias("n")))
    if mode == "clip":
        edges = _pooled_quantiles(counts, {"lo": low_q or 0.0, "hi": high_q})
        edges = edges.withColumn("hi", F.when(F.col("hi") == F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")))
        # one row per metric: bounded by the metric list
        joined = counts.join(F.broadcast(edges), "metric").withColumn("value", F.least(F.greatest("value", "lo"), F.col("hi")))
    else:
        upper = _pooled_quantiles(counts, {"xmax": high_q})
        kept = counts.join(F.broadcast(upper), "metric").filter(F.col("value") <= F.col("xmax"))
        edges = kept.groupBy("metric", split_col).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        edges = edges.select(
            "metric", split_col,
            F.when(F.col("hi") == F.col("lo"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("hi") == F.col("lo"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        )
        joined = kept.join(edges, ["metric", split_col])
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counted = joined.select("metric", split_col, "n", index.cast("int").alias("bin"), "lo", width.alias("width")).groupBy(
        "metric", split_col, "bin"
    ).agg(F.sum("n").alias("n"), F.first("lo").alias("lo"), F.first("width").alias("width"))
    total = F.sum("n").over(Window.partitionBy("metric", split_col))  # as many rows as bins
    return counted.withColumn("total", total).select(
        "metric", split_col, "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("edge"),
        "n", (F.col("n") / (F.col("total") * F.col("width"))).alias("density"),
    )


def rank_correlation(df: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Spearman correlation with average ranks, pairwise complete, one row per feature with a column per target."""
    pairs = [
        F.struct(
            F.lit(f).alias("feature"), F.lit(t).alias("target"),
            F.col(f).cast("double").alias("x"), F.col(t).cast("double").alias("y"),
        )
        for f in features for t in targets
    ]
    complete = df.select(F.inline(F.array(*pairs))).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    )
    complete = complete.withColumn("pair", F.concat_ws("|", "feature", "target"))
    joint = complete.groupBy("pair", "feature", "target", "x", "y").agg(F.count("*").alias("n"))

    def average_rank(axis: str) -> DataFrame:
        counts = joint.groupBy("pair", axis).agg(F.sum("n").alias("k"))
        cum = running_sums(counts, ["pair"], [axis], {"c": "k"}, numeric_bucket(complete, axis, by="pair"), few_groups=True)
        return cum.select("pair", axis, (F.col("c") - F.col("k") + (F.col("k") + 1) / 2).alias(f"r{axis}"))

    sizes = joint.groupBy("pair").agg(F.sum("n").alias("total"))
    ranked = joint.join(average_rank("x"), ["pair", "x"]).join(average_rank("y"), ["pair", "y"])
    # one row per feature-target pair: bounded by the two column lists
    ranked = ranked.join(F.broadcast(sizes), "pair").select(
        "feature", "target", "n",
        ((F.col("rx") - (F.col("total") + 1) / 2) / F.col("total")).alias("dx"),
        ((F.col("ry") - (F.col("total") + 1) / 2) / F.col("total")).alias("dy"),
    )
    r = F.sum(F.col("n") * F.col("dx") * F.col("dy")) / F.sqrt(
        F.sum(F.col("n") * F.col("dx") ** 2) * F.sum(F.col("n") * F.col("dy") ** 2)
    )
    table = ranked.groupBy("feature", "target").agg(r.alias("rho"))
    return table.groupBy("feature").agg(*[F.max(F.when(F.col("target") == t, F.col("rho"))).alias(f"rho_{t}") for t in targets])


def imbalance_ratio(df: DataFrame, category: str) -> DataFrame:
    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    return counts.agg((F.max("n") / F.min("n")).alias("imbalance_ratio"))


def acceptance_verdict(
    shifts: DataFrame, variation: DataFrame, max_smd: float = 0.1, max_ks: float = 0.05, max_tv: float = 0.03
) -> DataFrame:
    """Whether a split may be accepted: all |SMD| and KS under their limits and TV at most its limit.

    ``shifts`` has ``smd_*`` and ``ks_*`` columns; ``variation`` has ``total_variation``.
    """
    smds = [F.abs(F.col(c)) for c in shifts.columns if c.startswith("smd_")]
    kss = [F.col(c) for c in shifts.columns if c.startswith("ks_")]
    tv = variation.agg(F.max("total_variation")).scalar()
    worst = shifts.agg(
        F.max(F.greatest(*smds, F.lit(0.0))).alias("worst_smd"), F.max(F.greatest(*kss, F.lit(0.0))).alias("worst_ks")
    ).withColumn("worst_tv", tv)
    return worst.withColumn(
        "accepted",
        (F.col("worst_smd") < max_smd) & (F.col("worst_ks") < max_ks) & (F.col("worst_tv") <= max_tv),
    )
