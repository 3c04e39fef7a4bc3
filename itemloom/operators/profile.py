"""Row features of question text, value counts, top lists and cross tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom import CHOICES
from itemloom.functions import rules, text as tx
from itemloom.session import spread


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_metrics(df: DataFrame, rule_list=rules.PROFILE_RULES, fallback: str = rules.PROFILE_FALLBACK) -> DataFrame:
    """Question and option lengths plus the profile question type."""
    chars = {c: F.length(_text(c)) for c in CHOICES}
    words = [tx.word_count(_text(c)) for c in CHOICES]
    total = sum(chars.values(), F.lit(0))
    return df.select(
        "split", "id",
        F.length(_text("question")).alias("question_chars"),
        tx.word_count(_text("question")).alias("question_tokens_ws"),
        (total / 4).alias("choice_chars_mean"),
        F.greatest(*chars.values()).alias("choice_chars_max"),
        total.alias("choice_chars_total"),
        (sum(words, F.lit(0)) / 4).alias("choice_tokens_ws_mean"),
        rules.pattern_label(_text("question"), rule_list, fallback).alias("question_type"),
        *[chars[c].alias(f"choice_{c}_chars") for c in CHOICES],
    )


# The feature columns of the text study, in report order.
TEXT_FEATURES = [
    "question_char_len",
    "question_word_len",
    "question_korean_ratio",
    "question_english_ratio",
    "question_digit_ratio",
    "option_char_mean",
    "option_char_range",
    "numeric_option_count",
    "full_text_char_len",
]


def normalize_columns(df: DataFrame, columns: Sequence[str] = ("question", *CHOICES)) -> DataFrame:
    """Add ``<column>_norm`` for each text column."""
    return df.withColumns({f"{c}_norm": tx.normalize_text(F.col(c)) for c in columns})


def text_features(df: DataFrame) -> DataFrame:
    """Normalized text with length, script and option features, full text and text-study question type."""
    out = normalize_columns(spread(df))
    sizes = {c: F.length(f"{c}_norm") for c in CHOICES}
    q = F.col("question_norm")
    out = out.withColumns({
        **{f"{c}_char_len": F.length(f"{c}_norm") for c in ("question", *CHOICES)},
        **{f"{c}_word_len": tx.word_count(F.col(f"{c}_norm")) for c in ("question", *CHOICES)},
        "question_korean_ratio": tx.pattern_share(q, "[가-힣]"),
        "question_english_ratio": tx.pattern_share(q, "[A-Za-z]"),
        "question_digit_ratio": tx.pattern_share(q, r"(?U)\d"),
        "question_has_digit": tx.has_digit(q),
        "question_has_question_mark": q.contains("?"),
        "option_char_mean": sum(sizes.values(), F.lit(0)) / 4,
        "option_char_min": F.least(*sizes.values()),
        "option_char_max": F.greatest(*sizes.values()),
        "option_char_range": F.greatest(*sizes.values()) - F.least(*sizes.values()),
        "numeric_option_count": sum((tx.numeric_like(F.col(f"{c}_norm")).cast("int") for c in CHOICES), F.lit(0)),
        "full_text": tx.problem_text("question_norm", [f"{c}_norm" for c in CHOICES]),
        "question_type": rules.text_type(q),
    })
    return out.withColumn("full_text_char_len", F.length("full_text"))


def option_similarity(df: DataFrame, suffix: str = "") -> DataFrame:
    """Mean and maximum bigram similarity over the six option pairs; columns without a suffix are normalized first."""
    out = df if suffix else df.withColumns({f"{c}__plain": tx.normalize_text(F.col(c)) for c in CHOICES})
    out = out.withColumns({f"__g_{c}": tx.ngram_set(F.col(c + (suffix or "__plain"))) for c in CHOICES})
    pairs = [(x, y) for i, x in enumerate(CHOICES) for y in CHOICES[i + 1:]]
    out = out.withColumn("__sims", F.array(*[tx.jaccard(F.col(f"__g_{x}"), F.col(f"__g_{y}")) for x, y in pairs]))
    mean = F.aggregate("__sims", F.lit(0.0), lambda acc, s: acc + s) / len(pairs)
    return out.withColumns({"option_similarity_mean": mean, "option_similarity_max": F.array_max("__sims")}).drop(
        "__sims", *[f"__g_{c}" for c in CHOICES], *([] if suffix else [f"{c}__plain" for c in CHOICES])
    )


def answer_length_artifact(df: DataFrame, suffix: str = "") -> DataFrame:
    """Length of the gold option against the mean of the other three."""
    names = [c + suffix for c in CHOICES]
    answer = F.lower(tx.strip(F.col("answer")))
    known = answer.isin(*CHOICES)
    gold = F.when(known, F.length(tx.option_of(answer, names))).otherwise(0)
    total = sum((F.length(n) for n in names), F.lit(0))
    wrong = F.when(known, (total - gold) / 3).otherwise(total / 4)
    return df.withColumns({
        "answer_char_len": gold, "wrong_char_mean": wrong, "answer_minus_wrong_len": gold - wrong,
    })


def gold_overlap(df: DataFrame) -> DataFrame:
    """Largest character overlap between the gold option and any other option."""
    gold = tx.option_of(F.col("answer"))
    best = F.greatest(*[
        F.when(F.col("answer") != c, tx.char_overlap(gold, F.col(c))).otherwise(F.lit(-1.0)) for c in CHOICES
    ])
    return df.withColumn("gold_overlap", best)


def value_counts(df: DataFrame, category: str, domain: Sequence[str] | None = None) -> DataFrame:
    """Counts and shares; with a domain, absent categories appear with zero."""
    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    if domain is not None:
        names = df.sparkSession.createDataFrame([(d,) for d in domain], f"{category} string")
        counts = names.join(counts, category, "left").na.fill(0, ["n"])
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def top_values(df: DataFrame, column: str, k: int, count_name: str = "n") -> DataFrame:
    """Most frequent values, ties in value order."""
    counts = df.groupBy(column).agg(F.count("*").alias(count_name))
    return counts.orderBy(F.desc(count_name), column).limit(k)


def top_prefixes(df: DataFrame, column: str, chars: int = 12, k: int = 30) -> DataFrame:
    return top_values(df.select(F.substring(column, 1, chars).alias("prefix")), "prefix", k)


def top_tokens(df: DataFrame, column: str, k: int = 40, stop_words: Sequence[str] = rules.STOP_WORDS) -> DataFrame:
    """Most frequent tokens of the normalized, lower-cased text that are longer than one character, stop words removed."""
    text = F.lower(tx.normalize_text(F.col(column)))
    tokens = spread(df.select(column)).select(F.explode(F.regexp_extract_all(text, F.lit("[가-힣A-Za-z0-9]+"), F.lit(0))).alias("token"))
    kept = tokens.filter((F.length("token") > 1) & ~F.col("token").isin(*stop_words))
    return top_values(kept, "token", k)


def top_words(df: DataFrame, column: str, k: int = 30) -> DataFrame:
    words = spread(df.select(column)).select(F.explode(F.regexp_extract_all(column, F.lit("[가-힣A-Za-z]+"), F.lit(0))).alias("word"))
    return top_values(words, "word", k)


def choice_overview(df: DataFrame) -> DataFrame:
    """One row: option length mean and maximum, digit share, repeated options, options inside the question."""
    cells = [F.col(c) for c in CHOICES]
    sizes = [F.length(c) for c in cells]
    inside = F.lit(False)
    for c in cells:
        inside = inside | F.col("question").contains(c)
    digit = sum((tx.has_digit(c).cast("int") for c in cells), F.lit(0))
    return df.agg(
        (F.sum(sum(sizes, F.lit(0))) / (4 * F.count("*"))).alias("choice_len_mean"),
        F.max(F.greatest(*sizes)).alias("choice_len_max"),
        (F.sum(digit) / (4 * F.count("*"))).alias("digit_share"),
        F.count_if(F.size(F.array_distinct(F.array(*cells))) < 4).alias("duplicate_choice_rows"),
        F.count_if(inside).alias("choice_in_question_rows"),
    )


def total_text_length(df: DataFrame) -> DataFrame:
    """Add the summed length of question and options."""
    return df.withColumn("text_len", sum((F.length(_text(c)) for c in ("question", *CHOICES)), F.lit(0)))


def cross_table(df: DataFrame, row: str, split_col: str, splits: Sequence[str]) -> DataFrame:
    """Counts and percent of each category per split."""
    pivot = df.groupBy(row).pivot(split_col, list(splits)).count().na.fill(0)
    totals = pivot.agg(*[F.sum(F.col(s)).alias(s) for s in splits]).select(F.struct(*splits)).scalar()
    wide = pivot.withColumn("__t", totals)
    return wide.select(
        row,
        *[F.col(s).alias(f"n_{s}") for s in splits],
        *[(F.col(s) / F.col(f"__t.{s}") * 100).alias(f"pct_{s}") for s in splits],
    )


def margin_table(df: DataFrame, left: str, right: str) -> DataFrame:
    """Two-way counts with row, column and grand totals (``All``)."""
    counted = df.cube(left, right).agg(F.count("*").alias("n"), F.grouping(left).alias("gl"), F.grouping(right).alias("gr"))
    def label(c, g):
        return F.when(F.col(g) == 1, F.lit("All")).otherwise(F.col(c).cast("string"))
    return counted.select(label(left, "gl").alias(left), label(right, "gr").alias(right), "n")


def repeated_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    return top_values(df, column, k)


def image_size_overview(df: DataFrame, split_col: str, splits: Sequence[str]) -> DataFrame:
    """Width and height percentiles and the share of long sides over 1500 and 2500."""
    from itemloom.operators.distribution import metric_profile

    marks = {"p5": 0.05, "p50": 0.5, "p95": 0.95}
    profile = metric_profile(df, split_col, splits, ["width", "height"], marks)
    wide = profile.select(F.inline(F.array(*[
        F.struct(F.lit(s).alias("split"), F.col("metric"), *[F.col(f"{m}_{s}").alias(m) for m in marks]) for s in splits
    ])))
    sizes = wide.groupBy("split").agg(*[
        F.max(F.when(F.col("metric") == d, F.col(m))).alias(f"{d}_{m}") for d in ("width", "height") for m in marks
    ])
    long_side = F.greatest("width", "height")
    shares = df.groupBy(F.col(split_col).alias("split")).agg(
        F.avg((long_side > 1500).cast("int")).alias("share_over_1500"),
        F.avg((long_side > 2500).cast("int")).alias("share_over_2500"),
    )
    return sizes.join(shares, "split")


def top_combinations(
    df: DataFrame, left: str, right: str, split_col: str, splits: Sequence[str], lead: str, k: int = 10
) -> DataFrame:
    """Most common value pairs of the leading split with the shares in every split (percent, two decimals)."""
    from itemloom.operators.distribution import share_table

    keyed = df.withColumn("combination", F.concat(F.col(left).cast("string"), F.lit("x"), F.col(right).cast("string")))
    counts = keyed.filter(F.col(split_col) == lead).groupBy("combination").agg(F.count("*").alias("__n"))
    top = counts.orderBy(F.desc("__n"), "combination").limit(k)
    table = share_table(keyed, split_col, splits, "combination")
    return table.join(F.broadcast(top.select("combination")), "combination")  # k rows by construction


def melted_means(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Unpivot columns and average them per group."""
    return df.select(group, *[F.col(c).cast("double") for c in columns]).unpivot([group], list(columns), "channel", "value").groupBy(
        group, "channel"
    ).agg(F.avg("value").alias("mean_value"))
