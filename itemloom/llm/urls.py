"""URL filters: rules first, and a ratio of character language models for the rest.

A url's characters are mapped to 32 symbols (a-z, 0 for any digit, four marks, one for everything else), and every
position gives one 4-gram with padding at the front. Urls that a rule allows and urls that a rule blocks are counted
apart. Both models are variable-order Markov models: the estimate for a context of three symbols falls back by
Witten-Bell weights on two, one and none, in proportion to how many different symbols followed the context, and an unseen
context counts not at all. A url's score is the mean over its characters of log p(accepted) - log p(rejected).

The rule-decided urls of four fifths of the hosts (by md5 of the host) are counted; those of the other hosts, which the
models have not seen, calibrate the cut. Scores are put into steps of 0.02; between two steps that hold scores every
cut has the same sum of both error rates, and the cut is the middle of the interval where it is smallest (of equal ones the
widest, then the lowest). Without held-out urls of both sides the cut is 0. Counts cover every url. The table of
4-grams has at most 33**4 rows whatever the input, so it may be broadcast.

Defined results: a null url, or one without ``://``, has empty host and path and no rule; an url without characters, and
every undecided url while one side has no examples, is allowed; rows are independent, so repeated rows agree; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.llm.exact import LOWER, UPPER
from itemloom.llm.store import stored

SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-?*"
ORDER = 4
STEP, SPAN = 0.02, 5.0


def parsed(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    cut = F.instr(url, "://")
    rest = F.when(cut > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def ruled(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """Longest rule that fits and its verdict; null where none does. A rule is a host and the start of a path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # later ones win
        own, slash, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, rules[rule]).otherwise(verdict)
    return name, verdict


def symbols(url: Column) -> Column:
    """The url over 32 symbols."""
    low = F.translate(url, UPPER + "123456789", LOWER + "000000000")
    known = F.regexp_replace(low, r"[=&%_~+:;,#@!]", "?")
    return F.regexp_replace(known, r"[^a-z0./?\-]", "*")


def grams(rows: DataFrame, text: str, *carried: str) -> DataFrame:
    """One row per character with its 4-gram."""
    padded = rows.select(*carried, F.concat(F.lit("^" * (ORDER - 1)), text).alias("p"), F.length(text).alias("len")).filter("len > 0")
    return padded.select(*carried, "len", F.explode(F.sequence(F.lit(1), F.col("len"))).alias("at"), "p").select(
        *carried, "len", F.expr(f"substring(p, at, {ORDER})").alias("gram")
    )


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, ratio) from (gram, yes, no): log of the two models' probabilities for the last symbol of each gram."""
    level = None
    for k in range(1, ORDER + 1):
        own = counts.groupBy(F.substring("gram", ORDER - k + 1, k).alias("g")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        context = Window.partitionBy(F.substring("g", 1, k - 1)) if k > 1 else Window.partitionBy(F.lit(0))
        for side in ("yes", "no"):
            own = own.withColumns({
                f"n_{side}": F.sum(side).over(context), f"t_{side}": F.sum((F.col(side) > 0).cast("int")).over(context),
            })
        if level is None:
            own = own.withColumns({f"low_{s}": F.lit(1.0 / (len(SYMBOLS) + 1)) for s in ("yes", "no")})
        else:
            own = own.join(level, F.substring("g", 2, k - 1) == F.col("below"))
        p = {
            s: F.when(F.col(f"n_{s}") == 0, F.col(f"low_{s}")).otherwise(
                (F.col(s) + F.col(f"t_{s}") * F.col(f"low_{s}")) / (F.col(f"n_{s}") + F.col(f"t_{s}"))
            )
            for s in ("yes", "no")
        }
        level = own.select(F.col("g").alias("below"), *[p[s].alias(f"low_{s}") for s in ("yes", "no")])
    return level.select(F.col("below").alias("gram"), (F.log("low_yes") - F.log("low_no")).alias("ratio"))


def calibrated_cut(scores: DataFrame) -> float:
    """Middle of the best interval for a cut on (score, side) rows; from a table of at most 501 steps."""
    steps = int(2 * SPAN / STEP)
    step = F.least(F.greatest(F.floor((F.col("score") + SPAN) / STEP), F.lit(0)), F.lit(steps)).alias("step")
    bins = scores.groupBy(step).agg(F.sum((F.col("side") == "allow").cast("int")).alias("yes"), F.sum((F.col("side") == "block").cast("int")).alias("no"))
    in_order = Window.orderBy("step")
    below, everything = in_order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    lost = F.try_divide(F.coalesce(F.sum("yes").over(below), F.lit(0)), F.sum("yes").over(everything))
    passed = 1 - F.try_divide(F.coalesce(F.sum("no").over(below), F.lit(0)), F.sum("no").over(everything))
    low = F.coalesce(F.lag("step").over(in_order) + 1, F.col("step"))
    intervals = bins.select("step", low.alias("low"), F.round(lost + passed, 9).alias("error"))
    best = intervals.orderBy("error", F.col("low") - F.col("step"), "step").first()
    return (best["low"] + best["step"]) / 2 * STEP - SPAN if best is not None and best["error"] is not None else 0.0


def filtered(pages: DataFrame, rules: dict[str, str], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Verdict on every row: the id, host, path, rule, score, verdict."""
    host, path = parsed(F.col("url"))
    rows = pages.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_column).alias("id"), F.col(url_column).alias("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, side = ruled(F.col("host"), F.col("path"), rules)
    held = F.substring(F.md5("host"), 1, 1).isin("0", "1", "2")
    rows = stored(
        rows.withColumns({"rule": rule, "side": side, "held": held, "marks": symbols(F.coalesce("url", F.lit("")))}).drop("url"), "urls"
    )
    learned = (F.col("side") == "allow") & ~F.col("held"), (F.col("side") == "block") & ~F.col("held")
    counts = grams(rows, "marks", "side", "held").groupBy("gram").agg(*[
        F.sum(F.when(side, 1).otherwise(0)).alias(name) for side, name in zip(learned, ("yes", "no"), strict=True)
    ])
    ratios = stored(log_ratios(stored(counts, "grams")), "ratios").withColumnRenamed("gram", "known")
    # at most 33**4 rows, by the symbols
    scored = grams(rows, "marks", "row_no").join(F.broadcast(ratios), F.col("gram") == F.col("known"))
    scores = stored(
        scored.groupBy("row_no").agg((F.sum("ratio") / F.max("len")).alias("score")), "scores"
    )
    judged = rows.drop("marks").join(scores.withColumnRenamed("row_no", "s_row"), F.col("row_no") == F.col("s_row"), "left")
    sides = {r["side"]: r["n"] for r in rows.filter("side IS NOT NULL AND NOT held").groupBy("side").agg(F.count("*").alias("n")).collect()}
    trained = len(sides) == 2
    cut = calibrated_cut(judged.filter("held AND side IS NOT NULL AND score IS NOT NULL")) if trained else 0.0
    method = F.when(F.lit(trained) & (F.col("score") < F.lit(cut)), "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id_column), "host", "path", "rule", F.col("score").alias("url_score"), F.coalesce("side", method).alias("verdict")
    )
