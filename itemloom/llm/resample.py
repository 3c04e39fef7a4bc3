"""Quality classifier by importance resampling.

Words and word pairs are hashed into a fixed number of buckets. Two generative models give every bucket a probability:
one from trusted documents, one from all documents. A document's log importance weight is the sum of log ratios over
its features; it is divided by their number and scaled, so that long documents are neither favoured nor ruled out by
their length alone. Adding Gumbel noise that follows the id and taking the largest sums samples documents without
replacement in proportion to the weights: the top k of ``share`` of all rows.

A few bad words in a good text vanish in that average. So where rejected rows are labelled too, a third model counts in
how many rejected and trusted rows each word occurs. Words that tell them apart beyond chance and occur mostly in
rejected rows are evidence: the largest of their log odds counts, whatever the length of the text, and rows with more
than ``CERTAIN`` are never kept. ``share`` is then the most that is kept.

The raw model counts every row. The other models count at most ``max_trusted`` trusted and as many rejected rows, those
with the smallest hashes of their ids; that is the only bound. Count tables have ``BUCKETS`` and ``WORDS`` entries
whatever the input.

Defined results: null or empty text has no features and weight 0; a null id has one noise value; rows that repeat an id
share it; of equal scores at the cut all rows are taken; without trusted documents all weights are 0; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.store import stored
from itemloom.llm.words import WordHasher, runs

BUCKETS = 1 << 16
WORDS = 1 << 20  # buckets of single words, so that rare ones seldom share theirs
CERTAIN = float(np.log(9))  # nine of ten rows with such words are rejected ones


def features(text: bytes, hasher: WordHasher) -> np.ndarray:
    """Buckets of all words and word pairs."""
    h = hasher(text.lower().split())
    both = np.concatenate([runs(h, 1), runs(h, 2)])
    return (both >> np.uint64(48)).astype(np.int64)


def _texts(docs: DataFrame, id_column: str, text_column: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"), *more)


def bucket_counts(docs: DataFrame, trusted: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(bucket, raw, target) over all rows, and over the rows whose id is in ``trusted``."""
    rows = _texts(docs, id_column, text_column)
    rows = rows.join(F.broadcast(trusted), F.col("id") == F.col("t_id"), "left").select("text", F.col("t_id").isNotNull().alias("good"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                for text, good in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counted = np.bincount(features(text, hasher), minlength=BUCKETS)
                    raw += counted
                    if good:
                        target += counted
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    parts = rows.mapInArrow(work, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, smoothing: float = 1.0) -> np.ndarray:
    """Log ratio of both models for every bucket: a table of fixed size, brought to the driver."""
    found = counts.toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    model = lambda n: np.log((n + smoothing) / (n.sum() + smoothing * BUCKETS))
    return model(target) - model(raw)


def words_of(text: bytes, hasher: WordHasher) -> np.ndarray:
    """Buckets of the distinct words."""
    return np.unique((runs(hasher(list(set(text.lower().split()))), 1) >> np.uint64(44)).astype(np.int64))


def word_rows(docs: DataFrame, trusted: DataFrame, rejected: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(bucket, good, bad): trusted and rejected rows with a word of the bucket; bucket -1 counts all of them."""
    labelled = trusted.withColumn("good", F.lit(True)).unionByName(rejected.withColumn("good", F.lit(False)))
    rows = _texts(docs, id_column, text_column).join(F.broadcast(labelled), F.col("id") == F.col("t_id")).select("text", "good")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        n = np.zeros((2, WORDS + 1), np.int64)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                for text, good in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    n[int(good), words_of(text, hasher)] += 1
                    n[int(good), WORDS] += 1
        used = np.flatnonzero(n.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(used == WORDS, -1, used)), pa.array(n[1, used]), pa.array(n[0, used])], ["bucket", "good", "bad"])

    parts = rows.mapInArrow(work, "bucket long, good long, bad long")
    return parts.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def rejecting_odds(counts: DataFrame) -> np.ndarray:
    """Log odds of rejection for every word bucket that beyond chance stands for it, else 0: a table of fixed size."""
    # a word in fewer rejected than trusted rows is never evidence
    found = counts.filter("bucket < 0 OR bad > good").toPandas()
    odds = np.zeros(WORDS)
    total = found[found["bucket"] < 0]
    if not len(total) or not total["good"].iloc[0] or not total["bad"].iloc[0]:
        return odds
    n = float(total["good"].iloc[0]), float(total["bad"].iloc[0])
    found = found[found["bucket"] >= 0]
    seen = found["good"].to_numpy(float), found["bad"].to_numpy(float)
    rate = (seen[0] + seen[1]) / sum(n)
    term = lambda x, m: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(m, 1e-300)), 0.0)
    test = 2 * sum(term(x, m * rate) + term(m - x, m * (1 - rate)) for x, m in zip(seen, n, strict=True))
    more = (seen[1] / n[1] > seen[0] / n[0]) & (test > 2 * np.log(max(len(found), 2)))
    odds[found["bucket"].to_numpy()[more]] = np.log((seen[1] + 0.5) / (seen[0] + 0.5))[more]
    return odds


def weights(docs: DataFrame, ratios: np.ndarray, id_column: str, text_column: str, scale: float, odds: np.ndarray | None = None) -> DataFrame:
    """(id, n_features, log_weight, evidence) of every row; evidence is the largest log odds of rejection of its words."""
    rows = _texts(docs, id_column, text_column)
    kind = rows.schema["id"].dataType.simpleString()
    used = np.flatnonzero(odds) if odds is not None else np.empty(0, np.int64)
    table = rows.sparkSession.sparkContext.broadcast((ratios, odds if len(used) else None))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (ratio, odd) = WordHasher(), table.value
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                against = [float(odd[words_of(t, hasher)].max(initial=0.0)) if odd is not None else 0.0 for t in texts]
                found = [(len(f), float(ratio[f].mean() * scale) if len(f) else 0.0) for t in texts for f in [features(t, hasher)]]
                n, w = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array(against, pa.float64())],
                    ["id", "n_features", "log_weight", "evidence"],
                )

    return rows.mapInArrow(work, f"id {kind}, n_features long, log_weight double, evidence double")


def kth_largest(scores: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The exact k-th largest value: the range that holds it is cut into bins until it is one value."""
    low, high = scores.agg(F.min(column), F.max(column)).first()
    above = 0  # rows over the range looked at
    while low < high:
        width = (high - low) / bins
        within = scores.filter((F.col(column) >= low) & (F.col(column) <= high))
        b = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        found = within.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        table: pd.DataFrame = found.toPandas().sort_values("b", ascending=False)
        upto = above + table["n"].cumsum()
        hit = int((upto >= k).to_numpy().argmax())
        above += int(table["n"].iloc[:hit].sum())
        new = float(table["low"].iloc[hit]), float(table["high"].iloc[hit])
        if new == (low, high):  # values closer than a bin can tell apart
            return low
        low, high = new
    return low


def resampled(
    docs: DataFrame, trusted: DataFrame, share: float = 0.85, seed: str = "dsir", id_column: str = "doc_id", text_column: str = "text",
    max_trusted: int = 100_000, scale: float = 20.0, noise: float = 0.25, rejected: DataFrame | None = None,
) -> DataFrame:
    """The id, n_features, log_weight, score and kept of every row. ``trusted`` and ``rejected`` list the ids of such rows.

    ``noise`` is the temperature of the Gumbel noise: 1 samples by the weights as they are, less follows them closely.
    """
    def some(ids: DataFrame) -> DataFrame:
        known = ids.select(F.col(id_column).alias("t_id")).filter("t_id IS NOT NULL").distinct()
        return known.orderBy(F.xxhash64("t_id"), "t_id").limit(max_trusted)

    chosen = some(trusted)
    ratios = log_ratios(bucket_counts(docs, chosen, id_column, text_column))
    odds = rejecting_odds(word_rows(docs, chosen, some(rejected), id_column, text_column)) if rejected is not None else None
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    scores = weights(docs, ratios, id_column, text_column, scale, odds).withColumn("score", F.col("log_weight") - F.lit(noise) * F.log(-F.log(u)))
    scores = stored(scores, "scores")
    k = int(scores.count() * share)
    cut = kth_largest(scores, "score", k) if k else float("inf")
    return scores.select(F.col("id").alias(id_column), "n_features", "log_weight", "score", ((F.col("evidence") <= CERTAIN) & (F.col("score") >= F.lit(cut))).alias("kept"))
