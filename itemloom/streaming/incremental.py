"""The batch operators run on streams: vote tallies, windowed drift and the leakage screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    """Event time as a timestamp with the watermark, where one is wanted."""
    return df if watermark is None else df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def vote_tally(votes: DataFrame, watermark: str | None = None, window: str = "1 day", item: str = "item_id", vote: str = "vote", ts: str = "ts") -> DataFrame:
    """Votes per window, item and value; the same plan serves a table and a stream."""
    kept = _timed(votes, ts, watermark).filter(F.col(vote).isNotNull())
    return kept.groupBy(F.window(ts, window), item, vote).agg(F.count("*").alias("n"))


def window_drift(values: DataFrame, baseline: Column, column: str = "value", watermark: str | None = None, window: str = "1 day", ts: str = "ts") -> DataFrame:
    """Count, mean, deviation and standardized mean difference of each window from a frozen baseline.

    ``baseline`` is a struct expression with fields ``mean`` and ``std``, for instance literals.
    """
    out = _timed(values, ts, watermark).groupBy(F.window(ts, window)).agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")
    )
    base_mean, base_std = baseline.getField("mean"), baseline.getField("std")
    pooled = F.sqrt((F.col("std") ** 2 + base_std**2) / 2)
    return out.withColumn("smd", F.when(pooled == 0, 0.0).otherwise((F.col("mean") - base_mean) / pooled))


def screen_arrivals(arriving: DataFrame, held_out: DataFrame, key: str, ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """Flag arriving rows whose key is in the held-out table and drop repeats inside the watermark."""
    known = held_out.select(F.col(key).alias("__k")).distinct()
    flagged = arriving.join(known, F.col(key) == F.col("__k"), "left")
    flagged = flagged.withColumn("leaked", F.col("__k").isNotNull()).drop("__k")
    return _timed(flagged, ts, watermark).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available and stop; each batch adds its rows with its number to a table of files.

    A batch that is run again after a failure replaces its own folder, so results stay exact.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(store).start()
    )
    query.awaitTermination()


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per key from stored update batches."""
    newest = F.max_by(F.struct(*[F.col(c) for c in updates.columns if c != "batch"]), "batch")
    return updates.groupBy(*keys).agg(newest.alias("__row")).select("__row.*")
