"""Intermediate tables of the pipeline operators, kept where every executor can read them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.session import ensure_checkpoint_dir


#: Spark's setting to remove the shuffle files of a query when it ends, not when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of tables written in the open :func:`passing` blocks, innermost last.
_passing: list[list[str]] = []


def stored(df: DataFrame, tag: str, outlives: bool = False) -> DataFrame:
    """Write rows as Parquet under the shared checkpoint folder and read them back.

    Lineage ends there, so a lost executor costs one read, and both inputs of a later join are plain shuffles that
    adaptive execution can split when one key is hot. The shuffles that made the rows are removed at once. The folder
    belongs to the cluster's checkpoint area and lives as long as that does, because the returned frame is lazy; but a
    table written in a :func:`passing` block goes at its end unless it ``outlives`` it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/itemloom/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    if len(_passing) > outlives:
        _passing[-1 - outlives].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discarded(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`stored` that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end: for operators whose result reads only what outlives the block."""
    _passing.append([])
    try:
        yield
    finally:
        discarded(spark, *_passing.pop())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a stored list of ids and hashes that may be broadcast: 16 bytes each, so 8 MB.
SMALL_LIST = 500_000


def light(rows: DataFrame) -> DataFrame:
    """A stored list of ids and hashes, to be broadcast only when it is counted to be small."""
    return F.broadcast(rows) if rows.limit(SMALL_LIST + 1).count() <= SMALL_LIST else rows


def without(docs: DataFrame, gone: DataFrame, same: Column) -> DataFrame:
    """Rows of ``docs`` that match no row of a stored list."""
    return docs.join(light(gone), same, "left_anti")


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``docs`` under names that no operator uses, where each column went, and the way back to the old columns.

    So extra columns may bear any name, also one that an operator adds on its way.
    """
    names = docs.columns
    place = {n: f"column_{i}" for i, n in enumerate(names)}
    inner = docs.toDF(*[f"column_{i}" for i in range(len(names))])
    return inner, place, lambda df: df.select(*[F.col(f"column_{i}").alias(n) for i, n in enumerate(names)])
