"""Sinks: splits with metadata, tables with a summary, run caches and completeness checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.operators.quality import ContractError, config_differences


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def write_split(split: DataFrame, metadata: DataFrame, root: str, id_col: str = "id", fmt: str = "csv") -> dict[str, str]:
    """Rows partitioned by split, one-row metadata as JSON, and the list of validation ids."""
    paths = {"rows": f"{root}/rows", "meta": f"{root}/split_meta", "ids": f"{root}/validation_ids"}
    tagged = split.withColumn("split", F.when(F.col("is_validation"), "validation").otherwise("train")).drop("is_validation")
    tagged.write.mode("overwrite").partitionBy("split").option("header", True).option("escape", '"').format(fmt).save(paths["rows"])
    metadata.withColumn("created", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).coalesce(1).write.mode(
        "overwrite"
    ).json(paths["meta"])
    split.filter("is_validation").select(id_col).write.mode("overwrite").option("header", True).csv(paths["ids"])
    return paths


def ensure_split(spark: SparkSession, root: str, build: Callable[[], tuple[DataFrame, DataFrame]], force: bool = False, **options) -> dict[str, str]:
    """Write a split only when it is not there yet (or when forced)."""
    paths = {"rows": f"{root}/rows", "meta": f"{root}/split_meta", "ids": f"{root}/validation_ids"}
    if not force and all(path_exists(spark, f"{p}/_SUCCESS") for p in paths.values()):
        return paths
    return write_split(*build(), root, **options)


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> DataFrame:
    """Write named tables and return their (table, rows) summary, which is written too."""
    summary = None
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).format(fmt).save(f"{root}/{name}")
        spark = df.sparkSession
        reader = spark.read.option("header", True).option("multiLine", fmt == "csv").option("escape", '"')
        row = reader.format(fmt).load(f"{root}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        summary = row if summary is None else summary.unionByName(row)
    summary.coalesce(1).write.mode("overwrite").json(f"{root}/summary")
    return summary


def ensure_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], expected_rows: int) -> DataFrame:
    """Reuse a stored table when its row count fits, otherwise build and store it."""
    if path_exists(spark, f"{path}/_SUCCESS"):
        stored = spark.read.parquet(path)
        if stored.count() == expected_rows:
            return stored
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_runs(
    spark: SparkSession, path: str, requests: DataFrame, compute: Callable[[DataFrame], DataFrame],
    keys: tuple[str, ...] = ("tag", "run", "view"), id_col: str = "id",
) -> DataFrame:
    """Stored run results, completed for the requested (keys, id) that are not there yet.

    Results are appended under the key columns as partitions, so a look-up reads only the runs asked for.
    """
    wanted = [*keys, id_col]
    if path_exists(spark, path):
        known = spark.read.parquet(path)
        fresh = requests.join(known.select(*wanted), wanted, "left_anti")
    else:
        known, fresh = None, requests
    if known is None or not fresh.isEmpty():
        compute(fresh).write.mode("append").partitionBy(*keys).parquet(path)
    return spark.read.parquet(path).join(requests.select(*wanted), wanted, "left_semi")


def guard_config(stored: DataFrame, current: DataFrame) -> None:
    """Fail with the differing keys when a stored configuration does not equal the current one."""
    differing = config_differences(stored, current).limit(50).collect()
    if differing:
        raise ContractError("configuration changed: " + ", ".join(f"{r['key']}: {r['stored']} -> {r['current']}" for r in differing))
