"""Reading splits, edit lists, probability tables, external question sets, images and text boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom import CHOICES
from itemloom.functions import text as tx
from itemloom.operators.quality import ContractError


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with header, quoted line breaks and doubled quotes; all columns are strings without a schema."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_splits(
    spark: SparkSession, root: str, splits: Sequence[str] = ("train", "test", "dev"), fmt: str = "csv", split_col: str = "split"
) -> DataFrame:
    """All splits in one frame, tagged with the split name; columns a split lacks are null."""
    out = None
    for name in splits:
        part = read_csv(spark, f"{root}/{name}.csv") if fmt == "csv" else spark.read.format(fmt).load(f"{root}/{name}.{fmt}")
        part = part.withColumn(split_col, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_edit_list(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Edit lists as text: every column a string, empty cells stay empty instead of null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("emptyValue", "").option("nullValue", "\u0000").schema(schema).csv(path)
    )
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns])


def read_records(spark: SparkSession, path: str, columns: Sequence[str], header: bool = True) -> DataFrame:
    """CSV records as text with what did not fit: ``bad_record`` holds the raw text of records with too few or too many
    cells, else null, and ``source_file`` the file that a record came from. Quoted line breaks belong to their record, and
    empty cells are empty text; in a bad record, cells that are empty or lacking are null. Nothing is dropped.
    """
    schema = ", ".join([*(f"`{c}` string" for c in columns), "bad_record string"])
    reader = spark.read.option("header", header).option("multiLine", True).option("escape", '"').option("emptyValue", "").option("nullValue", "\u0000")
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_record").option("enforceSchema", True).schema(schema).csv(path)
    cells = [F.when(F.col("bad_record").isNull() & F.col(c).isNull(), "").otherwise(F.col(c)).alias(c) for c in columns]
    return rows.select(*cells, "bad_record", F.col("_metadata.file_name").alias("source_file"))


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Decoded pixels; an unreadable file is a row with width -1 unless dropped."""
    df = spark.read.format("image").option("dropInvalid", drop_invalid).option("recursiveFileLookup", True).load(path)
    return df.select(F.col("image.origin").alias("path"), (F.col("image.width") > 0).alias("readable"), "image")


def read_files(spark: SparkSession, path: str, pattern: str | None = None, content: bool = True) -> DataFrame:
    """File listing with bytes; without content only names and sizes are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.load(path)
    return df if content else df.select("path", "length", "modificationTime")


def as_runs(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Probability tables as (id, run, probs); a single averaged table becomes run 0."""
    run = F.col("run").cast("int") if "run" in df.columns else F.lit(0)
    sized = F.when(F.size("probs") == 4, F.col("probs")).otherwise(
        F.raise_error(F.concat(F.lit("expected four probabilities for "), F.col(id_col).cast("string"))).cast("array<double>")
    )
    return df.select(id_col, run.alias("run"), sized.alias("probs"))


def check_variant_table(df: DataFrame, expected_rows: int, variant: str = "variant") -> DataFrame:
    """Fail when a variant has another number of rows or a row without four probabilities."""
    counts = df.groupBy(variant).agg(F.count("*").alias("n"), F.count_if(F.size("probs") != 4).alias("bad"))
    broken = counts.filter((F.col("n") != expected_rows) | (F.col("bad") > 0)).limit(20).collect()
    if broken:
        raise ContractError(f"variant tables do not fit {expected_rows} rows of four: {[r.asDict() for r in broken]}")
    return df


QA_SCHEMA = "array<struct<question:string,answer:string>>"


def flatten_qa(df: DataFrame, group: str, pairs: str, keep: Sequence[str] = ()) -> DataFrame:
    """Nested question-answer lists as (group, k, question, answer_text) with squeezed white space.

    ``pairs`` may be an array of structs, JSON text, or a Python literal with single quotes.
    """
    column = F.col(pairs)
    if dict(df.dtypes)[pairs] == "string":
        options = {"allowSingleQuotes": "true"}
        column = F.from_json(column, QA_SCHEMA, options)
    flat = df.select(group, *keep, F.posexplode(column).alias("k", "pair"))
    return flat.select(
        group, "k", *keep,
        tx.squeeze(F.coalesce(F.col("pair.question"), F.lit(""))).alias("question"),
        tx.squeeze(F.coalesce(F.col("pair.answer"), F.lit(""))).alias("answer_text"),
    )


def image_bytes(encoded: Column) -> Column:
    """Bytes of a base64 text, with or without a data-URI prefix."""
    return F.unbase64(F.regexp_replace(encoded, r"^data:[^,]*,", ""))


def external_items(df: DataFrame, prefix: str) -> DataFrame:
    """Imported four-choice rows (A-D, answer) as items; rejected rows must be filtered before."""
    options = [tx.strip(F.col(o)).alias(c) for o, c in zip("ABCD", CHOICES)]
    extra = [c for c in ("topic_difficulty", "image_type") if c in df.columns]
    return df.select(
        F.concat(F.lit(prefix + "_"), "rid").alias("id"), tx.strip(F.col("question")).alias("question"), *options,
        F.lower(tx.strip(F.col("answer"))).alias("answer"), *extra,
        *([image_bytes(F.col("image")).alias("content")] if "image" in df.columns else []),
    )


def subset_by_id_file(df: DataFrame, spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """Keep rows whose id is listed in a white-space separated text file."""
    return keep_ids(df, spark.read.text(path), "value", id_col)


def keep_ids(df: DataFrame, lines: DataFrame, column: str, id_col: str = "id") -> DataFrame:
    ids = lines.select(F.explode(F.split(column, r"\s+")).alias("__id")).filter("__id <> ''").distinct()
    return df.join(ids, F.col(id_col).cast("string") == F.col("__id"), "left_semi")


def attach_hints(df: DataFrame, hints: DataFrame, id_col: str = "id", text: str = "ocr_text") -> DataFrame:
    """Left join of recognized text by id; the last row of a repeated id wins, missing is empty."""
    order = "pos" if "pos" in hints.columns else text
    one = hints.groupBy(F.col(id_col).cast("string").alias("__id")).agg(F.max_by(text, order).alias(text))
    joined = df.join(one, F.col(id_col).cast("string") == F.col("__id"), "left")
    return joined.drop("__id").withColumn(text, F.coalesce(text, F.lit("")))
