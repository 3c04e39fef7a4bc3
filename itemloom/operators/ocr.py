"""Text boxes from a recognizer to one ordered text per image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def box_corner(df: DataFrame, box: str = "box") -> DataFrame:
    """Add ``top`` and ``lft`` from a polygon given as an array of (x, y) structs."""
    return df.withColumns({
        "top": F.array_min(F.transform(box, lambda p: p["y"])), "lft": F.array_min(F.transform(box, lambda p: p["x"])),
    })


def reading_order_lines(
    boxes: DataFrame, image: str = "image_id", text: str = "txt", confidence: str = "conf", min_conf: float = 0.3,
    line_height: int = 40,
) -> DataFrame:
    """Confident boxes joined from left to right, one row per image and line."""
    line = F.bround(F.col("top") / line_height, 0).cast("long")
    entry = F.struct(F.col("lft").alias("lft"), F.col("top").alias("top"), F.col(text).alias("text"))
    lines = boxes.filter(F.col(confidence) >= min_conf).groupBy(image, line.alias("line")).agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )
    return lines.select(image, "line", F.array_join(F.transform("entries", lambda e: e["text"]), " | ").alias("text"))


def reading_order_text(boxes: DataFrame, image: str = "image_id", **options) -> DataFrame:
    """One text per image: its lines from the top, joined the same way. The text itself is the result's cell."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    return reading_order_lines(boxes, image, **options).groupBy(image).agg(
        F.array_join(F.transform(ordered, lambda e: e["text"]), " | ").alias("ocr_text")
    )


def share_texts(items: DataFrame, texts: DataFrame, image: str = "image_id") -> DataFrame:
    """Text of the item's image for every item; images without text give the empty string."""
    return items.join(texts, image, "left").withColumn("ocr_text", F.coalesce("ocr_text", F.lit("")))


def empty_count(items: DataFrame, image: str = "image_id") -> DataFrame:
    """Distinct images and how many of them have no text."""
    per = items.groupBy(image).agg(F.max(F.length("ocr_text")).alias("n"))
    return per.agg(F.count("*").alias("images"), F.count_if(F.col("n") == 0).alias("empty"))
