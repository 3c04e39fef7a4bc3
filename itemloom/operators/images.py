"""Image tables: sizes, pixel metrics, crops, augmentation parameters and copies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.functions import images as im
from itemloom.functions.hashing import seeded_key, uniform
from itemloom.operators.dedup import similar_pairs
from itemloom.session import cut_lineage, spread
from itemloom.functions.images import SLICE, affine_copy, crop_pixels, gaussian_blur, to_rgb

# Crop families by name, the crop share, the band share, affine limits, blur radius, fill
# colour, longest allowed side.
CROP_VIEWS = {
    "none": ["full"],
    "five": ["center", "tl", "tr", "bl", "br"],
    "topbottom": ["top", "bottom"],
}
CROP_SHARE = 0.72
AFFINE_TRANSLATE = 0.03
AFFINE_SHEAR_DEG = 5.0
BLUR_RADIUS = 1.0
FILL_COLOR = (255, 255, 255)
LONGEST_SIDE = 2048


def size_metrics(df: DataFrame, width: str = "width", height: str = "height", file_bytes: str = "file_bytes") -> DataFrame:
    """Megapixels, aspect ratio, orientation and bytes per pixel."""
    ratio = F.col(width) / F.col(height)
    pixels = F.col(width).cast("long") * F.col(height)
    return df.withColumns({
        "megapixels": pixels / 1e6,
        "aspect_ratio": ratio,
        "orientation": F.when(ratio > 1.05, "landscape").when(ratio < 0.95, "portrait").otherwise("square"),
        "bytes_per_pixel": F.col(file_bytes) / pixels,
    })


def pixel_table(images: DataFrame, image: str = "image", metrics: Sequence[str] = tuple(im.METRICS), side: int | None = im.THUMBNAIL) -> DataFrame:
    """Image rows with the chosen pixel metrics as columns; one Arrow pass, which computes only these.

    Larger images are measured on thumbnails with this longer side, or as they are without ``side``.
    """
    keep = [c for c in images.columns if c != image]
    return spread(images).select(*keep, im.pixel_metrics(im.image_part(image), metrics, side).alias("__m")).select(*keep, "__m.*")


def hash_text(phash: Column) -> Column:
    """A 64-bit hash as 16 hex digits."""
    return F.lower(F.lpad(F.hex(phash), 16, "0"))


def candidate_differences(
    pairs: DataFrame, images: DataFrame, left: str = "left_id", right: str = "right_id", id_col: str = "id", most: int | None = None
) -> DataFrame:
    """Whether the images of each candidate pair have the same size, and their pixel differences where they do.

    Sizes are joined first. Only images in some pair of equal sizes are then read with their bytes, and only such pairs
    reach Python. ``most`` states how many pairs there are at most, as after a top-k; then their ids are broadcast, so
    other images are dropped as they are read.
    """
    def side(name, fields, alias):
        return images.select(F.col(id_col).alias(name), fields.alias(alias))
    size = F.struct("image.height", "image.width")
    sized = pairs.join(side(left, size, "__l"), left).join(side(right, size, "__r"), right)
    sized = cut_lineage(sized.select(*pairs.columns, (F.col("__l") == F.col("__r")).alias("same_dimensions")))
    alike = sized.filter("same_dimensions").select(left, right).distinct()
    ids = alike.select(F.col(left).alias("__id")).union(alike.select(F.col(right).alias("__id"))).distinct()
    needed = images.join(F.broadcast(ids) if most is not None else ids, F.col(id_col) == F.col("__id"), "left_semi").select(id_col, im.image_part("image").alias("image"))
    pixels = lambda name, alias: needed.select(F.col(id_col).alias(name), F.col("image").alias(alias))
    gaps = alike.join(pixels(left, "__a"), left).join(pixels(right, "__b"), right).select(left, right, im.pixel_difference("__a", "__b").alias("__d"))
    return sized.join(gaps.select(left, right, "__d.*"), [left, right], "left")


def near_duplicate_report(
    items: DataFrame, images: DataFrame, hash_col: str = "phash", content: str = "sha", split_col: str = "split", left: str = "train",
    right: str = "test", threshold: int = 6, keep: int = 1000, position: str = "pos", id_col: str = "id", brightness: str = "brightness",
) -> DataFrame:
    """The ``keep`` closest pairs of different images within and across two splits, with their copies and pixel differences.

    ``items`` has a hash, a content key, a split, a position, an id and a brightness for every row of ``images``.
    """
    near = similar_pairs(items, hash_col, content, split_col, left, right, threshold, keep, position=position, columns=[id_col, brightness])
    gap = F.abs(F.col(f"left_{brightness}") - F.col(f"right_{brightness}")).alias("brightness_difference")
    pairs = cut_lineage(near.select("scope", "hamming_distance", f"left_{id_col}", f"right_{id_col}", "left_copies", "right_copies", gap))
    return candidate_differences(pairs, images, f"left_{id_col}", f"right_{id_col}", id_col, most=keep)


def crop_boxes(df: DataFrame, family: str = "five", share: float = CROP_SHARE, width: str = "width", height: str = "height") -> DataFrame:
    """One row per item and view with the box (x, y, w, h) in whole pixels."""
    w, h = F.col(width), F.col(height)
    def cut(size, part):
        return F.floor(size * F.lit(part)).cast("int")
    cw, ch = cut(w, share), cut(h, share)
    zero = F.lit(0)
    boxes = {
        "full": (zero, zero, w, h),
        "top": (zero, zero, w, cut(h, 0.6)),
        "bottom": (zero, cut(h, 0.4), w, h - cut(h, 0.4)),
        "center": (F.floor((w - cw) / 2).cast("int"), F.floor((h - ch) / 2).cast("int"), cw, ch),
        "tl": (zero, zero, cw, ch),
        "tr": (w - cw, zero, cw, ch),
        "bl": (zero, h - ch, cw, ch),
        "br": (w - cw, h - ch, cw, ch),
    }
    rows = [
        F.struct(F.lit(v).alias("view"), *[c.cast("int").alias(n) for n, c in zip("xywh", boxes[v])])
        for v in CROP_VIEWS[family]
    ]
    return df.select("*", F.inline(F.array(*rows)))


def affine_parameters(df: DataFrame, seed: int = 42, id_col: str = "id", width: str = "width", height: str = "height") -> DataFrame:
    """Shift (pixels) and shear (tangent) per row from seeded uniforms; the same on every run."""
    def symmetric(name, limit):
        return (uniform(seeded_key(seed, F.col(id_col), F.lit(name))) * 2 - 1) * limit
    return df.withColumns({
        "tx": symmetric("tx", AFFINE_TRANSLATE) * F.col(width),
        "ty": symmetric("ty", AFFINE_TRANSLATE) * F.col(height),
        "sx": F.tan(F.radians(symmetric("sx", AFFINE_SHEAR_DEG))),
        "sy": F.tan(F.radians(symmetric("sy", AFFINE_SHEAR_DEG))),
    })


def fit_size(df: DataFrame, longest: int = LONGEST_SIDE, width: str = "width", height: str = "height") -> DataFrame:
    """Target size with the longer side capped, ratio kept, halves rounded to even, at least one pixel."""
    side = F.greatest(width, height)
    scale = F.lit(float(longest)) / side
    def target(c):
        return F.when(side > longest, F.greatest(F.lit(1), F.bround(F.col(c) * scale, 0).cast("int"))).otherwise(F.col(c))
    return df.withColumns({"target_width": target(width), "target_height": target(height)})


def augmented_copies(images: DataFrame, kinds: tuple[str, ...] = ("blur", "affine"), seed: int = 42, id_col: str = "id") -> DataFrame:
    """Blurred and affine copies as image structs in row order (BGR), ids tagged with the kind."""
    sized = images.select(id_col, F.col("image.height").alias("height"), F.col("image.width").alias("width"),
                          F.col("image.nChannels").alias("nChannels"), F.col("image.data").alias("data")).filter("height > 0")
    # an image goes to Python once for all its copies
    wanted = affine_parameters(sized, seed, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(columns)}
            for first in range(0, len(batch), SLICE):
                rows = []
                for i in range(first, min(first + SLICE, len(batch))):
                    one = {n: at[n][i].as_py() for n in columns if n != "data"}
                    rgb = to_rgb(one["height"], one["width"], one["nChannels"], at["data"][i].as_buffer())
                    for kind in kinds:
                        if kind == "blur":
                            out = gaussian_blur(rgb, BLUR_RADIUS)
                        elif kind == "affine":
                            out = affine_copy(rgb, one["sx"], one["tx"], one["sy"], one["ty"], FILL_COLOR)
                        else:
                            raise ValueError(f"unknown kind {kind!r}")
                        rows.append((f"{one[id_col]}__{kind}", kind, one["height"], one["width"], 3, out[:, :, ::-1].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kept, strict=True)], names)

    columns = wanted.columns
    names = ["id", "kind", "height", "width", "nChannels", "data"]
    kept = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    flat = wanted.mapInArrow(run, "id string, kind string, height int, width int, nChannels int, data binary")
    image = F.struct(F.col("id").alias("origin"), "height", "width", "nChannels", F.lit(16).alias("mode"), "data")
    return flat.select("id", "kind", image.alias("image"))


def cropped_views(images: DataFrame, family: str = "five", id_col: str = "id") -> DataFrame:
    """Pixels of every crop view; boxes are computed in SQL, only the cut runs in Python."""
    sized = images.select(id_col, F.col("image.height").alias("height"), F.col("image.width").alias("width"),
                          F.col("image.nChannels").alias("nChannels"), F.col("image.data").alias("data")).filter("height > 0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                part = crop_pixels(to_rgb(r.height, r.width, r.nChannels, r.data), r.x, r.y, r.w, r.h)
                rows.append((str(getattr(r, id_col)), r.view, r.h, r.w, part[:, :, ::-1].tobytes()))
            yield pd.DataFrame(rows, columns=["id", "view", "height", "width", "data"])

    return crop_boxes(sized, family).mapInPandas(run, "id string, view string, height int, width int, data binary")
