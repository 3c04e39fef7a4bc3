import math
import random
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from itemloom import catalog
from itemloom.functions import images as im
from itemloom.operators import images as io_, quality as qc
from itemloom.sources import readers as rd


def png(pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\x00" + pixels[y].tobytes() for y in range(h))

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pictures():
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:48, 0:64]
    ramp = rng.integers(0, 256, (6, 8, 3)).astype(np.uint8).repeat(8, axis=0).repeat(8, axis=1)
    checker = np.where(((x // 8 + y // 8) % 2)[..., None] == 0, 255, 0).astype(np.uint8).repeat(3, axis=2)
    changed = ramp.copy()
    changed[10, 10] = 255 - changed[10, 10]
    return {
        "flat": np.full((8, 8, 3), 90, np.uint8), "red": np.tile(np.array([200, 0, 0], np.uint8), (9, 7, 1)), "ramp": ramp,
        "copy": ramp, "changed": changed, "checker": checker, "noise": rng.integers(0, 256, (300, 520, 3)).astype(np.uint8),
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    for name, p in pictures().items():
        (root / f"{name}.png").write_bytes(png(p))
    (root / "broken.png").write_bytes(b"\x89PNG not really")
    return str(root)


@pytest.fixture(scope="module")
def images(spark, folder):
    df = rd.read_images(spark, folder).withColumn("id", F.regexp_extract("path", r"([^/]+)\.png$", 1))
    return df.select("id", "readable", "image").cache()


def test_reading_and_inventory(spark, folder, images):
    assert images.count() == 8 and images.filter("NOT readable").first().id == "broken"
    found = images.select(F.col("id").alias("path"), "readable")
    listed = spark.createDataFrame([("ramp",), ("broken",), ("absent",)], "path string")
    status = {r.path: r.status for r in qc.file_inventory(listed, found).collect()}
    assert status["ramp"] == "ok" and status["broken"] == "unreadable" and status["absent"] == "missing" and status["flat"] == "extra"
    assert rd.read_files(spark, folder, "*.png").count() == 8


def test_pixel_metrics(images):
    got = {r.id: r for r in io_.pixel_table(images).collect()}
    flat = got["flat"]
    assert flat.brightness == pytest.approx(90 / 255) and flat.contrast == 0 and flat.entropy_bits == 0 and flat.hue_mean is None
    assert math.copysign(1, flat.entropy_bits) == 1
    red = got["red"]
    assert red.saturation == 1 and red.hue_mean == pytest.approx(0) and red.red_mean == pytest.approx(200 / 255)
    ramp, source = got["ramp"], pictures()["ramp"] / 255.0
    assert ramp.green_std == pytest.approx(source[..., 1].std()) and ramp.val_mean == pytest.approx(source.max(axis=2).mean())
    assert got["copy"].phash == ramp.phash
    assert ((got["changed"].phash ^ ramp.phash) & (2**64 - 1)).bit_count() <= 6
    assert ((got["checker"].phash ^ ramp.phash) & (2**64 - 1)).bit_count() > 6
    assert got["checker"].edge_density > 0.1 and got["checker"].laplacian_variance > got["ramp"].laplacian_variance
    assert got["broken"].brightness is None and got["broken"].phash is None


def test_chosen_metrics_and_hash_match_plain_formulas(images):
    few = io_.pixel_table(images, metrics=["contrast", "phash"])
    assert few.columns[-2:] == ["contrast", "phash"] and {r.id: r.phash for r in few.collect()} == {r.id: r.phash for r in io_.pixel_table(images).collect()}
    rng = np.random.default_rng(4)
    gray = rng.integers(0, 256, (64, 96)).astype(np.uint8)
    small = gray.astype(float).reshape(32, 2, 32, 3).mean(axis=(1, 3))
    wave = lambda u, x: math.cos(math.pi * u * (2 * x + 1) / 64) * (math.sqrt(0.5) if u == 0 else 1) / 4
    low = [sum(wave(u, i) * wave(v, j) * small[i, j] for i in range(32) for j in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    want = int("".join(str(int(x > middle)) for x in low), 2)
    assert im.perceptual_hash(gray) & (2**64 - 1) == want
    g = gray / 255
    strength = [(abs(g[y, x + 1] - g[y, x]) + abs(g[y + 1, x] - g[y, x])) / 2 for y in range(63) for x in range(95)]
    found = im.image_statistics(np.repeat(gray[..., None], 3, axis=2), ["edge_density", "laplacian_variance"])
    assert found["edge_density"] == pytest.approx(np.mean(np.array(strength) > im.EDGE_THRESHOLD))
    bends = [g[y - 1, x] + g[y + 1, x] + g[y, x - 1] + g[y, x + 1] - 4 * g[y, x] for y in range(1, 63) for x in range(1, 95)]
    assert found["laplacian_variance"] == pytest.approx(np.var(bends))
    thin = im.image_statistics(np.zeros((1, 5, 3), np.uint8), ["edge_density", "laplacian_variance", "hue_mean"])
    assert thin == {"edge_density": 0, "laplacian_variance": 0, "hue_mean": None}


def test_near_duplicate_report(spark, images):
    rows = io_.pixel_table(images, metrics=["phash", "brightness"]).filter("phash IS NOT NULL")
    keyed = rows.join(images.select("id", F.sha1("image.data").alias("sha")), "id")
    position = {n: i for i, n in enumerate(sorted(pictures()))}
    items = keyed.withColumns({"pos": F.create_map(*[F.lit(v) for kv in position.items() for v in kv])[F.col("id")], "split": F.when(F.col("id") == "copy", "test").otherwise("train")})
    got = {(r.left_id, r.right_id): r for r in io_.near_duplicate_report(items, images).collect()}
    r = got["changed", "copy"]
    gap = np.abs(pictures()["changed"].astype(int) - pictures()["copy"])
    assert r.scope == "train-test" and r.same_dimensions and r.pixel_mae == pytest.approx(gap.mean()) and r.pixel_abs_difference_p99 == pytest.approx(np.quantile(gap, 0.99))
    assert ("changed", "ramp") in got and ("ramp", "copy") not in got  # equal contents are no near duplicates
    sizes = {k: v.shape[:2] for k, v in pictures().items()}
    for (a, b), r in got.items():
        assert r.same_dimensions == (sizes[a] == sizes[b]) and (r.pixel_mae is None) == (not r.same_dimensions)


def test_hash_text(spark):
    df = spark.createDataFrame([(-1,), (10,)], "h long")
    assert [r[0] for r in df.select(io_.hash_text(F.col("h"))).collect()] == ["f" * 16, "000000000000000a"]


def test_candidate_differences(spark, images):
    pairs = spark.createDataFrame([("ramp", "copy"), ("ramp", "changed"), ("ramp", "flat")], "left_id string, right_id string")
    got = {r.right_id: r for r in io_.candidate_differences(pairs, images).collect()}
    assert got["copy"].pixel_mae == 0 and got["changed"].pixel_mae > 0 and got["changed"].pixel_abs_difference_p99 == 0
    assert not got["flat"].same_dimensions and got["flat"].pixel_mae is None


def test_box_resize_is_a_mean():
    a = np.arange(64, dtype=float).reshape(8, 8)
    assert np.allclose(im.box_resize(a, 4, 4), a.reshape(4, 2, 4, 2).mean(axis=(1, 3)))
    assert im.box_resize(a, 16, 16).shape == (16, 16)
    assert im.thumbnail(pictures()["noise"]).shape == (148, 256, 3)


def test_crops_and_copies(images):
    views = {(r.id, r.view): r for r in io_.cropped_views(images.filter("id = 'ramp'")).collect()}
    assert len(views) == 5
    source = pictures()["ramp"]
    corner = views[("ramp", "tl")]
    assert (corner.height, corner.width) == (34, 46)
    assert np.array_equal(np.frombuffer(corner.data, np.uint8).reshape(34, 46, 3)[:, :, ::-1], source[:34, :46])
    copies = {r.kind: r.image for r in io_.augmented_copies(images.filter("id IN ('ramp', 'broken')")).collect()}
    assert set(copies) == {"blur", "affine"} and all(c.height == 48 and c.width == 64 for c in copies.values())


def test_affine_identity_and_blur():
    p = pictures()["ramp"]
    assert np.array_equal(im.affine_copy(p, 0, 0, 0, 0, (255, 255, 255)), p)
    shifted = im.affine_copy(p, 0, 5, 0, 0, (255, 255, 255))
    assert np.array_equal(shifted[:, :59], p[:, 5:]) and (shifted[:, 59:] == 255).all()
    assert np.array_equal(im.gaussian_blur(pictures()["flat"], 1.0), pictures()["flat"])


def test_sizes(spark):
    df = spark.createDataFrame([(105, 100, 10), (100, 106, 10), (3000, 1500, 10), (5, 1, 1)], "width int, height int, file_bytes long")
    rows = io_.fit_size(io_.size_metrics(df), 1024).collect()
    assert [r.orientation for r in rows] == ["square", "portrait", "landscape", "landscape"]
    assert (rows[2].target_width, rows[2].target_height) == (1024, 512) and rows[0].target_width == 105
    assert rows[2].megapixels == 4.5


def plain_affine(rgb, sx, tx, sy, ty, fill):
    """Every weight where it is used."""
    h, w = rgb.shape[:2]
    out = np.zeros((h, w, 3))

    def weight(t):
        t = abs(t)
        return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0

    for y in range(h):
        for x in range(w):
            u, v = x + 0.5 + sx * (y + 0.5) + tx, sy * (x + 0.5) + y + 0.5 + ty
            if u < 0 or u >= w or v < 0 or v >= h:
                out[y, x] = fill
                continue
            u, v = u - 0.5, v - 0.5
            for j in range(math.floor(v) - 1, math.floor(v) + 3):
                for i in range(math.floor(u) - 1, math.floor(u) + 3):
                    out[y, x] += weight(u - i) * weight(v - j) * rgb[min(max(j, 0), h - 1), min(max(i, 0), w - 1)]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def test_affine_copy_makes_its_weights_once(monkeypatch):
    calls, known = [], im.cubic_weights
    monkeypatch.setattr(im, "cubic_weights", lambda t: calls.append(1) or known(t))
    rgb = np.random.default_rng(4).integers(0, 256, (13, 17, 3)).astype(np.uint8)
    for args in ((0.03, 1.7, -0.05, -0.4), (0.0, 0.0, 0.0, 0.0), (0.0, 2.0, 0.0, -1.0)):
        assert np.abs(im.affine_copy(rgb, *args, (255, 254, 253)).astype(int) - plain_affine(rgb, *args, (255, 254, 253))).max() <= 1
    assert len(calls) == 6


def test_images_go_to_python_once_and_in_views(images, capsys):
    copies = io_.augmented_copies(images)
    copies.explain()
    assert "Generate" not in capsys.readouterr().out.split("MapInArrow")[-1]
    got = {r["id"]: r["image"]["data"] for r in copies.collect()}
    assert len(got) == 14
    ramp = pictures()["ramp"]
    assert np.array_equal(np.frombuffer(got["ramp__blur"], np.uint8).reshape(ramp.shape)[:, :, ::-1], im.gaussian_blur(ramp, 1.0))
    rows = pa.array([{"height": 1, "width": 2, "nChannels": 3, "data": bytes([i % 256] * 6)} for i in range(2 * im.SLICE + 1)] + [None])
    parts = list(im._slices(rows))
    assert [len(p) for p in parts] == [im.SLICE, im.SLICE, 2] and parts[2][1] is None
    assert parts[1][3][0, 0, 0] == (im.SLICE + 3) % 256 and not parts[0][0].flags.owndata


@pytest.fixture(scope="module")
def texts(tmp_path_factory):
    """Documents table: one text whose image is higher than a thumbnail, and 3,000 short ones, some with a mean half way between two figures."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij XYZ0189.,", k=rng.randint(2, 9)))
    long = " ".join(word() for _ in range(40_000))
    short = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(3_000)]
    root = tmp_path_factory.mktemp("texts")
    pq.write_table(pa.table({"doc_id": pa.array(range(3_001), pa.int64()), "text": [long, *short]}), root / "documents.parquet")
    assert len(long) > 256 * 768
    return str(root)


def equals_its_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    df = catalog.load().QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.load().ORACLE[name]}) ORDER BY id").fetchall()
    assert [tuple(r) for r in df.orderBy("id").collect()] == want


@pytest.mark.parametrize("name", [
    "im2_brightness_and_channels", "im3_saturation_and_colorfulness", "im4_gray_entropy", "im5_edges_and_laplacian", "im7_hue_mean", "im7_hue_saturation_value",
])
def test_long_texts_and_ties_equal_sql(spark, texts, name):
    equals_its_sql(spark, texts, name)


def test_whole_images_and_thumbnails():
    noise = pictures()["noise"]
    whole = im.image_statistics(noise, ["red_mean", "contrast"], side=None)
    assert whole["red_mean"] == pytest.approx(noise[..., 0].mean() / 255)
    assert whole["contrast"] > 2 * im.image_statistics(noise, ["contrast"])["contrast"] > 0  # a thumbnail evens out noise
