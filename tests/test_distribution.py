import numpy as np
import pytest
from pyspark.sql import functions as F

from itemloom.operators import distribution as ds, ordering as od


def frame(spark, seed=0, ties=False):
    rng = np.random.default_rng(seed)
    train, test = rng.normal(0, 1, 700), rng.normal(0.3, 2, 500)
    if ties:
        train, test = np.where(rng.random(700) < 0.4, 1.0, np.round(train, 1)), np.round(test, 1)
    rows = [("train", float(v)) for v in train] + [("test", float(v)) for v in test] + [("train", None), ("test", float("nan"))]
    return spark.createDataFrame(rows, "split string, x double"), train, test


def ks(a, b):
    grid = np.sort(np.concatenate([a, b]))
    return np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max()


@pytest.mark.parametrize("ties", [False, True])
def test_profile_matches_numpy(spark, ties):
    df, a, b = frame(spark, 3, ties)
    p = ds.metric_profile(df, "split", ["train", "test"], ["x"], ks_pairs=[("train", "test"), ("test", "train")]).first()
    for s, v in (("train", a), ("test", b)):
        assert p[f"count_{s}"] == len(v)
        assert p[f"mean_{s}"] == pytest.approx(v.mean()) and p[f"std_{s}"] == pytest.approx(v.std(ddof=1))
        for name, q in ds.QUARTILES.items():
            assert p[f"{name}_{s}"] == pytest.approx(np.quantile(v, q))
    assert p["ks_train_test"] == pytest.approx(ks(a, b)) == p["ks_test_train"]
    assert 0 <= p["ks_train_test"] <= 1


def test_smd_zero_spread(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", 1.0), ("test", 1.0), ("test", 1.0)], "split string, x double")
    r = ds.numeric_comparison(df, "split", "train", "test", ["x"]).first()
    assert r.standardized_mean_difference == 0.0 and r.ks_statistic == 0.0


def test_histogram_modes(spark):
    df, a, b = frame(spark, 5)
    lo, hi = np.quantile(np.concatenate([a, b]), [0.005, 0.995])
    want, edges = np.histogram(np.clip(a, lo, hi), bins=np.linspace(lo, hi, 21), density=True)
    got = np.zeros(20)
    for r in ds.density_histogram(df, "split", ["x"], 20).filter("split = 'train'").collect():
        got[r.bin] = r.density
    assert np.allclose(got, want)
    upper = np.quantile(np.concatenate([a, b]), 0.995)
    want, _ = np.histogram(b[b <= upper], bins=20, density=True)
    got = np.zeros(20)
    for r in ds.density_histogram(df, "split", ["x"], 20, mode="filter").filter("split = 'test'").collect():
        got[r.bin] = r.density
    assert np.allclose(got, want)


def test_rank_correlation(spark):
    import pandas as pd

    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, 300).astype(float)
    y = np.round(x + rng.normal(0, 3, 300))
    y[::17] = np.nan
    df = spark.createDataFrame(list(zip(x.tolist(), [None if np.isnan(v) else float(v) for v in y])), "x double, y double")
    want = pd.DataFrame({"x": x, "y": y}).dropna().rank().corr().iloc[0, 1]
    assert ds.rank_correlation(df, ["x"], ["y"]).first()["rho_y"] == pytest.approx(want)


def test_ks_p_value_limits():
    assert ds.ks_p_value(0.0, 50, 50) == 1.0
    assert ds.ks_p_value(1.0, 500, 500) < 1e-100
    # both series agree where they meet
    a, b = ds.ks_p_value(1.1799 / 5, 50, 50), ds.ks_p_value(1.1801 / 5, 50, 50)
    assert a == pytest.approx(b, abs=1e-3)


def test_running_sums_by_many_buckets(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 1000).alias("o"))
    got = od.running_sums(df, ["g"], ["o"], {"c": F.lit(1)}, od.numeric_bucket(df, "o", buckets=13)).collect()
    for g in range(3):
        part = sorted((r for r in got if r.g == g), key=lambda r: r.o)
        assert [r.c for r in part] == list(range(1, len(part) + 1))


def test_rank_limit_keeps_exactly_the_first(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("k"))
    full = sorted(r.k for r in df.collect())
    got = {r.k: r.r for r in od.rank_by_key(df, "k", "r", upto=37).collect()}
    assert got == {k: i + 1 for i, k in enumerate(full[:37])}


def test_verdict(spark):
    shifts = spark.createDataFrame([("m", 0.05, 0.01), ("n", -0.2, 0.01)], "metric string, smd_v_t double, ks_v_t double")
    tv = spark.createDataFrame([(0.01,)], "total_variation double")
    assert not ds.acceptance_verdict(shifts, tv).first().accepted
    assert ds.acceptance_verdict(shifts.filter("metric = 'm'"), tv).first().accepted
