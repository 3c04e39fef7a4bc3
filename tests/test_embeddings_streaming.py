import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemloom.operators import embeddings as em
from itemloom.streaming import incremental as inc


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (120, 6)), rng.normal(0.5, 1.5, (90, 6))]) * np.array([5, 3, 2, 1, 1, 0.5])
    splits = ["train"] * 120 + ["test"] * 90
    rows = [(i, s, [float(v) for v in r]) for i, (s, r) in enumerate(zip(splits, x))]
    return spark.createDataFrame(rows, "id int, split string, embedding array<double>").cache(), x, np.array(splits)


def test_projection_and_frechet(vectors):
    df, x, s = vectors
    p = em.fit_projection(df, "split", k=4)
    u, sing, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(p.mean, x.mean(axis=0)) and np.allclose(np.abs(p.components), np.abs(vt[:4].T), atol=1e-6)
    assert np.allclose(p.explained, (sing**2 / (sing**2).sum())[:4])
    lead = np.abs(p.components).argmax(axis=0)
    assert (p.components[lead, range(4)] > 0).all()
    proj = (x - x.mean(axis=0)) @ p.components
    a, b = proj[s == "train"], proj[s == "test"]
    got = em.frechet_distance(p.apply(df), "split", "train", "test", "projected").first()[0]
    vals, vecs = np.linalg.eigh(np.cov(a, rowvar=False))
    root = (vecs * np.sqrt(vals.clip(0))) @ vecs.T
    mid = np.linalg.eigvalsh(root @ np.cov(b, rowvar=False) @ root)
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(np.cov(a, rowvar=False)) + np.trace(np.cov(b, rowvar=False)) - 2 * np.sqrt(mid.clip(0)).sum()
    assert got == pytest.approx(want)
    table = em.component_table(p.apply(df), p, "split", "train", "test", 3).orderBy("component").collect()
    assert [r.component for r in table] == [1, 2, 3] and table[0].train_std == pytest.approx(a[:, 0].std(ddof=1))


def exact_kernel_distance(x, y, bandwidth):
    k = lambda a, b: np.exp(-((a[:, None, :] - b[None]) ** 2).sum(axis=2) / (2 * bandwidth)).mean()
    return k(x, x) + k(y, y) - 2 * k(x, y)


def test_kernel_distance(vectors):
    df, x, s = vectors
    r = em.kernel_distance(df, "split", "train", "test", "embedding", features=4096).first()
    gaps = ((x[:, None, :] - x[None]) ** 2).sum(axis=2)
    assert r.bandwidth == pytest.approx(gaps[np.triu_indices(len(x), 1)].mean())
    want = exact_kernel_distance(x[s == "train"], x[s == "test"], r.bandwidth)
    assert abs(r.mmd_squared - want) < 4 * r.standard_error and r.standard_error < 0.1 * want
    again = em.kernel_distance(df.repartition(7), "split", "train", "test", "embedding", features=4096).first()
    assert again.mmd_squared == pytest.approx(r.mmd_squared)


def test_sampled_kernel_distance(vectors):
    df, x, s = vectors
    r = em.sampled_kernel_distance(df, "split", "train", "test", "embedding", per_split=90, probes=10_000).first()
    assert r.mmd_squared > 0 and r.bandwidth > 0
    same = em.sampled_kernel_distance(df.withColumn("split", F.when(F.col("id") % 2 == 0, "train").otherwise("test")), "split", "train", "test", "embedding").first()
    assert same.mmd_squared < r.mmd_squared


def test_moments_are_those_of_all_rows(spark, vectors):
    df, x, s = vectors
    odd = df.repartition(40).unionByName(spark.createDataFrame([(999, "train", None)], df.schema))  # null vectors are left out
    found = em.split_moments(odd, "split", "embedding")
    for name in ("train", "test"):
        own = x[s == name]
        assert found[name].n == len(own) and np.allclose(found[name].mean, own.mean(axis=0)) and np.allclose(found[name].covariance, np.cov(own, rowvar=False))
    both = em.pooled(found)
    assert both.n == len(x) and np.allclose(both.covariance, np.cov(x, rowvar=False))
    even = em.pooled(found, per_split=30)  # every split weighs thirty rows, from all of its rows
    assert even.n == pytest.approx(60) and np.allclose(even.mean, (x[s == "train"].mean(axis=0) + x[s == "test"].mean(axis=0)) / 2)
    cells = em.covariance_table(df, "split", "embedding").filter("split = 'test'").orderBy("i", "j").collect()
    assert np.allclose([r.covariance for r in cells], np.cov(x[s == "test"], rowvar=False).ravel())
    assert em.moment_sums(df.limit(0), "embedding", "split").count() == 0


def test_frechet_of_flat_vectors(spark):
    rng = np.random.default_rng(5)
    flat = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 5))  # no Cholesky factor
    rows = [(i, "train" if i < 30 else "test", [float(v) for v in r]) for i, r in enumerate(flat)]
    df = spark.createDataFrame(rows, "id int, split string, embedding array<double>")
    r = em.frechet_terms(df, "split", "train", "test", "embedding").first()
    a, b = (np.cov(part, rowvar=False) for part in (flat[:30], flat[30:]))
    root = np.sqrt(np.abs(np.linalg.eigvals(a @ b))).sum()
    assert r.frechet_distance == pytest.approx(((flat[:30].mean(0) - flat[30:].mean(0)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * root, abs=1e-6)
    same = em.frechet_distance(df.withColumn("split", F.lit("train")).unionByName(df.withColumn("split", F.lit("test"))), "split", "train", "test", "embedding")
    assert same.first()[0] == pytest.approx(0, abs=1e-8)


def plain_grams(text, low=2, high=5):
    text = re.sub(r"\s\s+", " ", (text or "").lower())
    return Counter(text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1))


def test_ngram_statistics_and_vectors(spark, monkeypatch):
    monkeypatch.setattr(em, "HELD_GRAMS", 50)
    texts = ["Abc  abc", "abcab", None, "", "x", "abcab zzz " * 40, "éß漢字 abc"]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "id int, t string, fold int").repartition(3)
    stats = em.ngram_statistics(df, "t", "fold")
    want = {}
    for i, t in enumerate(texts):
        for term, n in plain_grams(t).items():
            have = want.get((term, i % 2), (0, 0))
            want[term, i % 2] = (have[0] + 1, have[1] + n)
    assert {(r.term, r.by): (r.df, r.total) for r in stats.collect()} == want
    vocab = em.vocabulary(stats, len(texts), min_df=2, size=10)
    totals = Counter()
    for (term, _), (n, total) in want.items():
        totals[term, "df"] += n
        totals[term, "total"] += total
    terms = sorted({t for t, _ in want if totals[t, "df"] >= 2}, key=lambda t: (-totals[t, "total"], t))[:10]
    assert [r.term for r in vocab.orderBy(F.desc("total"), "term").collect()] == terms
    vectorizer = em.Vectorizer.of(vocab)
    at, weights = vectorizer(texts[1])
    own = {t: (1 + np.log(n)) * (np.log(8 / (1 + totals[t, "df"])) + 1) for t, n in plain_grams(texts[1]).items() if t in terms}
    norm = np.sqrt(sum(w * w for w in own.values()))
    assert {sorted(terms)[i]: pytest.approx(w) for i, w in zip(at, weights)} == {t: w / norm for t, w in own.items()}
    assert np.linalg.norm(weights) == pytest.approx(1) and len(vectorizer("")[0]) == 0
    stored = em.tfidf_vectors(df, "t", vectorizer, ["id"]).orderBy("id").collect()
    assert [list(r.features.indices) for r in stored] == [vectorizer(re.sub(r"\s\s+", " ", (t or "").lower()))[0].tolist() for t in texts]


def test_auc_with_ties(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    z = np.round(y * 0.7 + rng.normal(0, 1, 400), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(z, y)], "score double, label double")
    pos, neg = z[y == 1], z[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert em.roc_auc(df).first().auc == pytest.approx(want)


def test_domain_classifier_separates(spark):
    rows = [(i, f"{'alpha beta' if i % 2 else 'gamma delta'} {i}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, t string, y int")
    aucs = [r.auc for r in em.domain_classifier(df, "t", "y", folds=2).collect()]
    assert len(aucs) == 2 and min(aucs) > 0.99
    few = em.domain_classifier(df, "t", "y", folds=2, max_fit=5)  # the weights come from ten rows, all rows are scored
    summary = em.auc_summary(few).first()
    assert summary.folds == 2 and summary.mean_auc > 0.9
    grams = em.distinguishing_ngrams(df, "t", "y", k=5).collect()
    assert {r.side for r in grams} == {"label0", "label1"}
    assert all("mm" in g.term or g.term in "gamma delta " for g in grams if g.side == "label0")


def test_vote_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i // 5, "abcd"[i % 3], f"2024-01-01 {i % 24:02d}:00:00") for i in range(200)]
    votes = spark.createDataFrame(rows, "item_id int, vote string, t string").select("item_id", "vote", F.to_timestamp("t").alias("ts"))
    votes.filter("item_id < 20").write.mode("append").parquet(src)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = spark.readStream.schema(votes.schema).parquet(src)
        flat = inc.vote_tally(stream, watermark="2 days").select("window.start", "item_id", "vote", "n")
        inc.run_available(flat, out, state, "update")

    run()
    votes.filter("item_id >= 20").write.mode("append").parquet(src)
    run()
    got = inc.latest(spark.read.parquet(out), ["start", "item_id", "vote"])
    want = inc.vote_tally(votes).select("window.start", "item_id", "vote", "n")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_late_votes_are_dropped(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def add(day):
        spark.createDataFrame([(1, "a", f"2024-01-{day:02d} 12:00:00")], "item_id int, vote string, t string").select(
            "item_id", "vote", F.to_timestamp("t").alias("ts")).write.mode("append").parquet(src)
        stream = spark.readStream.schema("item_id int, vote string, ts timestamp").parquet(src)
        inc.run_available(inc.vote_tally(stream, watermark="1 day").select("window.start", "item_id", "vote", "n"), out, state, "update")

    for day in (1, 20, 2):  # the last one is far behind the watermark
        add(day)
    got = inc.latest(spark.read.parquet(out), ["start", "item_id", "vote"])
    assert sorted(r.start.day for r in got.collect()) == [1, 20]


def test_arrival_screen(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [("k1", "2024-01-01 00:00:00"), ("k1", "2024-01-01 00:10:00"), ("k2", "2024-01-01 00:20:00")]
    spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("ts")).write.parquet(src)
    held = spark.createDataFrame([("k2",)], "k string")
    stream = spark.readStream.schema("k string, ts timestamp").parquet(src)
    inc.run_available(inc.screen_arrivals(stream, held, "k"), out, state)
    assert sorted((r.k, r.leaked) for r in spark.read.parquet(out).collect()) == [("k1", False), ("k2", True)]


def test_grams_of_many_texts_are_counted_in_few_sorted_runs(monkeypatch):
    """Small and very large alphabets, blanks and zero characters; terms are looked up once a run, not once a text."""
    rng = np.random.default_rng(3)
    wide = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 200))) for _ in range(20)] + ["\U0001f600é\0\0é", "", "a"]
    small = ["".join(rng.choice(list("abc "), 40)) for _ in range(200)]
    for texts in (wide, small, [""], []):
        got = {}
        for terms, gram, row, tf in em._grams(texts, 2, 5):
            assert len(set(terms)) == len(terms)
            got |= {(terms[g], int(r)): int(n) for g, r, n in zip(gram, row, tf)}
        want = {(t[i : i + n], k) for k, t in enumerate(texts) for n in range(2, 6) for i in range(len(t) - n + 1)}
        assert got.keys() == want and all(n == sum(texts[k].startswith(t, i) for i in range(len(texts[k]))) for (t, k), n in list(got.items())[:500])
    calls = []
    counted = em._grams
    monkeypatch.setattr(em, "_grams", lambda *a: calls.append(1) or counted(*a))
    vectorizer = em.Vectorizer(["ab", "abc"], [1.0, 2.0], 2, 5)
    made = list(vectorizer.many(small))
    assert len(made) == len(small) and len(calls) == 1
    for (at, weights), text in zip(made, small):
        own = [(1 + np.log(n)) * idf for t, idf in (("ab", 1.0), ("abc", 2.0)) if (n := text.count(t))]
        assert len(at) == len(own) and weights.tolist() == pytest.approx([w / np.linalg.norm(own) for w in own])


def test_weights_come_from_all_rows(spark, monkeypatch):
    """No row is left out of a fit unless a caller asks for it."""
    fitted = []
    fit = em.fit_classifier
    monkeypatch.setattr(em, "sample_rows", lambda *a, **k: pytest.fail("rows were sampled"))
    monkeypatch.setattr(em, "fit_classifier", lambda vectors, rows, *a: fitted.append((vectors.count(), rows)) or fit(vectors, rows, *a))
    df = spark.createDataFrame([(i, f"{'alpha beta' if i % 4 else 'gamma delta'} {i}", int(i % 4 > 0)) for i in range(60)], "id int, t string, y int")
    assert em.distinguishing_ngrams(df, "t", "y", k=5).count() == 10
    assert fitted == [(60, 60)]
    assert em.domain_classifier(df, "t", "y", folds=2).count() == 2
    assert sum(n for n, _ in fitted[1:]) == 60  # with two folds, every row is fitted on once
