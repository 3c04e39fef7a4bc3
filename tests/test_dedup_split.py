import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemloom.functions import hashing as hs
from itemloom.operators import dedup as dd, splitting as sp


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def brute(values, t):
    out = set()
    for a, b in itertools.combinations(sorted(set(values)), 2):
        d = ((a ^ b) & (2**64 - 1)).bit_count()
        if d <= t:
            out.add((a, b, d))
    return out


@pytest.mark.parametrize("bucket", [200, 12, 3])
def test_hamming_pairs_equal_brute_force(spark, bucket):
    """Small buckets force the crowded ones to be split again, down to the deepest level."""
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 2**63, 60)]
    values = list(base)
    for v in base[:20]:
        for _ in range(3):
            w = v
            for b in rng.choice(64, rng.integers(1, 9), replace=False):
                w ^= 1 << int(b)
            values.append(w)
    low = [int(x) for x in rng.integers(0, 2**14, 60)]  # many hashes share most of their bits
    values = [signed(v) for v in values + low]
    df = spark.createDataFrame([(v,) for v in values], "h long")
    got = {tuple(r) for r in dd.hamming_pairs(df, "h", 6, bucket=bucket).collect()}
    assert got == brute(values, 6)


def test_similar_pairs_keep_the_closest(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(90):
        h = int(rng.integers(0, 4)) if i % 3 else int(rng.integers(0, 2**20))  # a third of all rows share few hashes
        rows.append((i, f"r{i}", ["train", "test", "dev"][i % 3 if i % 9 else 0], h, f"s{i % 40}"))
    df = spark.createDataFrame(rows, "pos int, id string, split string, phash long, sha string")
    first = {}
    for pos, id_, split, h, sha in rows:
        if split != "dev":
            first.setdefault((split, h, sha), pos)
    nodes = [(s, h, c, p) for (s, h, c), p in first.items()]
    want = []
    for (s1, h1, c1, p1), (s2, h2, c2, p2) in itertools.product(nodes, nodes):
        inside = s1 == s2 and p1 < p2
        across = s1 == "train" and s2 == "test"
        d = (h1 ^ h2).bit_count()
        if (inside or across) and c1 != c2 and d <= 6:
            want.append((d, f"{s1}-{s2}", p1, p2))
    want.sort()
    for keep in (5, 40, 1000):
        got = dd.similar_pairs(df, "phash", "sha", "split", "train", "test", keep=keep, columns=["id"])
        assert [(r.hamming_distance, r.scope, r.left_p, r.right_p) for r in got.collect()] == want[:keep]


def union_find(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k in (0, 1):
        seen = {}
        for i, r in enumerate(rows):
            if r[k] is None:
                continue
            a, b = find(i), find(seen.setdefault(r[k], i))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_union_find(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"s{rng.integers(0, 90)}" if rng.random() < 0.8 else None, f"p{rng.integers(0, 90)}" if rng.random() < 0.7 else None) for _ in range(120)]
    rows += [(f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(40)]  # one long chain
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "pos int, sha string, phash string")
    got = {r.pos: r.gid for r in dd.duplicate_components(df, ["sha", "phash"]).collect()}
    assert [got[i] for i in range(len(rows))] == union_find(rows)


def test_null_keys_do_not_group(spark):
    df = spark.createDataFrame([(0, None, "train"), (1, None, "test"), (2, "x", "train"), (3, "x", "test")], "pos int, k string, split string")
    groups = dd.exact_groups(df, "k", "split", ["train", "test"]).collect()
    assert len(groups) == 1 and groups[0].splits == "test:1;train:1" and groups[0].group == 1


def test_cross_split_pairs_count_without_listing(spark):
    rows = [("train", "h", "q"), ("train", "h", "r"), ("test", "h", "q"), ("test", "h", "q"), ("train", "z", "q")]
    df = spark.createDataFrame([(i, f"i{i}", *r) for i, r in enumerate(rows)], "pos int, id string, split string, k string, question string")
    r = dd.cross_split_pairs(df, "k", "split", "train", "test").collect()
    assert len(r) == 1 and (r[0].pairs, r[0].equal_question_pairs) == (4, 2)
    links = {x.id: (x.partner_id, x.partners) for x in dd.cross_split_links(df, "k", "split", "train", "test").collect()}
    assert links == {"i0": ("i2", 2), "i1": ("i2", 2), "i2": ("i0", 2), "i3": ("i0", 2)}


def test_split_never_divides_a_group(spark):
    rng = np.random.default_rng(5)
    sizes = [300, *rng.integers(1, 6, 200).tolist()]  # one group holds about a third of the rows
    rows, pos = [], 0
    for g, n in enumerate(sizes):
        for _ in range(int(n)):
            rows.append((pos, f"g{g}", "abcd"[int(rng.integers(0, 4))]))
            pos += 1
    df = spark.createDataFrame(rows, "pos int, gid string, answer string")
    out = sp.stratified_group_split(df, 0.1, 42)
    assert out.groupBy("gid").agg(F.countDistinct("is_validation").alias("n")).filter("n > 1").isEmpty()
    assert out.count() == len(rows)
    first = {}
    for _, g, a in rows:
        first.setdefault(g, [a, 0])[1] += 1
    held = {r.gid for r in out.filter("is_validation").select("gid").distinct().collect()}
    for c in "abcd":
        own = [(g, n) for g, (a, n) in first.items() if a == c]
        target, taken = round(0.1 * sum(n for _, n in own)), sum(n for g, n in own if g in held)
        assert target <= taken < target + max(n for _, n in own)
    meta = sp.split_metadata(out).first()
    assert meta.n_train + meta.n_validation == meta.n_original == len(rows) and meta.n_groups == len(sizes)


def test_group_split_takes_at_least_one(spark):
    df = spark.createDataFrame([(i, f"k{i % 5}") for i in range(20)], "pos int, group_key string")
    out = sp.group_split(df, 0.01)
    assert out.filter("is_validation").select("group_key").distinct().count() == 1
    assert sp.group_split(df, 0).filter("is_validation").isEmpty()


def test_folds_are_balanced(spark):
    df = spark.range(103).select(F.col("id"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("s"))
    counts = sp.assign_folds(df, 5, "s").groupBy("s", "fold").count().collect()
    for s in "xy":
        sizes = [r["count"] for r in counts if r.s == s]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_content_hash_falls_back_to_path(spark):
    import hashlib

    df = spark.createDataFrame([(b"abc" * 10, "p"), (None, "p")], "c binary, p string")
    got = [r[0] for r in df.select(hs.content_hash(F.col("c"), F.col("p"), head_bytes=3)).collect()]
    assert got == [hashlib.sha1(b"abc").hexdigest(), hashlib.sha1(b"p").hexdigest()]


def test_keep_first_by_position(spark):
    df = spark.createDataFrame([(2, "k", "z"), (1, "k", "y"), (3, "m", "x")], "pos int, key string, v string")
    assert {(r.key, r.v) for r in dd.keep_first(df, "key").collect()} == {("k", "y"), ("m", "x")}
