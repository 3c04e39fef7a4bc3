import os
import random
import re
import subprocess
import tempfile

import numpy as np
from pyspark.sql import functions as F

from itemloom.llm import exact, jaccard, passages, quality_rules
from itemloom.llm.graph import components, extended
from itemloom.llm.store import SHUFFLE_CLEANUP, stored
from itemloom.session import ensure_checkpoint_dir


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_components(rows, n, percent):
    """Smallest id of every row's component, by all pairs."""
    sets = [grams(t, n) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s), k if not s else least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))]


def edited(words, rnd, edits):
    words = list(words)
    for _ in range(edits):
        kind, at = rnd.choice("rrid"), rnd.randrange(len(words))
        if kind == "r":
            words[at] = f"new{rnd.randrange(4000)}"
        elif kind == "i":
            words.insert(at, f"new{rnd.randrange(4000)}")
        else:
            del words[at]
    return words


def clusters(seed, groups=4, size=45):
    """Copies around several middles, at all distances about the threshold, with shared lines and cut-off copies."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(groups):
        middle = [f"t{rnd.randrange(3000)}" for _ in range(rnd.choice([12, 40, 90, 160]))]
        for _ in range(size):
            base = edited(middle, rnd, rnd.choice([0, 1, 2, 3, 5, 8]))
            rows.append(" ".join(base[: rnd.choice([len(base)] * 4 + [len(base) * 9 // 10])]))
    rows += [" ".join(f"t{rnd.randrange(3000)}" for _ in range(60)) for _ in range(30)]
    return list(enumerate(rows))


def got_components(spark, rows, n, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs, n=n, percent=percent).collect()]


def test_near_duplicates_match_all_pairs(spark):
    rows = clusters(3)
    assert sorted(got_components(spark, rows, 3, 90)) == sorted(brute_components(rows, 3, 90))


def test_later_rounds_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 3)  # leaders all the way down
    rows = clusters(5, groups=2, size=60)
    assert sorted(got_components(spark, rows, 2, 80)) == sorted(brute_components(rows, 2, 80))


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(odd_docs).collect()]
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=order) == sorted(brute_components(rows, 5, 80), key=order)
    kept = jaccard.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 7 in ids and not {2, 3, 8} & set(ids)
    assert sum(not grams(r["text"], 5) for r in kept.collect()) == sum(not grams(t, 5) for _, t in rows)
    assert jaccard.near_duplicates(no_docs).count() == 0


def test_sketches_of_similar_sets_always_share_a_word():
    rnd = np.random.default_rng(1)
    for size in (1, 2, 9, 10, 14, 15, 40, 333, 2000):
        for _ in range(20):
            a = np.unique(rnd.integers(0, 1 << 48, size, dtype=np.uint64))
            most = 1
            while 100 * (len(a) - most) >= 80 * (len(a) + most):
                most += 1
            gone = rnd.integers(0, most)
            b = np.unique(np.concatenate([a[gone:], rnd.integers(0, 1 << 48, rnd.integers(0, most), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= 80 * (len(a) + len(b) - common):
                limits = jaccard.band_limits(max(len(a), len(b)))
                assert np.intersect1d(jaccard.sketch_keys(a, 80, limits), jaccard.sketch_keys(b, 80, limits)).size


def test_components_in_steps_equal_components_at_once(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    whole = {(r["node"], r["component"]) for r in components(frame(links)).collect()}
    steps = {(r["node"], r["component"]) for r in extended(components(frame(links[:200])), frame(links[200:])).collect()}
    assert whole == {x for x in steps if any(x[0] in k and k[0] != k[1] for k in links)}
    assert {c for n, c in whole if n >= 5000} == {5000} and {c for n, c in whole if 1000 <= n <= 1060} == {1000}


def test_compact_windows_are_the_minima_of_all_wide_ranges():
    rnd = np.random.default_rng(3)
    for v in (rnd.integers(0, 1 << 60, 120, dtype=np.uint64), rnd.integers(0, 3, 90).astype(np.uint64), np.zeros(50, np.uint64)):
        c, l, r = passages.compact_windows(v, 10)
        for i in range(len(v)):
            for j in range(i + 9, len(v)):
                at = i + int(v[i : j + 1].argmin())
                assert sum((c == at) & (l <= i) & (r >= j)) == 1


def test_passages_are_found_and_the_rest_is_left_alone(spark, odd_docs, no_docs):
    rnd = random.Random(9)
    word = lambda: f"t{rnd.randrange(100_000)}"
    exact = [word() for _ in range(55)]
    near = [word() for _ in range(120)]
    changed = list(near)
    changed[30] = changed[90] = "other"
    short = [word() for _ in range(40)]
    fill = lambda n: [word() for _ in range(n)]
    texts = {}
    for i in range(40):
        texts[i] = fill(rnd.randrange(5, 150)) + exact + fill(rnd.randrange(5, 150))
    texts[50], texts[51] = fill(70) + near + fill(10), fill(20) + changed + fill(33)
    texts[60], texts[61] = fill(80) + short + fill(50), short + fill(100)
    texts[70] = fill(300)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = passages.repeated_passages(docs).collect()
    spans = {r["doc_id"]: " ".join(texts[r["doc_id"]][r["first_word"] : r["end_word"]]) for r in got}
    assert set(spans) == {*range(40), 50, 51}
    assert all(" ".join(exact) in spans[i] for i in range(40))
    assert " ".join(near) in spans[50] and " ".join(changed) in spans[51]
    odd = passages.repeated_passages(odd_docs).collect()
    assert {r["doc_id"] for r in odd} == {1, 2, 3, 8, None}
    assert passages.repeated_passages(no_docs).count() == 0


def test_near_passages_about_a_common_phrase_are_all_found(spark):
    """Edits within 27 words on both sides of a phrase that unrelated texts share, too."""
    rnd = random.Random(12)
    word = lambda: f"t{rnd.randrange(10**6)}"
    fill = lambda n: [word() for _ in range(n)]
    hot = fill(45)
    texts = {}
    doc = lambda middle: fill(rnd.randrange(40, 120)) + middle + fill(rnd.randrange(40, 120))
    for i in range(100):
        left, right = fill(30), fill(30)
        left2, right2 = list(left), list(right)
        left2[29 - rnd.randrange(4)], right2[rnd.randrange(4)], right2[rnd.randrange(10, 20)] = word(), word(), word()
        texts[2 * i], texts[2 * i + 1] = doc(left + hot + right), doc(left2 + hot + right2)
    for i in range(200):
        texts[1000 + i] = doc(hot)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    assert {r["doc_id"] for r in passages.repeated_passages(docs).collect()} == set(range(200))


def test_copies_met_again_and_leaders_from_the_start_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FIRST_FEW", 2)
    rows = clusters(11, groups=2, size=25)
    rows += [(1000 + i, t) for i, t in rows] + [(2000 + i, t.upper()) for i, t in rows[:20]] + rows[:10]
    assert sorted(got_components(spark, rows, 5, 80)) == sorted(brute_components(rows, 5, 80))


def test_keys_with_the_same_nodes_are_compared_once(spark):
    rows = [(k, n) for k in range(40) for n in (7, 8)] + [(50, n) for n in (7, 8, 9)] + [(60, n) for n in (7, 9)]
    members = spark.createDataFrame(rows, "key long, node long")
    kept = jaccard.once(members, jaccard.groups_of(members)).collect()
    assert sorted(tuple(r) for r in kept) == [(0, 7), (0, 8), (50, 7), (50, 8), (50, 9), (60, 7), (60, 9)]
    about = members.withColumn("center", members["key"] % 2)  # the same nodes about another centre say something else
    kept = jaccard.once(about, jaccard.groups_of(about, "center"), "center").collect()
    assert sorted((r["key"], r["node"]) for r in kept if r["key"] < 50) == [(0, 7), (0, 8), (1, 7), (1, 8)]


def test_differences_meet_the_labels_as_one_row_a_star(spark):
    found = [(1, 2, 1, 100, 100, False, list(range(60))), (1, 3, 1, 100, 100, True, list(range(40)))]
    stars = spark.createDataFrame(found, "leader long, node long, star int, a int, b int, linked boolean, diff array<long>")
    got = {r["node"]: r["words"] for r in jaccard.followed(stars, 80, "leader").collect()}
    assert set(got) == {2, 3} and all(len(w) > 1 for w in got.values())


def test_copies_too_far_apart_are_not_compared_in_later_rounds(spark, monkeypatch):
    rnd = random.Random(4)
    middle = [f"t{i}" for i in range(160)]
    rows = list(enumerate(" ".join(edited(middle, rnd, rnd.choice([1, 2, 3, 5, 6, 8]))) for _ in range(90)))
    later, real = [], jaccard.later_pairs
    monkeypatch.setattr(jaccard, "later_pairs", lambda pairs, *rest: later.append(pairs.count()) or real(pairs, *rest))
    assert sorted(got_components(spark, rows, 5, 80)) == sorted(brute_components(rows, 5, 80))
    assert sum(later) < len(rows)


def test_links_to_the_largest_component_are_found_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 3)
    rows = clusters(21, groups=3, size=70)
    assert sorted(got_components(spark, rows, 3, 80)) == sorted(brute_components(rows, 3, 80))


def test_split_windows_are_the_minima_of_wide_ranges_among_new_positions():
    rnd = np.random.default_rng(6)
    for _ in range(60):
        size, width = 40, 8
        values = rnd.integers(0, rnd.choice([3, 1 << 40]), size).astype(np.uint64)
        new = np.flatnonzero(rnd.random(size) < rnd.choice([0.1, 0.6, 1]))
        c = int(rnd.integers(0, size))
        got = sorted((int(new[i]), a, b) for i, a, b in passages.windows_around(values[new], new, size, c, width))
        want, seen, todo = [], set(new.tolist()), [(0, size - 1)]
        while todo:
            a, b = todo.pop()
            inside = [m for m in range(a, b + 1) if m in seen]
            if b - a + 1 < width or not inside:
                continue
            at = [m for m in inside if values[m] == min(values[k] for k in inside)]
            want += [(m, a, b) for m in at]
            if c not in at:
                todo.append((max([a, *(m + 1 for m in at if m < c)]), min([b, *(m - 1 for m in at if m > c)])))
        assert got == sorted(want)


def test_stages_leave_only_the_tables_that_their_results_read(spark):
    """Words, sets and pairs are deleted on the way, and the rows that a stage returns can be read twice afterwards."""
    folder = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/itemloom"
    docs = spark.createDataFrame(clusters(3, groups=2, size=20), "doc_id long, text string").withColumn("source", F.lit("a"))
    for stage, kept in ((quality_rules.apply_rules, "verdicts"), (exact.first_of_copies, "copies"), (jaccard.one_of_each, "near-copies")):
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        out = stage(docs)
        assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before if not x.startswith(".")] == [kept]
        assert out.count() == len(out.collect()) > 0


def test_stored_rows_leave_no_shuffle_files(spark):
    def files():
        top = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
        own = [os.path.join(top, d) for d in os.listdir(top) if d.startswith("blockmgr-")]
        return set(subprocess.run(["find", *own, "-name", "shuffle_*.data"], capture_output=True, text=True).stdout.split())

    setting, before = spark.conf.get(SHUFFLE_CLEANUP, None), files()
    rows = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few")
    assert sorted(r["count"] for r in rows.collect()) == [142, 143, 143, 143, 143, 143, 143]
    assert files() <= before and spark.conf.get(SHUFFLE_CLEANUP, None) == setting


def test_pairs_compared_in_turn_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "AT_ONCE", 5)
    sizes, first = [], jaccard.first_pairs
    monkeypatch.setattr(jaccard, "first_pairs", lambda pairs, sets, *a: sizes.append((pairs.count(), sets.count())) or first(pairs, sets, *a))
    rows = clusters(3, groups=2, size=20)
    assert sorted(got_components(spark, rows, 3, 80)) == sorted(brute_components(rows, 3, 80))
    assert len(sizes) > 1 and all(n < m for n, m in sizes)


def test_windows_of_a_text_that_repeats_itself_are_one_for_each_centre(spark):
    """Nothing goes on for one text alone, and windows with the same key and centre do not multiply from round to round."""
    rows = [(1, 7, 0, 5, 0, 9, True), (1, 7, 0, 6, 2, 9, True), (1, 8, 0, 5, 3, 9, True), (1, 8, 0, 5, 2, 7, False), (2, 8, 0, 3, 0, 9, False)]
    opened = spark.createDataFrame(rows, "node long, key long, h int, c int, l int, r int, failed boolean")
    got = passages._shared(opened).select("node", "key", "h", "c", "l", "r", "failed").collect()
    assert sorted(tuple(r) for r in got) == [(1, 8, 0, 5, 2, 9, True), (2, 8, 0, 3, 0, 9, False)]
    x, y = np.arange(100, 160, dtype=np.uint32), np.tile(np.arange(7, dtype=np.uint32), 60)
    parents = [{"key": 9, "h": 0, "lc": 0, "ll": 0, "lr": 50, "c": c, "l": c, "r": len(y) - 5, "el": -1, "er": -1, "go": 2} for c in range(0, 350, 7)]
    found = passages._next_windows(x, y, parents, parents, 46)
    assert len(found) == len({(w["key"], w["h"], w["c"]) for w in found}) <= passages.SPLITS * len(y)
    assert all(w["l"] <= w["c"] <= w["r"] < len(y) for w in found)
