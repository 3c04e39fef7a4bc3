import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemloom.llm import audit, lines, spelling


def failures(rows):
    """Mask of every (id, part, text) row."""
    masks = []
    for i, _, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = i is not None and any(j is not None and j < i and (other or "") == text for j, _, other in rows)
        tests = [
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            bool(re.search(r"[#$%&*|]", text)), copy,
        ]
        masks.append(sum(1 << k for k, t in enumerate(tests) if t))
    return masks


def plain_audit(rows, labels):
    marks = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i] = [max(marks[i][0], int(quality == 1)), max(marks[i][1], int(toxic == 1))]
    out, masks = {}, failures(rows)
    for part in {p or "" for _, p, _ in rows}:
        own = [(m, *(marks[r[0]] if r[0] is not None else (0, 0))) for m, r in zip(masks, rows) if (r[1] or "") == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [x for x in left if x[0] & bit]
                left = [x for x in left if not x[0] & bit]
                fails = sum(1 for x in own if x[0] & bit)
                alone = sum(1 for x in own if x[0] == bit)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone), letter]
    total = Counter()
    for (part, _, _), v in out.items():
        total[part, v[6]] += v[1]
    return {(*k, *v[:6], total[k[0], v[6]]) for k, v in out.items()}


def test_audit_matches_every_order_walked_plainly(spark, odd_docs, no_docs):
    rnd = random.Random(3)
    prose = lambda n, k: " ".join(f"w{rnd.randrange(k)}" for _ in range(n))
    more = [(20 + i, rnd.choice([prose(120, 10**6), prose(120, 30), prose(20, 9), "LOUD " * 120, prose(110, 10**6) + " 100%", "same text"]), rnd.choice(["en", "de", None])) for i in range(60)]
    docs = odd_docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string")).withColumns({
        "mask": F.lit("x"), "n": F.lit(1), "id": F.lit(2), "part": F.lit(3), "digest": F.lit(4),
    })
    marks = [(i, rnd.randrange(2), rnd.randrange(2)) for i in range(80)] + [(3, 1, 1), (3, 0, None), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("part", F.lit("z"))
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()]
    got = audit.audited(docs, labels)
    assert {tuple(r) for r in got.collect()} == plain_audit(rows, marks)
    assert got.count() == 600 * len({p or "" for _, p, _ in rows})
    assert audit.audited(no_docs, labels).count() == 0
    assert {r["good_lost"] for r in audit.audited(docs, labels.limit(0)).collect()} == {0}


def test_gray_code_states_are_subset_sums():
    rnd = np.random.default_rng(1)
    for k in (1, 3, 6):
        table = rnd.integers(0, 9, (1 << k, 2))
        states = audit.subset_survivors(table)
        for s in range(1 << k):
            assert (states[s] == table[[m for m in range(1 << k) if not m & s]].sum(axis=0)).all()


def words_of(rows, changed, least=7):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[a-zA-ZÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            if changed:
                h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
                if h % 31 == 0:
                    word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                found[word] += 1
    return found


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts, times=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(own, key=lambda v: (-counts[v], v)) for w, own in near.items() if own}
    form = {w: v for w, v in best.items() if counts[v] >= times * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form.get(w), counts[form[w]] if w in form else None, root(w)) for w, n in counts.items()}


def test_words_are_counted_and_damaged_as_stated(spark, odd_docs, no_docs):
    rnd = random.Random(9)
    more = [(i, " ".join(rnd.choice(["Wonderful", "ÀÉßberaus", "naïveté", "short", "x" * 30, "wonder7ful", "l'élégance"]) for _ in range(40))) for i in range(100, 200)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumns({"id": F.lit(1), "word": F.lit(2), "n": F.lit(3)})
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for changed in (spelling.lost_letter, None):
        got = {r["word"]: r["n"] for r in spelling.counted_words(docs, changed=changed).collect()}
        assert got == words_of(rows, changed)
    assert spelling.counted_words(no_docs).count() == 0


@pytest.mark.parametrize("box", [16_000, 40])
def test_near_words_match_all_pairs(spark, monkeypatch, box):
    monkeypatch.setattr(spelling, "BOX_WORDS", box)  # one box a length, and many
    monkeypatch.setattr(spelling, "LEAF", 4)
    rnd = random.Random(box)
    letters = "abcdeéèz漢"
    counts = {}
    while len(counts) < 700:
        word = "".join(rnd.choice(letters) for _ in range(rnd.choice([3, 4, 5, 7])))
        for _ in range(3):
            counts.setdefault(word, rnd.choice([1, 2, 15, 200, 3000]))
            at = rnd.randrange(len(word))
            word = rnd.choice([word[:at] + rnd.choice(letters) + word[at:], word[:at] + word[at + 1 :], word[:at] + rnd.choice(letters) + word[at + 1 :]])
    counts.pop("", None)
    counts |= {"".join(p): 2 for p in permutations("abcde")} | {"q" * 5000: 3, "q" * 5001: 40}  # anagrams, and very long words
    got = spelling.grouped(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {tuple(r) for r in got.collect()} == plain_groups(counts)


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:02}", f"w{i + 1:02}") for i in range(21)] + [("a", "w05"), ("b", "a")]
    got = dict(map(tuple, spelling.rooted(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "w21" for w, _ in chain}
    empty = spelling.grouped(spark.createDataFrame([], "word string, n long"))
    assert empty.count() == 0


def key_of(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\f\r"))


def plain_lines(rows, among=None):
    holders = defaultdict(set)
    for i, text in among if among is not None else rows:
        for line in (text or "").split("\n"):
            if len(key := key_of(line)) >= 20:
                holders[key].add(i)
    frequent = {k: max((i for i in ids if i is not None)) for k, ids in holders.items() if len(ids) >= 3}
    out = Counter()
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if key_of(x) not in frequent or frequent[key_of(x)] == i]
        out[i, len(own), len(own) - len(kept), "\n".join(kept)] += 1
    return out


def line_docs(spark, seed, first, n):
    rnd = random.Random(seed)
    pool = [f"A common line with the number {k}" for k in range(25)] + ["short line", "", " \t ", "Ünïcode line that is löng enough\x0b", "x" * 19, "é" * 20]
    rows = [(first + i, "\n".join(rnd.choice(["  ", "", "\t"]) + rnd.choice(pool).replace("common", rnd.choice(["common", "COMMON"])) for _ in range(rnd.randrange(6)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def as_counter(df):
    return Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect())


def test_line_dedup_matches_brute_force(spark, odd_docs, no_docs):
    odd = odd_docs.select("doc_id", "text").unionByName(line_docs(spark, 5, 20, 60)).unionByName(spark.createDataFrame(
        [(None, "A common line with the number 1\nown"), (None, "A common line with the number 1"), (9, "A common line with the number 2")], "doc_id long, text string"))
    docs = odd.withColumns({"key": F.lit(1), "row": F.lit("r"), "shard": F.lit(2), "keys": F.lit(3), "line": F.lit("z")})
    assert as_counter(lines.deduped(docs)) == plain_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert lines.deduped(no_docs).count() == 0


def test_insertions_and_deletions_can_be_taken_back(spark, monkeypatch):
    monkeypatch.setattr(lines, "SLICE", 20)
    first, second = line_docs(spark, 1, 0, 50), line_docs(spark, 2, 50, 50)
    rows = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    one = lines.built(first)
    both = lines.inserted(one, second)
    everything = rows(first) + rows(second)
    assert as_counter(lines.deduped(first.unionByName(second), both)) == plain_lines(everything)
    gone = spark.createDataFrame([(i,) for i in range(40, 75)], "doc_id long")
    fewer = lines.deleted(both, gone)
    left = [r for r in everything if not 40 <= r[0] < 75]
    assert as_counter(lines.deduped(spark.createDataFrame(left, "doc_id long, text string"), fewer)) == plain_lines(left)
    back = lines.deleted(both, second.select("doc_id"))
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, one.counts.collect()))
    for state in (one, both, fewer, back):  # no key at the limit is ever missed
        held = {r["shard"]: lines.Cuckoo.read(bytes(r["data"])) for r in state.filters.collect()}
        keys = state.counts.filter(F.col("n_docs") >= state.limit).withColumn("shard", lines.shard_of(F.col("key"), state.shards)).collect()
        assert keys and all(held[r["shard"]].holds([bytes(r["key"])])[0] for r in keys)
    nothing = lines.deleted(one, first.select("doc_id"))
    assert nothing.counts.count() == 0 and lines.suspected(one.refs, nothing).count() == 0


def test_cuckoo_filters_hold_remove_and_grow():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(3000)]
    made = lines.Cuckoo.of(keys)
    assert made.holds(keys).all()
    made.remove(keys[:1500])
    assert made.holds(keys[1500:]).all() and made.holds(keys[:1500]).mean() < 0.02
    again = lines.Cuckoo.read(made.data.tobytes())
    again.add(keys[:1500])
    assert again.data is not None and again.holds(keys).all()
    small = lines.Cuckoo.sized(1)
    small.add(keys)
    assert small.data is None
    assert lines.Cuckoo.of([]).data is not None
