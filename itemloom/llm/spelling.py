"""Spelling variants: words one edit apart, found with k-d trees over letter-count vectors.

A word's vector counts its letters: 26 places for a-z, six more that all other code points share by their remainder.
Replacing a letter moves a word to a vector with one count less and one more (or to the same vector, among the six), inserting
one adds one count, so both stay within an L1 distance of two. There is a tree for every word length; words of length n
are searched in the tree of n for replaced letters and in the tree of n + 1 for inserted ones. At a split the search
goes into a box as it is, or spends its one count more or its one count less to reach it, else the box is pruned. In
the leaves the order of the letters is verified: one differing place, or a common start and end that cover the shorter word.

The upper part of the trees deals the work out: it is fitted on a bounded sample of words (``MAX_SAMPLE``, those of
the least hashes), which only decides where boxes end. Every word belongs to one box and is sent as a query to the boxes that
its search reaches. Each box is one group, where a lower tree over its own words is searched by all its queries at once. Groups
send on one row per word (number of near words, best one), not the pairs. As a box holds about ``BOX_WORDS`` words at any size,
only the number of boxes grows. Words with equal vectors (anagrams) cannot be split and are compared in blocks of a fixed size.

Defined results: a null text has no words; a null id counts as an empty one; rows that repeat add their words each time; of
near words with equal counts the smallest in code-point order is the form; columns other than the two named are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.store import stored

MAX_SAMPLE, SAMPLE_A_BOX, BOX_WORDS = 200_000, 64, 16_000
LEAF, PAIRS = 24, 1 << 20
#: Words that an extraction task holds before it sends their counts on.
HELD_WORDS = 300_000
DIMS = 32

LATIN = "a-zÀ-ÿ"


def lost_letter(word: str, doc_id: str) -> str:
    """The word with one code point less, where 31 divides the checksum of id and word."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counted_words(
    docs: DataFrame, letters: str = LATIN, least: int = 7, changed: Callable[[str, str], str] | None = None, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(word, n): maximal runs of ``letters``, A-Z lower-cased, of at least ``least`` code points after ``changed``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, seen = regex.compile(f"[{letters}]{{{least},}}"), Counter()
        for batch in batches:
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                for word, n in Counter(run.findall(text.encode().lower().decode())).items():
                    if changed is not None and len(word := changed(word, doc_id)) < least:
                        continue
                    seen[word] += n
                if len(seen) > HELD_WORDS:
                    yield _counts(seen)
                    seen.clear()
        yield _counts(seen)

    rows = docs.filter(F.col(text_column).isNotNull()).select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])


class Words:
    """Words of one length: code points, and letter-count vectors."""

    def __init__(self, words: list[str], length: int) -> None:
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)
        place = np.where((self.codes >= 97) & (self.codes <= 122), self.codes - 97, 26 + self.codes % 6).astype(np.int64)
        flat = (place + DIMS * np.arange(len(words))[:, None]).ravel()
        self.vectors = np.bincount(flat, minlength=DIMS * len(words)).reshape(len(words), DIMS).astype(np.int32)
        if not len(words) or self.codes.max() < 256:
            self.codes = self.codes.astype(np.uint8)

    def columns(self) -> np.ndarray:
        """Code points place by place, so that whole columns are compared."""
        return np.ascontiguousarray(self.codes.T)


class KdTree:
    """Splits of letter-count vectors: node i has (dim, value, left, right), or leaf number and -1 where it ends."""

    def __init__(self, vectors: np.ndarray, leaf: int) -> None:
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves: list[np.ndarray] = []
        waiting = [(np.arange(len(vectors)), -1, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            here = len(self.nodes)
            if parent >= 0:
                dim, value, *ends = self.nodes[parent]
                ends[side] = here
                self.nodes[parent] = (dim, value, *ends)
            split = self._split(vectors[rows]) if len(rows) > leaf else None
            if split is None:
                self.nodes.append((-1, len(self.leaves), -1, -1))
                self.leaves.append(rows)
                continue
            self.nodes.append((*split, -1, -1))
            low = vectors[rows, split[0]] <= split[1]
            waiting += [(rows[low], here, 0), (rows[~low], here, 1)]

    @staticmethod
    def _split(own: np.ndarray) -> tuple[int, int] | None:
        """The letter and count that part the words most evenly; None if all vectors are equal."""
        best, least, most = None, own.min(axis=0), own.max(axis=0)
        for value in range(int(most.max())):
            open_ = np.flatnonzero((least <= value) & (most > value))
            if len(open_):
                uneven = np.abs((own[:, open_] <= value).sum(axis=0) * 2 - len(own))
                if best is None or uneven.min() < best[0]:
                    best = (uneven.min(), int(open_[uneven.argmin()]), value)
        return best and best[1:]

    def reached(self, vectors: np.ndarray, more: bool, less: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``vectors``): boxes that hold the vector itself or, where allowed, with one count more or less or both."""
        none = np.full(len(vectors), -1, np.int8)
        waiting = [(0, np.arange(len(vectors)), none if more else none * 0 + DIMS, none if less else none * 0 + DIMS)]
        while waiting:
            at, rows, up, down = waiting.pop()
            if not len(rows):
                continue
            dim, value, left, right = self.nodes[at]
            if dim < 0:
                yield value, rows
                continue
            count = vectors[rows, dim] + (up == dim) - (down == dim)
            low, high = count <= value, count > value
            give = (count == value + 1) & (down == -1) & (up != dim)
            take = (count == value) & (up == -1) & (down != dim)
            to_left, to_right = low | give, high | take
            waiting.append((left, rows[to_left], up[to_left], np.where(give, dim, down)[to_left].astype(np.int8)))
            waiting.append((right, rows[to_right], np.where(take, dim, up)[to_right].astype(np.int8), down[to_right]))

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(vectors), np.int64)
        for leaf, rows in self.reached(vectors, False, False):
            out[rows] = leaf
        return out


def replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the words b (columns) differ from the words a in exactly one place, as rows of a by columns of b."""
    unlike = np.zeros((a.shape[1], b.shape[1]), np.int16)
    for x, y in zip(a, b, strict=True):
        unlike += x[:, None] != y[None, :]
    return unlike == 1


def inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the words b are one of the words a with one letter more: a common start and end cover it."""
    covered = np.zeros((a.shape[1], b.shape[1]), np.int16)
    start, end = np.ones(covered.shape, bool), np.ones(covered.shape, bool)
    for i in range(len(a)):
        start &= a[i][:, None] == b[i][None, :]
        end &= a[-1 - i][:, None] == b[-1 - i][None, :]
        covered += start
        covered += end
    return covered >= len(a)


def near_in_box(member_words: Words, query_words: Words, insert: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) rows of all words one edit apart in a box: a letter replaced, or one more in the member."""
    tree, test = KdTree(member_words.vectors, LEAF), inserted if insert else replaced
    members, queries = member_words.columns(), query_words.columns()
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for leaf, rows in tree.reached(query_words.vectors, True, not insert):
        own = tree.leaves[leaf]
        for i in range(0, len(own), 1024):
            part = own[i : i + 1024]
            step = max(1, PAIRS // len(part))
            for k in range(0, len(rows), step):
                q, m = np.nonzero(test(queries[:, rows[k : k + step]], members[:, part]))
                if len(q):
                    found.append((rows[k + q], part[m]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _boxes(vocabulary: DataFrame) -> dict[int, KdTree]:
    """The upper trees by word length, from a bounded sample; boxes are planned for BOX_WORDS words of all."""
    words = vocabulary.count()
    size = min(MAX_SAMPLE, max(1, SAMPLE_A_BOX * words // BOX_WORDS))
    sample: dict[int, list[str]] = {}
    for row in vocabulary.select("word").orderBy(F.xxhash64("word"), "word").limit(size).collect():
        sample.setdefault(len(row["word"]), []).append(row["word"])
    leaf = max(1, size * BOX_WORDS // max(1, words))
    return {length: KdTree(Words(own, length).vectors, leaf) for length, own in sample.items()}


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): how many words are one edit away, and the one with the largest n. Words without any are left out."""
    trees = _boxes(vocabulary)

    def box(length: int, leaf: int) -> str:
        return f"{length}:{leaf}"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = np.array(batch["word"].to_pylist(), object), batch["n"].to_numpy()
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            out: list[tuple[str, int, np.ndarray]] = []
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                vectors = Words(words[rows].tolist(), length).vectors
                for role, at, more, less in ((0, length, False, False), (1, length, True, True), (2, length + 1, True, False)):
                    if at in trees:
                        out += [(box(at, leaf), role, rows[own]) for leaf, own in trees[at].reached(vectors, more, less)]
                    else:
                        out.append((box(at, 0), role, rows))  # no word of this length is in the sample: one box
            if out:
                picked = np.concatenate([rows for *_, rows in out])
                counts = [len(rows) for *_, rows in out]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([b for b, *_ in out], counts)), pa.array(np.repeat([r for _, r, _ in out], counts).astype(np.int32)),
                    pa.array(words[picked], pa.string()), pa.array(n[picked]),
                ], names=["box", "role", "word", "n"])

    def search(group: pa.Table) -> pa.Table:
        words, n, role = np.array(group["word"].to_pylist(), object), group["n"].to_numpy(), group["role"].to_numpy()
        length = int(group["box"][0].as_py().split(":")[0])
        rank = np.empty(len(words), np.int64)  # largest count first, then the smallest word
        rank[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
        count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
        members = np.flatnonzero(role == 0)
        own = Words(words[members].tolist(), length)
        for kind in (1, 2) if len(members) else ():
            queries = np.flatnonzero(role == kind)
            if len(queries):
                q, m = near_in_box(own, Words(words[queries].tolist(), length - (kind == 2)), kind == 2)
                ends = [(queries[q], members[m])] + [(members[m], queries[q])] * (kind == 2)
                for one, other in ends:
                    np.add.at(count, one, 1)
                    np.minimum.at(best, one, rank[other])
        hit, by_rank = np.flatnonzero(count), np.argsort(rank)
        top = by_rank[best[hit]]
        return pa.table([pa.array(words[hit], pa.string()), pa.array(count[hit]), pa.array(words[top], pa.string()), pa.array(n[top])], names=["word", "n_near", "near", "near_n"])

    dealt = vocabulary.select("word", "n").mapInArrow(deal, "box string, role int, word string, n long")
    parts = dealt.groupBy("box").applyInArrow(search, "word string, n_near long, near string, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("near"))).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.minus_n")).alias("near_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form. Roots are taken twice as far each round; a form's n is a multiple of its word's, so rounds are few."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("next"), F.col("root").alias("far"))
        joined = stored(now.join(ahead, F.col("root") == F.col("next"), "left"), "roots")
        now = joined.select("word", F.coalesce("far", "root").alias("root"))
        if joined.filter("far IS NOT NULL").isEmpty():
            return now


def grouped(vocabulary: DataFrame, times: int = 10) -> DataFrame:
    """Each word of (word, n) with its number of near words, its form and its root.

    The form is the near word of largest n if that is at least ``times`` the word's n; the root is the last of the forms
    that follow one another, or the word itself.
    """
    vocabulary = stored(vocabulary, "words")
    found = near_words(vocabulary).withColumnRenamed("word", "own")
    is_form = F.col("near_n") >= times * F.col("n")
    known = stored(
        vocabulary.join(found, F.col("word") == F.col("own"), "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")
        ), "near",
    )
    roots = rooted(known.filter("form IS NOT NULL").select("word", "form")).withColumnRenamed("word", "own")
    return known.join(roots, F.col("word") == F.col("own"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
