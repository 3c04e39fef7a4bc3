"""Line dedup that can be taken back: exact reference tables, with sharded cuckoo filters in front of them.

A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys that are long enough and stand in
at least ``limit`` documents lose all their lines except in the largest document. The state has three tables:

* ``refs``: one row (key, doc_id, row) for every row of the input and key in it; keys and rows are 16-byte digests.
* ``counts``: (key, n_docs, keeper), the exact count of documents and the largest of them.
* ``filters``: for each shard of the key space a cuckoo filter of the keys at the limit: buckets of four 16-bit
  fingerprints, each key in one of two buckets, so single keys can be taken out again.

Inserting documents adds references, counts anew the keys that they hold, and puts keys that reach the limit into
their shard's filter; deleting documents takes references away and removes keys that fall below it. A filter that is
full is built again from the counts, larger. To find what has to go, references are dealt by shard, in slices of bounded
size, and meet their shard's filter; what it lets pass, true keys and a few false ones, is decided by the exact counts. So
lines of a single document, nearly all there are, cost one small shuffle. No text moves before its dropped keys are known.

Hot keys: references of a key are summed with map-side combining, a shard with many references is cut into slices,
and the exact join has one row per key on its smaller side, so adaptive execution can split the other.

Defined results: a null or empty text is one empty line; documents are told apart by id, so rows that repeat an id are one
document to the counts and each is rewritten on its own; rows with a null id together are one document, below
all others; columns other than the two named are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.exact import LOWER, UPPER
from itemloom.llm.store import stored

BLANKS = " \t\n\x0b\f\r"
SLOTS, KICKS = 4, 500
#: Frequent keys that a shard is planned for, the least and the greatest number of shards (beyond it shards grow), and
#: references in one slice of a shard.
SHARD_KEYS, LEAST_SHARDS, MOST_SHARDS, SLICE = 100_000, 16, 65_536, 100_000


class Cuckoo:
    """A cuckoo filter over 16-byte keys; ``data`` is None once a key found no place."""

    def __init__(self, data: np.ndarray) -> None:
        self.data: np.ndarray | None = data

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(2, math.ceil(math.log2(max(1, keys) / (SLOTS * 0.8))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, blob: bytes) -> Cuckoo:
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy())

    @classmethod
    def of(cls, keys: list[bytes]) -> Cuckoo:
        """A filter of these keys, as large as it takes."""
        room = len(keys)
        while True:
            made = cls.sized(room)
            made.add(keys)
            if made.data is not None:
                return made
            room = 2 * room + 8

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and the two buckets of each key."""
        words = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        prints = (words[:, 1] >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (words[:, 0] % np.uint64(len(self.data))).astype(np.int64)
        return prints, first, self.other(prints, first)

    def other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        jump = (prints.astype(np.uint64) * np.uint64(0x5BD1E995) >> np.uint64(7)) | np.uint64(1)
        return at ^ (jump % np.uint64(len(self.data))).astype(np.int64)

    def holds(self, keys: list[bytes]) -> np.ndarray:
        prints, first, second = self.places(keys)
        return ((self.data[first] == prints[:, None]) | (self.data[second] == prints[:, None])).any(axis=1)

    def add(self, keys: list[bytes]) -> None:
        if self.data is None or not keys:
            return
        for found, *at in zip(*self.places(keys), strict=True):
            if not self._placed(found, at[0]) and not self._placed(found, at[1]) and not self._kicked(found, at[1]):
                self.data = None
                return

    def _placed(self, found: np.uint16, at: int) -> bool:
        free = np.flatnonzero(self.data[at] == 0)
        if len(free):
            self.data[at, free[0]] = found
        return len(free) > 0

    def _kicked(self, found: np.uint16, at: int) -> bool:
        """Move others to their second buckets until one has room."""
        for turn in range(KICKS):
            out = self.data[at, turn % SLOTS]
            self.data[at, turn % SLOTS] = found
            found, at = out, int(self.other(np.array([out], np.uint16), np.array([at]))[0])
            if self._placed(found, at):
                return True
        return False

    def remove(self, keys: list[bytes]) -> None:
        if self.data is None or not keys:
            return
        for found, *at in zip(*self.places(keys), strict=True):
            for bucket in at:
                held = np.flatnonzero(self.data[bucket] == found)
                if len(held):
                    self.data[bucket, held[0]] = 0
                    break


@dataclass
class LineState:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    limit: int
    least: int


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _row(doc_id: Column, text: Column) -> Column:
    """Digest that tells rows of an id and a text from all others."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), text).cast("binary")))


def references(docs: DataFrame, least: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key, doc_id, row) of every line of at least ``least`` code points; a line that repeats in a row may repeat here."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = docs.select(F.col(id_column).alias("doc_id"), _row(F.col(id_column), text).alias("row"), F.explode(F.split(text, "\n")).alias("line"))
    keys = lines.select("doc_id", "row", line_key(F.col("line")).alias("key")).filter(F.length("key") >= least)
    return keys.select(F.unhex(F.md5(F.col("key").cast("binary"))).alias("key"), "doc_id", "row")


def counted(refs: DataFrame) -> DataFrame:
    """(key, n_docs, keeper)."""
    return refs.select("key", "doc_id").distinct().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


FILTER = "shard int, n_keys long, data binary"


def _filter_row(shard: int, n: int, made: Cuckoo) -> pa.Table:
    data = None if made.data is None else made.data.tobytes()
    return pa.table([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["shard", "n_keys", "data"])


def built_filters(counts: DataFrame, limit: int, shards: int) -> DataFrame:
    """A filter for every shard that has keys at the limit."""

    def build(group: pa.Table) -> pa.Table:
        keys = group["key"].to_pylist()
        return _filter_row(group["shard"][0].as_py(), len(keys), Cuckoo.of(keys))

    frequent = counts.filter(F.col("n_docs") >= limit).select(shard_of(F.col("key"), shards).alias("shard"), "key")
    return frequent.groupBy("shard").applyInArrow(build, FILTER)


def _planned(counts: DataFrame, limit: int) -> int:
    keys = counts.filter(F.col("n_docs") >= limit).count()
    return min(MOST_SHARDS, max(LEAST_SHARDS, 1 << math.ceil(math.log2(max(1, keys / SHARD_KEYS)))))


def _state(refs: DataFrame, counts: DataFrame, limit: int, least: int) -> LineState:
    shards = _planned(counts, limit)
    return LineState(refs, counts, stored(built_filters(counts, limit, shards), "line-filters"), shards, limit, least)


def built(docs: DataFrame, limit: int = 3, least: int = 20, id_column: str = "doc_id", text_column: str = "text") -> LineState:
    """The state of these documents."""
    refs = stored(references(docs, least, id_column, text_column), "line-refs")
    return _state(refs, stored(counted(refs), "line-counts"), limit, least)


def inserted(state: LineState, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> LineState:
    """The state with more documents. An id that is there already is one document with the lines of both."""
    new = stored(references(docs, state.least, id_column, text_column), "line-refs")
    return _moved(state, stored(state.refs.unionByName(new), "line-refs"), new.select("key").distinct())


def deleted(state: LineState, ids: DataFrame, id_column: str = "doc_id") -> LineState:
    """The state without the documents of these ids (a null id means the rows without one)."""
    gone = ids.select(F.col(id_column).alias("gone_id")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("gone_id"))
    touched = stored(state.refs.join(gone, same, "left_semi").select("key").distinct(), "line-keys")
    return _moved(state, stored(state.refs.join(gone, same, "left_anti"), "line-refs"), touched)


def _moved(state: LineState, refs: DataFrame, touched: DataFrame) -> LineState:
    """Count the touched keys anew and bring the filters up to date."""
    touched = stored(touched, "line-keys")
    fresh = stored(counted(refs.join(touched, "key", "left_semi")), "line-counts")
    counts = stored(state.counts.join(touched, "key", "left_anti").unionByName(fresh), "line-counts")
    if _planned(counts, state.limit) > state.shards:
        return _state(refs, counts, state.limit, state.least)
    old = state.counts.select(F.col("key").alias("old_key"), F.col("n_docs").alias("n_old")).join(touched, F.col("old_key") == F.col("key"), "left_semi")
    high = lambda n: F.coalesce(F.col(n), F.lit(0)) >= state.limit
    change = fresh.join(old, F.col("key") == F.col("old_key"), "full").select(
        F.coalesce("key", "old_key").alias("key"), (high("n_docs").cast("int") - high("n_old").cast("int")).alias("change")
    ).filter("change <> 0").withColumn("shard", shard_of(F.col("key"), state.shards))

    def update(old_filter: pa.Table, changes: pa.Table) -> pa.Table:
        made, n = (Cuckoo.read(old_filter["data"][0].as_py()), old_filter["n_keys"][0].as_py()) if len(old_filter) else (Cuckoo.sized(8), 0)
        if not len(changes):
            return old_filter.select(["shard", "n_keys", "data"])
        keys, signs = changes["key"].to_pylist(), changes["change"].to_pylist()
        made.remove([k for k, s in zip(keys, signs, strict=True) if s < 0])
        made.add([k for k, s in zip(keys, signs, strict=True) if s > 0])
        return _filter_row(changes["shard"][0].as_py(), n + sum(signs), made)

    updated = stored(state.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInArrow(update, FILTER), "line-filters")
    full = updated.filter("data IS NULL").select("shard")
    again = counts.withColumn("shard", shard_of(F.col("key"), state.shards)).join(full, "shard", "left_semi").drop("shard")
    filters = stored(updated.filter("data IS NOT NULL").unionByName(built_filters(again, state.limit, state.shards)), "line-filters")
    return LineState(refs, counts, filters, state.shards, state.limit, state.least)


def suspected(refs: DataFrame, state: LineState) -> DataFrame:
    """References that their shard's filter lets pass."""
    dealt = refs.withColumn("shard", shard_of(F.col("key"), state.shards))
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
    sizes = F.broadcast(stored(sizes, "line-sizes"))  # one row per shard, of which there are MOST_SHARDS at most
    part = F.pmod(F.xxhash64("row", "key"), F.col("slices")).cast("int")
    cut = dealt.join(sizes, "shard").select("shard", part.alias("slice"), "key", "doc_id", "row")
    copies = state.filters.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "data")

    def probe(rows: pa.Table, held: pa.Table) -> pa.Table:
        rows = rows.select(["key", "doc_id", "row"])
        if not len(rows) or not len(held):
            return rows.slice(0, 0)
        return rows.filter(pa.array(Cuckoo.read(held["data"][0].as_py()).holds(rows["key"].to_pylist())))

    schema = f"key binary, doc_id {dict(refs.dtypes)['doc_id']}, row binary"
    return cut.groupBy("shard", "slice").cogroup(copies.groupBy("shard", "slice")).applyInArrow(probe, schema)


def dropped_keys(refs: DataFrame, state: LineState) -> DataFrame:
    """(row, keys): for every row that loses lines, the keys of these lines; no more than the row has lines."""
    frequent = state.counts.filter(F.col("n_docs") >= state.limit)
    held = stored(suspected(refs, state), "line-suspects").join(frequent, "key")
    lost = held.filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("row").agg(F.collect_set("key").alias("keys"))


def rewritten(docs: DataFrame, drops: DataFrame, least: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): texts without the lines of the keys that go."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text"), _row(F.col(id_column), text).alias("own"))
    joined = rows.join(drops, F.col("own") == F.col("row"), "left").select("doc_id", "text", "keys")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blanks = BLANKS.encode()
        for batch in batches:
            counts, gone, texts = [], [], []
            for text, keys in zip(batch["text"].to_pylist(), batch["keys"].to_pylist(), strict=True):
                lines = text.encode().split(b"\n")
                kept, out = lines, set(keys or ())
                if out:
                    own = [line.strip(blanks).lower() for line in lines]
                    kept = [line for line, k in zip(lines, own, strict=True) if len(k) < least or hashlib.md5(k).digest() not in out]
                    text = b"\n".join(kept).decode()
                counts.append(len(lines))
                gone.append(len(lines) - len(kept))
                texts.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"]
            )

    return joined.mapInArrow(rewrite, f"doc_id {dict(rows.dtypes)['doc_id']}, n_lines long, n_dropped long, kept string")


def deduped(docs: DataFrame, state: LineState | None = None, limit: int = 3, least: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row of ``docs`` without the lines that go: doc_id, n_lines, n_dropped, kept.

    With a ``state``, which must hold these documents, its counts decide; else the state is built from ``docs``.
    """
    if state is None:
        state = built(docs, limit, least, id_column, text_column)
        refs = state.refs
    else:
        refs = stored(references(docs, state.least, id_column, text_column), "line-refs")
    drops = stored(dropped_keys(refs, state), "line-drops")
    return rewritten(docs, drops, state.least, id_column, text_column)
