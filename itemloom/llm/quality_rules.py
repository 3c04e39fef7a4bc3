"""Quality rules: cross-document line frequency.

Lines are normalised (A-Z lower-cased, digits as 0, words joined by one space) and hashed. Per host and line the number
of distinct documents is counted; lines above the host's limit are removed, and a document that is depleted by that is
rejected. Copies must not make their own lines frequent, so documents count as distinct when their own text differs. That
takes two counts: a plain one finds the lines that stand in more documents than the limit; then each document with such
lines is named by the smallest hash over the 8-word windows that start in its other lines, and the names are counted.
Exact copies agree in their name always and near copies mostly, while unrelated documents that share a block of lines, of
whatever length, do not. A document of such lines only is named by all of its windows, so its copies agree too.

The limit of a host is the larger of ``min_documents`` and ``share`` of its documents. A document is depleted when lines
were removed and fewer than ``min_words`` words remain or more than ``max_lost`` of its words went.

Defined results: null or empty text has no words and fails the base rules; a null host is a host of its own; rows that
repeat an id are documents of their own; an empty table gives no rows; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from itemloom.llm.store import passing, shielded, stored
from itemloom.llm.words import WordHasher, runs

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
# white space, and the bytes of a character after its first
_NO_CHARACTER = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_SIGNATURE = (
    "row_no long, id {kind}, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, lines array<struct<line:long,own:long,words:int>>"
)


def _profile(text: bytes, hasher: WordHasher) -> tuple:
    """Base figures of a text and its distinct lines: hash, smallest hash of a window that starts in it, words over all repeats."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, _NO_CHARACTER))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    rows = text.split(b"\n")
    counts = [len(r.split()) for r in rows]
    full = [(r, c) for r, c in zip(rows, counts, strict=True) if c]
    dup_lines = len(full) - len({r for r, _ in full})
    windows = runs(hasher(words), WINDOW)
    repeat = _repeated(windows, n)
    plain = [normalised(r) for r, _ in full]
    sizes: dict[bytes, int] = {}
    least: dict[bytes, int] = {}
    low = np.uint64(0xFFFFFFFFFFFFFFFF)
    if full:
        starts = np.cumsum([0, *(c for _, c in full[:-1])])
        padded = np.concatenate([windows, np.full(n - len(windows), low)])
        for line, (_, c), m in zip(plain, full, np.minimum.reduceat(padded, starts).tolist(), strict=True):
            sizes[line] = sizes.get(line, 0) + c
            least[line] = min(m, least.get(line, int(low)))
    lines = [
        {"line": line_hash(line), "own": None if least[line] == int(low) else _signed(least[line]), "words": words_of} for line, words_of in sizes.items()
    ]
    return n, chars, symbols, dup_lines, repeat, lines


def normalised(line: bytes) -> bytes:
    return b" ".join(line.split()).lower().translate(_DIGITS)


def line_hash(line: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(line))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _repeated(windows: np.ndarray, n: int) -> int:
    """Words that lie in a window found at least twice."""
    if len(windows) < 2:
        return 0
    order = np.sort(windows)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(windows, np.unique(twice))
    edge = np.zeros(n + 1, np.int64)
    edge[:-WINDOW][: len(hit)] += hit
    edge[WINDOW : WINDOW + len(hit)] -= hit
    return int((np.cumsum(edge[:n]) > 0).sum())


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    kind = pa.list_(pa.struct([("line", pa.int64()), ("own", pa.int64()), ("words", pa.int32())]))
    names = ["row_no", "id", "host", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            rows = [_profile(t, hasher) for t in part.column(4).to_pylist()]
            *figures, lines = zip(*rows, strict=True)
            made = [pa.array(f, pa.int64()) for f in figures]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *made, pa.array(lines, kind)], names)


def _over_limit(counts: DataFrame, hosts: DataFrame, least: int) -> DataFrame:
    """(h, l): the lines of (host, line, n_documents) above their host's limit, which is ``least`` or more."""
    over = counts.filter(F.col("n_documents") > least).join(hosts, counts["host"].eqNullSafe(hosts["host"])).filter(F.col("n_documents") > F.col("most"))
    return stored(over.select(counts["host"].alias("h"), F.col("line").alias("l")), "frequent-lines")


def line_rules(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
    min_documents: int = 20, share: float = 0.005, min_words: int = 20, max_lost: float = 0.6, min_length: int = 20,
    max_repeat_percent: int = 30,
) -> DataFrame:
    """Figures and verdict of every document.

    Columns: row_no (number of the input row), the id, rule_host, text_key (xxhash64 of the text), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_lost_words (words on removed lines), removed_lines (their hashes), kept.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(id_column).alias("id"),
        F.col(host_column).cast("string").alias("host"), F.xxhash64(text_column).alias("text_key"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"),
    )
    seen = stored(rows.mapInArrow(_profiles, _SIGNATURE.replace("{kind}", kind)), "rules")
    hosts = seen.groupBy("host").agg(F.greatest(F.lit(float(min_documents)), F.count("*") * share).alias("most"))
    # inline is a narrow generator: host and one line at a time
    lines = seen.select("row_no", "host", F.inline("lines"))
    often = _over_limit(lines.groupBy("host", "line").agg(F.count("*").alias("n_documents")), hosts, min_documents)
    marked = lines.join(often, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")), "left").withColumn("often", F.col("l").isNotNull())
    own = F.coalesce(F.min(F.when(~F.col("often"), F.col("own"))), F.min("own"), F.lit(0))
    named = marked.groupBy("row_no").agg(own.alias("name"), F.max("often").alias("any_often")).filter("any_often")
    again = marked.filter("often").select("row_no", "host", "line").join(named.select(F.col("row_no").alias("n_row"), "name"), F.col("row_no") == F.col("n_row"))
    above = _over_limit(again.groupBy("host", "line").agg(F.count_distinct("name").alias("n_documents")), hosts, min_documents)
    lost = (
        lines.join(above, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
        .groupBy("row_no").agg(F.sum("words").alias("lost"), F.collect_list("line").alias("removed"))
    )
    lost_words = F.coalesce("lost", F.lit(0)).cast("long")
    base = (F.col("n_words") < min_length) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (lost_words > 0) & ((F.col("n_words") - lost_words < min_words) | (lost_words > max_lost * F.col("n_words")))
    return seen.drop("lines").join(lost, "row_no", "left").select(
        "row_no", F.col("id").alias(id_column), F.col("host").alias("rule_host"), "text_key", "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words", base.alias("base_failed"), lost_words.alias("n_lost_words"),
        F.coalesce("removed", F.array().cast("array<long>")).alias("removed_lines"), (~base & ~depleted).alias("kept"),
    )


@F.pandas_udf(StringType())
def without_lines(texts: pd.Series, removed: pd.Series) -> pd.Series:
    """Texts without the lines whose hashes are listed."""
    out = []
    for text, hashes in zip(texts, removed, strict=True):
        if text is None or hashes is None or not len(hashes):
            out.append(text)
            continue
        gone = set(hashes)
        lines = [(x, normalised(x.encode())) for x in text.split("\n")]
        out.append("\n".join(x for x, plain in lines if not plain or line_hash(plain) not in gone))
    return pd.Series(out, dtype=object)


def apply_rules(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", **options
) -> DataFrame:
    """``docs`` without rejected documents, and without the removed lines in the others; same columns.

    A column ``n_chars`` that holds the length of the text does so afterwards.
    """
    inner, place, back = shielded(docs)
    own, text, host = place[id_column], place[text_column], place[host_column]
    with passing(docs.sparkSession):
        found = line_rules(inner, own, text, host, **options).filter("NOT kept OR size(removed_lines) > 0").select(
            F.col(own).alias("r_id"), F.col("text_key").alias("r_key"), F.col("rule_host").alias("r_host"), F.col("kept").alias("r_kept"),
            F.col("removed_lines").alias("r_lines"),
        )
        # rows that agree in id, text and host have one verdict
        found = stored(found.dropDuplicates(["r_id", "r_key", "r_host"]), "verdicts", outlives=True)
    same = (
        F.col(own).eqNullSafe(F.col("r_id")) & (F.xxhash64(text) == F.col("r_key")) & F.col(host).cast("string").eqNullSafe(F.col("r_host"))
    )
    rest = inner.join(found, same, "left").filter("r_kept IS NULL OR r_kept")
    if size := place.get("n_chars"):
        shorter = rest.withColumn("before", F.length(text)).withColumn(text, without_lines(F.col(text), F.col("r_lines")))
        rest = shorter.withColumn(size, F.when(F.col(size) == F.col("before"), F.length(text)).otherwise(F.col(size)).cast(docs.schema["n_chars"].dataType))
    else:
        rest = rest.withColumn(text, without_lines(F.col(text), F.col("r_lines")))
    return back(rest)
