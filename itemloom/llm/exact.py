"""Exact duplicates by an extendible-hash index on shared files.

Entries (row number, id, 64-bit key, digest, without the text) are written once. Their distinct keys fill buckets that
are ranges of the key's leading bits. The directory starts with one bucket and doubles its depth until no bucket holds
more than ``capacity`` distinct keys or the key has no more bits; a bucket that fits keeps its local depth, so only
overfull ones are split. Each bucket has one owner: group rows are written as one range of keys per owner. Equal keys
are counted before any row is shuffled by key, so a text that makes up a third of the corpus costs one row per task.

Inside a bucket, entries chain by digest, and the bytes behind every chain of two or more are compared: the least and
the greatest text of a chain are equal only if all are. Chains that hold different bytes are taken apart by the text
itself, so the result is exact for any key and digest function.

Defined results: null text counts as empty; of equal texts the row with the largest id stays, a null id is smaller than
any, and of rows that share that id exactly one stays; an empty table gives no rows; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.store import passing, shielded, stored, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Pieces that the rows of one chain are dealt into while their bytes are compared.
SALTS = 16


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII text takes the short way."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def text_digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def directory(keys: DataFrame, capacity: int, step: int = 4) -> DataFrame:
    """Buckets of the index as (bucket_low, bucket_high, depth, n_keys): ranges of keys that follow one another.

    ``keys`` has one row per distinct ``key``. Overfull buckets are split ``step`` bits at a time; each pass counts
    only the keys that are still in overfull buckets. Only a count per pass comes to the driver.
    """
    # shift the sign so that unsigned order is the order of leading bits
    rest = keys.select(F.col("key").bitwiseXOR(F.lit(-(2**63))).alias("u"))
    done, depth = None, 0
    while True:
        counted = rest.groupBy(F.shiftrightunsigned("u", 64 - depth).alias("p") if depth else F.lit(0).cast("long").alias("p")).agg(
            F.count("*").alias("n_keys")
        )
        counted = stored(counted.withColumn("depth", F.lit(depth)), "directory")
        full = F.col("n_keys") > capacity
        fits = counted if depth >= 64 else counted.filter(~full)
        done = fits if done is None else done.unionByName(fits)
        if depth >= 64 or counted.filter(full).isEmpty():
            break
        over = counted.filter(full).select(F.col("p").alias("q"))
        prefix = F.shiftrightunsigned("u", 64 - depth) if depth else F.lit(0).cast("long")
        rest = rest.join(over, prefix == F.col("q"), "left_semi")
        depth = min(64, depth + step)
    low = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(p, 64 - depth)"))
    width = F.when(F.col("depth") == 0, F.lit(-1).cast("long")).otherwise(F.expr("shiftleft(1L, 64 - depth) - 1"))
    flip = F.lit(-(2**63))
    return done.select(
        low.bitwiseXOR(flip).alias("bucket_low"), (low + width).bitwiseXOR(flip).alias("bucket_high"), "depth", "n_keys"
    )


def exact_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", normalise: Callable[[Column], Column] = ascii_lower,
    key: Callable[[Column], Column] = text_key, digest: Callable[[Column], Column] = text_digest, capacity: int = 1_000_000,
) -> DataFrame:
    """Verdict on every row: the id, keep_id, group_size, kept, text_sha256, text_key and row_no."""
    text = normalise(F.coalesce(F.col(text_column), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_column).alias("id"), text.alias("norm"))
    entries = stored(
        rows.select("row_no", "id", key(F.col("norm")).alias("key"), digest(F.col("norm")).alias("digest")), "entries"
    )
    chains = entries.groupBy("key", "digest").agg(F.max(F.struct("id", "row_no")).alias("top"), F.count("*").alias("size"))
    groups = stored(owned(chains.select("key", "digest", "size", "top.*"), capacity), "groups")
    several = groups.filter("size > 1").select(
        F.col("key").alias("g_key"), F.col("digest").alias("g_digest"), F.col("size").alias("g_size"),
        F.col("id").alias("g_id"), F.col("row_no").alias("g_row"),
    )
    same = (F.col("key") == F.col("g_key")) & (F.col("digest") == F.col("g_digest"))
    # bytes behind chains of two or more
    texts = docs.select(F.col(id_column).alias("id"), text.alias("norm")).withColumns(
        {"key": key(F.col("norm")), "digest": digest(F.col("norm"))}
    )
    # the salt deals a hot chain out over tasks, each of which sends on its own least and greatest text
    salted = several.select("g_key", "g_digest", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("g_salt"))
    texts = texts.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    unlike = stored(
        texts.join(salted, same & (F.col("salt") == F.col("g_salt")), "left_semi").groupBy("key", "digest")
        .agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a <> b").select(F.col("key").alias("u_key"), F.col("digest").alias("u_digest")),
        "unlike",
    )
    joined = entries.join(several, same, "left").select(
        "row_no", "id", "key", "digest", F.coalesce("g_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("g_row").isNull(), F.col("id")).otherwise(F.col("g_id")).alias("keep_id"),
        (F.coalesce("g_row", "row_no") == F.col("row_no")).alias("kept"),
    )
    out = ["id", "keep_id", "group_size", "kept", "digest", "key", "row_no"]
    if unlike.isEmpty():
        result = joined.select(*out)
    else:
        clash = (F.col("key") == F.col("u_key")) & (F.col("digest") == F.col("u_digest"))
        mixed = rows.withColumns({"key": key(F.col("norm")), "digest": digest(F.col("norm"))}).join(unlike, clash, "left_semi")
        tops = mixed.groupBy("key", "norm").agg(F.max(F.struct("id", "row_no")).alias("top"), F.count("*").alias("group_size"))
        tops = tops.withColumnsRenamed({"key": "t_key", "norm": "t_norm"})
        apart = mixed.join(tops, (F.col("key") == F.col("t_key")) & (F.col("norm") == F.col("t_norm"))).select(
            "id", F.col("top.id").alias("keep_id"), "group_size", (F.col("top.row_no") == F.col("row_no")).alias("kept"),
            "digest", "key", "row_no",
        )
        result = joined.join(unlike, clash, "left_anti").select(*out).unionByName(apart)
    return result.select(
        F.col("id").alias(id_column), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"),
        F.col("key").alias("text_key"), "row_no",
    )


def owned(chains: DataFrame, capacity: int) -> DataFrame:
    """Group rows with the bucket that owns their key, dealt out so that an owner has one range of keys.

    The directory is small (a row per ``capacity`` keys), but it is joined on a prefix rather than broadcast.
    """
    chains = stored(chains, "chains")
    buckets = directory(chains.select("key").distinct(), capacity)
    depths = sorted(r["depth"] for r in buckets.select("depth").distinct().collect())
    tagged = None
    for depth in depths:
        own = buckets.filter(F.col("depth") == depth).select(F.col("bucket_low"), F.col("depth").alias("local_depth"))
        if depth == 0:
            part = chains.withColumns({"bucket_low": F.lit(-(2**63)), "local_depth": F.lit(0)})
        else:
            prefix = F.expr(f"shiftright(bucket_low, {64 - depth})")
            part = chains.join(own, F.shiftright("key", 64 - depth) == prefix)
        tagged = part if tagged is None else tagged.unionByName(part)
    if tagged is None:
        tagged = chains.withColumns({"bucket_low": F.lit(-(2**63)), "local_depth": F.lit(0)})
    return tagged.repartitionByRange("bucket_low", "key")


def first_of_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every group of equal texts; same columns."""
    inner, place, back = shielded(docs)
    own, text = place[id_column], F.coalesce(F.col(place[text_column]), F.lit(""))
    with passing(docs.sparkSession):
        verdict = exact_duplicates(inner, own, place[text_column], **options).filter("NOT kept").select(
            F.col(own).alias("v_id"), F.col("text_key").alias("v_key"), F.col(own).eqNullSafe(F.col("keep_id")).alias("tie")
        )
        gone = stored(verdict, "copies", outlives=True)
    keyed = inner.withColumn("doc_key", options.get("key", text_key)(options.get("normalise", ascii_lower)(text)))
    same = F.col(own).eqNullSafe(F.col("v_id")) & (F.col("doc_key") == F.col("v_key"))
    others = without(keyed, gone.filter("NOT tie"), same)
    ties = gone.filter("tie")
    if ties.isEmpty():
        return back(others)
    # rows that share the id of the row that stays: one of them
    tied = keyed.join(ties, same, "left_semi").dropDuplicates([own, "doc_key"])
    return back(others.join(ties, same, "left_anti").unionByName(tied))
