"""Exact and near duplicates and duplicate components."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.operators.ordering import numeric_bucket, running_sums
from itemloom.operators.skew import join_groups
from itemloom.session import cut_lineage


def exact_groups(df: DataFrame, key: str, split_col: str, splits: Sequence[str], position: str = "pos") -> DataFrame:
    """One row per key shared by several rows: number by first appearance, size, and sizes per split.

    Members are not folded into one cell, since one group may hold a large part of the table; ``group_members``
    lists them row by row.
    """
    per_split = [F.count(F.when(F.col(split_col) == s, 1)).alias(f"n_{s}") for s in splits]
    groups = (
        df.filter(F.col(key).isNotNull()).groupBy(key)
        .agg(F.count("*").alias("count"), F.min(position).alias("first_pos"), *per_split)
        .filter("count > 1")
    )
    label = F.concat_ws(";", *[
        F.when(F.col(f"n_{s}") > 0, F.concat(F.lit(f"{s}:"), F.col(f"n_{s}").cast("string"))) for s in sorted(splits)
    ])
    bucket = numeric_bucket(df, position, of="first_pos")  # bounds from the rows: no second grouping for them
    numbered = running_sums(groups, [], ["first_pos"], {"group": F.lit(1).cast("long")}, bucket)
    return numbered.withColumn("splits", label)


def group_members(df: DataFrame, groups: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of the duplicate groups with their group number."""
    return join_groups(df.select(key, *columns), cut_lineage(groups.select(key, "group", "count")), key, "count").select("group", key, *columns)


def classify_groups(groups: DataFrame, splits: Sequence[str]) -> DataFrame:
    """How many duplicate groups (and rows) lie across splits or inside one split."""
    present = sum(((F.col(f"n_{s}") > 0).cast("int") for s in splits), F.lit(0))
    kind = F.when(present > 1, "cross_split")
    for s in splits:
        kind = kind.when(F.col(f"n_{s}") > 0, f"{s}_only")
    return groups.groupBy(kind.alias("kind")).agg(F.count("*").alias("groups"), F.sum("count").alias("rows"))


def cross_split_pairs(df: DataFrame, key: str, split_col: str, left: str, right: str, question: str = "question") -> DataFrame:
    """Per key present in both splits: rows on each side, pairs they form, and pairs with equal questions.

    The pairs of one key are the product of its two sides, so they are counted, not written out.
    """
    def side(s):
        return F.count_if(F.col(split_col) == s)
    both = df.filter(F.col(key).isNotNull() & F.col(split_col).isin(left, right))
    per_question = both.groupBy(key, question).agg(side(left).alias("l"), side(right).alias("r"))
    return per_question.groupBy(key).agg(
        F.sum("l").alias(f"n_{left}"), F.sum("r").alias(f"n_{right}"),
        (F.sum("l") * F.sum("r")).alias("pairs"), F.sum(F.col("l") * F.col("r")).alias("equal_question_pairs"),
    ).filter(F.col("pairs") > 0)


def cross_split_links(
    df: DataFrame, key: str, split_col: str, left: str, right: str, position: str = "pos", id_col: str = "id",
    columns: Sequence[str] = (),
) -> DataFrame:
    """Every row whose key occurs in the other split too, with the first row and the row count of that side."""
    def first(s):
        return F.min_by(F.when(F.col(split_col) == s, F.col(id_col)), F.when(F.col(split_col) == s, F.col(position)))
    both = df.filter(F.col(key).isNotNull() & F.col(split_col).isin(left, right))
    sides = cut_lineage(both.groupBy(key).agg(
        first(left).alias("__fl"), first(right).alias("__fr"), F.count("*").alias("__n"),
        F.count_if(F.col(split_col) == left).alias("__nl"), F.count_if(F.col(split_col) == right).alias("__nr"),
    ).filter((F.col("__nl") > 0) & (F.col("__nr") > 0)))
    is_left = F.col(split_col) == left
    return join_groups(both, sides, key, "__n").select(
        key, split_col, id_col, *columns,
        F.when(is_left, F.col("__fr")).otherwise(F.col("__fl")).alias("partner_id"),
        F.when(is_left, F.col("__nr")).otherwise(F.col("__nl")).alias("partners"),
    )


# ---- near duplicates by Hamming distance -------------------------------------------------------------------------


def _masks(bits: list[int], groups: int, chosen: int) -> list[int]:
    """Bit masks of every choice of ``chosen`` out of ``groups`` runs of the given bit positions."""
    runs = [bits[len(bits) * i // groups: len(bits) * (i + 1) // groups] for i in range(groups)]
    signed = []
    for picked in combinations(runs, chosen):
        mask = sum(1 << b for run in picked for b in run)
        signed.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return signed


def _plan_masks(rows: int, threshold: int, bits: int) -> list[int]:
    """Masks such that any two hashes within the threshold agree on one, for the least expected work.

    More fixed bits mean more masks per hash but fewer chance meetings; the cheapest family depends on the rows.
    """
    plans = []
    for chosen in range(1, 5):
        groups = threshold + chosen
        if groups <= bits:
            meetings = rows / 2 ** (bits * chosen // groups + 1)
            plans.append((comb(groups, chosen) * (1 + meetings), groups, chosen))
    _, groups, chosen = min(plans)
    return _masks(list(range(bits)), groups, chosen)


def _meet(keyed: DataFrame, threshold: int) -> DataFrame:
    """Pairs of hashes sharing a masked key that are within the threshold."""
    a, b = keyed.select("mask", "key", F.col("h").alias("h1")), keyed.select("mask", "key", F.col("h").alias("h2"))
    return (
        a.join(b, ["mask", "key"]).filter("h1 < h2")
        .select("h1", "h2", F.bit_count(F.col("h1").bitwiseXOR(F.col("h2"))).alias("distance"))
        .filter(F.col("distance") <= threshold)
    )


def _keys(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", F.col("h").bitwiseAND(F.col("mask")))


def _work(keyed: DataFrame) -> float:
    """Comparisons a join on (mask, key) would make."""
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").cast("double").alias("n"))
    return sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0


def hamming_pairs(hashes: DataFrame, column: str, threshold: int, bits: int = 64, bucket: int = 2000) -> DataFrame:
    """All pairs of different hash values within a Hamming distance, each once as (h1, h2, distance).

    Hashes within the threshold agree on at least one bit mask of a suitable family, so equal masked values are
    the join key. Buckets of more than ``bucket`` hashes are split again by the bits not yet fixed, as long as
    that at least halves their comparisons; where it does not, they consist of true pairs for the most part.
    Nothing is dropped.
    """
    spark = hashes.sparkSession
    distinct = cut_lineage(hashes.select(F.col(column).alias("h")).filter("h IS NOT NULL").distinct())
    masks = _plan_masks(distinct.count(), threshold, bits)
    keyed = _keys(distinct.select("h", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask")))
    pairs = None
    while True:
        steps = []
        for m in masks:
            free = [b for b in range(bits) if not (m >> b) & 1]
            if len(free) > threshold + 1:
                steps += [(m, m | sub) for sub in _masks(free, threshold + 1, 1)]
        splittable = sorted({m for m, _ in steps})
        sizes = keyed.filter(F.col("mask").isin(splittable)).groupBy("mask", "key").agg(F.count("*").alias("n"))
        crowded = cut_lineage(sizes.filter(F.col("n") > bucket))
        before = crowded.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
        if before == 0.0:
            found = _meet(keyed, threshold)
            return (found if pairs is None else pairs.unionByName(found)).distinct()
        hot = keyed.join(crowded, ["mask", "key"], "left_semi")
        wider = spark.createDataFrame(steps, "mask long, wider long")  # as many rows as masks times runs of bits
        split = cut_lineage(_keys(hot.join(F.broadcast(wider), "mask").select("h", F.col("wider").alias("mask")).distinct()))
        if _work(split) > before / 2:
            found = _meet(keyed, threshold)
            return (found if pairs is None else pairs.unionByName(found)).distinct()
        found = _meet(keyed.join(crowded, ["mask", "key"], "left_anti"), threshold)
        pairs = found if pairs is None else pairs.unionByName(found)
        keyed, masks = split, sorted({w for _, w in steps})


def closest_hashes(contents: DataFrame, hash_col: str, content: str, split_col: str, left: str, right: str, threshold: int, keep: int, bits: int = 64, bucket: int = 2000) -> DataFrame:
    """Ordered hash pairs (h1, h2, distance) among which the ``keep`` closest pairs of different contents are.

    The radius grows from 0 and stops as soon as the pairs within it are enough, at the threshold at the latest. A small
    radius needs few, long runs of equal bits, so crowded neighbourhoods end the search before short runs are compared.
    Pairs are counted from the contents of each hash value and side, never written out for that.
    """
    side = lambda s: F.max(F.when(F.col(split_col) == s, 1).otherwise(0))
    one = contents.groupBy(hash_col, content).agg(side(left).alias("l"), side(right).alias("r"))
    sums = [F.sum(F.col(c).cast("double")).alias(c) for c in ("l", "r")]
    values = cut_lineage(one.groupBy(F.col(hash_col).alias("h")).agg(*sums, F.sum(F.col("l") * F.col("r")).alias("shared"), F.count("*").alias("n")))
    within = (F.col("l") * (F.col("l") - 1) + F.col("r") * (F.col("r") - 1)) / 2 + F.col("l") * F.col("r") - F.col("shared")
    found = values.agg(F.sum(within)).first()[0] or 0.0
    links = values.filter("n > 1").select(F.col("h").alias("h1"), F.col("h").alias("h2"), F.lit(0).alias("distance"))
    near = None
    for radius in range(1, threshold + 1):
        if found >= keep:
            break
        near = cut_lineage(hamming_pairs(values, "h", radius, bits, bucket))
        one, two = (values.select(F.col("h").alias(f"h{i}"), F.col("l").alias(f"l{i}"), F.col("r").alias(f"r{i}")) for i in (1, 2))
        pairs = F.col("l1") * F.col("l2") + F.col("r1") * F.col("r2") + F.col("l1") * F.col("r2") + F.col("r1") * F.col("l2")
        found = (values.agg(F.sum(within)).first()[0] or 0.0) + (near.join(one, "h1").join(two, "h2").agg(F.sum(pairs)).first()[0] or 0.0)
    if near is None:
        return links
    return links.unionByName(near).unionByName(near.select(F.col("h2").alias("h1"), F.col("h1").alias("h2"), "distance"))


def similar_pairs(
    df: DataFrame, hash_col: str, content: str, split_col: str, left: str, right: str, threshold: int = 6,
    keep: int = 1000, bits: int = 64, position: str = "pos", columns: Sequence[str] = (), bucket: int = 2000,
) -> DataFrame:
    """The closest pairs of different contents within and across two splits.

    Equal contents of a split count as one entry (``left_copies``, ``right_copies``) represented by its first
    row. For the ``keep`` closest pairs in (distance, scope, left, right) order only the first ``2*keep + 1``
    contents of each hash value can matter, so crowded hash values are cut there without changing the result.
    """
    contents = cut_lineage(df.filter(F.col(split_col).isin(left, right) & F.col(hash_col).isNotNull()).groupBy(
        split_col, hash_col, content
    ).agg(
        F.min(position).alias("p"), F.count("*").alias("copies"),
        *[F.min_by(c, position).alias(c) for c in columns],
    ))
    links = closest_hashes(contents, hash_col, content, split_col, left, right, threshold, keep, bits, bucket)
    ranked = running_sums(
        contents, [split_col, hash_col], ["p"], {"__r": F.lit(1).cast("long")}, numeric_bucket(df, position, of="p"),
        below=2 * keep + 1,
    ).filter(F.col("__r") <= 2 * keep + 1)
    fields = [split_col, hash_col, content, "p", "copies", *columns]
    lhs = ranked.select(*[F.col(c).alias(f"left_{c}") for c in fields])
    rhs = ranked.select(*[F.col(c).alias(f"right_{c}") for c in fields])
    ls, rs = F.col(f"left_{split_col}"), F.col(f"right_{split_col}")
    wanted = ((ls == rs) & (F.col("left_p") < F.col("right_p"))) | ((ls == left) & (rs == right))
    joined = (
        links.join(lhs, F.col("h1") == F.col(f"left_{hash_col}"))
        .join(rhs, F.col("h2") == F.col(f"right_{hash_col}"))
        .filter(wanted & (F.col(f"left_{content}") != F.col(f"right_{content}")))
        .withColumn("scope", F.concat_ws("-", ls, rs))
    )
    order = ["distance", "scope", "left_p", "right_p"]
    return joined.orderBy(*order).limit(keep).select(
        "scope", F.col("distance").alias("hamming_distance"), "left_p", "right_p", "left_copies", "right_copies",
        *[f"{side}_{c}" for c in columns for side in ("left", "right")],
    ).orderBy("hamming_distance", "scope", "left_p", "right_p")


# ---- components over two keys ------------------------------------------------------------------------------------


def _smallest(edges: DataFrame) -> DataFrame:
    """The smallest node that each node has an edge to or is, and how many edges it has; written, as it is joined by parts."""
    return cut_lineage(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("degree")))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected(edges: DataFrame) -> DataFrame:
    """Smallest node of each component as (node, component) for every node with an edge ``u``-``v``.

    Alternates two star contractions (each node links its larger neighbours, then its smaller ones, to the
    smallest); the number of rounds grows with the logarithm of the component size, not with its diameter. The star
    of a large component has one node with nearly all edges, which is answered by a broadcast (``join_groups``).
    """
    current = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = _fingerprint(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = join_groups(both, _smallest(both), "u", "degree").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        lowest = _smallest(large)
        small = join_groups(large, lowest, "u", "degree").select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = small.unionByName(lowest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        current = cut_lineage(linked)
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def duplicate_components(df: DataFrame, keys: Sequence[str], position: str = "pos") -> DataFrame:
    """Add ``gid``: smallest position among rows linked, directly or through others, by any equal key.

    Rows with identical key tuples are one node, and a missing key links nothing.
    """
    nodes = cut_lineage(df.groupBy(*keys).agg(F.min(position).alias("node")))
    edges = None
    for k in keys:
        own = nodes.filter(F.col(k).isNotNull())
        first = cut_lineage(own.groupBy(k).agg(F.min("node").alias("v"), F.count("*").alias("n")))
        link = join_groups(own, first, k, "n").select(F.col("node").alias("u"), "v").filter("u <> v")
        edges = link if edges is None else edges.unionByName(link)
    labels = connected(edges)
    tagged = nodes.join(labels, "node", "left").select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.coalesce("component", "node").alias("gid"), F.col("node").alias("__node")
    )
    all_null = F.lit(True)
    same = None
    for k in keys:
        all_null = all_null & F.col(k).isNull()
        eq = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = eq if same is None else same & eq
    # rows without any key stand alone
    return df.join(tagged, same).withColumn("gid", F.when(all_null, F.col(position)).otherwise(F.col("gid"))).drop(
        *[f"__{k}" for k in keys], "__node"
    )


def keep_first(df: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """The first row of every key, chosen by position."""
    order = F.struct(F.col(position), *[F.col(c) for c in df.columns if c != position])
    return df.groupBy(key).agg(F.min(order).alias("__row")).select("__row.*")
