"""Near-duplicate documents: n-gram Jaccard join by parity sketches.

A document is the set of its word n-grams (hashed to 48 bits). Texts with the same set are one node. Two sets of sizes
a and b with Jaccard similarity of at least ``percent`` differ in at most d = (a + b)(100 - p) / (100 + p) elements.
A sketch holds the parity of every element in a bit of its own, in one of d + 1 + s words; words are so long that they are
kept as the XOR of the 64-bit codes of their elements. An element that only one of two sets holds flips one bit, so the
Hamming distance of two sketches is at most the symmetric difference, and at least s + 1 words must be equal
(pigeonhole). Words without elements say little; a set whose partners are at most t elements away has all but t words in
common with each of them, and names its empty words only if all of these might be empty. The spare number s keeps that
rare for the largest sets of a band, whose partners are farthest away. Sets are sketched per size band, with d for the largest pair of the band; a set near the lower
end of its band is sketched for the band below as well. Joining on (band, word number, word) misses no link.

Sketch words that many sets share are never expanded into pairs. Each shared word has a leader, the node with the most
shared words (the middle of a group of copies), and every other node is compared with the leader only, by exact
intersection; groups of a few nodes are compared pair by pair at once. What two followers x and y have to say to
each other is found through their differences from the leader: if they are similar, these differences D(x), D(y)
overlap in at least (|D(x)| + |D(y)| - d) / 2 elements. Elements that nodes of one component only have count for nothing;
among the others, the rarest first, x and y share one where both have their overlap left. Such elements, named after the
leader, are the shared words of the next round, and only nodes that have their overlap left there are compared;
differences are kept relative to the first leader, the centre. Words whose nodes already are in one component are done. Leaders are taken in one fixed order, so this
ends. No group is capped and no link between components is lost.

Defined results: null or empty text, or text without words, has no n-grams and is linked with nothing; with fewer words
than n the whole sequence is the one n-gram; rows with a null id are linked but name no component, and a component of
such rows alone is null; repeated rows are one node; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.llm.graph import components, extended
from itemloom.llm.store import discarded, light, passing, shielded, stored, without
from itemloom.llm.words import WordHasher, mix, runs

#: Bits of an n-gram hash. Two sets of 1,000 hold a false match with a chance of 4e-9.
BITS = 48
#: Ratio of the sizes at the ends of a band.
BAND = 1.5
#: Least number of words beyond those that the pigeonhole needs, so that as many empty ones may go unnamed.
SPARE = 2
#: Groups of up to this many nodes are compared pair by pair in the first round, where whole sets move for a pair.
FIRST_FEW = 8
#: The same for later rounds, where only differences move.
FEW = 32
#: Pairs of the first round that are compared at once, or half as many as there are sets if that is more.
AT_ONCE = 50_000
#: Sets that a task remembers, so that copies it meets again send no words.
RECENT = 200_000


def band_limits(size: int) -> list[int]:
    """First sizes of the bands, up to the one above ``size``."""
    limits = [1]
    while limits[-1] <= size:
        limits.append(max(limits[-1] + 1, int(limits[-1] * BAND)))
    return limits


def most_apart(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of similar sets with these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def shingles(text: bytes, n: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct n-gram hashes."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = hasher(words)
    grams = runs(h, n) if len(words) >= n else runs(h, len(words)) + np.uint64(len(words))
    return np.unique(mix(grams) >> np.uint64(64 - BITS))


def sketch_keys(grams: np.ndarray, percent: int, limits: list[int]) -> np.ndarray:
    """Keys (band, word number, word) of a set in its band and, near the band's lower end, in the one below."""
    n = len(grams)
    band = int(np.searchsorted(limits, n, "right")) - 1
    codes = mix(grams + np.uint64(1))
    keys = []
    for b in (band, band - 1):
        if b < 0:
            continue
        last = limits[b + 1] - 1
        above = last * 100 // percent  # largest partner in the next band
        if b < band and n > above:
            continue
        words = most_apart(last, max(last, above), percent) + 1
        words += SPARE + int(2 * words * math.exp(-last / words))  # twice what is empty in the largest sets
        largest = last if b < band else n * 100 // percent  # partner whose words of this band are met here
        spare = words - 1 - most_apart(n, largest, percent)
        at = (grams * np.uint64(words)) >> np.uint64(BITS)  # grows with the hash, so words are slices
        starts = np.searchsorted(at, np.arange(words, dtype=np.uint64))
        empty = np.diff(np.append(starts, n)) == 0
        value = np.bitwise_xor.reduceat(np.append(codes, np.uint64(0)), starts)
        name = np.arange(words, dtype=np.uint64) + np.uint64((b + 1) << 40)
        value = np.where(empty, np.uint64(0), value)
        chosen = slice(None) if empty.sum() > spare else ~empty
        keys.append(mix(value ^ mix(name))[chosen])
    return np.concatenate(keys)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def node_of(grams: np.ndarray) -> int:
    """64-bit name of a set."""
    return int(mix(np.array([mix(grams).sum() + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def _binary(docs: DataFrame, id_column: str, text_column: str, extra: list[Column]) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), *extra, F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))


def sketched(docs: DataFrame, id_column: str, text_column: str, n: int, percent: int) -> DataFrame:
    """(id, text_key, n_shingles, node, keys) of every row; node is null for an empty set.

    ``keys`` is empty for a copy of a set that the same task has met among its last ones.
    """
    rows = _binary(docs, id_column, text_column, [F.xxhash64(text_column).alias("text_key")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, limits, met = WordHasher(), band_limits(1), set()
        for batch in batches:
            for at in range(0, len(batch), 500):
                if len(met) > RECENT:
                    met.clear()
                part = batch.slice(at, 500)
                sizes, nodes, keys = [], [], []
                for text in part.column(2).to_pylist():
                    grams = shingles(text, n, hasher)
                    if len(grams) >= limits[-1]:
                        limits = band_limits(len(grams))
                    sizes.append(len(grams))
                    nodes.append(node_of(grams) if len(grams) else None)
                    new = nodes[-1] is not None and nodes[-1] not in met
                    met.add(nodes[-1])
                    keys.append(_signed(np.unique(sketch_keys(grams, percent, limits))) if new else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "text_key", "n_shingles", "node", "keys"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"id {kind}, text_key long, n_shingles long, node long, keys array<long>")


def node_sets(docs: DataFrame, id_column: str, text_column: str, n: int) -> DataFrame:
    """(node, grams) of every row with a set, for the rows that are to be compared."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for at in range(0, len(batch), 500):
                sets = [g for t in batch.slice(at, 500).column(1).to_pylist() if len(g := shingles(t, n, hasher))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node_of(g) for g in sets], pa.int64()), pa.array([_signed(g) for g in sets], pa.list_(pa.int64()))],
                    ["node", "grams"],
                )

    return _binary(docs, id_column, text_column, []).mapInArrow(work, "node long, grams array<long>")


def first_pairs(pairs: DataFrame, sets: DataFrame, among: Column, percent: int) -> DataFrame:
    """(leader, node, star, a, b, linked, diff): exact verdict, sizes, and for a star what differs, elements that the leader lacks first.

    ``sets`` (node, grams, leads) tell which nodes are leaders; ``among`` holds for every ``node`` of the pairs.
    """
    return (
        pairs.join(sets.filter("leads").select(F.col("node").alias("leader"), F.col("grams").alias("x")).hint("merge"), "leader")
        .join(sets.filter(among).select("node", F.col("grams").alias("y")).hint("merge"), "node")
        .select(
            "leader", "node", "star", F.size("x").alias("a"), F.size("y").alias("b"), F.size(F.array_intersect("x", "y")).alias("common"),
            F.when(F.col("star") == 1, F.concat(F.array_except("y", "x"), F.array_except("x", "y"))).alias("diff"),
        )
        .withColumn("linked", 100 * F.col("common") >= percent * (F.col("a") + F.col("b") - F.col("common"))).drop("common")
    )


def compared_in_turn(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """:func:`first_pairs` of stored pairs and sets, some pairs after the others.

    The leader's set moves once for every pair, and a set has the more partners the more texts there are. So the nodes
    are dealt out by hash, and what moves at once is a fixed share of the sets themselves.
    """
    turns = max(1, math.ceil(pairs.count() / max(AT_ONCE, sets.count() // 2)))
    turn = F.pmod(F.xxhash64("node"), F.lit(turns))
    found = [stored(first_pairs(pairs.filter(turn == i), sets, turn == i, percent), "compared") for i in range(turns)]
    return functools.reduce(DataFrame.unionByName, found)


def later_pairs(pairs: DataFrame, diffs: DataFrame, percent: int) -> DataFrame:
    """(center, leader, node, star, a, b, linked, diff) of (center, leader, node, star) from both differences to the centre.

    Where the node differs from the leader, its own deviations from the centre come first: they are its own edits,
    while the leader's edits are missing in everybody else as well.
    """
    own = diffs.select("center", F.col("node").alias("leader"), F.col("b").alias("a"), F.col("diff").alias("x"))
    other = diffs.select("center", "node", "b", F.col("diff").alias("y"))
    both = pairs.join(own, ["center", "leader"]).join(other, ["center", "node"]).select(
        "center", "leader", "node", "star", "a", "b", F.concat(F.array_except("y", "x"), F.array_except("x", "y")).alias("diff")
    )
    union = F.col("a") + F.col("b") + F.size("diff")  # twice the union
    linked = 100 * (F.col("a") + F.col("b") - F.size("diff")) >= percent * union
    return both.select("center", "leader", "node", "star", "a", "b", linked.alias("linked"), F.when(F.col("star") == 1, F.col("diff")).alias("diff"))


def followed(found: DataFrame, percent: int, *context: str) -> DataFrame:
    """(center, about, node, linked, b, apart, overlap, words) of compared stars, one row a star, so that they are joined as few rows.

    ``words`` name the elements of the difference after the leader; any partner has at least ``overlap`` of them.
    """
    a, b, apart = F.col("a"), F.col("b"), F.size("diff")
    # if the node is linked to the leader, a partner in another component is not, and is this far from the leader at least
    least = F.when(F.col("linked"), _most_apart(a + F.ceil(b * percent / F.lit(100)), percent) + 1).otherwise(1)
    most = _widest(percent)
    overlap = F.greatest(F.lit(1), F.ceil((apart + F.greatest(least, apart - most) - most) / F.lit(2))).cast("int")
    words = F.transform("diff", lambda e: F.xxhash64(*[F.col(c) for c in context], e))
    stars = found.filter("star = 1").select(
        F.col(context[0]).alias("center"), F.xxhash64(*context).alias("about"), "node", "linked", "b", apart.alias("apart"), overlap.alias("overlap"), words.alias("words")
    )
    return stars.filter(F.col("overlap") <= F.col("apart"))


def _most_apart(sizes: Column, percent: int) -> Column:
    """:func:`most_apart` of the sum of two sizes."""
    return F.floor(sizes * (100 - percent) / F.lit(100 + percent))


def _widest(percent: int) -> Column:
    """Largest difference from any partner of a node of size b, which has up to b * 100 / percent elements."""
    return _most_apart(F.col("b") + F.floor(F.col("b") * 100 / F.lit(percent)), percent)


def open_words(stars: DataFrame, percent: int) -> DataFrame:
    """(center, key, node, component, linked, b, apart, left, rank): words of ``followed`` stars that may lead to links between components.

    Elements that one component alone has are in no overlap that matters. The others are ranked by how many stars have
    them; ``left`` counts those of the node from this one on. Similar nodes meet in the first element that they share, where both have
    their overlap left. So a word is kept as far as this allows, then as far as any node that has met there allows.
    """
    facts = ["center", "component", "linked", "b", "apart", "overlap"]
    each = stars.select("about", "node", "component", F.explode("words").alias("key"))
    shared = each.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").cast("int").alias("rank"))
    shared = stored(shared.filter("c1 <> c2").select(F.col("key").alias("k"), "rank"), "unsettled")
    held = each.join(shared, F.col("key") == F.col("k")).groupBy("about", "node").agg(F.sort_array(F.collect_list(F.struct("rank", "key"))).alias("held"))
    held = held.withColumnsRenamed({"about": "h_about", "node": "h_node"})
    enough = stars.join(held, (F.col("about") == F.col("h_about")) & (F.col("node") == F.col("h_node"))).filter(F.size("held") >= F.col("overlap"))
    first = F.slice("held", F.lit(1), F.size("held") - F.col("overlap") + 1)
    counted = F.transform(first, lambda w, i: F.struct(w["key"].alias("key"), w["rank"].alias("rank"), (F.size("held") - i).alias("left")))
    keys = stored(enough.select("node", *facts[:-1], F.inline(counted)), "keys")
    met = keys.groupBy("key").agg(
        F.min("component").alias("c1"), F.max("component").alias("c2"), F.min("apart").alias("low"), F.min(F.when(~F.col("linked"), F.col("apart"))).alias("far")
    ).filter("c1 <> c2")
    met = stored(met.select(F.col("key").alias("k"), "low", "far"), "met")
    nearest = F.when(F.col("linked"), F.col("far")).otherwise(F.col("low"))
    return keys.join(met, F.col("key") == F.col("k")).filter(2 * F.col("left") >= F.col("apart") + nearest - _widest(percent)).drop("k", "low", "far")


def _links(found: DataFrame) -> DataFrame:
    return found.filter("linked").select(F.col("leader").alias("a"), F.col("node").alias("b"))


def groups_of(members: DataFrame, *context: str) -> DataFrame:
    """(k, size, x, y, rank, *context) of every key: how many nodes have it, and two hashes of which ones."""
    which = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    rank = F.min("rank") if "rank" in members.columns else F.lit(0)
    groups = members.groupBy("key").agg(F.count("*").alias("size"), *which, rank.alias("rank"), *[F.min(c).alias(c) for c in context])
    return stored(groups.withColumnRenamed("key", "k"), "groups")


def once(members: DataFrame, groups: DataFrame, *context: str) -> DataFrame:
    """``members`` of one key for every set of nodes, the first by rank: similar texts share many words, which all say the same."""
    kept = stored(groups.groupBy("size", "x", "y", *context).agg(F.min(F.struct("rank", "k")).alias("first")).select("first.k"), "kept")
    return members.join(kept, F.col("key") == F.col("k")).drop("k")


#: What :func:`open_words` tells of the node of a word.
FACTS = ["component", "b", "apart", "left"]


def may_link(percent: int) -> Column:
    """Whether two nodes of a word of :func:`open_words`, the other one's facts named t_, can be similar and are in two components."""
    overlap = F.col("apart") + F.col("t_apart") - _most_apart(F.col("b") + F.col("t_b"), percent)
    return (F.col("component") != F.col("t_component")) & (2 * F.least("left", "t_left") >= overlap)


def led(members: DataFrame, weight: DataFrame, few: int, *context: str, may: Column | None = None) -> DataFrame:
    """(*context, leader, node, star): pairs to compare among the nodes of every key.

    With more than ``few`` nodes, each goes with the heaviest node (of equal ones the largest) and ``star`` is true.
    Otherwise all are compared, less than ``few`` per node, and nothing is left for a next round. With ``may``, the
    condition for pairs, only ``few`` nodes outside the largest component need be compared, with all others.
    """
    facts = [] if may is None else FACTS
    ranked = members.join(weight.withColumnRenamed("node", "w_node"), F.col("node") == F.col("w_node")).select("key", "node", "weight", *context, *facts)
    ranked = stored(ranked, "ranked")
    top = F.max(F.struct("weight", "node")).alias("top")
    if may is None:
        leaders = ranked.groupBy("key").agg(top, F.count("*").alias("others"))
    else:
        # nodes outside the largest component of a key
        parts = ranked.groupBy("key", "component").agg(top, F.count("*").alias("n"))
        leaders = parts.groupBy("key").agg(F.max("top").alias("top"), (F.sum("n") - F.max("n")).alias("others"), F.max(F.struct("n", "component")).alias("main"))
    main = [] if may is None else [F.col("main.component").alias("main")]
    leaders = stored(leaders.select(F.col("key").alias("k"), F.col("top.node").alias("leader"), "others", *main), "leaders")
    same = F.col("key") == F.col("k")
    pairs = ranked.join(leaders.filter(F.col("others") > few), same).filter("node <> leader").select(*context, "leader", "node", F.lit(1).alias("star"))
    if few > 2:
        small = ranked.join(leaders.filter(F.col("others") <= few).drop("leader"), same)
        twin = small.select(F.col("key").alias("k2"), F.col("node").alias("leader"), *[F.col(c).alias(f"t_{c}") for c in facts])
        both = (F.col("key") == F.col("k2")) & (F.col("node") < F.col("leader"))
        if may is not None:  # those outside meet all
            small = small.filter("component <> main")
            both = (F.col("key") == F.col("k2")) & may & ((F.col("node") < F.col("leader")) | (F.col("t_component") == F.col("main")))
        pairs = pairs.unionByName(small.join(twin, both).select(*context, "leader", "node", F.lit(0).alias("star")))
    return pairs.groupBy(*context, "leader", "node").agg(F.max("star").alias("star"))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = 5, percent: int = 80
) -> DataFrame:
    """Component of every row: the id, text_key, n_shingles, component_id (smallest linked id, its own included), component.

    ``component`` names the component by its smallest node and is null for an empty set.
    """
    sketches = stored(sketched(docs, id_column, text_column, n, percent), "sketches")
    rows = stored(sketches.drop("keys"), "rows")
    # copies are one node from here on, and one of its rows stands for it
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), F.min(F.struct("id", "text_key")).alias("row"))
    nodes = stored(nodes, "nodes")
    # the same plan at every size: words are counted inside the tasks, then meet the shared ones by a shuffle
    keyed = sketches.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("n1"), F.max("node").alias("n2")).filter("n1 <> n2")
    shared = stored(shared.select(F.col("key").alias("k")), "shared")
    members = keyed.join(shared.hint("merge"), F.col("key") == F.col("k")).select("key", "node").distinct()
    members = stored(members, "shared-nodes")
    discarded(docs.sparkSession, sketches.stored_at)  # all words; most belong to one set only
    # the node whose words are shared most is the middle of its group: the others differ from it by their own edits only
    groups = groups_of(members)
    weight = members.join(groups, F.col("key") == F.col("k")).groupBy("node").agg(F.sum("size").alias("weight"))
    weight = stored(weight, "weights")
    pairs = stored(led(once(members, groups), weight, FIRST_FEW), "pairs")
    # one row of every node that takes part; only these texts are read again
    leaders = pairs.select(F.col("leader").alias("node")).distinct()
    taking = pairs.select("node").unionByName(leaders).distinct()
    chosen = nodes.join(taking, "node", "left_semi").select(F.col("row.id").alias("r_id"), F.col("row.text_key").alias("r_key"))
    same = F.col(id_column).eqNullSafe(F.col("r_id")) & (F.xxhash64(text_column) == F.col("r_key"))
    texts = docs.select(id_column, text_column).join(light(stored(chosen, "chosen")), same, "left_semi")
    sets = node_sets(texts, id_column, text_column, n).dropDuplicates(["node"])
    leads = leaders.select(F.col("node").alias("l_node")).hint("merge")
    sets = stored(sets.join(leads, F.col("node") == F.col("l_node"), "left").select("node", "grams", F.col("l_node").isNotNull().alias("leads")), "sets")
    found = compared_in_turn(pairs, sets, percent)
    discarded(docs.sparkSession, sets.stored_at)
    diffs = found.filter("star = 1").select(F.col("leader").alias("center"), "node", "b", "diff")
    labels = stored(components(_links(found)), "labels")
    keys = followed(found, percent, "leader")
    while True:
        stars = keys.join(labels.withColumnRenamed("node", "l_node"), F.col("node") == F.col("l_node"), "left")
        members = stored(open_words(stars.withColumn("component", F.coalesce("component", "node")), percent), "unsettled-nodes")
        if members.isEmpty():
            break
        pairs = stored(led(once(members, groups_of(members, "center"), "center"), weight, FEW, "center", may=may_link(percent)), "pairs")
        if pairs.isEmpty():
            break
        found = stored(later_pairs(pairs, diffs, percent), "compared")
        labels = extended(labels, _links(found))
        keys = followed(found, percent, "center", "leader")
    least = nodes.select("node", "least").join(labels, "node", "left").select(F.coalesce("component", "node").alias("component"), "node", "least")
    ids = stored(least, "least")
    lowest = ids.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(ids.join(lowest, "component").select(F.col("node").alias("m_node"), F.col("component").alias("m_component"), "component_id"), "named")
    # null nodes match nothing and name themselves
    return rows.select("id", "text_key", "n_shingles", "node").join(named, F.col("node") == F.col("m_node"), "left").select(
        F.col("id").alias(id_column), "text_key", "n_shingles",
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.col("m_component").alias("component"),
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of every component, the one with its smallest id; same columns.

    Rows without n-grams all stay, and so do rows that agree in id and text with the row that stays.
    """
    inner, place, back = shielded(docs)
    own, text = place[id_column], place[text_column]
    with passing(docs.sparkSession):
        found = near_duplicates(inner, own, text, n, percent).filter("component IS NOT NULL").select(
            "component", F.struct(F.col(own).isNull().alias("none"), F.col(own).alias("id"), "text_key").alias("row")
        )
        found = stored(found, "members")
        groups = found.groupBy("component").agg(F.min("row").alias("top"), F.count("*").alias("size")).filter("size > 1")
        groups = stored(groups.select(F.col("component").alias("c"), "top"), "tops")
        gone = found.join(groups, F.col("component") == F.col("c")).filter(~F.col("row").eqNullSafe(F.col("top"))).select(
            F.col("row.id").alias("v_id"), F.col("row.text_key").alias("v_key")
        )
        gone = stored(gone, "near-copies", outlives=True)
    return back(without(inner, gone, F.col(own).eqNullSafe(F.col("v_id")) & (F.xxhash64(text) == F.col("v_key"))))
