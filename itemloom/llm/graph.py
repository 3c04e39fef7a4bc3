"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that it is connected with.

    Every round links each node's neighbours to the smallest of them, first from the larger side and then from the
    smaller, until nothing changes; the number of rounds grows with the logarithm of the longest chain. Minima are
    taken with map-side combining and written before they are joined, so the star of a large component is a hot key
    of a plain join, which adaptive execution splits.
    """
    now = stored(_ordered(links), "links")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        # larger neighbours go to the smallest node around
        large = _ordered(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # then every node has few smaller neighbours left; they go to its smallest one, and so does the node
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(_ordered(small.unionByName(low.select("a", F.col("m").alias("b")))), "links")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` of :func:`components` after more ``links``: only the graph between components is worked on."""
    first, second = (labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    known = stored(
        links.join(first, "a", "left").join(second, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")),
        "known",
    )
    between = known.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    if between.isEmpty():
        return labels
    higher = stored(components(between), "higher").select(F.col("node").alias("component"), F.col("component").alias("top"))
    nodes = labels.unionByName(
        known.select(F.col("a").alias("node"), F.col("ca").alias("component")).unionByName(known.select(F.col("b").alias("node"), F.col("cb").alias("component")))
    ).distinct()
    return stored(nodes.join(higher, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
