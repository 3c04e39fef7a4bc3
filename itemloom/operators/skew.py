"""Joins of rows with one row per group, where one group may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group counts as heavy from this share of all rows on, so there are at most as many heavy groups.
HEAVY = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, null_safe: bool = False) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` on ``key``; ``groups`` has one row per key and the group's rows in ``size``.

    Groups of at least a thousandth of all rows, fewer than ``HEAVY`` by counting, are answered by a broadcast and so
    never gather their rows; the others meet by a shuffle. ``groups`` is read several times: store it first.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    own = groups.withColumnRenamed(key, "__group")
    same: Column = F.col(key).eqNullSafe(F.col("__group")) if null_safe else F.col(key) == F.col("__group")
    limit = max(2, -(-total // HEAVY))
    heavy = own.filter(F.col(size) >= limit)
    by_broadcast = rows.join(F.broadcast(heavy), same)
    rest = rows.join(F.broadcast(heavy.select("__group")), same, "left_anti").join(own.filter(F.col(size) < limit), same)
    return by_broadcast.unionByName(rest).drop("__group")
