"""Content hashes and seeded, engine-independent orderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int | str, *parts: Column) -> Column:
    """A reproducible pseudo-random sort key: hex md5 of seed and row key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def key_bucket(key: Column, hex_digits: int = 3) -> Column:
    """Leading hex digits as a number: evenly filled and in the same order as the key itself."""
    return F.conv(F.substring(key, 1, hex_digits), 16, 10).cast("int")


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of a key."""
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def content_hash(content: Column, path: Column, head_bytes: int | None = None, algorithm: str = "sha1") -> Column:
    """Hash of the bytes (or only their head); unreadable content falls back to the hash of the path."""
    body = content if head_bytes is None else F.substring(content, 1, head_bytes)
    def digest(c):
        return F.sha2(c, 256) if algorithm == "sha256" else F.sha1(c)
    return F.coalesce(digest(body), digest(path.cast("binary")))
