"""A seeded hash that other engines can repeat, used for stable samples."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def digest(seed: int, *keys: Column) -> Column:
    """Hex digest of the seed and the key texts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def row_hash(seed: int, *keys: Column) -> Column:
    """60-bit number, uniform over rows whose keys differ."""
    return F.conv(F.substring(digest(seed, *keys), 1, 15), 16, 10).cast("long")
