"""Numbers and running totals over a whole table without gathering it, or one of its keys, in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from alertloom.runtime import broadcast_if_small, settle

#: Consecutive rows of a partition that one window holds.
BLOCK = 1 << 16
IN_TASK = (1 << 33) - 1


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``_part`` and ``_at``, two numbers that follow the order of ``keys``.

    Partitions are ranges of the keys with about equally many rows, as many as the session
    shuffles to; a common leading key is cut by the keys after it. What is equal in
    all keys stays together.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The place in the task is part of what is written, so reading it back in other pieces changes nothing.
    placed = settle(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    return placed.withColumn("_part", F.shiftright("_at", 33))


def number_rows(df: DataFrame, order: list[str], start: int, name: str) -> DataFrame:
    """Add ``name``: start, start + 1, … in the order of the ``order`` columns.

    Rows are range-partitioned and keep their place in the partition; the rows of all
    partitions before are added from one count for each partition. The number of
    partitions follows the session and the table, and nothing else is bounded.
    """
    placed = ordered(df, order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each partition.
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = placed.join(F.broadcast(before), "_part")
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit(IN_TASK)) + F.lit(start)
    return joined.withColumn(name, number.cast("long")).drop("_part", "_at", "_before")


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str]) -> DataFrame:
    """Add columns ``name: value``: the sum of ``value`` over all rows up to this one in the order of the ``order`` columns.

    Two levels: a window within each block of ``BLOCK`` consecutive rows of a partition, and
    the totals of the blocks before.
    """
    placed = ordered(df, order).withColumn("_block", F.shiftright(F.col("_at").bitwiseAND(F.lit(IN_TASK)), BLOCK.bit_length() - 1))
    keys = ["_part", "_block"]
    # One row for each block.
    blocks = placed.groupBy(*keys).agg(*[F.sum(value).alias(f"_of_{name}") for name, value in totals.items()])
    before = blocks.select(*keys, *[(F.sum(f"_of_{name}").over(Window.orderBy(*keys)) - F.col(f"_of_{name}")).alias(f"_of_{name}") for name in totals])
    upto = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.withColumns({name: F.sum(value).over(upto) for name, value in totals.items()})
    joined = inside.join(broadcast_if_small(before), keys)
    return joined.withColumns({name: F.col(name) + F.col(f"_of_{name}") for name in totals}).drop(*keys, "_at", *[f"_of_{name}" for name in totals])


def number_texts(df: DataFrame, text: str, start: int, name: str) -> DataFrame:
    """Number the distinct values of a text column, in the order of their digests; equal texts get one number."""
    values = df.select(text).distinct().withColumn("_digest", F.md5(text))
    return df.join(number_rows(values, ["_digest"], start, name).select(text, name), text)
