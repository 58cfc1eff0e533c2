"""Distinct attacks and rules that are already known."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def distinct_attacks(alerts: DataFrame, order: str = "pos", carry: tuple[str, ...] = ()) -> DataFrame:
    """First alert of each (message, dest_port), nulls equal.

    A plain minimum of the position is combined before the shuffle, so a message
    that makes up most of the rows costs one row per task.
    """
    aggregates = [F.min(order).alias(order)]
    if carry:
        aggregates.append(F.min_by(F.struct(*carry), F.col(order)).alias("_first"))
    out = alerts.groupBy("message", "dest_port").agg(*aggregates)
    return out.select("message", "dest_port", order, *[F.col(f"_first.{c}").alias(c) for c in carry])


def drop_known_rules(new: DataFrame, existing: DataFrame, key: str = "rule_key") -> DataFrame:
    """Rules whose text without number and revision is not stored yet."""
    return new.join(existing.select(key), key, "left_anti")
