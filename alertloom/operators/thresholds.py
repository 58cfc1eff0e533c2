"""Per-source time thresholds on matches and alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from alertloom.operators.numbering import running_totals

MICROS = 1_000_000


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _instants(df: DataFrame, group: list[str], value: Column | None = None) -> DataFrame:
    """(group, _t, _n): rows per group and instant, or the sum of ``value``; combined before the shuffle."""
    return df.groupBy(*group, "_t").agg((F.count(F.lit(1)) if value is None else F.sum(value)).cast("long").alias("_n"))


def _in_reach(instants: DataFrame, group: list[str], micros: Column) -> DataFrame:
    """(group, _t, _n): what the instants of (t - micros, t] hold together, for each instant t of a group.

    Range counting by two lookups in one running total. Each instant is put in twice, at t
    with its rows and at t - micros with none, and the total over all groups' instants, which are
    sorted by group and time, is taken at both places; rows of earlier groups cancel out. So a
    source with any number of rows or instants, in one second or many, is spread over
    partitions like all other rows.
    """
    at = F.struct(F.col("_t").alias("_when"), F.lit(0).alias("_kind"), F.col("_n").alias("_weight"))
    reach = F.struct((F.col("_t") - micros).alias("_when"), F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_weight"))
    points = instants.withColumn("_point", F.explode(F.array(at, reach))).select(*group, "_t", "_point.*")
    # What lies at t - micros itself is out of reach, so its rows come before the lookup.
    totals = running_totals(points, [*group, "_when", "_kind", "_t"], {"_total": "_weight"})
    upto = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_total")))
    return totals.groupBy(*group, "_t").agg((upto(0) - upto(1)).alias("_n"))


def _at_instants(df: DataFrame, instants: DataFrame, group: list[str], how: str) -> DataFrame:
    """Join rows with facts about their group and instant, nulls equal."""
    keys = [*group, "_t"]
    other = instants.withColumnsRenamed({c: f"_i{c}" for c in keys})
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_i{c}")) for c in keys])
    return df.join(other, on, how)


def detection_filter(matches: DataFrame, track: str, count: int, seconds: int, rule: str = "sid", ts: str = "ts") -> DataFrame:
    """Matches whose source has at least ``count`` matches of the rule in (t - seconds, t].

    Equal timestamps count for each other. Rows are counted by instant first, so no
    source, however many rows it sends and in however short a time, is one task's work.
    """
    group = [rule, track]
    timed = matches.withColumn("_t", _micros(ts))
    reached = _in_reach(_instants(timed, group), group, F.lit(seconds * MICROS)).where(F.col("_n") >= count).select(*group, "_t")
    return _at_instants(timed, reached, group, "left_semi").select(*matches.columns)


def detection_filters(matches: DataFrame, src: str = "src_ip", dst: str = "dst_ip", ts: str = "ts") -> DataFrame:
    """Apply each matched rule's own threshold; rules without one pass unchanged.

    Count and seconds stay columns, so the plan is one pass however many thresholds the rules have.
    """
    bounded = matches.where(F.col("df_count").isNotNull()).withColumns({"_t": _micros(ts), "_who": F.when(F.col("df_track") == "by_dst", F.col(dst)).otherwise(F.col(src))})
    group = ["sid", "df_track", "_who", "df_count", "df_seconds"]
    reached = _in_reach(_instants(bounded, group), group, F.col("df_seconds").cast("long") * MICROS)
    passed = _at_instants(bounded, reached.where(F.col("_n") >= F.col("df_count")).drop("_n"), group, "left_semi")
    return matches.where(F.col("df_count").isNull()).unionByName(passed.select(*matches.columns))


def _of_rule(gid: int, sid: int) -> Column:
    return F.coalesce((F.col("gid") == gid) & (F.col("sid") == sid), F.lit(False))


def event_filter(
    alerts: DataFrame, gid: int, sid: int, kind: str, track: str, count: int, seconds: int,
    order: tuple[str, ...] = ("event_ts",), ts: str = "event_ts",
) -> DataFrame:
    """Thin out the alerts of one rule per tracked address and fixed interval.

    ``limit`` keeps the first ``count`` of an interval, ``both`` keeps one, the
    one that completes ``count``. Other rules pass unchanged. Ranks above
    ``count`` are cut before the shuffle by the planner.
    """
    if kind not in ("limit", "both"):
        raise ValueError(f"unknown event filter {kind!r}")
    t = _micros(ts)
    interval = t - F.pmod(t, F.lit(seconds * MICROS))
    per = Window.partitionBy(track, "_interval").orderBy(*order)
    ranked = alerts.where(_of_rule(gid, sid)).withColumn("_interval", interval)
    ranked = ranked.withColumn("_rank", F.row_number().over(per)).where(F.col("_rank") <= count)
    if kind == "both":
        ranked = ranked.where(F.col("_rank") == count)
    return alerts.where(~_of_rule(gid, sid)).unionByName(ranked.select(*alerts.columns))


def rate_filter(
    alerts: DataFrame, gid: int, sid: int, track: str, count: int, seconds: int, new_action: str, timeout: int,
    ts: str = "event_ts", action: str = "action",
) -> DataFrame:
    """Switch the action of one rule while its rate is exceeded.

    The rate is exceeded at an alert that is at least the ``count``-th in
    (t - seconds, t]; the new action holds for alerts in [t, t + timeout). Both are range
    counts over instants: of alerts, then of the instants at which the rate is exceeded.
    """
    timed = alerts.where(_of_rule(gid, sid)).withColumn("_t", _micros(ts))
    group = [track]
    reached = _in_reach(_instants(timed, group), group, F.lit(seconds * MICROS))
    crossed = reached.withColumn("_n", (F.col("_n") >= count).cast("long"))
    held = _in_reach(crossed, group, F.lit(timeout * MICROS)).where("_n > 0").select(*group, "_t", F.lit(True).alias("_held"))
    switched = _at_instants(timed, held, group, "left").withColumn(action, F.when(F.col("_held"), F.lit(new_action)).otherwise(F.col(action)))
    return alerts.where(~_of_rule(gid, sid)).unionByName(switched.select(*alerts.columns))
