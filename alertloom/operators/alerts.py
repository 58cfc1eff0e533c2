"""Alert lines to alert tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.functions import parsing
from alertloom.runtime import existing_paths
from alertloom.sources.alerts import read_alert_lines


def parse_alerts(
    lines: DataFrame, line: str = "value", keep: tuple[str, ...] = (), formats: tuple[str, ...] = parsing.FORMATS,
    observation: str | None = None,
) -> DataFrame:
    """The eight fields of every line that is an alert; other lines drop out.

    ``formats`` are tried in order. The match is exploded, not filtered, so
    Catalyst cannot evaluate it a second time in a pushed-down predicate. In a stream
    each batch's progress shows, under the name of ``observation``, the numbers of lines,
    alerts and rejects from the same pass; :func:`log_counts` gives them for files.
    """
    found = parsing.matching_fields(F.col(line), formats)
    if observation is None:
        hits = lines.select(*keep, F.explode(found).alias("_parts"))
    else:
        hit = F.coalesce(F.size("_found") > 0, F.lit(False))
        seen = lines.select(*keep, found.alias("_found")).observe(observation, F.count(F.lit(1)).alias("lines"), F.count_if(hit).alias("alerts"), F.count_if(~hit).alias("rejects"))
        hits = seen.select(*keep, F.explode("_found").alias("_parts"))
    return hits.select(*keep, *parsing.named_fields(F.col("_parts")))


def rejected_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """The complement of :func:`parse_alerts`."""
    return lines.where(~F.coalesce(parsing.is_alert_line(F.col(line)), F.lit(False)))


def typed_alerts(alerts: DataFrame, year: int, zone: str = "+00:00", keep: tuple[str, ...] = ()) -> DataFrame:
    """Alerts with an instant, numeric ports and the parts of the signature."""
    port = lambda name: F.col(name).try_cast("long").alias(name)
    return alerts.select(
        *keep,
        parsing.event_time(F.col("timestamp"), year, zone).alias("event_ts"),
        *parsing.split_signature(F.col("signature_id")),
        "message", "protocol", "source_ip", port("source_port"), "dest_ip", port("dest_port"),
    )


def file_counts(df: DataFrame, file: str = "file") -> DataFrame:
    """Rows per file."""
    return df.groupBy(file).agg(F.count(F.lit(1)).alias("row_count"))


def log_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every log that was asked for, in one pass over those that exist: path, found, lines, alerts, rejects.

    A log without alerts, or without lines, has zeros; a missing one is not found and has zeros too.
    """
    present, _ = existing_paths(spark, paths)
    index = {p: k for k, p in enumerate(present)}
    asked = spark.createDataFrame([(k, p, index.get(p)) for k, p in enumerate(paths)], "_order int, path string, file_index int")
    lines = read_alert_lines(spark, paths).select("file_index", F.coalesce(parsing.is_alert_line(F.col("value")), F.lit(False)).alias("hit"))
    counts = lines.groupBy("file_index").agg(F.count(F.lit(1)).alias("lines"), F.count_if("hit").alias("alerts"))
    joined = asked.join(F.broadcast(counts), "file_index", "left")
    lines, alerts = (F.coalesce(c, F.lit(0)) for c in ("lines", "alerts"))
    return joined.select("path", F.col("file_index").isNotNull().alias("found"), lines.alias("lines"), alerts.alias("alerts"), (lines - alerts).alias("rejects"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Typed alerts counted per rule, protocol and port, with their sources and time span.

    Counts and instants have a fixed width, so both aggregation steps hash.
    """
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return alerts.groupBy("gid", "sid", "rev", "message", "protocol", "dest_port").agg(
        F.count(F.lit(1)).alias("alerts"),
        F.countDistinct("source_ip").alias("sources"),
        iso(F.min("event_ts")).alias("first_seen"),
        iso(F.max("event_ts")).alias("last_seen"),
    )
