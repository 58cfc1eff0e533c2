"""Alert logs and alert tables: reading and writing."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from alertloom.functions import parsing
from alertloom.runtime import broadcast_if_small, existing_paths

log = logging.getLogger(__name__)

SCHEME = r"\A(\w+):/+"
LINES = T.StructType([T.StructField("value", T.StringType())])
ALERTS = T.StructType([T.StructField(name, T.StringType()) for name in parsing.FIELDS])


def with_position(df: DataFrame, *columns) -> DataFrame:
    """Add where each row came from: file, block start, and order inside the task.

    (file, block, seq) orders the rows of a file as they stand in it, without a
    shuffle: blocks are ordered by their start, and a task numbers its rows upwards.
    """
    return df.select(
        *(columns or ("*",)),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


def with_order(df: DataFrame) -> DataFrame:
    """Replace (file, block, seq) by one number ``pos`` that orders all rows of a scan.

    Files follow each other by name. The number has a fixed width, so a minimum of
    it is combined by hashing before any shuffle.
    """
    files = sorted({_plain(f) for f in df.inputFiles()})
    index = df.sparkSession.createDataFrame(list(enumerate(files)), "_index long, _file string")
    named = df.withColumn("_file", F.regexp_replace("file", SCHEME, "$1:/"))
    part = lambda c, power: c.cast("decimal(38,0)") * F.lit(str(10**power)).cast("decimal(38,0)")
    in_task = F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))
    pos = part(F.col("_index"), 24) + part(F.col("block"), 10) + in_task.cast("decimal(38,0)")
    ordered = named.join(broadcast_if_small(index), "_file").withColumn("pos", pos.cast("decimal(38,0)"))
    return ordered.drop("_file", "_index", "file", "block", "seq")


def read_alert_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of the logs that exist; ``file_index`` keeps the order of the list.

    Missing paths are skipped with a note. Undecodable bytes become U+FFFD.
    """
    present, missing = existing_paths(spark, paths)
    for path in missing:
        log.warning("skipping missing log %s", path)
    if not present:
        empty = "value string, file string, block long, seq long, file_index int"
        return spark.createDataFrame([], empty)
    lines = with_position(spark.read.schema(LINES).text(present), F.make_valid_utf8("value").alias("value"))
    origin = F.regexp_replace("file", SCHEME, "$1:/")
    order = F.lit(len(present))
    for i, path in reversed(list(enumerate(present))):
        root = _qualified(spark, path)
        order = F.when((origin == root) | F.startswith(origin, F.lit(root + "/")), F.lit(i)).otherwise(order)
    return lines.withColumn("file_index", order)


def _qualified(spark: SparkSession, path: str) -> str:
    """Full path with its scheme, in the spelling of the scan's file paths."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return _plain(p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString())


def _plain(path: str) -> str:
    """One spelling for ``file:/x`` and ``file:///x``."""
    return re.sub(SCHEME, r"\1:/", path)


# Cells keep their outer spaces, and quotes inside a cell are doubled.
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_alerts(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> bool:
    """Write the eight fields, in place of what the path holds; an empty table writes nothing. Says whether it wrote."""
    table = df.select(*parsing.FIELDS)
    if table.isEmpty():
        log.warning("no alerts to save")
        return False
    if fmt == "csv":
        table.write.mode(mode).options(**CSV_OPTIONS).csv(path)
    else:
        table.write.mode(mode).format(fmt).save(path)
    return True


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    # inferSchema stays off: every cell is read as text, so ports and labels keep their spelling.
    return spark.read.options(**CSV_OPTIONS).csv(path)


def read_alert_table(spark: SparkSession, path: str, default_label: int = 1) -> DataFrame:
    """Alerts for training: label 1 for ALL rows; a missing file is an empty table."""
    if not existing_paths(spark, [path])[0]:
        log.warning("%s not found", path)
        return spark.createDataFrame([], ALERTS).withColumn("label", F.lit(default_label))
    return _read_csv(spark, path).withColumn("label", F.lit(default_label))


def read_alerts_for_mining(spark: SparkSession, path: str) -> DataFrame:
    """Alerts for mining: column names normalised, label 1 only where none is given, ``pos`` in file order."""
    raw = _read_csv(spark, path)
    table = with_order(with_position(raw, *[F.col(f"`{c}`").alias(c.lower().strip()) for c in raw.columns]))
    if "message" not in table.columns:
        raise ValueError("the alert table has no message column")
    return table if "label" in table.columns else table.withColumn("label", F.lit(1))
