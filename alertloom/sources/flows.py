"""Labelled flow files: headed CSVs of any header, and the headerless 49-column set."""

from __future__ import annotations

import csv
import logging

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from alertloom.functions.features import header_roles, missing_to_null
from alertloom.runtime import files_in
from alertloom.sources.alerts import LINES, _plain, with_position

log = logging.getLogger(__name__)

# The names that may head the two columns, in order of preference.
PORT_NAMES = ["Destination Port", "Dst Port", "dest_port", "dsport", "dp", "Destination_Port"]
LABEL_NAMES = ["Label", "label", "class", "attack_cat"]

# Fixed value: the columns of the headerless set.
HEADERLESS_COLUMNS = (
    "srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes", "sttl", "dttl", "sloss",
    "dloss", "service", "Sload", "Dload", "Spkts", "Dpkts", "swin", "dwin", "stcpb", "dtcpb", "smeansz",
    "dmeansz", "trans_depth", "res_bdy_len", "Sjit", "Djit", "Stime", "Ltime", "Sintpkt", "Dintpkt", "tcprtt",
    "synack", "ackdat", "is_sm_ips_ports", "ct_state_ttl", "ct_flw_http_mthd", "is_ftp_login", "ct_ftp_cmd",
    "ct_srv_src", "ct_srv_dst", "ct_dst_ltm", "ct_src_ ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm",
    "ct_dst_src_ltm", "attack_cat", "Label",
)

FLOWS = "dataset string, headerless boolean, dest_port string, raw_label string, attack_cat string, file string, block long, seq long"


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _csv(spark: SparkSession, files: list[str], columns: int, header: bool) -> DataFrame:
    reader = spark.read.schema(_text_schema([f"c{i}" for i in range(columns)]))
    return reader.options(header=header, encoding="ISO-8859-1", escape='"', enforceSchema=True).csv(files)


def _header(line: str | None) -> tuple[str, ...]:
    """Column names of a first line; names that repeat get a number, so each stands once."""
    if line is None or not line.strip():
        return ()
    names: list[str] = []
    for name in next(csv.reader([line])):
        copies = sum(1 for n in names if n.split("\0")[0] == name)
        names.append(f"{name}\0{copies}" if copies else name)
    return tuple(n.replace("\0", ".") for n in names)


def _first_lines(spark: SparkSession, files: list[str]) -> dict[str, tuple]:
    """(first line, lines, whole) of each file that can be read, from one pass however many files there are.

    A file that cannot be read, or not to its end, costs itself and no other: the scan
    passes over it, and what was read is held against the file's size. A line feed, and
    perhaps a carriage return, belongs to each line.
    """
    rows = with_position(spark.read.option("ignoreCorruptFiles", True).schema(LINES).text(files), "value", F.col("_metadata.file_size").alias("size"))
    by_file = rows.groupBy("file").agg(
        F.min_by("value", F.struct("block", "seq")).alias("first"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("bytes"), F.max("size").alias("size")
    )
    # One row a file, like the listing itself.
    return {_plain(r["file"]): (r["first"], r["n"], r["bytes"] + 2 * r["n"] >= r["size"]) for r in by_file.collect()}


def survey_flow_files(spark: SparkSession, folder: str) -> tuple[dict[tuple[str, ...], list[str]], DataFrame]:
    """(usable files by header, report) of the headed CSVs directly in a folder.

    The report is (file, rows, reason): every file, its lines after the header, and why it
    is left out, null where it is not.
    """
    files = files_in(spark, folder, "*.csv")
    seen = _first_lines(spark, files) if files else {}
    usable: dict[tuple[str, ...], list[str]] = {}
    report = []
    for path in files:
        first, n, whole = seen.get(_plain(path), (None, 0, None))
        header = _header(first)
        if whole is None:
            reason = "empty or unreadable"
        elif not whole:
            reason = "not readable to its end"
        elif not header:
            reason = "no header"
        else:
            reason = header_roles(list(header), {"port": PORT_NAMES, "label": LABEL_NAMES})[1]
        if reason:
            log.warning("skipping %s: %s", path, reason)
        else:
            usable.setdefault(header, []).append(path)
        report.append((path, max(n - 1, 0), reason or None))
    return usable, spark.createDataFrame(report, "file string, rows long, reason string")


def read_flow_csv(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """Port and label of every headed CSV directly in the folder.

    Headers differ per file, so files are grouped by header and each distinct
    header is one scan of two columns. Files that lack either column, that are empty or
    that cannot be read are skipped with a note; ``survey_flow_files`` lists them.
    """
    parts = []
    for header, members in survey_flow_files(spark, folder)[0].items():
        at, _ = header_roles(list(header), {"port": PORT_NAMES, "label": LABEL_NAMES})
        cells = _csv(spark, members, len(header), header=True)
        pick = lambda role: missing_to_null(F.col(f"c{at[role]}"))
        parts.append(
            with_position(
                cells,
                F.lit(dataset).alias("dataset"),
                F.lit(False).alias("headerless"),
                pick("port").alias("dest_port"),
                pick("label").alias("raw_label"),
                F.lit(None).cast("string").alias("attack_cat"),
            )
        )
    if not parts:
        return spark.createDataFrame([], FLOWS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_headerless_flows(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """Port, category and label of the headerless files; the scan reads those three columns."""
    files = files_in(spark, folder, "*.csv")
    if not files:
        return spark.createDataFrame([], FLOWS)
    cells = _csv(spark, files, len(HEADERLESS_COLUMNS), header=False)
    pick = lambda name: missing_to_null(F.col(f"c{HEADERLESS_COLUMNS.index(name)}"))
    return with_position(
        cells,
        F.lit(dataset).alias("dataset"),
        F.lit(True).alias("headerless"),
        pick("dsport").alias("dest_port"),
        pick("Label").alias("raw_label"),
        pick("attack_cat").alias("attack_cat"),
    )
