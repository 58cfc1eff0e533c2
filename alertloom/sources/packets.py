"""Decoded packet tables, as a batch or as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PACKETS = (
    "packet_id long, ts timestamp, protocol string, src_ip string, src_port int, dst_ip string, dst_port int, "
    "payload binary, tcp_flags string, itype int, icode int, to_server boolean, established boolean"
)


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKETS).parquet(path)


def stream_packets(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(PACKETS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
