"""Session helpers: shared scratch space, lineage cuts and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only below both of these measured sizes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024


def shared_root(spark: SparkSession) -> str:
    """The folder that every executor can reach, as the session names it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="alertloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return f"{shared_root(spark)}/alertloom/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Cut lineage by writing the rows to the shared folder and reading them back.

    The files outlive executors, so a lost executor costs a re-read and not a
    recomputation, and sampling decisions taken from the rows stay valid.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a table out to all cores when it has fewer files than cores.

    A file written as one row group is one task however large the cluster is. A
    table in many files is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if len(df.inputFiles()) < cores else df


def measured_size(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of the cell texts), computed by one distributed aggregate."""
    width = F.lit(0).cast("long")
    for name in df.columns:
        width = width + F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(8)).cast("long")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    n, b = measured_size(df)
    return n <= rows and b <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the measured size allows it.

    Beyond the bound the frame is returned as it is: the join then shuffles and
    adaptive execution splits the skewed partitions of the larger side.
    """
    return F.broadcast(df) if is_small(df, rows, size) else df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Stop early when nothing was loaded."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def existing_paths(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """Split paths into (present, missing), asking the file system that owns each path."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    present, missing = [], []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        (present if p.getFileSystem(conf).exists(p) else missing).append(path)
    return present, missing


def files_in(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Plain files directly inside ``folder`` that match ``pattern``, sorted by name."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/" + pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(s.getPath().toString() for s in (found or []) if s.isFile())
