"""What several corpus operators share: bounded Arrow batches, settled tables, connected groups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.runtime import shared_root

# Arrow batches between the JVM and Python end at the first of these.
BATCH_ROWS = 512
BATCH_BYTES = 8 * 1024 * 1024

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small, since one document may hold megabytes.

    These are session settings; they change the size of batches, never a result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/alertloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, LOWER)


def _star(pairs: DataFrame) -> DataFrame:
    """One large-star and one small-star step; pairs (u, v) with u > v, no repeats."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected groups of an edge table: (node, root), the root being the least node of its group.

    Alternates large-star and small-star steps until the pairs stand still, which takes
    about log2(nodes) rounds. Each round is two joins and two aggregates over pairs, so a
    node with many neighbours is never gathered, and each round is settled, so a lost
    executor costs one round. Only nodes that have an edge to another node are returned.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs, before = settled(pairs, "pairs"), None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before, pairs = state, settled(_star(pairs), "pairs")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
