"""Rule suggestions and mined rules: stores and text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.functions.rule_text import without_identity
from alertloom.operators.dedup import drop_known_rules
from alertloom.runtime import existing_paths, settle
from alertloom.sources.alerts import with_position

# The line before each suggestion, and the head of the mined-rules file.
MARKER = "# Auto-generated for Malicious Packet"
MINED_HEAD = (
    "# AI-Mined Snort Rules",
    "# Generated from {source} analysis",
    "# These rules use $HOME_NET and $EXTERNAL_NET variables.",
)

STORE = "rule_key string, rule string, bucket int"
FILTERS = "segment int, bits binary, bucket int"
#: Folders of a store, and parts of a folder's Bloom filter. A part is one bitmap of 32,768 bits; only parts with
#: a key are written, and at ten bits a key all of them tell seven million keys apart with one false alarm in a hundred.
BUCKETS, SEGMENTS = 32, 64
BITS = 32_768
PROBES = 6


def _placed(df: DataFrame) -> DataFrame:
    """Rows with the folder, the part of its filter and the places in that part that belong to their rule_key."""
    place = lambda k: F.pmod(F.xxhash64("rule_key", F.lit(k)), F.lit(BITS))
    return df.withColumns({
        "bucket": F.pmod(F.xxhash64("rule_key"), F.lit(BUCKETS)).cast("int"), "segment": F.pmod(F.xxhash64("rule_key", F.lit(-1)), F.lit(SEGMENTS)).cast("int"),
        "_places": F.array(*[place(k) for k in range(PROBES)]),
    })


def _filters_of(store: str) -> str:
    # Spark's scans pass over names that begin so.
    return f"{store.rstrip('/')}/_filters"


def _numbers(df: DataFrame, column: str) -> list[int]:
    """The folders that occur, ``BUCKETS`` at most."""
    return sorted(r[0] for r in df.select(column).distinct().collect())


def stored_rules(spark: SparkSession, store: str) -> DataFrame:
    """(rule_key, rule) of a store, which may hold nothing yet."""
    if not existing_paths(spark, [store])[0]:
        return spark.createDataFrame([], "rule_key string, rule string")
    return spark.read.schema(STORE).parquet(store).select("rule_key", "rule")


def new_suggestions(keyed: DataFrame, store: str) -> DataFrame:
    """The rows (rule_key, …) whose rule the store does not hold.

    Bloom filters of the rows' folders say which rows cannot be stored; only folders in
    which a row may be are read, and there an anti-join on the whole key decides. A
    batch of new rules reads filters and no rule.
    """
    spark = keyed.sparkSession
    if not existing_paths(spark, [store])[0]:
        return keyed
    placed = settle(_placed(keyed), "suggested")
    listed = existing_paths(spark, [_filters_of(store)])[0]
    if listed:
        parts = spark.read.schema(FILTERS).parquet(listed[0]).where(F.col("bucket").isin(_numbers(placed, "bucket")))
        parts = parts.groupBy("bucket", "segment").agg(F.bitmap_or_agg("bits").alias("bits"))
        byte = lambda p: F.conv(F.hex(F.substring("bits", F.shiftright(p, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = lambda p: F.call_function("shiftright", byte(p), p.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1
        placed = settle(placed.join(parts, ["bucket", "segment"], "left").withColumn("_maybe", F.col("bits").isNotNull() & F.forall("_places", bit)).drop("bits"), "suggested")
    else:
        placed = placed.withColumn("_maybe", F.lit(True))
    maybe = placed.where("_maybe")
    folders = _numbers(maybe, "bucket")
    fresh = placed.where("NOT _maybe")
    if folders:
        stored = spark.read.schema(STORE).parquet(store).where(F.col("bucket").isin(folders))
        fresh = fresh.unionByName(drop_known_rules(maybe, stored))
    return fresh.select(*keyed.columns)


def write_suggestions(df: DataFrame, store: str) -> None:
    """Append new rules to the suggestion store, which is keyed by the rule without its number.

    Filters are written before rules, so a write that ends half way leaves filters that
    say too much, which costs a read, and never too little. One writer at a time.
    """
    keyed = df.select(without_identity(F.col("rule")).alias("rule_key"), "rule").groupBy("rule_key").agg(F.min("rule").alias("rule"))
    fresh = settle(_placed(new_suggestions(keyed, store)), "fresh")
    bits = fresh.select("bucket", "segment", F.explode("_places").alias("_place")).groupBy("bucket", "segment").agg(F.bitmap_construct_agg("_place").alias("bits"))
    bits.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(_filters_of(store))
    fresh.select("rule_key", "rule", "bucket").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(store)


def export_suggestions(df: DataFrame, path: str) -> None:
    """Text form: marker, rule and a blank line for each suggestion."""
    df.select(F.concat_ws("\n", F.lit(MARKER), "rule", F.lit("")).alias("value")).write.mode("append").text(path)


def read_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """(desc, body, file, block, seq) of each block; blocks without body drop out.

    The marker is the record separator of the scan, so a file of any size is
    split over tasks. The record before the first marker of a file is no block.
    """
    blocks = with_position(
        spark.read.option("lineSep", MARKER).text(path),
        F.trim("value", F.lit(" \t\n\r\x0b\x0c")).alias("body"),
    )
    records = settle(blocks, "blocks")
    heads = records.where("block = 0").groupBy("file").agg(F.min("seq").alias("seq"))
    return records.join(heads, ["file", "seq"], "left_anti").where("body <> ''").select(
        F.lit(MARKER).alias("desc"), "body", "file", "block", "seq"
    )


def write_mined_rules(df: DataFrame, path: str, source: str) -> bool:
    """Ordered text export of ``(sid, message, rule)`` with its three head lines.

    Rows are range-partitioned by number: part files follow each other, and the
    head stands first in the first. What the path holds is replaced; nothing is written
    for an empty table.
    """
    if df.isEmpty():
        return False
    spark = df.sparkSession
    head = "\n".join(MINED_HEAD).format(source=source) + "\n"
    body = df.select(
        F.col("sid").cast("long").alias("sid"),
        F.concat(F.lit("# Based on log: "), "message", F.lit("\n"), "rule", F.lit("\n")).alias("value"),
    )
    lines = spark.createDataFrame([(-1, head)], "sid long, value string").unionByName(body)
    lines.repartitionByRange("sid").sortWithinPartitions("sid").select("value").write.mode("overwrite").text(path)
    return True
