"""A corpus pipeline: quality, near-duplicates, benchmark leaks, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. What a
stage returns is written to the shared folder and read again by the next one. All stages
but the last return the columns of documents. Stages read other tables (labels, benchmark)
beside the documents in ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.llm.common import settled
from alertloom.llm.decontaminate import decontaminate
from alertloom.llm.mixing import domain_posteriors, fit_domains, fit_rates, mix
from alertloom.llm.quality import fit_quality, keep_quality
from alertloom.llm.queries import END_ID, domain_labels, table, tokenizer_file
from alertloom.llm.simhash_dedup import near_distinct
from alertloom.llm.token_output import read_token_ids, write_token_ids
from alertloom.runtime import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels of ``docs`` outside the held-out third."""
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose SimHash fingerprints of three-word shingles link at three or fewer differing bits."""
    return near_distinct(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages are raised to tempered shares by repeating documents; the largest keeps its size."""
    model = fit_domains(docs, domain_labels(docs, table(spark, sf_dir, "labels")), "lang")
    return mix(docs, fit_rates(settled(domain_posteriors(docs, model), "posteriors"), model))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written, and read back: doc_id, start, n_tokens, ids_crc32."""
    path = scratch_path(spark, "token-ids")
    write_token_ids(docs, path, tokenizer_file(), END_ID)
    return read_token_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token ids", token_stage),
]

#: Training, graph components and tokenising have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
