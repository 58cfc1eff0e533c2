"""Both models together: the alert decision, scoring of packets, saving and loading."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from alertloom.functions.features import engineer_features
from alertloom.functions.rule_text import packet_prompt
from alertloom.models import anomaly
from alertloom.models.classifier import classify
from alertloom.models.vectorise import vectorised
from alertloom.operators.filters import inspectable


@dataclass
class Detector:
    """A classifier and, where benign rows existed, an anomaly detector with its own vectoriser."""

    classifier: PipelineModel
    vectoriser: PipelineModel | None = None
    nodes: DataFrame | None = None


def hybrid_alert(rf: Column, iforest: Column, mode: str = "either") -> Column:
    """``either``: one of the models raises the alert; ``classifier``: the first alone decides."""
    if mode == "classifier":
        return rf == 1
    if mode != "either":
        raise ValueError(f"unknown mode {mode!r}")
    return (rf == 1) | (F.coalesce(iforest, F.lit(1)) == -1)


def score(detector: Detector, rows: DataFrame, mode: str = "either") -> DataFrame:
    """Feature rows with ``rf``, ``iforest`` and ``is_alert``."""
    out = classify(detector.classifier, rows)
    if mode != "classifier" and detector.nodes is not None:
        out = anomaly.score_anomaly(vectorised(detector.vectoriser, out), detector.nodes).drop("features", "anomaly_score")
    else:
        out = out.withColumn("iforest", F.lit(None).cast("int"))
    return out.withColumn("is_alert", hybrid_alert(F.col("rf"), F.col("iforest"), mode))


def score_packets(detector: Detector, packets: DataFrame, mode: str = "either") -> DataFrame:
    """Packets that raise an alert, with the prompt that asks for a rule. Batch or stream."""
    kept = inspectable(packets)
    rows = engineer_features(kept, port="dst_port", keep=("packet_id", "src_ip", "protocol"))
    scored = score(detector, rows, mode).where("is_alert")
    prompt = packet_prompt(F.col("protocol"), F.col("dest_port"), F.col("message"))
    return scored.select("packet_id", "src_ip", "protocol", "dest_port", "rf", "iforest", prompt.alias("prompt"))


def save_models(detector: Detector, path: str) -> None:
    detector.classifier.write().overwrite().save(f"{path}/classifier")
    if detector.nodes is not None:
        detector.vectoriser.write().overwrite().save(f"{path}/vectoriser")
        detector.nodes.write.mode("overwrite").parquet(f"{path}/forest")


def load_models(spark: SparkSession, path: str, with_anomaly: bool = True) -> Detector:
    classifier = PipelineModel.load(f"{path}/classifier")
    if not with_anomaly:
        return Detector(classifier)
    nodes = spark.read.schema(anomaly.NODES).parquet(f"{path}/forest")
    return Detector(classifier, PipelineModel.load(f"{path}/vectoriser"), nodes)
