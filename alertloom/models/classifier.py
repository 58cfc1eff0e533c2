"""The supervised half of the detector."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, functions as F

from alertloom.models.vectorise import MAX_TERMS, fit_vectoriser
from alertloom.runtime import settle

TREES = 100
#: Bytes that the forest holds for the rows of one task.
TASK_BYTES = 256 << 20
MAX_DEPTH = 30  # the deepest that Spark grows; the reference sets no limit


def _dealt(rows: DataFrame, trees: int) -> DataFrame:
    """The rows (features, label, _at) over as many tasks as the forest needs to hold at most ``TASK_BYTES`` for each.

    For each row it keeps four bytes a feature and four a tree. Files of vectors are far smaller,
    so their splits do not bound that; a table whose splits do is left as it is.
    """
    size, first = rows.count(), rows.first()
    parts = -(-size * (64 + 4 * (trees + first["features"].size)) // TASK_BYTES) if first else 0
    if parts <= rows.rdd.getNumPartitions():
        return rows.drop("_at")
    # The place is written with the row, so the same rows come in the same order to the same task.
    return rows.repartition(parts, "_at").sortWithinPartitions("_at").drop("_at")


def train_classifier(
    train: DataFrame, trees: int = TREES, max_depth: int = MAX_DEPTH, seed: int = 42, terms: int = MAX_TERMS, text: bool = True
) -> PipelineModel:
    """Fit the vectoriser and a random forest on feature rows with a ``label``."""
    vectoriser = fit_vectoriser(train, terms, text)
    # Growing the forest passes over its rows several times; the texts are tokenised for it once.
    rows = settle(vectoriser.transform(train).select("features", F.col("label").cast("double").alias("label"), F.monotonically_increasing_id().alias("_at")), "vectors")
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=max_depth, seed=seed, featuresCol="features", labelCol="label", maxMemoryInMB=1024,
        cacheNodeIds=True, checkpointInterval=10, featureSubsetStrategy="sqrt",
    ).fit(_dealt(rows, trees))
    return PipelineModel(vectoriser.stages + [forest])


def classify(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The rows with the predicted class ``rf`` (0 or 1)."""
    return model.transform(df).select(*df.columns, F.col("prediction").cast("int").alias("rf"))
