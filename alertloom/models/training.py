"""Fitting both models on one labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from alertloom.models.anomaly import train_anomaly
from alertloom.models.classifier import MAX_DEPTH, TREES, classify, train_classifier
from alertloom.models.detector import Detector
from alertloom.models.vectorise import MAX_TERMS, fit_vectoriser, vectorised
from alertloom.operators.filters import benign
from alertloom.operators.reports import classification_report
from alertloom.operators.sampling import cap_rows, stratified_split
from alertloom.runtime import settle


def train_detector(
    rows: DataFrame, keys: tuple[str, ...], seed: int = 42, trees: int = TREES, max_depth: int = MAX_DEPTH,
    terms: int = MAX_TERMS, text: bool = True, train_cap: int | None = None, benign_cap: int | None = None,
) -> tuple[Detector, DataFrame]:
    """(detector, classification report) of feature rows with ``label``; ``keys`` identify a row.

    The anomaly detector has its own vectoriser, fitted on benign rows only. It is
    left out when there are none. ``train_cap`` limits the rows of both models and
    ``benign_cap`` those of the anomaly detector; by default there is no limit.
    """
    if train_cap is not None:
        rows = cap_rows(rows, train_cap, keys, seed)
    train, test = stratified_split(rows, label="label", keys=keys, seed=seed)
    # Training reads its rows many times, so they are dealt out evenly once. The forest
    # draws its samples by row order, so the order is fixed too.
    train = settle(train.repartition(*keys).sortWithinPartitions(*keys), "train")
    classifier = train_classifier(train, trees, max_depth, seed, terms, text)
    report = classification_report(classify(classifier, test), prediction="rf")
    normal = benign(rows)
    if normal.isEmpty():
        return Detector(classifier), report
    normal = normal if benign_cap is None else cap_rows(normal, benign_cap, keys, seed)
    normal = settle(normal.repartition(*keys), "benign")
    vectoriser = fit_vectoriser(normal, terms, text)
    nodes = settle(train_anomaly(vectorised(vectoriser, normal), keys, seed=seed), "forest")
    return Detector(classifier, vectoriser, nodes), report
