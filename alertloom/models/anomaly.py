"""The unsupervised half of the detector: an isolation forest as a table of tree nodes.

Each tree is grown from at most 256 rows in its own task; the forest is a table of
(tree, node, feature, threshold, left, right, size, depth). Scoring walks all rows
of an Arrow batch through the broadcast table at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from alertloom.functions.hashing import row_hash

TREES = 100
SAMPLE = 256
THRESHOLD = 0.5
EULER_GAMMA = 0.5772156649015329
NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"
HASH_RANGE = 1 << 60


def average_path(size: np.ndarray) -> np.ndarray:
    """Mean depth at which a search among ``size`` rows ends."""
    size = np.asarray(size, dtype=float)
    above = np.maximum(size, 3.0) - 1.0
    long = 2.0 * (np.log(above) + EULER_GAMMA) - 2.0 * above / (above + 1.0)
    return np.where(size <= 1, 0.0, np.where(size == 2, 1.0, long))


def tree_samples(df: DataFrame, keys: tuple[str, ...], trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, …): up to ``sample`` rows for each tree, chosen by hashes of the row key.

    A first hash keeps about one and a half times the rows all trees need, so the
    per-tree hashes run on a bounded number of rows whatever the table holds.
    """
    total = df.count()
    key = [F.col(k) for k in keys]
    share = min(1.0, 1.5 * trees * sample / max(total, 1))
    pool = df.where(row_hash(seed, *key) < F.lit(int(share * HASH_RANGE))) if share < 1.0 else df
    keep = min(1.0, (sample + 6 * sample**0.5) / max(total * share, 1.0))
    offered = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn(
        "_h", F.xxhash64("tree", F.lit(seed), *key)
    )
    drawn = offered.where(F.pmod("_h", F.lit(1 << 40)) < F.lit(int(keep * (1 << 40))))
    # About ``sample`` rows reach each tree here, so the rank below is bounded too.
    in_tree = Window.partitionBy("tree").orderBy("_h", *keys)
    return drawn.withColumn("_i", F.row_number().over(in_tree)).where(F.col("_i") <= sample).drop("_h", "_i")


def _sparse(vector: str) -> list[Column]:
    """Positions and values of a vector column that are stored, without widening it."""
    parts = F.unwrap_udt(vector)
    dense = F.sequence(F.lit(0), F.size(parts["values"]) - 1)
    return [F.coalesce(parts["indices"], dense).alias("_at"), parts["values"].alias("_values")]


def _matrix(at: pd.Series, values: pd.Series, slots: np.ndarray, width: int) -> np.ndarray:
    """Rows as a dense block; ``slots`` maps a feature to its column, -1 leaves it out."""
    out = np.zeros((len(at), width))
    if len(at) == 0:
        return out
    lengths = np.fromiter((len(a) for a in at), dtype=np.int64, count=len(at))
    if lengths.sum() == 0:
        return out
    row = np.repeat(np.arange(len(at)), lengths)
    feature = np.concatenate(at.to_numpy()).astype(np.int64)
    value = np.concatenate(values.to_numpy())
    known = feature < len(slots)
    row, feature, value = row[known], feature[known], value[known]
    slot = slots[feature]
    used = slot >= 0
    out[row[used], slot[used]] = value[used]
    return out


def grow_tree(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """Random splits on features that vary, down to single rows or the depth limit."""
    rng = np.random.default_rng([seed, tree])
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []
    pending = [(np.arange(len(x)), 0, -1, 0)]
    while pending:
        rows, depth, parent, side = pending.pop()
        node = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = node
        nodes.append([tree, node, -1, 0.0, -1, -1, len(rows), depth])
        if depth >= limit or len(rows) <= 1:
            continue
        block = x[rows]
        low, high = block.min(axis=0), block.max(axis=0)
        varying = np.flatnonzero(high > low)
        if len(varying) == 0:
            continue
        feature = int(rng.choice(varying))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = block[:, feature] <= threshold
        nodes[node][2], nodes[node][3] = feature, threshold
        pending.append((rows[~goes_left], depth + 1, node, 1))
        pending.append((rows[goes_left], depth + 1, node, 0))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


def train_anomaly(
    vectors: DataFrame, keys: tuple[str, ...], trees: int = TREES, sample: int = SAMPLE, seed: int = 42, features: str = "features"
) -> DataFrame:
    """Node table of a forest grown on the given (benign) rows."""
    rows = tree_samples(vectors.select(*keys, features), keys, trees, sample, seed).select("tree", *keys, *_sparse(features))
    order = list(keys)

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        width = max((int(a.max()) + 1 for a in pdf["_at"] if len(a)), default=1)
        return grow_tree(int(key[0]), _matrix(pdf["_at"], pdf["_values"], np.arange(width), width), seed)

    return rows.groupBy("tree").applyInPandas(grow, NODES)


class Forest:
    """The node table in arrays, padded to one rectangle, ready to score blocks of rows."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"])
        names = nodes["tree"].unique()
        place = pd.Series(np.arange(len(names)), index=names)
        shape = (len(names), int(nodes["node"].max()) + 1)
        at = (place[nodes["tree"]].to_numpy(), nodes["node"].to_numpy())
        used = np.unique(nodes.loc[nodes["feature"] >= 0, "feature"])
        self.slots = np.full(int(used.max()) + 1 if len(used) else 1, -1, dtype=np.int64)
        self.slots[used] = np.arange(len(used))
        self.width = max(len(used), 1)
        self.slot = np.full(shape, -1, dtype=np.int64)
        splits = nodes["feature"].to_numpy()
        self.slot[at] = np.where(splits >= 0, self.slots[np.maximum(splits, 0)], -1)
        self.threshold, self.left, self.right, self.path = (np.zeros(shape, dtype=t) for t in (float, np.int64, np.int64, float))
        self.threshold[at], self.left[at], self.right[at] = nodes["threshold"], nodes["left"], nodes["right"]
        self.path[at] = nodes["depth"].to_numpy() + average_path(nodes["size"].to_numpy())
        self.depth = int(nodes["depth"].max())
        roots = nodes.loc[nodes["node"] == 0, "size"]
        self.scale = float(average_path(np.array([roots.max()]))[0]) or 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path), near 1 for rows that are isolated early."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for tree in range(self.slot.shape[0]):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                slot = self.slot[tree, node]
                inner = slot >= 0
                if not inner.any():
                    break
                low = x[rows, np.maximum(slot, 0)] <= self.threshold[tree, node]
                node = np.where(inner, np.where(low, self.left[tree, node], self.right[tree, node]), node)
            total += self.path[tree, node]
        return np.power(2.0, -(total / self.slot.shape[0]) / self.scale)

    def score_sparse(self, at: pd.Series, values: pd.Series, block: int = 4096) -> np.ndarray:
        parts = [
            self.score(_matrix(at.iloc[i:i + block], values.iloc[i:i + block], self.slots, self.width))
            for i in range(0, len(at), block)
        ]
        return np.concatenate(parts) if parts else np.zeros(0)


def score_anomaly(df: DataFrame, nodes: DataFrame, features: str = "features", threshold: float = THRESHOLD) -> DataFrame:
    """The rows with ``anomaly_score`` and ``iforest`` (-1 anomaly, 1 normal).

    A forest has at most trees * (2 * sample - 1) nodes, 51,100 at the defaults,
    so it is collected and broadcast. Only the vector and nothing else of a row
    goes to Python.
    """
    forest = df.sparkSession.sparkContext.broadcast(Forest(nodes.toPandas()))

    @F.pandas_udf("double")
    def isolation(at: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series(forest.value.score_sparse(at, values))

    scored = df.withColumn("anomaly_score", isolation(*_sparse(features)))
    return scored.withColumn("iforest", F.when(F.col("anomaly_score") > threshold, F.lit(-1)).otherwise(F.lit(1)))
