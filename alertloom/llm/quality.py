"""Document quality: random-indexing word vectors, pooled, under a two-layer network."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from alertloom.llm.common import bound_batches, settled

#: Labelled rows that the classifier is fitted on at most; the least hashes of the identifiers are taken.
TRAIN_ROWS = 6000
#: Tasks of the fit. Each sends its context sums to the driver, so their number is fixed.
TRAIN_TASKS = 8
DIM = 48
WORD_BUCKETS = 1 << 14
SHAPE_BUCKETS = 1 << 10
WINDOW = 2
HIDDEN = 24
#: Words whose buckets a worker remembers.
CACHE = 500_000
PIECE = 1 << 20
_SPACE = re.compile(r"\s")
_RUN = re.compile(r"(.)\1+", re.S)
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_X]+"), re.compile(r"\d+")


class _Buckets(dict):
    """Word to (word bucket, shape bucket) as one number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        shape = _RUN.sub(r"\1", _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("X", word))))[:24]
        own = zlib.crc32(word.lower().encode()) % WORD_BUCKETS
        found = self[word] = own | zlib.crc32(shape.encode()) % SHAPE_BUCKETS << 16
        return found


_BUCKETS = _Buckets()


def word_terms(text: str) -> Iterator[tuple]:
    """(word buckets, shape buckets) of a text, a bounded piece at a time."""
    import numpy as np

    at = 0
    while at < len(text):
        end = len(text)
        if at + PIECE < end:
            space = _SPACE.search(text, at + PIECE)
            end = space.start() if space else end
        words = text[at:end].split()
        if words:
            both = np.array([_BUCKETS[w] for w in words], np.int64)
            yield both & 0xFFFF, both >> 16
        at = end


def _index_vectors(buckets: int, seed: int):
    """The random index vector of each bucket: four entries of plus or minus one."""
    import numpy as np

    rng = np.random.default_rng(seed)
    out = np.zeros((buckets, DIM), np.float32)
    out[np.repeat(np.arange(buckets), 4), rng.integers(0, DIM, 4 * buckets)] = rng.choice([-1, 1], 4 * buckets)
    return out


def _contexts(batches):
    """Context sums of a task: for each word and shape the index vectors that stand around it."""
    import numpy as np
    import pyarrow as pa

    words, shapes = np.zeros((WORD_BUCKETS, DIM), np.float32), np.zeros((SHAPE_BUCKETS, DIM), np.float32)
    index_w, index_s = _index_vectors(WORD_BUCKETS, 1), _index_vectors(SHAPE_BUCKETS, 2)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for w, s in word_terms(text or ""):
                own = index_w[w] + index_s[s]
                around = np.zeros_like(own)
                for k in range(1, WINDOW + 1):
                    around[k:] += own[:-k]
                    around[:-k] += own[k:]
                np.add.at(words, w, around)
                np.add.at(shapes, s, around)
    sums = np.concatenate([words, shapes]).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(sums.tobytes(), 1)], pa.binary())], names=["sums"])


@dataclass
class QualityModel:
    """Vectors, network and temperature. Its size is fixed by the bucket counts, so it may be sent to every task."""

    words: object
    shapes: object
    mean: object = None
    scale: object = None
    layers: object = None
    temperature: float = 1.0

    def pooled(self, text: str):
        """Pooled vectors of a whole text: means of word and shape vectors, spread of shapes, likeness of neighbours, length."""
        import numpy as np

        sums, squares, shapes, like, n, steps, before = np.zeros(DIM), 0.0, np.zeros(SHAPE_BUCKETS), 0.0, 0, 0, None
        for w, s in word_terms(text):
            rows = self.words[w]
            sums += rows.sum(axis=0)
            shapes += np.bincount(s, minlength=SHAPE_BUCKETS)
            same = np.concatenate([[before if before is not None else -1], w[:-1]]) == w
            like += float((rows[1:] * rows[:-1]).sum())
            squares += float(same.sum())
            before, n, steps = w[-1], n + len(w), steps + len(w) - 1
        total = max(n, 1)
        share = shapes / total
        middle = share @ self.shapes
        spread = np.sqrt(np.maximum(share @ (self.shapes * self.shapes) - middle * middle, 0))
        return np.concatenate([sums / total, middle, spread, [like / max(steps, 1), squares / total, np.log1p(n) / 10]]).astype(np.float32)

    def logit(self, features):
        import numpy as np

        a, b, c, d = self.layers
        hidden = np.tanh((features - self.mean) / self.scale @ a + b)
        return hidden @ c + d

    def score(self, texts: list[str | None]):
        import numpy as np

        if not texts:
            return np.zeros(0)
        z = self.logit(np.stack([self.pooled(t or "") for t in texts])).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _fit_network(x, y, epochs: int = 150, batch: int = 256, decay: float = 1e-3, seed: int = 7):
    """Adam on the cross-entropy of a tanh layer and a linear layer."""
    import numpy as np

    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for epoch in range(epochs):
        order, rate = rng.permutation(len(x)), 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for s in range(0, len(x), batch):
            rows, target = x[order[s : s + batch]], y[order[s : s + batch]]
            hidden = np.tanh(rows @ layers[0] + layers[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -50, 50))) - target) / len(rows)
            back = np.outer(error, layers[2]) * (1 - hidden * hidden)
            slopes = [rows.T @ back + decay * layers[0], back.sum(axis=0), hidden.T @ error + decay * layers[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return [p.astype(np.float32) for p in layers]


def _fit_temperature(z, y) -> float:
    """The temperature with the least cross-entropy on rows that the network has not seen."""
    import numpy as np

    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    loss = [float(np.mean(np.logaddexp(0, z / t) - y * z / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def held_out(id_col: str):
    """Rows whose crc32 of the identifier as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Fit on labelled rows outside the held-out third, ``train_rows`` at most.

    Which rows is decided by a hash of the identifier. Labels that are null or neither 0
    nor 1 are left out, and so are identifiers whose label rows disagree. One row in five
    of the sample is kept from the network and gives the temperature. With no usable row,
    or with one class only, the model scores every text at the share of label 1 (0.5 if
    there is none).
    """
    import numpy as np

    spark = docs.sparkSession
    bound_batches(spark)
    ids = F.col(id_col).cast("long")
    agreed = (
        labels.select(ids.alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("i").isNotNull())
        .groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("i", "y").where(~held_out("i"))
    )
    chosen = agreed.orderBy(F.xxhash64("i"), "i").limit(train_rows)
    texts = docs.select(ids.alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # At most train_rows identifiers, whatever the tables hold.
    sample = settled(texts.join(F.broadcast(chosen), "i").repartition(TRAIN_TASKS, "i"), "sample")
    parts = sample.select("text").mapInArrow(_contexts, "sums binary").collect()
    total = sum((np.frombuffer(zlib.decompress(p["sums"]), np.int32).reshape(-1, DIM).astype(np.float64) for p in parts), np.zeros((WORD_BUCKETS + SHAPE_BUCKETS, DIM)))
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    vectors = (total / np.where(norm > 0, norm, 1)).astype(np.float32)
    model = QualityModel(vectors[:WORD_BUCKETS], vectors[WORD_BUCKETS:])
    shared = spark.sparkContext.broadcast(model)

    def pool(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [shared.value.pooled(t or "").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["i", "y", "x"])

    rows = sorted(sample.select("i", "y", "text").mapInArrow(pool, "i long, y int, x binary").collect())
    y = np.array([r["y"] for r in rows], np.float64)
    width = 3 * DIM + 3
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(-1, width)
    model.mean, model.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
    if len(set(y.tolist())) < 2:
        rate = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        zero = np.zeros
        model.layers = [zero((width, HIDDEN), np.float32), zero(HIDDEN, np.float32), zero(HIDDEN, np.float32), np.array([np.log(rate / (1 - rate))], np.float32)]
        return model
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    kept = np.arange(len(y)) % 5 == 4
    model.layers = _fit_network((x[~kept] - model.mean) / model.scale, y[~kept])
    if kept.any():
        model.temperature = _fit_temperature(model.logit(x[kept]).astype(np.float64), y[kept])
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text: doc_id, score. One pass without a shuffle.

    A null text scores like an empty one. Rows are scored one by one, so repeated rows get
    equal scores. Only the identifier and the text are read.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns as they are."""
    bound_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(at).to_pylist()) >= least))

    return docs.mapInArrow(run, docs.schema)
