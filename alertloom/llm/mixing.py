"""Mixing to target weights: soft domain membership and nonnegative document rates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from alertloom.llm.common import bound_batches, settled
from alertloom.llm.quality import word_terms

#: Labelled rows that the classifier is fitted on at most; the least hashes of the identifiers are taken.
TRAIN_ROWS = 4000
BUCKETS = 1 << 11
#: Posteriors are whole numbers of this part of one.
PARTS = 256
#: Domains at most: their matrix of moments is held by the driver.
DOMAINS = 256
ROUNDS = 200
#: Rounds after which the rates reached so far are written beside their cells.
CARRY = 10
#: A fit ends when no total misses its target by more than this share of all, or moves by less than STALL.
TOLERANCE = 1e-4
STALL = 1e-7


@dataclass
class MixModel:
    """Classifier of domains, and the gradient steps that turn a posterior into a rate. Bounded by BUCKETS x DOMAINS.

    After a fit, ``missed`` tells by which share of all tokens each domain's expected total is over
    its target, and ``ignored`` the domains that have a target but that the classifier does not know.
    """

    domains: list[str]
    weights: object = None
    bias: object = None
    step: float = 1.0
    residuals: list = field(default_factory=list)
    missed: dict[str, float] = field(default_factory=dict)
    ignored: list[str] = field(default_factory=list)

    def features(self, text: str):
        """(square roots of the shares of hashed words, number of words) of a whole text."""
        import numpy as np

        counts = np.zeros(BUCKETS)
        for words, _ in word_terms(text):
            counts += np.bincount(words % BUCKETS, minlength=BUCKETS)
        n = int(counts.sum())
        return np.sqrt(counts / max(n, 1)), n

    def parts(self, features):
        """Posteriors in whole parts that add up to PARTS, by largest remainders."""
        import numpy as np

        z = features @ self.weights + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        exact = p / p.sum(axis=1, keepdims=True) * PARTS
        out = np.floor(exact).astype(np.int64)
        order = np.argsort(out - exact, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        return out + (rank < PARTS - out.sum(axis=1, keepdims=True))

    def rates(self, parts, rate=None, done: int = 0):
        """The rates of posteriors after all gradient steps: from one, down the gradient, never below zero.

        ``rate`` are the rates after the first ``done`` steps, where they are known.
        """
        import numpy as np

        p = np.asarray(parts, np.float64) / PARTS
        rate = np.ones(len(p)) if rate is None else rate
        for residual in self.residuals[done:]:
            rate = np.maximum(0, rate - self.step * (p @ residual))
        return rate


def _fit_softmax(x, y, k: int, rounds: int = 150, decay: float = 1e-4):
    """Multinomial logistic regression by accelerated gradient steps."""
    import numpy as np

    weights, bias, target = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32), np.eye(k, dtype=np.float32)[y]
    step, ahead, old = np.float32(4), 0.0, weights
    for _ in range(rounds):
        ahead_next = (1 + np.sqrt(1 + 4 * ahead * ahead)) / 2
        look = weights + np.float32((ahead - 1) / ahead_next) * (weights - old) if ahead else weights
        z = x @ look + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - target) / np.float32(len(x))
        old, weights, bias, ahead = weights, look - step * (x.T @ error + np.float32(decay) * look), bias - step * error.sum(axis=0), ahead_next
    return weights, bias


def fit_domains(docs: DataFrame, labelled: DataFrame, domain_col: str, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> MixModel:
    """Fit the classifier of domains on ``labelled`` rows (identifier, domain), ``train_rows`` at most.

    Rows with a null identifier or domain, and identifiers whose rows disagree, are left
    out. Without usable rows there is one nameless domain.
    """
    import numpy as np

    spark = docs.sparkSession
    bound_batches(spark)
    ids = F.col(id_col).cast("long")
    agreed = (
        labelled.select(ids.alias("i"), F.col(domain_col).cast("string").alias("d")).where("i is not null and d is not null")
        .groupBy("i").agg(F.min("d").alias("d"), F.max("d").alias("e")).where("d = e").select("i", "d")
    )
    chosen = agreed.orderBy(F.xxhash64("i"), "i").limit(train_rows)
    texts = docs.select(ids.alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # At most train_rows identifiers, whatever the tables hold.
    sample = texts.join(F.broadcast(chosen), "i")

    def featurise(batches):
        import pyarrow as pa

        model = MixModel([])
        for batch in batches:
            rows = [model.features(t)[0].astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["i", "d", "x"])

    # Sent to the driver: train_rows times BUCKETS half-precision numbers at most.
    rows = sorted(sample.select("i", "d", "text").mapInArrow(featurise, "i long, d string, x binary").collect())
    domains = sorted({r["d"] for r in rows}) or [""]
    if len(domains) > DOMAINS:
        raise ValueError(f"{len(domains)} domains; at most {DOMAINS} are fitted")
    if not rows:
        return MixModel(domains, np.zeros((BUCKETS, 1)), np.zeros(1))
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    weights, bias = _fit_softmax(x, np.array([domains.index(r["d"]) for r in rows]), len(domains))
    return MixModel(domains, weights, bias)


def domain_posteriors(docs: DataFrame, model: MixModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens (words between white space) and parts, the posterior in 256ths, of every whole text.

    One row for each row of ``docs``: null and empty texts have no tokens and the posterior of
    a text without words, null and repeated identifiers are carried as they are, other columns
    are not read, and an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            found = [shared.value.features(t or "") for t in batch.column(1).to_pylist()]
            parts = shared.value.parts(np.stack([x for x, _ in found]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array(parts.tolist(), pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "parts"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, parts array<int>")


def fit_rates(posteriors: DataFrame, model: MixModel, targets: dict[str, float] | None = None, tempering: float = 0.7, keep_all: bool = True) -> MixModel:
    """Fit rates whose expected domain token totals are the targets' shares, in least squares.

    Minimises, over nonnegative rates, the squared differences between the domains' totals
    (sum of rate x tokens x posterior) and their targets, each weighted by one over the
    domain's present total. A round of projected gradient sums the current totals over the
    table; the gradient of a document is its posterior times the weighted residuals, so a
    rate follows from the posterior and the residuals of all rounds, which the driver keeps. Documents with equal posteriors
    have equal rates: their tokens are added up once, and the rounds run over these cells,
    which stay distributed. Every ``CARRY`` rounds the cells are written with the rates reached,
    so a round takes ``CARRY`` steps a cell at most, however many went before.

    Without ``targets`` each domain's weight is its share to the power ``tempering``.
    Weights of unknown domains are ignored and named in ``ignored``, missing ones are zero. With ``keep_all`` the
    total is as large as the most reduced domain needs to stay whole; otherwise it is the
    total there is. Without tokens all rates are one. A fit ends when all totals are met within
    TOLERANCE, no longer move, or after ROUNDS; ``missed`` of the result tells how far off each is.
    """
    import numpy as np

    k = len(model.domains)
    model.ignored = sorted(set(targets or {}) - set(model.domains))
    cells = posteriors.where("n_tokens > 0").groupBy("parts").agg(F.sum("n_tokens").alias("n"))
    cells, carried = settled(cells.withColumn("rate", F.lit(1.0)), "cells"), 0

    def moments(batches):
        import pyarrow as pa

        total, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            p = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, k) / PARTS
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            total += n @ p
            squares += (p * n[:, None]).T @ p
        found = np.concatenate([total, squares.reshape(-1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found)), pa.int32()), pa.array(found)], names=["i", "m"])

    # Added up by Spark, in decimals so that the order does not matter: the driver gets k + k x k numbers, not as many a partition.
    sums = cells.mapInArrow(moments, "i int, m double").groupBy("i").agg(F.sum(F.col("m").cast("decimal(38,9)")).cast("double").alias("m")).collect()
    both = np.zeros(k + k * k)
    for r in sums:
        both[r["i"]] = r["m"]
    total, all_tokens = both[:k], both[:k].sum()
    if all_tokens == 0:
        return model
    share = total / all_tokens
    wanted = np.array([max(0.0, targets.get(d, 0.0)) for d in model.domains]) if targets else np.where(share > 0, share, 0) ** tempering
    if wanted.sum() == 0:
        raise ValueError("no domain has a positive target weight")
    goal = wanted / wanted.sum()
    if keep_all:
        goal = goal * max(share[j] / goal[j] for j in range(k) if goal[j] > 0)
    scale = np.where(share > 0, 1 / np.where(share > 0, share, 1), 0)
    # The step is one over the largest curvature.
    curvature = both[k:].reshape(k, k) / all_tokens * np.sqrt(np.outer(scale, scale))
    model.step, model.residuals, last = 1 / float(np.linalg.eigvalsh(curvature)[-1]), [(share - goal) * scale], share - goal
    for turn in range(1, ROUNDS + 1):
        shared = cells.sparkSession.sparkContext.broadcast(model)

        def totals(batches, shared=shared, carried=carried):
            import pyarrow as pa

            own = np.zeros(k)
            for batch in batches:
                p = np.array(batch.column(0).to_pylist(), np.int64).reshape(-1, k)
                own += (shared.value.rates(p, batch.column(2).to_numpy(), carried) * batch.column(1).to_numpy(zero_copy_only=False)) @ p / PARTS
            yield pa.RecordBatch.from_arrays([pa.array([own.tolist()], pa.list_(pa.float64()))], names=["m"])

        now = sum((np.array(r["m"]) for r in cells.mapInArrow(totals, "m array<double>").collect()), np.zeros(k)) / all_tokens
        residual = now - goal
        model.missed = dict(zip(model.domains, residual.tolist()))
        if turn == ROUNDS or np.abs(residual).max() <= TOLERANCE * goal.sum() or np.abs(residual - last).max() <= STALL:
            break
        if turn % CARRY == 0:

            def advance(batches, shared=shared, carried=carried):
                import pyarrow as pa

                for batch in batches:
                    p = np.array(batch.column(0).to_pylist(), np.int64).reshape(-1, k)
                    rate = shared.value.rates(p, batch.column(2).to_numpy(), carried)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rate)], names=["parts", "n", "rate"])

            cells, carried = settled(cells.mapInArrow(advance, cells.schema), "cells"), len(model.residuals)
        model.residuals.append(residual * scale)
        last = residual
    return model


def _copies(rates, keys):
    """Whole copies: the rate's floor, and one more where the key's hash falls below its fraction."""
    import numpy as np
    import xxhash

    u = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.float64) / 2.0**64
    low = np.floor(rates)
    return (low + (u < rates - low)).astype(np.int64)


def document_rates(posteriors: DataFrame, model: MixModel) -> DataFrame:
    """doc_id, n_tokens, posterior, rate and copies of every row of ``posteriors``; none for an empty table.

    Equal posteriors have equal rates, rows without tokens too; rows with one identifier are drawn alike.
    """
    shared = posteriors.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = np.array(batch.column(2).to_pylist(), np.int64)
            rates = shared.value.rates(parts)
            copies = _copies(rates, [repr(d).encode() for d in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array((parts / PARTS).tolist(), pa.list_(pa.float64())), pa.array(rates), pa.array(copies)],
                names=["doc_id", "n_tokens", "posterior", "rate", "copies"],
            )

    return posteriors.mapInArrow(run, "doc_id long, n_tokens long, posterior array<double>, rate double, copies long")


def mix(docs: DataFrame, model: MixModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as their copies say, with all their columns as they are.

    A null text counts as empty. The draw of a document depends on its identifier alone,
    so rows with one identifier and like texts are drawn alike. An empty table stays empty. One pass, no shuffle.
    """
    bound_batches(docs.sparkSession)
    shared, at, key = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                m = shared.value
                parts = m.parts(np.stack([m.features(t or "")[0] for t in batch.column(at).to_pylist()]))
                copies = _copies(m.rates(parts), [repr(d).encode() for d in batch.column(key).to_pylist()])
                for start in range(int(copies.max())):  # a round for each further copy keeps batches small
                    yield batch.filter(pa.array(copies > start))

    return docs.mapInArrow(run, docs.schema)
