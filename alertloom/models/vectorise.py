"""Messages and counts to feature vectors, as Spark ML stages that can be saved.

Everything is fitted with SQL aggregates and then frozen into ready-made JVM
stages, so a fitted set of stages is an ordinary ``PipelineModel``.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, Normalizer, RegexTokenizer, SQLTransformer, VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, functions as F

from alertloom.functions.features import FEATURES
from alertloom.runtime import settle

# Fixed value: a token is a run of two or more word characters.
TOKEN = r"[\p{L}\p{N}_]{2,}"
MAX_TERMS = 1000
#: Terms that the sketch proposes for one that is wanted, and terms that it tracks.
PROPOSED, TRACKED = 4, 200_000
#: Fixed value of the frequent-items sketch: its error is at most this share of all uses, over its size.
ERROR = 3.5


def tokens(message: Column) -> Column:
    return F.regexp_extract_all(F.lower(message), F.lit(f"({TOKEN})"), 1)


def term_counts(df: DataFrame, message: str = "message", listed: DataFrame | None = None) -> DataFrame:
    """(term, uses, rows): how often each term occurs and in how many rows; with ``listed`` (term) of those only.

    Both counts come from one pass and are combined before the shuffle, so a term
    that occurs everywhere costs one row per task.
    """
    held = df.select(tokens(F.col(message)).alias("_tokens"))
    once = lambda used, row: (lambda t: F.struct(t.alias("term"), F.lit(used).alias("used"), F.lit(row).alias("row")))
    marks = F.concat(F.transform("_tokens", once(1, 0)), F.transform(F.array_distinct("_tokens"), once(0, 1)))
    each = held.select(F.explode(marks).alias("m")).select("m.*")
    each = each if listed is None else each.join(listed, "term", "left_semi")
    return each.groupBy("term").agg(F.sum("used").alias("uses"), F.sum("row").alias("rows"))


def top_terms(df: DataFrame, n: int = MAX_TERMS, message: str = "message", sketch: bool = False) -> DataFrame:
    """The ``n`` most used terms; ties are broken by the term.

    Where the vocabulary is very large, ``sketch`` takes two passes and shuffles no more
    than the sketch holds: a heavy-hitter sketch proposes terms, their exact counts decide,
    and the sketch's error bound proves that no other term belongs. Where it proves
    nothing, as with a flat distribution, all terms are counted; the rows are the same either way.
    """
    if sketch:
        proven = _proven_top_terms(df, n, message)
        if proven is not None:
            return proven
    return term_counts(df, message).orderBy(F.desc("uses"), "term").limit(n)


def _proven_top_terms(df: DataFrame, n: int, message: str) -> DataFrame | None:
    """The top terms by sketch and exact count; None if the sketch cannot exclude all others."""
    proposals = PROPOSED * n
    words = df.select(F.explode(tokens(F.col(message))).alias("term"))
    found = words.agg(F.expr(f"approx_top_k(term, {proposals}, {max(TRACKED, proposals)})").alias("top"), F.count(F.lit(1)).alias("total")).first()
    top = found["top"] or []
    if not top:
        return None
    # A term that the sketch lost has no more uses than its error; one that it holds beyond the proposals no more than the last of them.
    lost = ERROR * found["total"] / max(TRACKED, proposals)
    most = max(lost, top[-1]["count"] if len(top) == proposals else 0)
    # As many rows as there are proposals.
    listed = df.sparkSession.createDataFrame([(t["item"],) for t in top], "term string")
    counts = settle(term_counts(df, message, F.broadcast(listed)), "terms")
    chosen = counts.orderBy(F.desc("uses"), "term").limit(n)
    size, least = chosen.agg(F.count(F.lit(1)), F.min("uses")).first()
    return chosen if most < 1 or (size == n and least > most) else None


def inverse_frequency(n: Column, rows: Column) -> Column:
    """Smoothed: ln((1 + n) / (1 + rows)) + 1."""
    return F.log((1 + n) / (1 + rows)) + 1


def summarise(df: DataFrame) -> tuple[int, dict[str, tuple[float, float]]]:
    """Rows, and mean and population deviation of each numeric feature; a zero deviation counts as 1."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES],
    ).first()
    return row["n"], {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in FEATURES}


def standardise(df: DataFrame, scales: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Add ``z_<feature>`` columns with zero mean and unit variance."""
    scales = scales or summarise(df)[1]
    return df.withColumns({f"z_{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scales.items()})


def _standardiser(scales: dict[str, tuple[float, float]]) -> SQLTransformer:
    scaled = ", ".join(f"(`{c}` - {m!r}D) / {s!r}D AS `z_{c}`" for c, (m, s) in scales.items())
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


def tfidf_stages(df: DataFrame, total: int, n: int = MAX_TERMS, sketch: bool = False) -> list:
    """Tokens, counts, weights and unit length over ``total`` rows. The vocabulary is at most ``n`` collected rows."""
    chosen = top_terms(df, n, sketch=sketch).select("term", inverse_frequency(F.lit(total), F.col("rows")).alias("idf")).collect()
    if not chosen:
        raise ValueError("no message holds a term")
    counter = CountVectorizerModel.from_vocabulary([r["term"] for r in chosen], inputCol="tokens", outputCol="counts")
    return [
        RegexTokenizer(inputCol="message", outputCol="tokens", pattern=TOKEN, gaps=False, toLowercase=True, minTokenLength=2),
        counter,
        ElementwiseProduct(inputCol="counts", outputCol="weights", scalingVec=Vectors.dense([r["idf"] for r in chosen])),
        Normalizer(inputCol="weights", outputCol="text_vector", p=2.0),
    ]


def fit_vectoriser(df: DataFrame, n: int = MAX_TERMS, text: bool = True, sketch: bool = False) -> PipelineModel:
    """Stages from feature rows to ``features``: the numeric block, then the text block.

    ``text=False`` leaves the text block out; ``sketch`` is that of :func:`top_terms`.
    """
    total, scales = summarise(df)
    stages = [_standardiser(scales)]
    inputs = [f"z_{c}" for c in FEATURES]
    if text:
        stages += tfidf_stages(df, total, n, sketch)
        inputs.append("text_vector")
    return PipelineModel(stages + [VectorAssembler(inputCols=inputs, outputCol="features")])


def vectorised(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The rows with ``features`` and without the intermediate columns."""
    return model.transform(df).select(*df.columns, "features")
