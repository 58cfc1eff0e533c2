"""Filter interaction audit: truth-table words of surviving subsets, counted by carry-save positional popcounts."""

from __future__ import annotations

import re
from itertools import permutations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from alertloom.llm.common import bound_batches, settled
from alertloom.runtime import broadcast_if_small

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
FEW_WORDS = 100
#: Distinct words in hundredths of all words, and capitals in hundredths of all characters.
DISTINCT, CAPITALS = 80, 10
MARKS = re.compile(rb"[#$%&*|]")
UPPER = bytes(range(65, 91))
#: Keys of counts that a task holds at a time.
KEYS = 4096
#: Rows of one text from which on it counts as frequent.
OFTEN = 1000


def text_failures(data: bytes) -> int:
    """Which of the filters A to D a UTF-8 text fails, as bits from A on."""
    words = data.split()  # bytes.split() cuts at \x20 and \x09-\x0D
    n = len(words)
    fails = n < FEW_WORDS
    fails |= (100 * len(set(words)) < DISTINCT * n) << 1
    points = len(data) if data.isascii() else len(data.decode("utf-8", "replace"))
    fails |= (100 * (len(data) - len(data.translate(None, UPPER))) > CAPITALS * points) << 2
    return fails | (MARKS.search(data) is not None) << 3


def survival_word(fails: int) -> int:
    """Bit s is set if a text with these failures survives the subset s of the filters."""
    return sum(1 << s for s in range(SUBSETS) if not s & fails)


def positional_counts(words):
    """How many of the 32-bit words have each bit set.

    Three words of one weight become one of that weight and one of twice the weight, as
    a carry-save adder does for all 32 positions at once, until no weight has three left.
    """
    import numpy as np

    counts, weight, level = np.zeros(32, np.int64), 1, np.asarray(words, np.uint32)
    places = np.arange(32, dtype=np.uint32)
    while len(level):
        carries = [level[:0]]
        while len(level) >= 3:
            k = len(level) // 3
            a, b, c = level[:k], level[k : 2 * k], level[2 * k : 3 * k]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * k :]])
        for word in level:
            counts += weight * ((word >> places) & np.uint32(1)).astype(np.int64)
        level, weight = np.concatenate(carries), 2 * weight
    return counts


def _facts(batches):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        texts = [t or b"" for t in batch.column(1).to_pylist()]
        fails = pa.array([text_failures(t) for t in texts], pa.int32())
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), digests, fails], names=["of", "digest", "fails"])


def _popcounts(batches):
    """Counts of each bit per (part, label); what a task has gathered leaves it when there are too many keys."""
    import numpy as np
    import pyarrow as pa

    def record(held):
        parts, labels, counts = zip(*((p, x, c.tolist()) for (p, x), c in held.items()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(labels, pa.int32()), pa.array(counts, pa.list_(pa.int64()))], names=["part", "label", "counts"])

    held = {}
    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        names = parts.dictionary.to_pylist()
        codes = parts.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + batch.column(1).to_numpy(zero_copy_only=False)
        words = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint32)
        order = np.argsort(codes, kind="stable")
        ends = np.flatnonzero(np.diff(codes[order])) + 1
        for own in np.split(order, ends) if len(order) else []:
            key = (names[codes[own[0]] // 4], int(codes[own[0]] % 4))
            held[key] = held.get(key, 0) + positional_counts(words[own])
        if len(held) >= KEYS:
            yield record(held)
            held = {}
    if held:
        yield record(held)


def survival_words(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per document: part, label (1 for quality, 2 for toxic, added up), word.

    Texts are read once. What is shuffled is a digest, a few bits and an identifier per
    document: to the first document of a repeated text, and to the document's labels.
    """
    bound_batches(docs.sparkSession)
    of = F.struct(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    facts = docs.select(of.alias("of"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(_facts, "of struct<doc_id: long, part: string>, digest binary, fails int")
    facts = settled(facts.select("of.doc_id", "of.part", "digest", "fails"), "facts")
    repeats = settled(facts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1"), "repeats")
    # Texts that stand very often are no more than one for OFTEN rows; their rows are looked up apart, so no shuffle brings them together.
    often = repeats.where(F.col("n") > OFTEN).select("digest", "first")
    looked = facts.join(broadcast_if_small(often), "digest", "left")
    others = looked.where("first IS NULL").drop("first").join(repeats.where(F.col("n") <= OFTEN).select("digest", "first"), "digest", "left")
    placed = looked.where("first IS NOT NULL").unionByName(others)
    marked = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))).alias("label")
    )
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    words = [survival_word(k) for k in range(SUBSETS)]
    word = F.get(F.lit(words).cast("array<long>"), F.col("fails") + 16 * F.col("repeated"))
    joined = placed.withColumn("repeated", repeated).join(marked, "doc_id", "left")
    return joined.select("part", F.coalesce("label", F.lit(0)).cast("int").alias("label"), word.alias("word"))


def _steps() -> list[tuple[str, int, int, int, int]]:
    """(filter_order, step, bit, subset before, subset after) of every step of every order."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append(("".join(FILTERS[x] for x in order), step, k, before, before | 1 << k))
            before |= 1 << k
    return rows


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What each filter removes in each order, per part: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    A document becomes a 32-bit word: bit s says whether it survives the subset s of the
    filters A to E. The words are counted by position per part and label, within each
    task by carry-save adders and then by a sum, so 32 numbers per part and label are all
    that an order needs: a filter removes after the subset s what s has left and s with the
    filter has not. ``shapley`` adds a filter's removals up over all orders.

    A null text is empty and fails A; a null part is the empty string. A text is a
    repeat if a smaller identifier has an identical text, so rows of one identifier are no
    repeats of each other, and a row without an identifier neither is a repeat nor makes one.
    Rows that stand twice count twice. A document without labels, or with null labels, counts as
    neither good nor toxic; of several label rows any that says 1 decides. Every part has
    all 600 rows, zeros included; without documents there is none. Other columns are not read.
    """
    words = survival_words(docs, labels, id_col, text_col, part_col)
    # 32-bit words as they are; small batches are of no use here.
    bound_batches(docs.sparkSession, 1 << 16)
    counts = words.mapInArrow(_popcounts, "part string, label int, counts array<long>")
    summed = counts.groupBy("part").agg(*[
        F.sum(F.when(F.lit(mask == 0) | (F.col("label").bitwiseAND(mask) != 0), F.col("counts")[s]).otherwise(0)).alias(f"_{name}{s}")
        for name, mask in (("all", 0), ("good", 1), ("toxic", 2)) for s in range(SUBSETS)
    ])
    parts = settled(summed.select("part", *[F.array(*[f"_{name}{s}" for s in range(SUBSETS)]).alias(name) for name in ("all", "good", "toxic")]), "survivors")
    bound_batches(docs.sparkSession)

    schema = ArrayType(StructType([StructField("filter_order", StringType())] + [StructField(c, IntegerType()) for c in ("step", "bit", "before", "after")]))
    steps = F.from_json(F.lit(_json(_steps())), schema)
    each = parts.select("*", F.explode(steps).alias("x")).select("part", "all", "good", "toxic", "x.*")
    lost = lambda name: F.get(name, F.col("before")) - F.get(name, F.col("after"))
    bit = F.col("after") - F.col("before")
    everything = SUBSETS - 1
    fails = F.get("all", F.lit(0)) - F.get("all", bit)
    shapley = F.element_at(F.array(*[_shapley(k) for k in range(len(FILTERS))]), F.col("bit") + 1)
    return each.select(
        "part", "filter_order", "step", F.get("all", F.col("after")).alias("kept"), lost("all").alias("removed"), (fails - lost("all")).alias("redundant"),
        (F.get("all", F.lit(everything) - bit) - F.get("all", F.lit(everything))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def _shapley(k: int):
    """Removals of the filter ``k``, added up over all orders."""
    times: dict[tuple[int, int], int] = {}
    for _, _, bit, before, after in _steps():
        if bit == k:
            times[before, after] = times.get((before, after), 0) + 1
    total = F.lit(0).cast(LongType())
    for (before, after), n in times.items():
        total = total + n * (F.get("all", F.lit(before)) - F.get("all", F.lit(after)))
    return total


def _json(rows) -> str:
    import json

    return json.dumps([dict(zip(("filter_order", "step", "bit", "before", "after"), r, strict=True)) for r in rows])
