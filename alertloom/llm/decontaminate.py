"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from alertloom.llm.common import settled
from alertloom.llm.license_scan import NOT_WORD
from alertloom.runtime import broadcast_if_small

WORDS = 5
CONTAINMENT = 0.8
#: Letters of scripts that set no spaces between words; each counts as a word.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
#: Minimum hashes beyond the guaranteed one; a candidate has to share one more than this.
SPARE = 2


def words_of(text):
    """The lower-cased words of a text, without punctuation; an empty array if it has none."""
    lower = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    apart = F.when(lower.rlike(UNSPACED), F.regexp_replace(lower, f"({UNSPACED})", " $1 ")).otherwise(lower)
    spaced = F.trim(F.regexp_replace(apart, NOT_WORD, " "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def _shingles(words, size: int, join):
    """``join`` over every ``size`` words in a row; over all of them if there are fewer; none without words.

    The words are bound to a variable first, or each step would cut the text anew.
    """

    def of(w):
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: join(w, i))).otherwise(F.array())

    return F.element_at(F.transform(F.array(words), of), 1)


def shingle_texts(words, size: int = WORDS):
    return _shingles(words, size, lambda w, i: F.array_join(F.slice(w, i, size), " "))


def shingle_hashes(words, size: int = WORDS):
    return _shingles(words, size, lambda w, i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(size)]))


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    words: int = WORDS, containment: float = CONTAINMENT,
) -> DataFrame:
    """Pairs of a document and a test item whose shingles it holds: row, doc_id, item_id, n_shingles, shared, containment.

    Containment is the share of an item's distinct five-word shingles that stand in the
    document. A text has no bearing on it beyond that, so short items are found in long
    documents. Items are divided into classes by size, each a power of two wide. A class
    fixes how many minimum hashes of an item are searched: as many as the threshold lets
    the largest item of the class miss, and some more. So a document at the threshold must
    share at least ``shared - missable`` of them; no pair is lost. Candidates come from an
    equi-join on hashes; the words themselves decide in the second pass, which reads the
    candidates' documents only.

    The index of items is broadcast when its measured size allows, and is shuffled
    otherwise. An item of fewer than five words has one shingle, the whole, and is found
    wherever its words stand in a row: documents also give shingles of each size that occurs
    among such items. Letters of scripts without spaces are words. An item without
    words is in no document; null counts as empty. Repeated documents and items are
    matched row by row; a null identifier is carried as it is. ``row`` numbers the rows of
    ``docs`` in scan order, so ``docs`` must be a stable table. Other columns are not read.
    Without documents or items the result is empty.
    """
    item_words = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("w"))
    hashes = F.array_sort(F.array_distinct(shingle_hashes(F.col("w"), words)))
    index = item_words.select("item", "item_id", F.size("w").alias("size"), F.array_distinct(shingle_texts(F.col("w"), words)).alias("s"), hashes.alias("h")).where("size(s) > 0")
    n = F.size("h")
    largest = F.pow(F.lit(2), F.floor(F.log2(n)) + 1) - 1
    sketch = F.least(n, F.floor(F.lit(1 - containment) * largest + 1e-9) + 1 + SPARE).cast("int")
    need = F.ceil(F.lit(containment) * n - 1e-9).cast("int")
    index = settled(index.select("item", "item_id", "size", "s", "h", sketch.alias("k"), need.alias("need")), "items")
    least = F.greatest(F.col("k") - (F.size("h") - F.col("need")), F.lit(1))
    sketches = index.select("item", least.alias("least"), F.explode(F.slice("h", F.lit(1), F.col("k"))).alias("h"))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # Fewer than ``words`` values.
    short = sorted(r["size"] for r in index.where(F.col("size") < words).select("size").distinct().collect())

    def all_hashes(w):
        return F.concat(*[shingle_hashes(w, size) for size in (words, *short)])

    probes = rows.select("row", F.explode(F.element_at(F.transform(F.array(words_of(F.col("text"))), all_hashes), 1)).alias("h"))
    met = probes.join(broadcast_if_small(sketches), "h").distinct()
    pairs = settled(met.groupBy("row", "item", "least").agg(F.count(F.lit(1)).alias("hits")).where("hits >= least").select("row", "item"), "candidates")

    read = rows.join(broadcast_if_small(pairs), "row").join(broadcast_if_small(index.select("item", "item_id", "size", "s", "need")), "item")
    held = words_of(F.col("text"))
    within = F.contains(F.concat(F.lit(" "), F.array_join(held, " "), F.lit(" ")), F.concat(F.lit(" "), F.get("s", F.lit(0)), F.lit(" ")))
    shared = F.when(F.col("size") < words, within.cast("int")).otherwise(F.size(F.array_intersect(F.col("s"), shingle_texts(held, words))))
    found = read.select("row", "doc_id", "item_id", F.size("s").alias("n_shingles"), shared.alias("shared"), "need").where("shared >= need")
    return found.select("row", "doc_id", "item_id", "n_shingles", "shared", (F.col("shared") / F.col("n_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns as they are."""
    number = "row" if "row" not in docs.columns else "_row_" + "_".join(docs.columns)
    found = settled(contaminated(docs, items, **options).select(F.col("row").alias(number)).distinct(), "contaminated")
    return docs.withColumn(number, F.monotonically_increasing_id()).join(broadcast_if_small(found), number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
