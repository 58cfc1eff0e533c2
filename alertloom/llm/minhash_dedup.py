"""Near-duplicate documents: MinHash with tensored banding, verified on whole shingle sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from alertloom.llm.common import bound_batches, connected, settled
from alertloom.llm.simhash_dedup import SEED, _pieces

WORDS = 4
#: Least Jaccard similarity of a link, as a whole number of hundredths, so that the test is one of whole numbers.
PERCENT = 80
#: Half keys in each of the two collections, and minimum hashes in a half key. Every pair of half keys, one
#: from each collection, is the key of one of HALVES * HALVES tables, while only 2 * HALVES * DEPTH minimum
#: hashes are computed. Two sets of similarity s share no table with probability
#: 1 - (1 - (1 - s ** DEPTH) ** HALVES) ** 2, which is 1e-5 at 0.8 and 5e-9 at 0.9.
HALVES, DEPTH = 12, 2
#: Shingles that are hashed at a time.
CHUNK = 4096


def shingle_set(data: bytes, words: int = WORDS):
    """The sorted distinct XXH64 of a UTF-8 text's shingles; of all its words if there are fewer; none without words."""
    import numpy as np
    import xxhash

    found, kept, any_shingles = [], [], False
    for piece in _pieces(data.lower()):  # bytes.lower() changes A-Z only
        piece = kept + piece
        if len(piece) >= words:
            any_shingles = True
            shingles = map(b" ".join, zip(*(piece[k:] for k in range(words)), strict=False))
            found.append(np.unique(np.frombuffer(b"".join(map(_digest, shingles)), np.uint64)))
        # Of a text that is still too short all words are kept.
        kept = piece if len(piece) < words else piece[len(piece) - words + 1 :]
    if not any_shingles:
        return np.frombuffer(xxhash.xxh64_digest(b" ".join(kept), SEED) if kept else b"", np.uint64)
    return np.unique(np.concatenate(found))


def _digest(shingle: bytes) -> bytes:
    import xxhash

    return xxhash.xxh64_digest(shingle, SEED)


def half_keys(hashes):
    """The half keys of a set: those of the first collection, then those of the second."""
    import numpy as np

    n = 2 * HALVES * DEPTH
    rng = np.random.default_rng(SEED)
    factors, shifts = (rng.integers(0, 1 << 64, n, np.uint64) for _ in range(2))
    factors |= np.uint64(1)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        # The product's high half decides, as its low bits depend on few bits of the hash.
        mixed = hashes[None, at : at + CHUNK] * factors[:, None] + shifts[:, None]
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, (mixed * factors[::-1, None]).min(axis=1), out=least)
    least = least.reshape(2 * HALVES, DEPTH)
    keys = np.arange(1, 2 * HALVES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(DEPTH):
        keys = (keys ^ least[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def _sketches(words: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets = [shingle_set(t or b"", words) for t in batch.column(1).to_pylist()]
            keys = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
            flat = np.concatenate([half_keys(s) for s in sets]) if sets else np.zeros(0, np.int64)
            halves = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * HALVES), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array([len(s) for s in sets], pa.int64()), halves], names=["row", "key", "n", "halves"])

    return run


def _sets(words: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(t or b"", words) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "s"])

    return run


def _fits(n: str, m: str, percent: int):
    """Sizes at which two sets can have the similarity."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def crowded_tables(sets: DataFrame) -> DataFrame:
    """(id, n, bucket) of the sets (id, n, halves) in the tables' buckets that can hold two sets.

    A bucket's key joins a half key of each collection. Two sets that share it share both
    halves, so only halves that stand in two sets or more are paired, and sets without
    such halves in both collections give no table row at all.
    """
    halves = sets.select("id", "n", F.posexplode("halves").alias("k", "half"))
    met = halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    # No more than 2 * HALVES values each.
    kept = halves.join(met, "half", "left_semi").groupBy("id", "n").agg(
        F.collect_list(F.when(F.col("k") < HALVES, F.col("half"))).alias("a"), F.collect_list(F.when(F.col("k") >= HALVES, F.col("half"))).alias("b")
    )
    return kept.select("id", "n", "b", F.explode("a").alias("x")).select("id", "n", "x", F.explode("b").alias("y")).select("id", "n", F.xxhash64("x", "y").alias("bucket"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity."""
    one, other = (sets.select(F.col("id").alias(c), F.col("s").alias(s)) for c, s in (("a", "x"), ("b", "y")))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("sum"))
    return both.where(F.col("shared") * 100 >= (F.col("sum") - F.col("shared")) * percent).select("a", "b")


def _apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs whose ends are in different groups of ``joined`` (node, root)."""
    for side in ("a", "b"):
        pairs = pairs.join(joined.select(F.col("node").alias(side), F.col("root").alias(f"_{side}")), side, "left")
    return pairs.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def _rare_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) among ``members`` (id, root, s) in different groups; no pair at the similarity is lost.

    Shingles are ordered from rare to frequent among the members. A pair at the similarity
    shares a shingle of both sets' prefixes, and of the first one shared its places leave
    enough shingles behind; so copies that changed beyond the threshold, whose rare
    shingles are their own, never meet although they share their tables.
    """
    shingles = members.select("id", "root", F.size("s").cast("long").alias("n"), F.explode("s").alias("h"))
    counts = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    ordered = shingles.join(counts, "h").groupBy("id", "root", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100 - 1e-9) + 1
    heads = ordered.select("id", "root", "n", F.posexplode(F.slice("o", F.lit(1), prefix.cast("int"))).alias("i", "t")).where("t.df > 1")
    heads = settled(heads.select("id", "root", "n", "i", F.col("t.h").alias("h")), "prefixes")
    other = heads.select(*[F.col(c).alias(f"{c}_b") for c in ("id", "root", "n", "i")], "h")
    # Overlap of the similarity: percent * (n + m) / (100 + percent), and what the places leave.
    room = 1 + F.least(F.col("n") - F.col("i") - 1, F.col("n_b") - F.col("i_b") - 1)
    met = heads.join(other, "h").where(
        (F.col("id") < F.col("id_b")) & (F.col("root") != F.col("root_b")) & _fits("n", "n_b", percent) & (room * (100 + percent) >= (F.col("n") + F.col("n_b")) * percent)
    )
    return met.select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Near-duplicate groups, one row per document: row, doc_id, n_shingles, component_id, kept.

    Two documents are linked if the Jaccard similarity of their sets of distinct
    ``words``-word shingles is ``percent`` hundredths or more; groups are connected.
    component_id is the smallest identifier of the group, and the row that has it is kept.

    Tables come from ``crowded_tables``; equal sets are met by an aggregate before. Every
    link is confirmed on whole sets, in three steps that leave less and less to compare:
    each set meets the least leader of its buckets; then the leaders of all its buckets
    whose groups still differ from its own; then the members of buckets that still hold
    several groups meet, by ``_rare_pairs``. Groups are connected after each step, so a large
    group of like texts is not paired out. Only sets that share a table are read again.

    Null and empty texts and texts without words have no shingles and are linked with
    nothing, so each is its own group. A text of fewer words has one shingle, the whole.
    Rows that repeat an identifier are taken one by one and share a group only if linked;
    all rows that have their group's component_id are kept. A null identifier never names a
    group and its row is never kept; component_id is null where a group has no identifier. ``row`` numbers the rows of ``docs`` in
    scan order, so ``docs`` must be a stable table. Long texts are cut into words a piece at
    a time. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    keyed = rows.select(F.struct("row", "doc_id").alias("row"), "text")
    schema = "row struct<row: long, doc_id: long>, key binary, n long, halves array<long>"
    prints = settled(keyed.mapInArrow(_sketches(words), schema).select("row.row", "row.doc_id", "key", "n", "halves"), "sketches")
    known = settled(prints.where("n > 0").groupBy("key").agg(F.min("row").alias("id"), F.min("doc_id").alias("low")), "shingle-sets")
    distinct = prints.join(known.select(F.col("id").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), "n", "halves")

    placed = settled(crowded_tables(distinct), "tables")
    buckets = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "n")).alias("leader")).where("c > 1").drop("c")
    crowded = settled(placed.join(buckets, "bucket").select("bucket", "id", "n", F.col("leader.id").alias("lead"), F.col("leader.n").alias("lead_n")), "buckets")
    ids = crowded.select(F.col("id").alias("row")).distinct()
    sets = settled(rows.join(ids, "row", "left_semi").select("row", "text").mapInArrow(_sets(words), "id long, s array<long>"), "sets")

    star = settled(crowded.where((F.col("id") != F.col("lead")) & _fits("n", "lead_n", percent)).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "star")
    first = _confirmed(star.groupBy("b").agg(F.min("a").alias("a")), sets, percent)
    joined = settled(connected(first, "a", "b"), "joined")
    second = settled(_confirmed(_apart(star, joined), sets, percent), "links")
    joined = settled(connected(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second), "a", "b"), "joined")

    rooted = crowded.select("bucket", "id").join(joined.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).where("_l <> _h").select("bucket")
    members = rooted.join(mixed, "bucket", "left_semi").select("id", "root").distinct().join(sets, "id")
    third = _confirmed(settled(_rare_pairs(members, percent), "pairs"), sets, percent)
    roots = connected(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).union(third), "a", "b")

    rooted = known.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "low", F.coalesce("root", "id").alias("root"))
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(names, "root").select("key", "component_id")
    everyone = prints.select("row", "doc_id", F.when(F.col("n") > 0, F.col("key")).alias("key"), F.col("n").alias("n_shingles")).join(named, "key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return everyone.select("row", "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
