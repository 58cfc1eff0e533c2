"""Near-duplicate documents: SimHash fingerprints compared on vertical bit planes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from alertloom.llm.common import bound_batches, connected, settled

SEED = 42
WORDS = 3
RADIUS = 3
#: Bits of the fingerprint's blocks. Three differing bits leave two of the five blocks untouched.
BLOCKS = (13, 13, 13, 13, 12)
#: Rows of a bucket that one tile holds; a larger bucket is cut into tiles that meet pairwise.
TILE = 4096
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
FULL = 0xFFFFFFFFFFFFFFFF
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded list at a time."""
    at = 0
    while at < len(data):
        end = len(data)
        if at + PIECE < end:
            space = _SPACE.search(data, at + PIECE)
            end = space.start() if space else end
        yield data[at:end].split()
        at = end


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """SimHash of a UTF-8 text: bit k is set if it is set in over half of the shingles' XXH64."""
    import numpy as np
    import xxhash

    counts, total, kept, any_words = np.zeros(64, np.int64), 0, [], False
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)

    def add(shingles: Iterable[bytes]) -> int:
        digests = b"".join(xxhash.xxh64_digest(s, SEED) for s in shingles)
        table = np.frombuffer(digests, np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k : 8 * k + 8] += np.bincount(table[:, k], minlength=256) @ bits
        return len(table)

    for piece in _pieces(data.lower()):  # bytes.lower() changes A-Z only
        any_words = any_words or bool(piece)
        piece = kept + piece
        if len(piece) >= words:
            total += add(map(b" ".join, zip(*(piece[k:] for k in range(words)), strict=False)))
        kept = piece[-(words - 1) :] if words > 1 else []
    if not total:
        if not any_words:
            return 0
        total = add([b" ".join(kept)])
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t or b"", words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["row", "fp"])

    return run


def _planes(values):
    """Bit planes of 64-bit values: plane k holds bit k of 64 values a word."""
    import numpy as np

    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    packed = np.packbits(bits, axis=1, bitorder="little")
    wide = np.zeros((64, -(-len(values) // 64) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def _beyond(planes, over, radius: int = RADIUS):
    """Count set bits down the planes for all lanes at once; lanes over ``radius`` end up set in ``over``.

    ``planes`` yields a function of the columns still in play. The counter is carry-save:
    ones and twos are bit vectors, and a carry out of the twos marks the lane. Columns
    whose lanes are all marked are abandoned every eight planes.
    """
    import numpy as np

    if radius != 3:
        raise ValueError("the counter holds two bits: radius 3")
    columns = np.arange(over.shape[-1])
    ones, twos, marked = np.zeros_like(over), np.zeros_like(over), over.copy()
    for k, plane in enumerate(planes):
        d = plane(columns)
        carry = ones & d
        ones ^= d
        marked |= twos & carry
        twos ^= carry
        if k % 8 == 7:
            alive = (marked != np.uint64(FULL)).any(axis=tuple(range(marked.ndim - 1)))
            if not alive.all():
                over[..., columns[~alive]] = np.uint64(FULL)
                columns, ones, twos, marked = columns[alive], ones[..., alive], twos[..., alive], marked[..., alive]
                if not len(columns):
                    return over
    over[..., columns] = marked
    return over


def _unused(n: int):
    """Words of ``n`` lanes in which the lanes beyond ``n`` are set."""
    import numpy as np

    words = np.zeros(-(-n // 64), np.uint64)
    if n % 64:
        words[-1] = np.uint64(FULL << (n % 64) & FULL)
    return words


def close_pairs(xors):
    """Which of the XORs of two fingerprints have at most three bits set."""
    import numpy as np

    planes = _planes(xors)
    over = _beyond([lambda c, p=p: p[c] for p in planes], _unused(len(xors)))
    return ~np.unpackbits(over.view(np.uint8), bitorder="little")[: len(xors)].astype(bool)


def forest(values) -> list[tuple[int, int]]:
    """Links that connect the values of one tile as all its close pairs would: at most len - 1."""
    import numpy as np

    n, planes = len(values), _planes(values)
    varied = [k for k in range(64) if 0 < np.bitwise_count(planes[k]).sum() < n]
    signs = (np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.uint64)) * np.uint64(FULL)
    unused, label, links = _unused(n), np.arange(n), []
    for start in range(0, n, 64):
        first, sign = start // 64, signs[start : start + 64]
        over = np.broadcast_to(unused[first:], (len(sign), len(unused) - first)).copy()
        lanes = [lambda c, k=k, f=first, s=sign: planes[k, f:][c][None, :] ^ s[:, k][:, None] for k in varied]
        near = ~_beyond(lanes, over)
        for q in np.flatnonzero(near.any(axis=1)):
            hits = start + np.flatnonzero(np.unpackbits(near[q].view(np.uint8), bitorder="little")[: n - start])
            own = label[start + q]
            fresh, at = np.unique(label[hits], return_index=True)
            at = at[fresh != own]
            if len(at):
                links += [(int(values[start + q]), int(values[hits[k]])) for k in at]
                label[np.isin(label, fresh)] = own
    return links


def _links(batches):
    """Stream over sorted tiles and compare within each."""
    import numpy as np
    import pyarrow as pa

    kept_key, kept = None, []
    xors, pairs = [], []

    def small():
        nonlocal xors, pairs
        if xors:
            both = np.concatenate(pairs)
            near = close_pairs(np.concatenate(xors))
            yield from map(tuple, both[near].tolist())
        xors, pairs = [], []

    def tile(values):
        if len(values) > 64:
            yield from forest(values)
        elif len(values) > 1:
            i, j = np.triu_indices(len(values), 1)
            xors.append(values[i] ^ values[j])
            pairs.append(np.stack([values[i], values[j]], axis=1))
            if sum(map(len, xors)) > 1 << 16:
                yield from small()

    def record(found):
        table = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], names=["a", "b"])

    for batch in batches:
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
        fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        found = []
        for s, e in zip([0, *ends], [*ends, len(fp)], strict=True):
            if kept_key is not None and (key[s] != kept_key).any():
                found += tile(np.concatenate(kept))
                kept = []
            kept_key = key[s]
            kept.append(fp[s:e])
        if found:
            yield record(found)
    found = list(tile(np.concatenate(kept))) if kept else []
    found += small()
    if found:
        yield record(found)


def _tables() -> list[int]:
    """Masks of two blocks each."""
    masks, at = [], 0
    for width in BLOCKS:
        masks.append(((1 << width) - 1) << at)
        at += width
    return [a | b for a, b in combinations(masks, 2)]


def fingerprint_links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) whose connected groups are those of all pairs at three or fewer bits.

    Every fingerprint goes to ten buckets, one per pair of its five blocks; two within
    three bits share at least one. A bucket with over ``tile`` rows is cut into tiles of
    which each pair meets, so no task holds more, and all its pairs are still compared.
    """
    signed = [m - (1 << 64) if m >> 63 else m for m in _tables()]
    placed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    sizes = placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cut = placed.join(sizes, ["t", "key"]).withColumn("g", F.ceil(F.col("n") / tile).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    tiles = cut.select("t", "key", "fp", own.alias("c"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("d")).select(
        "t", "key", (F.least("c", "d") * (1 << 20) + F.greatest("c", "d")).alias("tile"), "fp"
    )
    dealt = tiles.repartition("t", "key", "tile").sortWithinPartitions("t", "key", "tile")
    return dealt.mapInArrow(_links, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Near-duplicate groups: one row per document, with row, doc_id, fingerprint, component_id and root.

    Fingerprints of whole texts are computed once and settled. Equal fingerprints are met
    by an aggregate before anything is compared, so a group of copies counts once. Links
    between different fingerprints come from ``fingerprint_links``; ``connected`` joins
    them to groups. component_id is the smallest identifier of the group, root its least
    fingerprint as a signed number.

    A null or empty text has fingerprint zero and links like any other. Rows with a null
    identifier are part of their group but never name it; a group of such rows only has a
    null component_id. ``row`` numbers the rows of ``docs`` in scan order. Other columns
    are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = numbered.select(F.struct("row", "doc_id").alias("row"), F.col("text").cast("binary").alias("text"))
    prints = settled(
        keyed.mapInArrow(_fingerprints(words), "row struct<row: long, doc_id: long>, fp long").select("row.row", "row.doc_id", "fp"), "simhash"
    )
    bound_batches(spark, 1 << 16)
    distinct = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "prints")
    groups = connected(fingerprint_links(distinct), "a", "b").withColumnsRenamed({"node": "fp"})
    rooted = distinct.join(groups, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "root", "component_id")
    return prints.join(named, "fp").select("row", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def near_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row of its smallest identifier stays.

    Of several rows with that identifier the first stays, and of a group without any
    identifier its first row. ``docs`` must be a stable table: it is scanned twice, and its
    rows are numbered in scan order. All columns are kept, whatever their names.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    stays = simhash_groups(docs, id_col, text_col, words).groupBy("root").agg(F.min_by("row", order).alias("row"))
    number = "row" if "row" not in docs.columns else "_row_" + "_".join(docs.columns)
    kept = stays.select(F.col("row").alias(number))
    return docs.withColumn(number, F.monotonically_increasing_id()).join(kept, number, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
