"""Repeated passages: shard Burrows-Wheeler transforms merged by interleave refinement.

A string of ``LENGTH`` bytes is repeated if it starts anywhere else too. The strings of a
corpus are first divided by an anchor that their content fixes: of the 100-byte grams
inside a string, the one with the least hash, the leftmost if there are several. Equal
strings have equal anchors, and consecutive strings of a text with one anchor form a run.
Only runs whose anchor occurs twice can hold a repeat, and only where runs of one anchor
differ does it take suffix order to tell which of their strings repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from alertloom.llm.common import bound_batches, settled

LENGTH = 200
GRAM = 100
WINDOW = LENGTH - GRAM + 1
#: Strings of a text that are hashed at a time; positions inside such a piece take 21 bits.
PIECE = 1 << 20
PLACE = (1 << 21) - 1
#: Distinct runs of one anchor that one task orders together; beyond it each string is counted by itself.
GROUP = 2048
#: Bytes of a shard whose transform is made by sorting, and of a batch of shards that are merged.
SHARD = 1 << 18
BATCH = 1 << 20
# Depths of the refinement: each doubles what is compared, the last reaches LENGTH.
FIRST = 7
STEPS = (7, 14, 28, 56, LENGTH - 112)


def _tables():
    import numpy as np

    base = 0x9E3779B97F4A7C15
    up, down = (np.full(PIECE + LENGTH, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _grams(data, up, down):
    """Hashes of all grams from prefix sums modulo 2**64."""
    import numpy as np

    symbols = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * down[: len(symbols)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * up[: len(symbols) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def runs(data: bytes, tables):
    """(start, strings, anchor hash) of a text's runs, as arrays."""
    import numpy as np

    starts, sizes, anchors = [], [], []
    for offset in range(0, len(data) - LENGTH + 1, PIECE):
        h = _grams(data[offset : offset + PIECE + LENGTH - 1], *tables)
        strings = len(h) - WINDOW + 1
        # The least of hash and place over a sliding window, from minima of blocks read both ways.
        key = np.full(-(-len(h) // WINDOW) * WINDOW, np.uint64(0xFFFFFFFFFFFFFFFF))
        key[: len(h)] = h & np.uint64(~PLACE & 0xFFFFFFFFFFFFFFFF) | np.arange(len(h), dtype=np.uint64)
        blocks = key.reshape(-1, WINDOW)
        ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        place = np.minimum(behind[:strings], ahead[WINDOW - 1 : WINDOW - 1 + strings]) & np.uint64(PLACE)
        first = np.flatnonzero(np.diff(place.astype(np.int64), prepend=-1))
        starts.append(first + offset)
        sizes.append(np.diff(first, append=strings))
        anchors.append(h[place[first]])
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(anchors)


def _find_runs(batches):
    import numpy as np
    import pyarrow as pa
    import xxhash

    tables = _tables()
    for batch in batches:
        rows, columns = [], []
        for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if data is None or len(data) < LENGTH:
                continue
            start, size, anchor = runs(data, tables)
            bounds = zip(start.tolist(), (start + size + LENGTH - 1).tolist(), strict=True)
            content = np.array([xxhash.xxh3_64_intdigest(data[s:e]) for s, e in bounds], np.uint64)
            columns.append((start, size, anchor.view(np.int64), content.view(np.int64)))
            rows.append(np.full(len(start), row, np.int64))
        if rows:
            start, size, anchor, content = (np.concatenate(c) for c in zip(*columns, strict=True))
            arrays = [np.concatenate(rows), start.astype(np.int64) << 21 | size, anchor, content]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["row", "at", "anchor", "content"])


@dataclass
class Transform:
    """Suffixes of a text in order of their first LENGTH symbols, and what stands before each: its BWT."""

    symbols: object
    order: object
    before: object


def _heads(symbols):
    """The first seven symbols at each place, as one number of nine bits each."""
    import numpy as np

    padded = np.concatenate([symbols, np.zeros(LENGTH + FIRST, np.int64)])
    head = np.zeros(len(symbols), np.int64)
    for k in range(FIRST):
        head = head << 9 | padded[k : k + len(symbols)]
    return head


def _ranks(keys, order, n: int):
    """Dense ranks by place, from keys that ``order`` sorts."""
    import numpy as np

    rank = np.zeros(n + LENGTH, np.int64)
    rank[order] = np.cumsum(np.diff(keys, prepend=keys[:1]) != 0) + 1
    return rank


def transform(symbols) -> Transform:
    """The transform of one shard, by sorting with doubled prefixes. Symbol 0 ends a context."""
    import numpy as np

    n, head = len(symbols), _heads(symbols)
    order = np.argsort(head, kind="stable")
    rank = _ranks(head[order], order, n)
    for step in STEPS:
        key = rank[:n] * (n + 1) + rank[step : step + n]
        order = np.argsort(key, kind="stable")
        rank = _ranks(key[order], order, n)
    return Transform(symbols, order, symbols[order - 1])


def merge(a: Transform, b: Transform) -> tuple[Transform, object]:
    """Merge two transforms by refining their interleave; also the ranks by place of the merged text.

    The first interleave compares seven symbols. Each refinement takes the ranks that the
    last one gave: inside a transform they are already in order, so it only re-interleaves
    two ordered lists and never sorts suffixes. Places with equal ranks at the end share a
    prefix of LENGTH symbols.
    """
    import numpy as np

    symbols = np.concatenate([a.symbols, b.symbols])
    n, cut = len(symbols), len(a.symbols)
    apart = np.concatenate([a.order, b.order + cut])
    # Heads and later keys stop at the border between the two texts.
    keys = np.concatenate([_heads(a.symbols)[a.order], _heads(b.symbols)[b.order]])
    rank = None
    for step in (None, *STEPS):
        if step is not None:
            after = apart + step
            follow = rank[after]
            follow[: len(a.order)][after[: len(a.order)] >= cut] = 0
            keys = rank[apart] * (n + 1) + follow
        interleave = np.argsort(keys, kind="stable")  # merges two runs that are in order
        rank = _ranks(keys[interleave], apart[interleave], n)
    order = apart[interleave]
    return Transform(symbols, order, np.concatenate([a.before, b.before])[interleave]), rank


def repeated_starts(contexts: list[bytes]) -> list:
    """For each context which of its strings occur twice or more among all of them, as boolean arrays."""
    import numpy as np

    shards, part, size = [], [], 0
    for k, c in enumerate(contexts):
        part.append(np.concatenate([np.frombuffer(c, np.uint8).astype(np.int64) + 1, [0]]))
        size += len(c) + 1
        if size >= SHARD or k == len(contexts) - 1:
            shards.append(transform(np.concatenate(part)))
            part, size = [], 0
    rank = None
    while len(shards) > 1:
        merged = [merge(shards[i], shards[i + 1]) for i in range(0, len(shards) - 1, 2)]
        rank = merged[0][1]
        shards = [m[0] for m in merged] + shards[len(merged) * 2 :]
    n = len(shards[0].symbols)
    if rank is None:
        rank = merge(shards[0], transform(np.zeros(1, np.int64)))[1]
    often = np.bincount(rank[:n])[rank[:n]] > 1
    out, at = [], 0
    for c in contexts:
        out.append(often[at : at + len(c) - LENGTH + 1])
        at += len(c) + 1
    return out


def _judge(batches):
    """Stream over contexts sorted by anchor; a batch of whole anchors is judged together."""
    import numpy as np
    import pyarrow as pa

    held, size, last = [], 0, None

    def judged():
        flags = repeated_starts([c for _, _, c in held])
        packed = [np.packbits(f, bitorder="little").tobytes() for f in flags]
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, _, _ in held], pa.int64()), pa.array([c for _, c, _ in held], pa.int64()), pa.array(packed, pa.binary())],
            names=["anchor", "content", "flags"],
        )

    for batch in batches:
        for anchor, content, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if size >= BATCH and anchor != last:
                yield judged()
                held, size = [], 0
            held.append((anchor, content, data))
            size, last = size + len(data), anchor
    if held:
        yield judged()


def _cut_contexts(batches):
    """Bytes of each run that a text stands for."""
    import pyarrow as pa
    import zstandard

    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        for packed, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data, out = plain.decompress(packed), []
            for w in wanted:
                start, size = w["at"] >> 21, w["at"] & PLACE
                out.append((w["anchor"], w["content"], data[start : start + size + LENGTH - 1], w["often"], w["crowd"]))
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["anchor", "content", "data", "often", "crowd"])


def _strings(batches):
    """Every string of a context by its hash, for anchors with very many contexts."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    for batch in batches:
        for anchor, content, data, often in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            n = len(data) - LENGTH + 1
            names = b"".join(xxhash.xxh3_128_digest(data[k : k + LENGTH]) for k in range(n))
            both = np.frombuffer(names, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array([anchor] * n), pa.array([content] * n), pa.array(range(n), pa.int32()), pa.array([2 if often else 1] * n, pa.int64())],
                names=["x", "y", "anchor", "content", "k", "n"],
            )


def _pack(batches):
    import pyarrow as pa
    import zstandard

    small = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [small.compress(d or b"") for d in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc", "packed"])


def _remove(batches):
    """Cut the bytes that a repeated string covers."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        docs, packed, hits = (batch.column(i).to_pylist() for i in range(3))
        sizes, spans, kept = [], [], []
        for p, found in zip(packed, hits, strict=True):
            data = plain.decompress(p)
            sizes.append(len(data))
            if not found:
                spans.append([])
                kept.append(data)
                continue
            change = np.zeros(len(data) + 1, np.int32)
            for f in found:
                start, size = f["at"] >> 21, f["at"] & PLACE
                flags = np.ones(size, bool) if f["flags"] is None else np.unpackbits(np.frombuffer(f["flags"], np.uint8), bitorder="little")[:size].astype(bool)
                at = start + np.flatnonzero(flags)
                change[at] += 1
                change[at + LENGTH] -= 1
            covered = np.cumsum(change[:-1]) > 0
            edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
            spans.append([{"start": int(s), "stop": int(e)} for s, e in zip(edges[::2], edges[1::2], strict=True)])
            kept.append(np.frombuffer(data, np.uint8)[~covered].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"]
        )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte that a repeated 200-byte string covers: doc_id, n_bytes, spans, kept (bytes).

    1. One scan finds the runs of every text; an aggregate finds anchors that occur twice.
    2. Runs of such an anchor with equal content repeat whole. Where an anchor's runs
       differ, one text of each distinct run is cut out.
    3. These contexts are dealt out by anchor. A task makes shard transforms, merges them,
       and reads off which strings repeat. An anchor with over ``GROUP`` distinct runs, as
       a passage in a third of all documents has, is not gathered: its strings are counted
       one by one, by an aggregate.
    4. Verdicts go back to all runs by (anchor, content), and to the texts by row.

    Texts are taken as UTF-8 bytes and strings never cross texts; ``kept`` may hold parts
    of characters. Runs and strings are told apart by 128 bits of hashes. A null text
    counts as empty and texts under 200 bytes are kept whole. Rows with equal texts repeat
    each other; null identifiers are carried as they are. Rows are numbered in scan order,
    so ``docs`` must be a stable table. Other columns are not read. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    number = F.monotonically_increasing_id().alias("row")
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data")
    found = settled(docs.select(number, data).mapInArrow(_find_runs, "row long, at long, anchor long, content long"), "runs")
    twice = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    likely = settled(found.join(twice, "anchor"), "likely")

    distinct = likely.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at")).alias("one"))
    distinct = settled(distinct, "distinct")
    crowds = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    unlike = distinct.join(crowds, "anchor").select("one.row", F.struct("one.at", "anchor", "content", (F.col("n") > 1).alias("often"), "crowd").alias("w"))
    packed = docs.select(F.struct(number, F.col(id_col).cast("long").alias("doc_id")).alias("doc"), data).mapInArrow(
        _pack, "doc struct<row: long, doc_id: long>, packed binary"
    ).select("doc.row", "doc.doc_id", "packed")
    wanted = unlike.groupBy("row").agg(F.collect_list("w").alias("wanted"))
    contexts = settled(
        packed.join(wanted, "row").select("packed", "wanted").mapInArrow(_cut_contexts, "anchor long, content long, data binary, often boolean, crowd long"), "contexts"
    )
    bound_batches(spark, 1 << 14)
    ordered = contexts.where(F.col("crowd") <= GROUP).select("anchor", "content", "data").repartition("anchor").sortWithinPartitions("anchor", "content")
    judged = ordered.mapInArrow(_judge, "anchor long, content long, flags binary")

    strings = contexts.where(F.col("crowd") > GROUP).select("anchor", "content", "data", "often").mapInArrow(
        _strings, "x long, y long, anchor long, content long, k int, n long"
    )
    often = strings.groupBy("x", "y").agg(F.sum("n").alias("n")).where("n > 1").select("x", "y")
    # Flags of a run as bytes of eight strings, the first in the lowest bit.
    bits = strings.join(often, ["x", "y"]).groupBy("anchor", "content", F.floor(F.col("k") / 8).alias("byte")).agg(
        F.sum(F.expr("shiftleft(1L, pmod(k, 8))")).alias("bits")
    )
    counted = bits.groupBy("anchor", "content").agg(F.map_from_entries(F.collect_list(F.struct(F.col("byte").cast("int"), "bits"))).alias("m"))
    counted = counted.select(
        "anchor", "content",
        F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(WINDOW // 8)), lambda b: F.lpad(F.hex(F.coalesce(F.try_element_at("m", b), F.lit(0))), 2, "0")), "")).alias("flags"),
    )
    crowded = contexts.where(F.col("crowd") > GROUP).select("anchor", "content").join(counted, ["anchor", "content"], "left").select(
        "anchor", "content", F.coalesce("flags", F.lit(bytes(WINDOW // 8 + 1))).alias("flags")
    )
    # A run that stands in two places repeats whole, which null says.
    single = distinct.select("anchor", "content", (F.col("n") > 1).alias("whole"))
    verdicts = single.join(judged.union(crowded), ["anchor", "content"], "left").select("anchor", "content", F.when(~F.col("whole"), F.col("flags")).alias("flags"), "whole")
    verdicts = settled(verdicts.where(F.col("whole") | (F.ltrim(F.hex("flags"), F.lit("0")) != "")).drop("whole"), "verdicts")

    bound_batches(spark)
    hits = likely.join(verdicts, ["anchor", "content"]).groupBy("row").agg(F.collect_list(F.struct("at", "flags")).alias("hits"))
    return packed.join(hits, "row", "left").select("doc_id", "packed", "hits").mapInArrow(
        _remove, "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary"
    )
