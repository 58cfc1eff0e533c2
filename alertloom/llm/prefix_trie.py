"""Conversation prefix trie: an Euler tour, ranked as a linked list, gives subtree sums as differences of prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from alertloom.llm.common import bound_batches, settled

#: Conversations of one family take their first turns from the one whose number divides by this, up to MOST - 1 of them.
FAMILY, MOST = 5, 9
#: Consecutive rows that one window or run lookup holds.
BLOCK = 8192
#: Turns of one conversation that one window holds.
STRETCH = 256
#: Arcs that one task ranks when a list has been contracted to so few.
GATHER = 1 << 15
#: Identifiers that are joined to one text before a node's digest runs over the texts.
CHUNK = 4096
LANES = 4


def in_order(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add ``name``: 0, 1, 2, … in the order of ``keys``, which must tell rows apart.

    Rows are range-partitioned, so a common leading key spreads over many partitions; the
    numbers of rows in the partitions before are one row a partition.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = settled(dealt.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    # One row for each partition.
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_before")


def _runs(df: DataFrame, key: str, at: str) -> DataFrame:
    """(_block, key, _low, _high) of the runs of equal keys in each block of ``BLOCK`` consecutive numbers."""
    return df.groupBy(F.floor(F.col(at) / BLOCK).alias("_block"), key).agg(F.min(at).alias("_low"), F.max(at).alias("_high"))


def _look_up(df: DataFrame, runs: DataFrame, facts: DataFrame, key: str, at: str) -> DataFrame:
    """Join ``facts``, one row a key, to all rows through the runs, so that a common key is as many keys as blocks."""
    return df.withColumn("_block", F.floor(F.col(at) / BLOCK)).join(runs.select("_block", key).join(facts, key), ["_block", key]).drop("_block")


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, g (a number in the order of conversations and turns), digest, size of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("_row"))
    return in_order(rows, ["conv_id", "turn", "digest", "_row"], "g").select("conv_id", "g", "digest", "size")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after the first turns are exchanged.

    Of each conversation its number and length; of each turn conv_id, q (its place from 0),
    digest of role and text, size in bytes, and whether it is the last.
    """
    turns = settled(_turns(conversations), "turns")
    runs = _runs(turns, "conv_id", "g")
    own = runs.groupBy("conv_id").agg(F.min("_low").alias("start"), (F.max("_high") - F.min("_low") + 1).alias("n"))
    own = own.withColumns({"base": F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY)), "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST})
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("_n"))
    taken = F.least("h", F.coalesce("_n", F.lit(0)))
    named = settled(own.join(bases, "base", "left").withColumn("k", taken).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("_n"), "conversations")
    placed = settled(_look_up(turns, runs, named, "conv_id", "g").withColumn("pos", F.col("g") - F.col("start")), "placed")
    after = placed.where("pos >= h").select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("q"), "digest", "size", "length")
    heads = placed.where(F.col("pos") < MOST - 1).select(F.col("conv_id").alias("base"), "pos", "digest", "size")
    given = named.select("conv_id", "base", "k", "length").join(heads, "base").where("pos < k").select("conv_id", F.col("pos").alias("q"), "digest", "size", "length")
    rows = after.unionByName(given)
    return named.select("conv_id", "length"), rows.select("conv_id", "q", "digest", "size", (F.col("q") + 1 == F.col("length")).alias("last"))


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws("/", depth, *sums)))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, size, last: of each first d turns a key that tells different sequences apart.

    Place and digest of a turn give ``LANES`` numbers of 32 bits, and a key is made from
    their sums over the first d turns, so long conversations are added up by stretches.
    """
    lanes = [f"l{k}" for k in range(LANES)]
    mixed = turns.select("*", F.floor(F.col("q") / STRETCH).alias("_stretch"), *[F.xxhash64("digest", "q", F.lit(k)).bitwiseAND(F.lit((1 << 32) - 1)).alias(x) for k, x in enumerate(lanes)])
    totals = mixed.groupBy("conv_id", "_stretch").agg(*[F.sum(x).alias(x) for x in lanes])
    earlier = Window.partitionBy("conv_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv_id", "_stretch", *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"_{x}") for x in lanes])
    upto = Window.partitionBy("conv_id", "_stretch").orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = mixed.select("conv_id", "_stretch", "q", "size", "last", *lanes, *[F.sum(x).over(upto).alias(f"s{x}") for x in lanes])
    joined = inside.join(before, ["conv_id", "_stretch"])
    sums = [F.col(f"s{x}") + F.col(f"_{x}") for x in lanes]
    return joined.select(
        "conv_id", (F.col("q") + 1).alias("depth"), _key(F.col("q") + 1, sums).alias("key"),
        _key(F.col("q"), [s - F.col(x) for s, x in zip(sums, lanes, strict=True)]).alias("parent"), "size", "last",
    )


def _walk(batches):
    """Ranks of one whole list (arc, next, w): the weights on the way from its head."""
    import numpy as np
    import pyarrow as pa

    tables = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
    if not tables:
        return
    arc, follows, w = (np.concatenate(c) for c in zip(*tables, strict=True))
    order = np.argsort(arc)
    arc, follows, w = arc[order], follows[order], w[order]
    at = np.searchsorted(arc, follows)
    ends = follows < 0
    headless = np.ones(len(arc), bool)
    headless[at[~ends]] = False
    (here,) = np.flatnonzero(headless)
    ranks, rank = np.empty(len(arc), np.int64), 0
    while True:
        ranks[here] = rank
        if ends[here]:
            break
        rank, here = rank + w[here], at[here]
    yield pa.RecordBatch.from_arrays([pa.array(arc), pa.array(ranks)], names=["arc", "rank"])


def list_ranks(arcs: DataFrame, gather: int | None = None) -> DataFrame:
    """(arc, rank): the place from 0 of each arc of one linked list (arc, next), whose end has next -1.

    The list is contracted: in each round every arc tosses a coin, and an arc with heads
    whose predecessor has tails is spliced out. About a quarter goes, so all rounds
    together shuffle a few times the list; pointers never jump over the whole list.
    When ``gather`` arcs are left, one task walks them, and the rounds are undone in reverse.
    Rounds are settled, so a lost executor costs one round.
    """
    gather = GATHER if gather is None else gather
    live, rounds = arcs.select("arc", "next", F.lit(1).cast("long").alias("w")), []
    live = settled(live, "list")
    while live.count() > gather:
        coin = lambda c: (F.col(c) >= 0) & (F.xxhash64(F.lit(len(rounds)), c).bitwiseAND(F.lit(1)) == 1)  # noqa: B023, E731
        before = live.where(~coin("arc") & coin("next")).select(F.col("arc").alias("u"), F.col("next").alias("arc"), F.col("w").alias("uw"))
        met = settled(live.where(coin("arc")).join(before, "arc", "left"), "spliced")
        stay = live.where(~coin("arc") & ~coin("next")).unionByName(met.where("u IS NULL").select("arc", "next", "w"))
        live = settled(stay.unionByName(met.where("u IS NOT NULL").select(F.col("u").alias("arc"), "next", (F.col("uw") + F.col("w")).alias("w"))), "list")
        rounds.append(met.where("u IS NOT NULL").select("arc", "u", "uw"))
    # No more than ``gather`` arcs.
    ranks = settled(live.coalesce(1).mapInArrow(_walk, "arc long, rank long"), "ranks")
    for gone in reversed(rounds):
        known = ranks.select(F.col("arc").alias("u"), "rank")
        ranks = settled(ranks.unionByName(gone.join(known, "u").select("arc", (F.col("rank") + F.col("uw")).alias("rank"))), "ranks")
    return ranks


def _joined_ids(batches):
    """Chunks (key, part, seq, ids) of comma-joined numbers; rows come in the order of key and number."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, seq, own, ids = TaskContext.get().partitionId(), 0, None, []

    def record(key, ids):
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([",".join(map(str, ids))])], names=["key", "part", "seq", "ids"])

    for batch in batches:
        for key, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (key != own or len(ids) == CHUNK):
                yield record(own, ids)
                seq, ids = seq + 1, []
            own = key
            ids.append(number)
    if ids:
        yield record(own, ids)


def _digests(batches):
    """(key, ends_sha256): chunks come in the order of key and place, and only a hash state is held."""
    import hashlib

    import pyarrow as pa

    def record(key, state):
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    own, state = None, None
    for batch in batches:
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is not None and key == own:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                yield record(own, state)
            own, state = key, hashlib.sha256(ids.encode())
    if state is not None:
        yield record(own, state)


def _subtotals(ranks: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, n_leaves, saved_tokens: differences of prefix sums at the arcs that enter and leave a node."""
    weighed = ranks.select("rank", (F.col("arc") % 2 == 0).alias("enters"), F.shiftright("arc", 1).alias("id")).join(nodes.select("id", "leaf", "saved"), "id")
    weighed = weighed.withColumns({"_block": F.floor(F.col("rank") / BLOCK), **{f"_{c}": F.when(F.col("enters"), F.col(c)).otherwise(0) for c in ("leaf", "saved")}})
    sums = weighed.groupBy("_block").agg(F.sum("_leaf").alias("_leaf"), F.sum("_saved").alias("_saved"))
    # One row for each block of arcs.
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_leaf", "_saved")])
    upto = Window.partitionBy("_block").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = weighed.select("_block", "id", "enters", "leaf", "saved", *[F.sum(c).over(upto).alias(c) for c in ("_leaf", "_saved")]).join(before, "_block")
    # What is added up between the arcs, the node's own included.
    part = lambda c: F.sum(F.when(F.col("enters"), F.col(c) - F.col(f"_{c}") - F.col(f"_{c}_before")).otherwise(F.col(f"_{c}") + F.col(f"_{c}_before")))
    return running.groupBy("id").agg(part("leaf").alias("n_leaves"), part("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, gather: int | None = None) -> DataFrame:
    """The trie of all rebuilt conversations, one row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    ``rebuilt`` exchanges first turns within families of ``FAMILY`` conversations. A node
    is a distinct sequence of first turns, and its conv_id the smallest conversation that
    starts with it. Nodes are numbered in the order of parent and conv_id, so children of one
    node have consecutive numbers, and first child, next sibling and parent give each
    enter and exit arc its successor. ``list_ranks`` turns that list into places, and
    prefix sums over the places give leaves and savings of every subtree.

    No conversation, node or family of siblings is gathered: turns are numbered by ranges,
    keys are sums over stretches, and common parents are looked up by blocks. The numbers that
    end at a node are hashed in order, in one task for a node but with a bounded state, as
    SHA-256 has no parallel form; they reach it as texts of ``CHUNK`` numbers.

    Turns are ordered by turn, null first, and equal turn numbers by the SHA-256 of role and text. Null
    roles and texts are empty. A row that stands twice is two turns. Rows without a
    conv_id are left out. Families go by the remainder that is not negative. A conversation that is left without turns
    belongs to the root. Other columns are not read; an empty table has no node, not even a root.
    """
    bound_batches(conversations.sparkSession, 1 << 14)
    members, turns = rebuilt(conversations)
    root = F.lit(b"root").cast("binary")
    rows = settled(prefixes(turns), "prefixes")
    zero = members.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("key"), F.lit(b"").alias("parent"), F.lit(0).cast("long").alias("size"), (F.col("length") == 0).alias("last"))
    # A first turn's parent is the root whatever its sums.
    rows = rows.withColumn("parent", F.when(F.col("depth") == 1, root).otherwise(F.col("parent"))).unionByName(zero)
    grouped = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"))
    numbered = settled(in_order(grouped, ["parent", "conv_id"], "id"), "nodes")

    runs = _runs(numbered, "parent", "id")
    families = runs.groupBy("parent").agg(F.min("_low").alias("first"), F.max("_high").alias("final"))
    above = numbered.select(F.col("key").alias("parent"), F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    families = settled(families.join(above, "parent", "left"), "families")
    with_parent = _look_up(numbered, runs, families.drop("first"), "parent", "id").drop("parent")
    children = families.select(F.col("parent").alias("key"), F.col("first").alias("child"), (F.col("final") - F.col("first") + 1).alias("n_children"))
    nodes = with_parent.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = settled(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("size")}), "tree")

    enter = F.struct((F.col("id") * 2).alias("arc"), F.when(F.col("child").isNull(), F.col("id") * 2 + 1).otherwise(F.col("child") * 2).alias("next"))
    onward = F.when(F.col("id") < F.col("final"), F.col("id") * 2 + 2).otherwise(F.coalesce(F.col("parent_id") * 2 + 1, F.lit(-1)))
    arcs = nodes.select(F.explode(F.array(enter, F.struct((F.col("id") * 2 + 1).alias("arc"), onward.alias("next")))).alias("x")).select("x.*")
    totals = _subtotals(list_ranks(arcs, gather), nodes)

    ends = rows.where("last").select("key", "conv_id")
    dealt = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = settled(dealt.mapInArrow(_joined_ids, "key binary, part long, seq long, ids string"), "ends")
    ordered = chunks.repartition("key").sortWithinPartitions("key", "part", "seq").select("key", "ids")
    digests = ordered.mapInArrow(_digests, "key binary, ends_sha256 string")
    both = nodes.join(totals, "id").join(digests, "key", "left")
    return both.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
