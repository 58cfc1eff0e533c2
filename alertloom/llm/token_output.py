"""Token ids in canonical length-limited Huffman blocks with bit-offset checkpoints.

The format is a folder of three Parquet tables, so that Spark's commit protocol, any file
system and any number of readers apply:

blocks    shard, block, start (ids of the shard before it), doc_ids, doc_tokens,
          n_tokens, payload (code bits, most significant first) and gaps (bits of each run
          of 128 ids but the last, as little-endian 16-bit integers). A block holds whole
          documents and is decoded without any other block.
codebook  id, bits: lengths of the canonical code; the codes follow from them.
shards    shard, start: ids in all shards before it.

Shards and blocks follow ascending identifiers.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from alertloom.llm.common import bound_batches, settled

MAX_BITS = 16
_SPACE = re.compile(r"\s")
RUN = 128
#: Ids after which a block ends; a longer document is a block of its own.
BLOCK = 1 << 16
#: Words and pieces whose ids a worker remembers, some 200 bytes each.
CACHE = 700_000
#: Characters of a text that are cut into pieces at a time.
PIECE = 1 << 20

# Characters for which case, composition and class are the same in every library.
_PLAIN_CHARS = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x130)) if c != 0xAD]
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f]*")


def _plain_class(kind: str) -> str:
    """The plain characters of a Unicode class, as the inside of a bracket expression."""
    return "".join(re.escape(c) for c in _PLAIN_CHARS if unicodedata.category(c)[0] == kind)


# Byte-level files write the printable Latin-1 characters as they are, and the other bytes from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class _Memory(dict):
    """Ids by text; what is missing is made, and a full memory starts anew."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        found = self[key] = self.make(key)
        return found


class Encoder:
    """``tokenizers`` with a memory for words and pieces.

    A byte-level BPE file cuts a text into pieces, none of which spans white space, and
    encodes each by itself, so each distinct piece goes through the library's model once
    while it is remembered. A text with characters on which libraries may differ, or with one of the file's special
    strings, and any text of a file of another build, goes through the library whole.
    """

    def __init__(self, source: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.size = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.width = f"<u{self.size}"
        spec = json.loads(source)
        self.special = [t["content"].lower() for t in spec.get("added_tokens") or []]
        self.cut = self._pieces_of(spec)
        pieces = _Memory(self._piece)
        self.words = _Memory(lambda word: b"".join([pieces[p] for p in self.cut.findall(word)]))

    @staticmethod
    def _pieces_of(spec: dict):
        """The file's own expression for pieces, over plain characters; None for files of another build."""
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != ["NFC", "Replace", "Lowercase"] or [s.get("type") for s in pre] != ["Split", "ByteLevel"]:
            return None
        if pre[0]["behavior"] != "Removed" or not pre[0]["invert"] or pre[1]["add_prefix_space"] or pre[1]["use_regex"]:
            return None
        pattern = pre[0]["pattern"]["Regex"].replace(r"\p{L}", _plain_class("L")).replace(r"\p{N}", _plain_class("N"))
        return None if r"\p" in pattern else re.compile(pattern)

    def _piece(self, piece: str) -> bytes:
        # The model's alphabet is the file's byte-level one: a character for each byte.
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return b"".join([t.id.to_bytes(self.size, "little") for t in self.library.model.tokenize(spelled)])

    def _bytes(self, encoding) -> bytes:
        import numpy as np

        return np.array(encoding.ids, self.width).tobytes()

    def encode(self, text: str) -> bytes:
        lower = text.lower()
        if self.cut is None or not _PLAIN.fullmatch(text) or any(s in lower for s in self.special):
            return self._bytes(self.library.encode(text, add_special_tokens=False))
        parts, at = [], 0
        while at < len(lower):
            end = len(lower)
            if at + PIECE < end:
                space = _SPACE.search(lower, at + PIECE)
                end = space.start() if space else end
            words = lower[at:end].split()
            known = self.words
            parts.append(b"".join([known[w] for w in words]))
            at = end
        return b"".join(parts)


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(source: str) -> Encoder:
    """The encoder of this worker process, which outlives a task."""
    key = hash(source)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(source)
    return _ENCODERS[key]


def _tokenise(source, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoder = encoder_of(source.value)
        end = np.array([end_id], encoder.width).tobytes()
        for batch in batches:
            ids = [encoder.encode(t or "") + end for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc", "ids"])

    return run


def _count(width: str, size: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), width), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["id", "n"])

    return run


def code_lengths(counts: dict[int, int], limit: int = MAX_BITS) -> dict[int, int]:
    """Bits of an optimal prefix code without codes over ``limit`` bits, by package-merge.

    The list of a level holds the symbols and the pairs of the level below, by weight. Of
    the last level the first 2n - 2 are taken, and of each level below the members of the
    taken pairs; a symbol's length is the number of levels it is taken in.
    """
    import numpy as np

    if not counts:
        return {}
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    n = len(symbols)
    if n == 1:
        return {symbols[0]: 1}
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit {limit} bits")
    leaves = np.array([counts[s] for s in symbols], np.int64)
    weights, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        even = len(weights) // 2 * 2
        both = np.concatenate([leaves, weights[0:even:2] + weights[1:even:2]])
        order = np.argsort(both, kind="stable")
        weights = both[order]
        levels.append(order < n)
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):
        own = int(leaf[:taken].sum())
        lengths[:own] += 1
        taken = 2 * (taken - own)
    return {s: int(b) for s, b in zip(symbols, lengths, strict=True)}


class Code:
    """The canonical code of the lengths: codes ascend by (length, id)."""

    def __init__(self, lengths: dict[int, int]):
        import numpy as np

        self.lengths, size = lengths, max(lengths, default=0) + 1
        self.bits, self.codes = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        code = last = 0
        symbols, spans = [], []
        for symbol in sorted(lengths, key=lambda s: (lengths[s], s)):
            code <<= lengths[symbol] - last
            last = lengths[symbol]
            self.bits[symbol], self.codes[symbol] = last, code
            symbols.append(symbol)
            spans.append(1 << (MAX_BITS - last))
            code += 1
        self.symbol_of = np.repeat(np.array(symbols, np.uint32), spans)
        self.bits_of = np.repeat(np.array([lengths[s] for s in symbols], np.int64), spans)
        rest = (1 << MAX_BITS) - len(self.symbol_of)  # a code of one symbol leaves half the table unused
        self.symbol_of = np.pad(self.symbol_of, (0, rest))
        self.bits_of = np.pad(self.bits_of, (0, rest), constant_values=1)

    def pack(self, ids) -> tuple[bytes, bytes]:
        """(payload, gaps) of at least one id: every 64-bit word is the OR of the codes that begin in it."""
        import numpy as np

        bits = self.bits[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        word, room = starts >> 6, 64 - (starts & 63) - bits
        codes = self.codes[ids]
        inside = room >= 0
        high = np.where(inside, codes << np.maximum(room, 0).astype(np.uint64), codes >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words = np.zeros(int(ends[-1] - 1 >> 6) + 1, np.uint64)
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(~inside)
        words[word[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
        gaps = np.diff(starts[::RUN]).astype("<u2").tobytes()
        return words.byteswap().tobytes()[: -(-int(ends[-1]) // 8)], gaps

    def unpack(self, payload: bytes, gaps: bytes, n: int):
        """All runs of a block at once: each step looks up one id of every run in the table."""
        import numpy as np

        at = np.concatenate([[0], np.cumsum(np.frombuffer(gaps, "<u2").astype(np.int64))])
        raw = np.frombuffer(payload + bytes(RUN * MAX_BITS // 8 + 3), np.uint8).astype(np.uint32)
        windows = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        out = np.empty((len(at), RUN), np.uint32)
        for k in range(min(RUN, n)):
            seen = windows[at >> 3] >> (8 - (at & 7)).astype(np.uint32) & 0xFFFF
            out[:, k] = self.symbol_of[seen]
            at = at + self.bits_of[seen]
        return out.reshape(-1)[:n]


def _write_blocks(lengths, width: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        code, shard, start, number = Code(lengths.value), TaskContext.get().partitionId(), 0, 0
        docs, parts, size = [], [], 0

        def block():
            nonlocal docs, parts, size, start, number
            payload, gaps = code.pack(np.concatenate(parts))
            row = {"shard": shard, "block": number, "start": start, "doc_ids": docs, "doc_tokens": [len(p) for p in parts], "n_tokens": size, "payload": payload, "gaps": gaps}
            start, number = start + size, number + 1
            docs, parts, size = [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([
            ("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
            ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("payload", pa.binary()), ("gaps", pa.binary()),
        ])
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(ids.as_buffer(), width)
                if size and size + len(ids) > BLOCK:
                    yield block()
                docs.append(doc)
                parts.append(ids)
                size += len(ids)
        if size:
            yield block()

    return run


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> None:
    """Encode every whole text, append ``end_id``, and write all ids in ascending order of the identifier.

    ``tokenizer`` is the path of a tokenizer file on the driver; its content goes to the
    tasks. Texts are encoded once and settled; counts of all ids give the code, of which
    there are at most as many as the vocabulary has entries. Then the ids are dealt out by
    ranges of (identifier, content, row), so that even one repeated identifier spreads, and
    each range becomes a shard.

    A null text counts as empty and yields the end id alone. Null identifiers come first.
    Rows with equal identifiers stand next to each other, in the order of a content hash.
    Other columns are not read. An empty table gives empty tables.
    """
    from tokenizers import Tokenizer

    if not 1 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits is at most {MAX_BITS}")
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    size = max(Tokenizer.from_str(source).get_vocab_size(), end_id + 1)
    width = "<u2" if size <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(source)
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row")).alias("doc"), F.col(text_col).cast("string").alias("text"))
    tokens = settled(rows.mapInArrow(_tokenise(shared, end_id), "doc struct<doc_id: long, row: long>, ids binary").select("doc.doc_id", "doc.row", "ids"), "tokens")
    counts = tokens.select("ids").mapInArrow(_count(width, size), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    lengths = code_lengths({r["id"]: r["n"] for r in counts}, max_bits)
    spark.createDataFrame(sorted(lengths.items()), "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
    dealt = tokens.withColumn("h", F.xxhash64("ids")).repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    blocks = dealt.select("doc_id", "ids").mapInArrow(
        _write_blocks(spark.sparkContext.broadcast(lengths), width),
        "shard int, block int, start long, doc_ids array<long>, doc_tokens array<long>, n_tokens long, payload binary, gaps binary",
    )
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    # One row per shard, and there are no more shards than shuffle partitions.
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    starts, total = [], 0
    for r in sorted(sizes):
        starts.append((r["shard"], total))
        total += r["n"]
    spark.createDataFrame(starts, "shard int, start long").coalesce(1).write.parquet(f"{path}/shards")


def _read_blocks(lengths, starts):
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        code, first = Code(lengths.value), starts.value
        names = ["doc_id", "start", "n_tokens", "ids"]
        for batch in batches:
            for row in batch.to_pylist():
                ids = code.unpack(row["payload"], row["gaps"], row["n_tokens"]).astype("<u4")
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                texts = [ids[e - n : e].tobytes() for n, e in zip(sizes, ends, strict=True)]
                begins = first[row["shard"]] + row["start"] + ends - sizes
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(begins), pa.array(sizes), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Read the format back: doc_id, start (ids before it in the whole output), n_tokens, ids.

    ``ids`` holds little-endian unsigned 32-bit integers. Blocks are decoded independently.
    The codebook and the list of shards are bounded by the vocabulary and by the number of
    shuffle partitions of the writer.
    """
    bound_batches(spark, 64)
    lengths = {r["id"]: r["bits"] for r in spark.read.parquet(f"{path}/codebook").collect()}
    starts = {r["shard"]: r["start"] for r in spark.read.parquet(f"{path}/shards").collect()}
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "start", "doc_ids", "doc_tokens", "n_tokens", "payload", "gaps")
    share = spark.sparkContext.broadcast
    return blocks.mapInArrow(_read_blocks(share(lengths), share(starts)), "doc_id long, start long, n_tokens long, ids binary")
