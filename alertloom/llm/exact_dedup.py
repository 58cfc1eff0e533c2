"""Exact de-duplication by Patricia tries over partitions of (length, content hash)."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from alertloom.llm.common import bound_batches, settled

#: Bytes that one trie holds in memory before it spills a subtree: its texts, and what its nodes take beside them.
TRIE_BYTES = 64 * 1024 * 1024
#: Bytes of a node with its children's table, its label's head and its terminal.
NODE_BYTES = 500
#: Rows of an input split that one trie takes; then its texts leave and a new one begins.
SPLIT_ROWS = 400_000


class Terminal:
    """What a trie keeps for one text: the smallest identifier, the count, and the rows seen."""

    __slots__ = ("best", "count", "rows")

    def __init__(self, best, count, rows):
        self.best, self.count, self.rows = best, count, rows

    def merge(self, best, count, rows):
        if best < self.best:
            self.best = best
        self.count += count
        self.rows += rows


class _Node:
    __slots__ = ("label", "children", "terminal", "held")

    def __init__(self, label, terminal=None):
        self.label, self.children, self.terminal, self.held = label, {}, terminal, len(label)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix: halving, so that the comparing itself is done on slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """A compressed radix trie over byte strings whose memory is bounded.

    An edge holds the bytes up to the next branch. Beyond ``limit`` bytes of labels and nodes the
    heaviest subtree below the first branch goes to a spill file, and later strings with
    that beginning follow it there. ``items`` gives what stayed in memory and then reads
    each spilled subtree with a trie of its own. Spill files vanish with the task.
    """

    def __init__(self, limit: int = TRIE_BYTES, depth: int = 0):
        self.root, self.limit, self.depth, self.held = _Node(b""), limit, depth, 0
        self.spilled: dict[bytes, object] = {}

    def insert(self, text: bytes, best, count: int, rows: list) -> None:
        if self.spilled:
            for start, sink in self.spilled.items():
                if text.startswith(start):
                    pickle.dump((text[len(start):], best, count, rows), sink)
                    return
        node, at = self.root, 0
        while True:
            if at == len(text):
                if node.terminal is None:
                    node.terminal = Terminal(best, count, rows)
                else:
                    node.terminal.merge(best, count, rows)
                return
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = _Node(text[at:], Terminal(best, count, rows))
                self.held += len(text) - at + NODE_BYTES
                if self.held > self.limit:
                    self._spill()
                return
            label = child.label
            if not text.startswith(label, at):
                shared = _common(label, text[at : at + len(label)])
                fork = _Node(label[:shared])
                child.label = label[shared:]
                fork.children[child.label[0]] = child
                node.children[fork.label[0]] = fork
                child = fork
                self.held += NODE_BYTES
            at += len(child.label)
            node = child

    def _walk(self, node, start: bytes) -> Iterator[tuple[bytes, Terminal]]:
        stack = [(node, start)]
        while stack:
            node, start = stack.pop()
            text = start + node.label
            if node.terminal is not None:
                yield text, node.terminal
            stack += [(child, text) for child in node.children.values()]

    @staticmethod
    def _weight(node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + NODE_BYTES
            stack += node.children.values()
        return total

    def _spill(self) -> None:
        """Write out the heaviest subtree below the first node that branches."""
        node, start = self.root, b""
        while len(node.children) == 1:
            node = next(iter(node.children.values()))
            start += node.label
        if not node.children:  # one string alone has to be held
            return
        first, child = max(node.children.items(), key=lambda item: self._weight(item[1]))
        del node.children[first]
        self.held -= self._weight(child)
        prefix = start + bytes([first])
        sink = tempfile.TemporaryFile()
        for text, t in self._walk(child, start):
            pickle.dump((text[len(prefix):], t.best, t.count, t.rows), sink)
        self.spilled[prefix] = sink

    def items(self) -> Iterator[tuple[bytes, Terminal]]:
        yield from self._walk(self.root, b"")
        self.root = _Node(b"")
        for prefix, sink in self.spilled.items():
            sink.seek(0)
            part = PatriciaTrie(self.limit, self.depth + 1)
            while True:
                try:
                    part.insert(*pickle.load(sink))
                except EOFError:
                    break
            sink.close()
            for text, t in part.items():
                yield prefix + text, t
        self.spilled = {}


def _order(doc, row: int, sign: int) -> tuple[bool, int, int]:
    """Smallest stays: nulls last, then the identifier, then the row."""
    return doc is None, 0 if doc is None else sign * doc, row


def _batch(rows: list[tuple], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _split_owners(sign: int, limit: int):
    """Per input split: meet equal texts in a trie, and let only the first of them carry its text."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([
            ("row", pa.int64()), ("doc_id", pa.int64()), ("text_sha256", pa.string()), ("local", pa.int64()),
            ("best_doc", pa.int64()), ("best_row", pa.int64()), ("count", pa.int64()), ("text", pa.binary()),
        ])

        def leaving(trie):
            out, size = [], 0
            for text, t in trie.items():
                digest, first = hashlib.sha256(text).hexdigest(), t.rows[0][0]
                null, best, stay = t.best
                out.append((*t.rows[0], digest, first, None if null else sign * best, stay, t.count, text))
                size += len(text)
                for row, doc in t.rows[1:]:
                    out.append((row, doc, digest, first, None, None, None, None))
                    if size + 200 * len(out) > 4_000_000:
                        yield _batch(out, schema)
                        out, size = [], 0
                if size + 200 * len(out) > 4_000_000:
                    yield _batch(out, schema)
                    out, size = [], 0
            if out:
                yield _batch(out, schema)

        trie, taken = PatriciaTrie(limit), 0
        for batch in batches:
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                # bytes.lower() changes A-Z only.
                trie.insert((text or b"").lower(), _order(doc, row, sign), 1, [(row, doc)])
            taken += batch.num_rows
            if taken >= SPLIT_ROWS:
                # The owners meet what leaves twice, as they meet what leaves two splits.
                yield from leaving(trie)
                trie, taken = PatriciaTrie(limit), 0
        yield from leaving(trie)

    return run


def _owners(sign: int, limit: int):
    """Per partition of (length, hash): one trie decides for the texts of all splits."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("local", pa.int64()), ("keep_id", pa.int64()), ("stay", pa.int64()), ("group_size", pa.int64())])
        trie = PatriciaTrie(limit)
        for batch in batches:
            for local, doc, row, count, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                trie.insert(text, _order(doc, row, sign), count, [local])
        out = []
        for _, t in trie.items():
            null, best, stay = t.best
            out += [(local, None if null else sign * best, stay, t.count) for local in t.rows]
            if len(out) > 50_000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", limit: int = TRIE_BYTES) -> DataFrame:
    """Groups of documents whose texts are equal after lower-casing A-Z: one row per document.

    Columns: doc_id, keep_id, group_size, kept, text_sha256.

    Two levels of tries. The first runs inside each input split, so a text that a third of
    all rows share leaves a split once for every ``SPLIT_ROWS`` rows. The texts that are left are dealt out by length and
    content hash; the owner of such a partition inserts them into its trie and decides who
    stays. Answers go back by the number of the split's first row, so a key of that join
    never has more rows than one split. Equality is decided on whole byte strings, by the
    tries; hashes only deal the texts out.

    A null text counts as empty. A null identifier loses against any other, and if all of a
    group are null, keep_id is null. Of rows that share text and identifier the first one
    stays. Other columns are not read. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    sign = -1 if keep == "largest" else 1
    bound_batches(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    local = settled(
        rows.mapInArrow(
            _split_owners(sign, limit),
            "row long, doc_id long, text_sha256 string, local long, best_doc long, best_row long, count long, text binary",
        ),
        "exact",
    )
    texts = local.where("text is not null").repartition(F.octet_length("text"), F.xxhash64("text"))
    owners = texts.select("local", "best_doc", "best_row", "count", "text").mapInArrow(
        _owners(sign, limit), "local long, keep_id long, stay long, group_size long"
    )
    return local.select("row", "doc_id", "text_sha256", "local").join(owners, "local").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("stay")).alias("kept"), "text_sha256",
    )
