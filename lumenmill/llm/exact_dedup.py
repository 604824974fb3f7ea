"""Exact deduplication by Patricia-trie owners (operator 10).

Rows are dealt to partitions by byte length and content hash. All full byte strings of a partition go into one compressed radix
trie, which forks where texts part; a terminal node stores the identifier that owns the text and how many rows ended there.
A trie that holds too many bytes spills by subtree. In a partition the strings come in the order of their bytes, by Spark's
external sort, so subtrees to the left of the string at hand are complete and leave first. Before the shuffle every input task
has such a trie too, so that a text with a third of all rows reaches its partition as a few rows from each task; there the heaviest
subtrees leave, as owners so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenmill.llm.common import give_back, put_away, text_of, unused, with_rows, written

OWNER = "sha256 string, body binary, owner long, n long, ties long"
_ARROW = pa.schema([("sha256", pa.string()), ("body", pa.binary()), ("owner", pa.int64()), ("n", pa.int64()), ("ties", pa.int64())])
#: Bytes that a node is reckoned to take beside its label.
NODE = 200


class Trie:
    """A compressed radix trie over byte strings.

    A node is [label, children by first byte, terminal, bytes held by it and all below]; a terminal is [owner, rows, rows that carry
    the owner's identifier, hash].
    """

    def __init__(self, largest: bool) -> None:
        self.root: list = [b"", {}, None, 0]
        self.better = (lambda a, b: b is None or a is not None and a > b) if largest else (lambda a, b: b is None or a is not None and a < b)

    @property
    def held(self) -> int:
        return self.root[3]

    def insert(self, body: bytes, owner: int | None, n: int = 1, ties: int = 1, sha: str = "") -> None:
        node, at, path = self.root, 0, [self.root]
        added = 0
        while at < len(body):
            child = node[1].get(body[at])
            if child is None:
                node[1][body[at]] = child = [body[at:], {}, None, 0]
                added += len(body) - at + NODE
                at = len(body)
            elif body.startswith(child[0], at):
                at += len(child[0])
            else:
                label = child[0]
                same = _common(label, body, at)
                fork = [label[:same], {label[same]: child}, None, child[3] + NODE]
                child[0] = label[same:]
                child[3] -= same
                node[1][body[at]] = fork
                for above in path:
                    above[3] += NODE
                child, at = fork, at + same
            node = child
            path.append(node)
        if node[2] is None:
            node[2] = [owner, n, ties, sha]
        else:
            end = node[2]
            end[1] += n
            if owner == end[0]:
                end[2] += ties
            elif self.better(owner, end[0]):
                end[0], end[2] = owner, ties
        if added:
            for above in path:
                above[3] += added

    def __iter__(self) -> Iterator[tuple[bytes, list]]:
        return _below(b"", self.root)

    def spill_heaviest(self, to: int) -> Iterator[tuple[bytes, list]]:
        """Takes out whole subtrees until at most so many bytes are held: from the root along the heaviest children to one of at most half of them."""
        while self.held > to:
            path, before = [self.root], b""
            while True:
                node = path[-1]
                first, child = max(node[1].items(), key=lambda x: x[1][3])
                if child[3] <= self.held / 2 or not child[1]:
                    break
                path.append(child)
                before += child[0]
            yield from self._cut(path, first, before)

    def spill_finished(self, body: bytes) -> Iterator[tuple[bytes, list]]:
        """Takes out all subtrees whose strings sort before body; with strings in order they are complete. What stays is on body's path."""
        node, path, before, at = self.root, [self.root], b"", 0
        while True:
            for first in [x for x in node[1] if at >= len(body) or x < body[at]]:
                yield from self._cut(path, first, before)
            if node[2] is not None and at < len(body):  # a string that body begins with
                yield before, node[2]
                node[2] = None
            child = node[1].get(body[at]) if at < len(body) else None
            if child is None:
                return
            if not body.startswith(child[0], at):
                same = _common(child[0], body, at)
                if at + same < len(body) and child[0][same] < body[at + same]:
                    yield from self._cut(path, body[at], before)
                return
            at += len(child[0])
            before += child[0]
            path.append(child)
            node = child

    @staticmethod
    def _cut(path: list, first: int, before: bytes) -> Iterator[tuple[bytes, list]]:
        child = path[-1][1].pop(first)
        for above in path:
            above[3] -= child[3]
        yield from _below(before, child)


def _below(before: bytes, node: list) -> Iterator[tuple[bytes, list]]:
    stack = [(before, node)]
    while stack:
        before, node = stack.pop()
        body = before + node[0]
        if node[2] is not None:
            yield body, node[2]
        stack += [(body, child) for child in node[1].values()]


def _common(label: bytes, body: bytes, at: int) -> int:
    """Length of the common start of label and body[at:], by bisection over slices."""
    low, high = 0, min(len(label), len(body) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == body[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _batches(ends: Iterator[tuple[bytes, list]], bodies: bool) -> Iterator[pa.RecordBatch]:
    """Terminals as rows, in batches of bounded bytes."""
    rows, held = [], 0
    for body, (owner, n, ties, sha) in ends:
        rows.append((sha, body if bodies else None, owner, n, ties))
        held += len(body) if bodies else 0
        if len(rows) >= 10_000 or held > 16 << 20:
            yield _rows(rows)
            rows, held = [], 0
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def _grown(batches: Iterator[pa.RecordBatch], largest: bool, limit: int, in_order: bool) -> Iterator[pa.RecordBatch]:
    """Owners from one trie, whose subtrees leave when it holds over limit bytes; in order (of the bytes) each text leaves once, with all its rows."""
    put_away()
    trie = Trie(largest)
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("sha256", "body", "owner", "n", "ties")]
        for sha, body, owner, n, ties in zip(*columns, strict=True):
            if trie.held > limit:
                yield from _batches(trie.spill_finished(body) if in_order else trie.spill_heaviest(limit // 2), not in_order)
            trie.insert(body, owner, n, ties, sha)
    yield from _batches(iter(trie), not in_order)
    del trie
    give_back()


def trie_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", limit: int = 48 << 20, row_col: str | None = None) -> DataFrame:
    """One row for each row of docs: the id, keep_id, group_size, kept, text_sha256 and n_bytes.

    Null text counts as empty. Texts are equal when their UTF-8 bytes are. keep names which identifier owns a text;
    a null identifier owns only if there is no other. Of rows that repeat the owner's identifier exactly one is kept.
    row_col: a column that is handed through as __row. limit: bytes that a task's trie holds at once. Other columns are not read; an empty table gives an empty result.
    """
    through = ["__row"] if row_col else []
    keyed = docs.select(*[F.col(row_col).alias("__row") for _ in through], F.col(id_col).cast("long").alias("owner"), text_of(text_col).cast("binary").alias("body")).select(
        *through, F.octet_length("body").alias("nbytes"), F.sha2("body", 256).alias("sha256"), "body", "owner", F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("ties")
    )
    largest = keep == "largest"
    own = ["sha256", "body", "owner", "n", "ties"]
    local = keyed.select(*own).mapInArrow(lambda batches: _grown(batches, largest, limit, False), OWNER)
    owners = (
        local.repartition(F.octet_length("body"), "sha256")
        .sortWithinPartitions("body")
        .mapInArrow(lambda batches: _grown(batches, largest, limit, True), OWNER)
        .select(F.col("sha256").alias("sha256"), F.col("owner").alias("keep_id"), F.col("n").alias("group_size"), "ties")
    )
    out = keyed.select(*through, "owner", "nbytes", "sha256").join(owners, "sha256")
    # Only rows that share both their text and the owner's identifier have to be told apart.
    own = F.col("owner").eqNullSafe(F.col("keep_id"))
    out = out.withColumn("own", own).withColumn("alone", F.when(~F.col("own") | (F.col("ties") == 1), F.monotonically_increasing_id()))
    # Dealt out by row, so that the join before is free to split a text that has a third of all rows.
    out = out.repartition("sha256", "owner", "alone")
    numbered = F.row_number().over(Window.partitionBy("sha256", "owner", "alone").orderBy("group_size"))
    return out.select(
        F.col("owner").alias(id_col), "keep_id", "group_size", (F.col("own") & (numbered == 1)).alias("kept"), F.col("sha256").alias("text_sha256"), F.col("nbytes").alias("n_bytes"), *through
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs, all columns, that own their text: one row of each text, whether ids repeat or are null. Of equal rows one stays; an empty table stays empty."""
    row = unused(docs, "__row")
    rows = with_rows(docs, row)
    gone = written(trie_owners(rows, id_col, text_col, keep, row_col=row).where("not kept").select(F.col("__row").alias(row)))
    # Rows that go are fewer than those that stay, and a table of known size: if Spark finds it small, no text is shuffled here.
    return rows.join(gone, row, "left_anti").select(*docs.columns)
