"""Hierarchical multi-length packing (operator 8).

Every task packs the documents of its own partition, so no token is shuffled. Documents are cut into
full windows of the longest tier and a rest; rests are routed to tiers of powers of two, each tier is
packed from its own longest rests down, and gaps are filled from shorter tiers - whole rests first,
then the head of one that is cut. What is left at a task's end fills windows of falling tiers, down to
the shortest, so nothing is padded. Step groups are dealt so that each holds about as many tokens.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmill.llm.common import give_back, kept, text_of

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
END_ID = (1).to_bytes(4, "little")
#: Distinct words (and runs of letters) that a worker remembers, and bytes of ids that wait to be packed.
CACHE_WORDS, WAITING = 250_000, 24 << 20


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class Words(dict):
    """The ids of whitespace-free words, as little-endian unsigned 32-bit bytes; each word is encoded when first met.

    Words of Latin letters, digits and ASCII signs are cut into runs here as the tokenizer's file says, and the runs go to its
    model, which knows far fewer of them than there are words; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        # The normalizer and the pattern for which cutting by hand is right; with others every word takes the long way.
        runs = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        self.by_hand = json.dumps(made["normalizer"]).count('"type"') == 4 and "Lowercase" in json.dumps(made["normalizer"]) and made["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": runs}
        self.cut = regex.compile(runs).findall
        self.latin = regex.compile(r"(?!.*<\|)[!-~\u00C0-\u012F\u0131-\u024F]+").fullmatch
        self.letters = _byte_letters()
        self.runs: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        text = word.decode("utf-8", "replace")
        if self.by_hand and (text.isascii() and "<|" not in text or self.latin(text)):
            low = text.lower()
            found = self.runs.get(low) or self.run(low) if low.isalpha() else b"".join([self.runs.get(run) or self.run(run) for run in self.cut(low)])
        else:
            found = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self[word] = found
        return found

    def run(self, run: str) -> bytes:
        if len(self.runs) >= CACHE_WORDS:
            self.runs.clear()
        shown = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
        self.runs[run] = found = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        return found


def _words(path: str) -> Words:
    return kept(("words", path), lambda: Words(path))


def token_bytes(texts: Iterable[str], path: str) -> list[bytes]:
    """The ids of each text and the end id. The tokenizer drops white space and never joins across it, so words are encoded apart."""
    ids = _words(path).__getitem__
    return [b"".join([*map(ids, t.encode("utf-8", "replace").split()), END_ID]) for t in texts]


class Packer:
    """Packs pieces (doc, start, doc_tokens, bytes) of one task; every emitted sequence is full."""

    def __init__(self, longest: int, first_id: int, group_tokens: int, groups: int) -> None:
        self.longest, self.next_id = longest, first_id
        self.by_length: list[deque] = [deque() for _ in range(longest + 1)]
        self.present = 0  # bit n is set while a rest of n tokens waits
        self.waiting = 0
        self.rows: list[tuple] = []
        self.load = [0] * groups
        self.first_group, self.group_tokens = first_id, group_tokens * groups

    def add(self, doc: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, self.longest
        for at in range(0, total - total % step, step):
            self.emit([(doc, at, total, ids[4 * at : 4 * (at + step)])], step)
        if rest := total % step:
            self.keep((doc, total - rest, total, ids[4 * (total - rest) :]))

    def keep(self, piece: tuple) -> None:
        n = len(piece[3]) // 4
        self.by_length[n].append(piece)
        self.present |= 1 << n
        self.waiting += n

    def take(self, n: int) -> tuple:
        piece = self.by_length[n].popleft()
        if not self.by_length[n]:
            self.present &= ~(1 << n)
        self.waiting -= n
        return piece

    def largest(self, most: int) -> int:
        return (self.present & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def emit(self, pieces: list[tuple], tier: int) -> None:
        """A full sequence goes to the step group that has the fewest tokens; when all are full, new ones begin."""
        group = self.load.index(min(self.load))
        self.load[group] += tier
        offset = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next_id, offset, tier, self.first_group + group))
            offset += n
        self.next_id += 1
        if sum(self.load) >= self.group_tokens:
            self.load = [0] * len(self.load)
            self.first_group += len(self.load)

    def fill(self, tier: int) -> None:
        """One window: the longest waiting rest that fits, then ever shorter ones, then the head of one that is cut."""
        pieces, gap = [], tier
        while gap:
            n = self.largest(gap)
            if n > 0:
                pieces.append(self.take(n))
                gap -= n
            else:
                doc, start, total, ids = self.take((self.present & -self.present).bit_length() - 1)
                pieces.append((doc, start, total, ids[: 4 * gap]))
                self.keep((doc, start + gap, total, ids[4 * gap :]))
                gap = 0
        self.emit(pieces, tier)

    def pack(self, end: bool) -> None:
        """Every tier from the longest: while a rest over half of it waits and there is enough to fill it. At the end, falling tiers take all."""
        tier = self.longest
        while tier:
            while self.waiting >= tier and (end or self.largest(tier) > tier // 2):
                self.fill(tier)
            if not end and self.waiting < tier:
                break
            tier //= 2


def pack_documents(docs: DataFrame, tokenizer: str, longest: int = 2048, groups: int = 8, group_tokens: int = 64 * 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier and step_group.

    Null text counts as empty, so such a document has its end id only; a null id and repeated rows are packed like others.
    longest: tokens of the longest tier, a power of two; the tiers are the powers of two up to it. A sequence is always filled
    to its tier. groups: step groups that are filled side by side to group_tokens each. tokenizer: a file all workers can read.
    Sequence and group ids hold the number of the input partition in their upper bits. An empty table gives no rows.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(longest, (context.partitionId() if context else 0) << 36, group_tokens, groups)
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]

        def rows() -> pa.RecordBatch:
            out, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, ids in zip(part.column("doc_id").to_pylist(), token_bytes(part.column("text").to_pylist(), tokenizer), strict=True):
                    packer.add(doc, ids)
                if packer.waiting * 4 > WAITING:
                    packer.pack(False)
                if len(packer.rows) > 10_000:
                    yield rows()
        packer.pack(True)
        if packer.rows:
            yield rows()
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(packed, OUT).withColumnRenamed("doc_id", id_col)
