"""Benchmark decontamination (operator 13): a prefix-filtered set join of item windows with documents.

A window (so many consecutive words of an item) is a set of shingles of three words. A document that contains it contains all of them, so
with shingles ordered by rarity a prefix of one, the rarest, is necessary: only its occurrences in documents are joined. Its place in the
window bounds where the window would have to begin and end (positional and length bound), and the words that stand there are compared.

Texts are hashed twice where they lie: once to count how often the benchmark's shingles occur, once to emit the occurrences of the
prefixes with the words around them. Both passes test shingles against a bitmap of fixed size, so nothing that is sent to the tasks
grows with the benchmark; what passes it by chance is dropped by the joins, which compare whole hashes and then words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenmill.llm.common import give_back, if_small, lower_az, text_of, written
from lumenmill.llm.shingles import hashed_runs, mixed, steps

#: What words are made of: ASCII digits and letters, and everything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_IN_WORD = np.ones(256, bool)
_IN_WORD[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
#: Words of a shingle.
SHINGLE = 3
#: Bits of the bitmap of shingles, 2 MB whatever the benchmark's size.
BITS = 1 << 24

COUNTED = "shingle long, n long"
EMITTED = "row long, doc_id long, n_words long, size int, shingle long, at long, first long, words array<string>"


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of size words."""
    total = np.zeros(max(len(hashes) - size + 1, 0), np.uint64)
    for j in range(size):
        total += hashes[j : j + len(total)] * steps(j)
    return mixed(total + np.uint64(size))


def _words(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    body = text.encode("utf-8", "replace")
    return body, *hashed_runs(np.frombuffer(body, np.uint8), _IN_WORD)


def bitmap(shingles: DataFrame) -> np.ndarray:
    """A bitmap with the bit of each shingle set: at most BITS / 64 rows come to the driver, whatever the number of shingles."""
    bit = F.pmod(F.col("shingle"), F.lit(BITS))
    place = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    rows = shingles.groupBy(F.floor(bit / 64).cast("int").alias("at")).agg(F.bit_or(place).alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[rows["at"]] = rows["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _passes(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(bits[(hashes & np.uint64(BITS - 1)).astype(np.int64)])


def item_windows(items: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """(item_id, words): the windows of every item, each once; an item of fewer words, but not none, is one window."""
    words = F.filter(F.split(F.regexp_replace(lower_az(text_of(text_col)), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), lambda w: w != "")
    rows = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    return rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(width)))).alias("words")).distinct()


def _window_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every shingle of every window (id, words): the whole window if it is shorter than a shingle."""
    for batch in batches:
        out = []
        for key, words in zip(batch.column("id").to_pylist(), batch.column("words").to_pylist(), strict=True):
            size = min(SHINGLE, len(words))
            out += [(key, size, at, h) for at, h in enumerate(shingle_hashes(_words(" ".join(words))[1], size).view(np.int64).tolist())]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], names=["id", "size", "offset", "shingle"])


def _counted(sizes: list[int], bits):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = []
            for text in batch.column("text").to_pylist():
                hashes = _words(text)[1]
                for size in sizes:
                    found = shingle_hashes(hashes, size)
                    met.append(found[_passes(found, bits.value)])
            values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *met]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    return count


def _emitted(sizes: list[int], around: int, bits):
    """A row for each document, and one for each occurrence of a prefix: its size, hash and place, and the words around it, lower-cased, with the place of the first."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                body, hashes, start, end = _words(text)
                out.append((row, doc_id, len(hashes), None, None, None, None, None))
                for size in sizes:
                    found = shingle_hashes(hashes, size)
                    reach = around if size == SHINGLE else 0
                    for at in _passes(found, bits.value).tolist():
                        first, last = max(0, at - reach), min(len(hashes), at + size + reach)
                        words = [body[start[i] : end[i]].lower().decode("utf-8", "replace") for i in range(first, last)]
                        out.append((row, None, None, size, int(found[at].view(np.int64)), at, first, words))
                if len(out) > 20_000:
                    yield _rows(out)
                    out = []
            yield _rows(out)
        give_back()

    return emit


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["row", "doc_id", "n_words", "size", "shingle", "at", "first", "words"])


def benchmark_hits(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, n_words, n_hit (words inside any occurrence of a window), item_ids (sorted as strings) of the items whose windows occur, and contaminated.

    Words are lower-cased in A-Z only. Null and empty text has no words; such an item has no window and is never met, such a document
    has no hit. Rows that repeat an item's id add to one item; items without an id are one item of id ''. Repeated documents come out alike
    and rows without an id each for itself. Ties in rarity go to the smaller hash. An empty benchmark hits nothing, an empty table of documents gives an empty result.
    Other columns are not read. The list of items of a document is one value, as long as the benchmark at most.
    """
    windows = item_windows(items, width, item_col, item_text_col)
    windows = windows.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    windows = written(windows.select(F.sha2(F.array_join("words", " "), 256).alias("id"), "words", F.sha2(F.array_join("items", ","), 256).alias("owners"), "items"))
    sets = windows.select("owners", "items").dropDuplicates(["owners"])
    shingles = written(windows.select("id", "words").mapInArrow(_window_shingles, "id string, size int, offset int, shingle long"))
    sizes = sorted(r[0] for r in shingles.select("size").distinct().collect())  # from 1 to SHINGLE

    context = docs.sparkSession.sparkContext
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    every = context.broadcast(bitmap(shingles))
    counts = rows.select("text").mapInArrow(_counted(sizes, every), COUNTED).groupBy("shingle").agg(F.sum("n").alias("n"))
    # The rarest shingle of each window, and where it stands in it. A window with a shingle that no document has can't occur.
    known = shingles.join(counts, "shingle", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset", "size")).alias("rarest"))
    prefixes = written(known.where("rarest.n > 0").join(windows.select("id", "words", "owners"), "id").select("rarest.shingle", "rarest.offset", "rarest.size", F.col("words").alias("window"), F.size("words").alias("length"), "owners"))

    rare = context.broadcast(bitmap(prefixes))
    met = written(rows.mapInArrow(_emitted(sizes, width - SHINGLE, rare), EMITTED))
    sized = met.where("shingle IS NULL").select("row", "doc_id", "n_words")
    begin, length = F.col("at") - F.col("offset"), F.col("length")
    places = met.where("shingle IS NOT NULL").join(if_small(prefixes), ["shingle", "size"]).where((begin >= F.col("first")) & (begin + length <= F.col("first") + F.size("words")))
    found = places.where(F.slice("words", (begin - F.col("first") + 1).cast("int"), length) == F.col("window"))
    found = written(found.select("row", "owners", begin.alias("begin"), (begin + length).alias("end")))
    hits = covered(found)
    owned = found.select("row", "owners").distinct().join(if_small(sets), "owners")
    named = owned.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("item_ids"))
    none = F.array().cast("array<string>")
    out = sized.join(hits, "row", "left").join(named, "row", "left")
    return out.select(F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"))


def covered(spans: DataFrame) -> DataFrame:
    """(row, n_hit): how many places the spans [begin, end) of each row cover together. Spans of one document are few beside its text."""
    longest = spans.groupBy("row", "begin").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy("row").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    fresh: Column = F.col("end") - F.greatest(F.col("begin"), F.coalesce("before", F.col("begin")))
    return longest.withColumn("before", before).groupBy("row").agg(F.sum(F.greatest(fresh, F.lit(0))).cast("long").alias("n_hit"))
