"""Fill-in-middle transformation (operator 12): a parallel automaton scan.

An automaton reads UTF-8 bytes and emits the ends of units (white space and the word behind it, or white space at the end) and the marks
`<P>`, `<S>`, `<M>`, if the text has any. A chunk is summed up without knowing what stands before it: for each state in which it may be
entered, the state in which it is left and how much it emits. Such functions compose, and composition is associative, so the chunks of
a giant document are read in parallel; composing their functions in order gives each chunk its state of entry and what came before, and
only the chunks that hold a cut are read again. A document of one chunk is cut where it lies, by the same functions and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenmill.llm.common import give_back, if_small, text_of, written

#: Bytes of a chunk. It shapes the cost only.
CHUNK = 1 << 16

# Classes of bytes: white space, '<', the letters of marks, '>', any other.
_SPACE, _OPEN, _LETTER, _CLOSE, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[32, *range(9, 14)]] = _SPACE
_CLASS[[ord(c) for c in "PSM"]] = _LETTER
_CLASS[ord("<")], _CLASS[ord(">")] = _OPEN, _CLOSE
# States: behind white space (and at the start), in a word, behind '<', behind '<' and a letter of marks.
_START, _WORD, _OPENED, _NAMED = range(4)
STATES = 4

FUNCTION = "row long, no int, chars long, after array<int>, ends array<long>, marks array<long>"
ENTERED = "row long, no int, state int, ends_before long, ends long, chars_before long, marks long"
FOUND = "row long, cut int, at long, chars long"
SCANNED = "doc_id long, body binary, h array<long>, n long, marks long, ats array<long>, chars array<long>"


def step(state: int, kind: int) -> tuple[int, int, int]:
    """The state after a byte of this class, the ends that it emits (before itself), and the marks."""
    if kind == _SPACE:
        return _START, int(state != _START), 0
    if kind == _OPEN:
        return _OPENED, 0, 0
    if kind == _LETTER and state == _OPENED:
        return _NAMED, 0, 0
    return _WORD, 0, int(kind == _CLOSE and state == _NAMED)


def chunk_function(kinds: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """For each state of entry: the state after the chunk, the ends and the marks in it.

    Two bytes decide the state behind them, so the states of entry meet after two steps and share the rest.
    """
    after, ends, marks = [], [], []
    space = kinds == _SPACE
    rest_ends = int(np.count_nonzero(space[2:] & ~space[1:-1]))
    closed = np.flatnonzero(kinds[2:] == _CLOSE)
    rest_marks = int(np.count_nonzero((kinds[closed] == _OPEN) & (kinds[closed + 1] == _LETTER)))
    for state in range(STATES):
        emitted, marked = rest_ends, rest_marks
        for kind in kinds[:2].tolist():
            state, e, m = step(state, kind)
            emitted, marked = emitted + e, marked + m
        if len(kinds) > 2:
            state = _START
            for kind in kinds[-2:].tolist():
                state = step(state, kind)[0]
        after.append(state)
        ends.append(emitted)
        marks.append(marked)
    return after, ends, marks


def composed(f: tuple, g: tuple) -> tuple[list[int], list[int], list[int]]:
    """The function of f's chunk followed by g's."""
    return [g[0][s] for s in f[0]], [e + g[1][s] for e, s in zip(f[1], f[0], strict=True)], [m + g[2][s] for m, s in zip(f[2], f[0], strict=True)]


def nth_end(kinds: np.ndarray, state: int, n: int) -> int:
    """The offset of the nth end (from 1) in a chunk that is entered in this state."""
    space = kinds == _SPACE
    word_before = np.concatenate([[state != _START], ~space[:-1]])
    return int(np.flatnonzero(space & word_before)[n - 1])


def code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def _raw(body: bytes) -> np.ndarray:
    return np.frombuffer(body, np.uint8)


def _record(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(names), types, strict=True)], names=names)


_LONG, _INT = pa.int64(), pa.int32()


def _scan_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one chunk: entered at the start, cut at once; rows (doc_id, body, h) go through."""
    for batch in batches:
        rows = []
        for body, h in zip(batch.column("body"), batch.column("h").to_pylist(), strict=True):
            raw = _raw(body.as_buffer())
            kinds = _CLASS[raw]
            _, ends, marks = chunk_function(kinds)
            n = ends[_START] + (len(raw) > 0)
            ks = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            ats = [0 if k == 0 else len(raw) if k == n else nth_end(kinds, _START, k) for k in ks]
            rows.append((n, marks[_START], ats, [code_points(raw[:at]) for at in ats]))
        found = _record(rows, ["n", "marks", "ats", "chars"], [_LONG, _LONG, pa.list_(_LONG), pa.list_(_LONG)])
        yield pa.RecordBatch.from_arrays([*batch.columns, *found.columns], names=[*batch.schema.names, *found.schema.names])
    give_back()


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The function of every chunk (row, no, piece)."""
    for batch in batches:
        rows = []
        for row, no, piece in zip(*(batch.column(c).to_pylist() for c in ("row", "no", "piece")), strict=True):
            rows.append((row, no, code_points(_raw(piece)), *chunk_function(_CLASS[_raw(piece)])))
        yield _record(rows, ["row", "no", "chars", "after", "ends", "marks"], [_LONG, _INT, _LONG, pa.list_(_INT), pa.list_(_LONG), pa.list_(_LONG)])


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each chunk is entered and what came before, from functions in order of (row, no): they are composed one by one."""
    last, so_far, chars = None, None, 0
    for batch in batches:
        rows = []
        for row, no, size, *function in zip(*(batch.column(c).to_pylist() for c in ("row", "no", "chars", "after", "ends", "marks")), strict=True):
            if row != last:
                last, so_far, chars = row, (list(range(STATES)), [0] * STATES, [0] * STATES), 0
            then = composed(so_far, function)
            rows.append((row, no, so_far[0][_START], so_far[1][_START], then[1][_START], chars, then[2][_START]))
            so_far, chars = then, chars + size
        yield _record(rows, ["row", "no", "state", "ends_before", "ends", "chars_before", "marks"], [_LONG, _INT, _INT, _LONG, _LONG, _LONG, _LONG])


def _selected(chunk: int):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, no, cut, state, k, before, piece in zip(*(batch.column(c).to_pylist() for c in ("row", "no", "cut", "state", "k", "chars_before", "piece")), strict=True):
                at = nth_end(_CLASS[_raw(piece)], state, k)
                rows.append((row, cut, no * chunk + at, before + code_points(_raw(piece)[:at])))
            yield _record(rows, ["row", "cut", "at", "chars"], [_LONG, _INT, _LONG, _LONG])

    return select


def _piece(body: Column, no: Column, chunk: int) -> Column:
    return F.substring(body, no * chunk + 1, F.lit(chunk))


def _scan_giants(giants: DataFrame, chunk: int) -> DataFrame:
    """As _scan_whole, for documents of many chunks: rows (row, doc_id, body, h) of a written table."""
    last = F.floor((F.octet_length("body") - 1) / chunk).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda no: _piece(F.col("body"), no, chunk))
    functions = giants.select("row", F.posexplode(pieces).alias("no", "piece")).repartition("row", "no").mapInArrow(_functions, FUNCTION)
    entered = functions.repartition("row").sortWithinPartitions("row", "no").mapInArrow(_entered, ENTERED)
    # One row a chunk: at most 2 GB / chunk rows for a document.
    whole = Window.partitionBy("row")
    entered = written(entered.select("*", (F.max("ends").over(whole) + 1).alias("n"), F.max("marks").over(whole).alias("all_marks")))
    totals = entered.groupBy("row").agg(F.max("n").alias("n"), F.max("all_marks").alias("marks"))
    ranks = giants.select("row", "h").join(if_small(totals), "row").select("row", "n", "marks", F.sort_array(F.array(*[F.col("h")[i] % (F.col("n") + 1) for i in (0, 1)])).alias("ks"))
    ranks = written(ranks)
    cuts = ranks.select("row", "n", F.posexplode("ks").alias("cut", "k"))
    inner = cuts.where((F.col("k") > 0) & (F.col("k") < F.col("n"))).select("row", "cut", "k")
    chosen = entered.join(if_small(inner), "row").where((F.col("ends_before") < F.col("k")) & (F.col("k") <= F.col("ends")))
    chosen = chosen.select("row", "no", "cut", "state", (F.col("k") - F.col("ends_before")).alias("k"), "chars_before")
    found = giants.select("row", "body").join(if_small(written(chosen)), "row").select("row", "no", "cut", "state", "k", "chars_before", _piece(F.col("body"), F.col("no"), chunk).alias("piece"))
    found = found.mapInArrow(_selected(chunk), FOUND).groupBy("row").agg(*[F.max(F.when(F.col("cut") == c, F.struct("at", "chars"))).alias(f"cut{c}") for c in (0, 1)])
    cut = written(ranks.join(found, "row", "left"))
    every = F.struct(F.octet_length("body").cast("long").alias("at"), F.char_length(F.col("body").cast("string")).cast("long").alias("chars"))
    none = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("chars"))
    places = [F.when(F.col("ks")[c] == 0, none).when(F.col("ks")[c] == F.col("n"), every).otherwise(F.col(f"cut{c}")) for c in (0, 1)]
    out = giants.join(if_small(cut), "row").select("doc_id", "body", "h", "n", "marks", F.array(*places).alias("places"))
    return out.select("doc_id", "body", "h", "n", "marks", F.col("places.at").alias("ats"), F.col("places.chars").alias("chars"))


def draws(id_col: str, seed: int) -> Column:
    """h1 to h4: the first four groups of eight digits of the sha256 of "<seed>:<id>"; a null id counts as ''."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fim_documents(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, n (units), form (plain, psm, spm), prefix_chars, middle_chars and output.

    The prefix ends after the smaller of two draws from 0 to n units, the middle after the larger. percent of the documents are
    transformed, spm_percent of those to `<S>`suffix`<P>`prefix`<M>`middle and the others to `<P>`prefix`<S>`suffix`<M>`middle.
    A text that is empty or null, or that holds one of the marks itself, stays plain, and its parts are null. Draws hang on the id
    alone: repeated rows come out alike, rows without an id draw as ''. Other columns are not read; an empty table gives an empty result.
    Texts over chunk bytes are read in chunks by many tasks; their rows are written once to the shared folder.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("body"), draws(id_col, seed).alias("h"))
    large = F.octet_length("body") > chunk
    giants = written(rows.where(large).select(F.monotonically_increasing_id().alias("row"), "*"))
    scanned = rows.where(~large).mapInArrow(_scan_whole, SCANNED).unionByName(_scan_giants(giants, chunk))
    plain = (F.octet_length("body") == 0) | (F.col("marks") > 0) | (F.col("h")[2] % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    a, b = F.col("ats")[0].cast("int"), F.col("ats")[1].cast("int")
    prefix, middle, suffix = F.substring("body", F.lit(1), a), F.substring("body", a + 1, b - a), F.substring("body", b + 1, F.octet_length("body"))
    mark = {m: F.lit(f"<{m}>").cast("binary") for m in "PSM"}
    output = F.when(plain, F.col("body")).when(form == "psm", F.concat(mark["P"], prefix, mark["S"], suffix, mark["M"], middle)).otherwise(F.concat(mark["S"], suffix, mark["P"], prefix, mark["M"], middle))
    chars = F.col("chars")
    return scanned.select(
        F.col("doc_id").alias(id_col), "n", form.alias("form"), F.when(~plain, chars[0]).alias("prefix_chars"), F.when(~plain, chars[1] - chars[0]).alias("middle_chars"), output.cast("string").alias("output")
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A transformed text holds no mark, so its output holds just the three that were put in."""
    part = F.split(output, "<[PSM]>")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
