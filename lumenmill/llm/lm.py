"""LM scoring (operator 6): a unigram base and a gated recurrent model, both learned from the training documents.

Word counts cover all training documents and stay distributed; only the most frequent words, at most so many, go to the workers.
The recurrent model sees frequent words as themselves and every other word as one of many buckets by its ending; given its bucket,
such a word has its smoothed share of the bucket's counts. Words too rare for the workers' list get their counts by a join.
Texts are read twice, once to count words and once to encode tokens as ids, which are kept as a table; training and scoring read ids.
Training runs over all training documents once, in rounds: each task starts from the last round's parameters and trains on its own
documents, and the results are averaged, weighted by tokens. So scores depend a little on how the documents are dealt over files;
for the same files and settings they are the same.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmill.llm import gru
from lumenmill.llm.common import most_frequent, text_of, written

#: Token ids of the model: 0 is the end of a text, then words, then buckets.
WORDS, BUCKETS = 511, gru.TOKENS - 512
#: Most frequent words that workers hold.
LISTED = 200_000
#: Words of a task that are counted at once.
COUNTED = 4_000_000
#: Tokens of whole texts that wait in a task until they are trained on, or scored, side by side.
SIDE = 2_000_000
PART = "rid long, doc_id long, held_out boolean, turn int, n_tokens long, n_known long, base double, model double, rare array<struct<word: binary, n: int>>, ids binary"
SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space, with A-Z in lower case: those of all texts one after the other, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, sizes = split.flatten().cast(pa.binary()), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.greater(pc.binary_length(flat), 0)  # white space at the ends of a text leaves empty words
    if pc.all(filled).as_py() is False:
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[filled.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        flat = flat.filter(filled)
    return flat, sizes


def bucket(word: bytes) -> int:
    return 512 + zlib.crc32(word[-3:]) % BUCKETS


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all texts of docs (column text); counted in the tasks before the shuffle."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        for batch in batches:
            held.append(words_of(batch.column("text"))[0])
            if sum(map(len, held)) >= COUNTED:
                yield _counted(held)
                held = []
        yield _counted(held)

    return docs.select("text").mapInArrow(local, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(held: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(pc.value_counts(pa.chunked_array(held, pa.binary()).combine_chunks()).flatten(), names=["word", "c"])


def _side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    """The rows of whole batches until they have SIDE tokens, and the ids of each row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += (pc.sum(pc.binary_length(batch.column("ids"))).as_py() or 0) // 2
        if size >= SIDE:
            yield _decoded(held)
            held, size = [], 0
    if size:
        yield _decoded(held)


def _decoded(held: list[pa.RecordBatch]) -> tuple[pa.Table, list[np.ndarray]]:
    table = pa.Table.from_batches(held)
    return table.drop_columns(["ids"]), [np.frombuffer(x, np.uint16) for x in table.column("ids").to_pylist()]


def train_model(encoded: DataFrame, params: dict[str, np.ndarray], rounds: int) -> dict[str, np.ndarray]:
    """Parameters after each text of encoded (ids, turn) was trained on once, in its turn."""
    for turn in range(rounds):
        shared = encoded.sparkSession.sparkContext.broadcast(params)

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = gru.Trainer(shared.value)
            n = 0
            for _, texts in _side_by_side(batches):
                trainer.train(texts)
                n += sum(map(len, texts))
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([trainer.flat.tobytes()], pa.binary())], names=["weight", "params"])

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, total = 0.0, None
            for batch in batches:
                for w, blob in zip(batch.column("weight").to_pylist(), batch.column("params").to_pylist(), strict=True):
                    x = w * np.frombuffer(blob, np.float32).astype(np.float64)
                    weight, total = weight + w, x if total is None else total + x
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], names=["weight", "params"])

        schema = "weight double, params binary"
        trained = encoded.where(F.col("turn") == turn).select("ids").mapInArrow(train, schema)
        means = trained.repartition(8).mapInArrow(mean, schema).collect()
        if means:
            weight = sum(r.weight for r in means)
            flat = sum(r.weight / weight * np.frombuffer(bytes(r.params), np.float32).astype(np.float64) for r in sorted(means, key=lambda r: (r.weight, bytes(r.params))))
            params = gru.unpacked(flat, params)
        shared.unpersist()
    return params


def encode(rows: DataFrame, listed: tuple[bytes, ...], log_c: np.ndarray, log_mass: np.ndarray) -> DataFrame:
    """rows (doc_id, held_out, turn, text) as PART: for each text the ids of its tokens, what of its log10 probabilities is known from the listed words, and its other words."""
    shared = rows.sparkSession.sparkContext.broadcast((listed, log_c, log_mass))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs, mass = shared.value
        index = {w: i for i, w in enumerate(known)}
        # Last, at -1, what stands for words that are not listed.
        kind = np.array([*(i + 1 for i in range(min(WORDS, len(known)))), *(bucket(w) for w in known[WORDS:]), 0], np.uint16)
        logs = np.append(logs, 0.0)
        rid = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                flat, sizes = words_of(part.column("text"))
                coded = flat.dictionary_encode()
                words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                own = kind[at]
                seldom = np.nonzero(at < 0)[0]
                own[seldom] = [bucket(words[i]) for i in seldom.tolist()]
                log = np.where(at >= WORDS, logs[at], 0.0) - np.where(own >= 512, mass[own], 0.0)
                doc = np.repeat(np.arange(len(part)), sizes)
                ids = np.zeros(len(code) + len(part), np.uint16)  # each text's words, and its end
                ids[np.arange(len(code)) + doc] = own[code]
                sums = [np.bincount(doc, weights=x[code], minlength=len(part)) for x in (at >= 0, logs[at], log)]
                others = np.nonzero(at[code] < 0)[0]
                pairs, n = np.unique(doc[others] * max(len(words), 1) + code[others], return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(len(part) + 1) * max(len(words), 1)).astype(np.int32)
                rare = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pairs % max(len(words), 1))), pa.array(n.astype(np.int32))], names=["word", "n"])
                ends = np.concatenate([[0], 2 * np.cumsum(sizes + 1)]).astype(np.int32)
                arrays = [
                    pa.array(range(rid, rid + len(part)), pa.int64()), *[part.column(c) for c in ("doc_id", "held_out", "turn")], pa.array(sizes + 1), pa.array(sums[0].astype(np.int64)), *[pa.array(x.astype(np.float64)) for x in sums[1:]],  # a bincount of nothing is of integers
                    pa.ListArray.from_arrays(pa.array(cuts), rare), pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(ids)]),
                ]
                rid += len(part)
                yield pa.RecordBatch.from_arrays(arrays, names=["rid", "doc_id", "held_out", "turn", "n_tokens", "n_known", "base", "model", "rare", "ids"])

    return rows.select("doc_id", "held_out", "turn", "text").mapInArrow(encoded, PART)


def lm_scores(docs: DataFrame, held_out: Column, hidden: int = 32, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the id, held_out, n_tokens, n_known, train_tokens, base_score and score, in log10.

    Learns from the rows that are not held out; a null id counts as ''. A text's tokens are its words and one end, so null or empty
    text is the end alone. Unseen words have the base probability of a count of 0, and in the model the share of one unseen word of
    their bucket. Repeated rows are counted, trained on and scored as rows. Without training rows the base gives every token
    probability 1. An empty table gives an empty result. The state runs through whole texts, however long. Other columns are not read.
    """
    key = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text_of(text_col).alias("text"), (F.floor(key / 5) % rounds).cast("int").alias("turn"))
    training = rows.where(~F.col("held_out"))
    counts = written(word_counts(training))
    ends = training.count()
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = words + ends, kinds + (ends > 0)
    top = most_frequent(counts, "c", LISTED)
    listed = tuple(bytes(w) for w in top["word"])
    log_c = np.log10(top["c"].to_numpy(np.float64) + 0.5)
    own = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(bytearray(w),) for w in listed[:WORDS]], "word binary")), "word", "left_anti")
    in_buckets = own.groupBy((512 + F.crc32(F.substring("word", -3, 3)) % BUCKETS).alias("id")).agg(F.sum("c").alias("c"), F.count("*").alias("kinds")).collect()
    mass, unigram = np.full(gru.TOKENS, 0.5), np.zeros(gru.TOKENS)
    unigram[0] = ends
    unigram[1 : 1 + min(WORDS, len(listed))] = top["c"].to_numpy(np.float64)[:WORDS]
    for r in in_buckets:
        mass[r.id] += r.c + 0.5 * r.kinds
        unigram[r.id] = r.c
    encoded = written(encode(rows, listed, log_c, np.log10(mass)))
    params = train_model(encoded.where(~F.col("held_out")), gru.fresh(hidden, unigram), rounds)
    shared = docs.sparkSession.sparkContext.broadcast(params)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in _side_by_side(batches):
            natural = gru.score(shared.value, texts) / math.log(10)
            model = table.column("model").to_numpy() + natural
            yield from table.set_column(table.schema.get_field_index("model"), "model", pa.array(model)).combine_chunks().to_batches()

    names = [x.split()[0] for x in SCORED.split(", ")]
    scored = encoded.select(*names, "ids").mapInArrow(score, SCORED)
    rare = encoded.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.n").join(counts, "word", "left")
    rare = rare.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"))
    joined = scored.join(rare, "rid", "left")
    logs, size, end_c = F.coalesce("logs", F.lit(0.0)), math.log10(total + 0.5 * (kinds + 1)), math.log10(ends + 0.5)
    return joined.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0)) + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs + end_c - F.col("n_tokens") * size).alias("base_score"), (F.col("model") + logs).alias("score"),
    )
