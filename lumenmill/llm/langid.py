"""Language identification by cross-parsing (operator 7).

For every language a suffix automaton of labelled text answers how far a match can be extended. A text is parsed greedily
into the longest phrases that occur in a language's sample; the language that needs the fewest phrases for its characters wins.
Texts are parsed in windows of fixed length, all windows of a batch side by side: an automaton is one table in which the next
state and the number of phrases that end are found by state and character.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmill.llm.common import give_back, if_small, kept, text_of, unused

OUT = "doc_id long, held_out boolean, lang_pred string, score double, n_windows long, n_phrases long"
#: Characters of a window; each starts a new phrase.
WINDOW = 256
#: Classes of characters: 0 is what separates words, 1 a letter outside the alphabet. BREAK stands between the documents of a sample.
SEPARATOR, RARE, BREAK = 0, 1, -1
#: Characters that all automata hold together, while each language has LEAST_CHARS: beyond 128 languages their sum grows by so many a language.
TOTAL_CHARS, LEAST_CHARS = 262_144, 2_048
#: Natural logarithm of the odds that one phrase less gives.
NATS = 4.0
#: Texts that are parsed side by side.
SLICE = 500


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the smallest automaton of all substrings; state 0 is the start."""
    trans: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for s in symbols:
        new = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and s not in trans[at]:
            trans[at][s] = new
            at = link[at]
        if at >= 0:
            to = trans[at][s]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(trans)
                trans.append(dict(trans[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and trans[at].get(s) == to:
                    trans[at][s] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    return trans


def parse_table(trans: list[dict[int, int]], classes: int) -> np.ndarray:
    """For (state, class): 4 * the row of the next state, plus 1 where a phrase begins; flat.

    Where a match can't be extended, the character begins a phrase; one that the sample lacks is a phrase of its own.
    """
    begin = np.ones(classes, dtype=np.int64)
    for c, to in trans[0].items():
        if c != BREAK:
            begin[c] = 4 * classes * to + 1
    table = np.tile(begin, (len(trans), 1))
    for state, out in enumerate(trans):
        for c, to in out.items() if state else ():
            if c != BREAK:
                table[state, c] = 4 * classes * to
    return table.ravel().astype(np.int32 if table.max() < 2**31 else np.int64)


class Model:
    """Tables of all languages, made from samples (language, text, share of the labelled documents)."""

    def __init__(self, samples: list[tuple[str, list[str], float]], most: int = 250) -> None:
        self.langs = [s[0] for s in samples]
        self.prior = np.log([max(s[2], 1e-9) for s in samples])
        every = "".join(map(chr, range(0x110000)))
        letter = np.fromiter((c.isalpha() for c in every), bool, 0x110000)
        low = np.fromiter((ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(every)), np.int32, 0x110000)
        count = np.zeros(0x110000, np.int64)
        for _, texts, _ in samples:
            for t in texts:
                count += np.bincount(low[self._points(t)], minlength=0x110000)
        known = [c for c in np.argsort(-count, kind="stable")[: 4 * most] if count[c] and letter[c]][:most]
        classes = np.where(letter, RARE, SEPARATOR).astype(np.uint8)
        classes[known] = np.arange(2, 2 + len(known))
        self.table = classes[low]
        self.classes = 2 + len(known)
        self.parses = [parse_table(suffix_automaton([c for t in texts for c in [*self.symbols(t)[0].tolist(), BREAK]]), self.classes) for _, texts, _ in samples]

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")

    def symbols(self, *texts: str) -> tuple[np.ndarray, np.ndarray]:
        """The classes of all texts, runs of separators as one, and the number of each text's symbols."""
        got = self.table[self._points("".join(texts))]
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(got) + 1, bool)
        first[np.concatenate([[0], ends])] = True
        before = np.concatenate([np.array([RARE], got.dtype), got[:-1]])[: len(got)]
        keep = (got != SEPARATOR) | (before != SEPARATOR) | first[:-1]
        upto = np.concatenate([[0], np.cumsum(keep)])
        return got[keep], np.diff(upto[np.concatenate([[0], ends])])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases by (text, language), windows by text, and whether the text has a letter."""
        got, sizes = self.symbols(*texts)
        windows = -(-sizes // WINDOW)
        of = np.repeat(np.arange(len(texts)), windows)
        rank = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = np.repeat(np.cumsum(sizes) - sizes, windows) + rank * WINDOW
        length = np.minimum(WINDOW, np.repeat(sizes, windows) - rank * WINDOW)
        order = np.argsort(-length, kind="stable")
        of, begin, length = of[order], begin[order], length[order]
        alive = np.searchsorted(-length, -np.arange(WINDOW), side="left")  # windows longer than t
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        states = [np.zeros(len(of), p.dtype) for p in self.parses]
        begun = [np.zeros(len(of), np.int32) for _ in self.parses]
        for t in range(WINDOW):
            n = int(alive[t])
            if n == 0:
                break
            c = got[begin[:n] + t]
            for parse, state, new in zip(self.parses, states, begun, strict=True):
                to = parse[state[:n] + c]
                new[:n] += to & 3
                np.right_shift(to, 2, out=state[:n])
        for j, new in enumerate(begun):
            total[:, j] = np.bincount(of, weights=new, minlength=len(texts))
        letters = np.zeros(len(texts), bool)
        letters[np.repeat(np.arange(len(texts)), sizes)[got != SEPARATOR]] = True
        return total, windows, letters

    def predict(self, texts: list[str]) -> list[tuple[str, float, int, int]]:
        """(language or 'und', probability, windows, phrases). All texts of one length compare the same way; ties go to the more frequent language, then by name."""
        if not self.langs:
            return [("und", 0.0, 0, 0)] * len(texts)
        total, windows, letters = self.phrases(texts)
        cost = self.prior - NATS * total
        best = np.argmax(cost, axis=1)
        share = 1 / np.exp(cost - cost.max(axis=1, keepdims=True)).sum(axis=1)
        return [(self.langs[b], float(s), int(w), int(total[i, b])) if ok else ("und", 0.0, int(w), 0) for i, (b, s, w, ok) in enumerate(zip(best, share, windows, letters, strict=True))]


def remainder(id_col: str, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def labelled_samples(
    docs: DataFrame, train: Column, sample_chars: int, id_col: str, text_col: str, lang_col: str, total_chars: int = TOTAL_CHARS, least_chars: int = LEAST_CHARS
) -> list[tuple[str, list[str], float]]:
    """A bounded sample of every language: about sample_chars characters, less where total_chars over the number of languages is less, but
    not less than least_chars; at most an eighth of that from one document, in order of the hash of id and text; equal rows count once.

    The bound is the only thing that is sampled here; the documents' number by language is counted over all. The threshold on
    the hash makes the expected sample eight times as large as needed, whatever the size of the table.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    total = rows.count()
    most = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.least(F.length("text"), F.lit(sample_chars // 8))).alias("chars")).orderBy(F.desc("n"), "lang").collect()
    if not most:
        return []
    sample_chars = min(sample_chars, max(least_chars, total_chars // len(most)))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(7), "id", "text"), 11) / F.lit(float(1 << 53))
    shares = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 8.0 * sample_chars / max(r.chars, 1))) for r in most], "lang string, share double")
    picked = rows.withColumn("draw", draw).join(if_small(shares), "lang").where(F.col("draw") < F.col("share")).select("lang", "draw", F.substring("text", 1, sample_chars // 8).alias("text")).distinct().collect()
    out = []
    by_lang: dict[str, list[tuple[float, str]]] = {}
    for p in picked:
        by_lang.setdefault(p.lang, []).append((p.draw, p.text))
    for r in most:
        texts, room = [], sample_chars
        for _, text in sorted(by_lang.get(r.lang, [])):
            if room > 0 and text:
                texts.append(text[:room])
                room -= len(text)
        out.append((r.lang, texts, r.n / total))
    return out


def _model(blob: bytes) -> Model:
    """The model of these samples. A worker holds one at a time; the tables of another, or of another stage, go before."""
    return kept(("langid", blob), lambda: Model(pickle.loads(blob)))


def identify(docs: DataFrame, held_out: Column | None = None, sample_chars: int = 32_768, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of docs: the id, held_out, lang_pred, score, n_windows and n_phrases.

    Learns from rows that are not held out and have a language. Text that is null or has no letter gives 'und' with score 0; so does
    every text if there is nothing to learn from, and an empty table gives an empty result. Repeated rows and rows without an id are
    predicted like others. The prediction reads nothing but the text, whole, and needs no shuffle.
    sample_chars bounds the labelled text that a language's automaton holds, and so the tables that workers build from the samples; every
    language is learned, with LEAST_CHARS of it at least, so those tables grow with the number of languages beyond 128.
    """
    held = F.lit(False) if held_out is None else held_out
    blob = pickle.dumps(labelled_samples(docs, ~held, sample_chars, id_col, text_col, lang_col))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(blob)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                columns = list(zip(*model.predict(part.column("text").to_pylist()), strict=True))
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *arrays], names=["doc_id", "held_out", "lang_pred", "score", "n_windows", "n_phrases"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), text_of(text_col).alias("text")).mapInArrow(predict, OUT).withColumnRenamed("doc_id", id_col)


def identified(docs: DataFrame, lang: str = "__lang", score: str = "__score", sample_chars: int = 32_768, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, all columns, and the prediction as columns lang and score, as in ``identify``; learned from all its rows that have a language."""
    blob = pickle.dumps(labelled_samples(docs, F.lit(True), sample_chars, id_col, text_col, lang_col))
    found = unused(docs, "__found")

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(blob)
        for texts in batches:
            parts = [model.predict(texts[at : at + SLICE].tolist()) for at in range(0, len(texts), SLICE)]
            yield pd.DataFrame([(lang, score) for part in parts for lang, score, *_ in part], columns=["lang", "score"])
        give_back()

    # Not deterministic only to the optimizer: a filter on the result must not make it run twice.
    return docs.withColumn(found, predict.asNondeterministic()(text_of(text_col))).select(*docs.columns, F.col(found)["lang"].alias(lang), F.col(found)["score"].alias(score))
