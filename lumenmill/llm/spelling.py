"""Spelling variant grouping (operator 11): letter-parity bitmasks in three bands.

A word's mask has one bit a letter: whether it occurs an odd number of times. One inserted, deleted or replaced letter flips at most
two bits, so of three bands of letters at least one keeps its bits; and as every letter has its own bit, the letters of that band then
stand unchanged and in order. Words are joined on a band's bits together with the hash of the band's letters in order, on length
(equal or one apart), and on the half of the word that the edit leaves alone. Those keys keep every pair and make groups small: the
bits alone would be a few hundred values for any vocabulary. Each pair is verified, and counted at the first key that it meets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmill.llm.common import lower_az, text_of, written

#: Letters of a word, and the bit of each: a to z without case, then the code points from 192 to 255.
RUN = "[A-Za-zÀ-ÿ]"
LETTERS = [chr(c) for c in (*range(97, 123), *range(192, 256))]
BANDS = 3
_BAND = ["".join(LETTERS[band::BANDS]) for band in range(BANDS)]


def variant_words(docs: DataFrame, least_length: int, every: int, id_col: str, text_col: str) -> DataFrame:
    """(word, length, n): the runs of letters of all texts, with A-Z lower-cased, that have least_length letters or more.

    Where `every` divides crc32 of "<id>:<run>", the run loses the letter at that number modulo its length; every=0 changes none.
    """
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(lower_az(text_of(text_col)), F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))).alias("run"))
    if every:
        h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
        runs = runs.select("run", h.alias("h"))
        at = (F.col("h") % F.char_length("run")).cast("int")
        cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
        runs = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("run"))
    words = runs.select(F.col("run").alias("word"), F.char_length("run").cast("int").alias("length")).where(F.col("length") >= least_length)
    return words.groupBy("word", "length").agg(F.count("*").alias("n"))


def band_letters(word: Column, band: int) -> Column:
    """The word's letters that belong to a band, in order."""
    return F.translate(word, "".join(letters for i, letters in enumerate(_BAND) if i != band), "")


def band_mask(word: Column, band: int) -> Column:
    """The bits of a band: bit i is set if its letter i occurs an odd number of times."""
    bit = lambda c: F.when(c == "", F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1), F.position(c, F.lit(_BAND[band])) - 1))
    return F.aggregate(F.split(band_letters(word, band), ""), F.lit(0), lambda mask, c: mask.bitwiseXOR(bit(c)))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two different words are one insertion, deletion or replacement apart."""
    return F.levenshtein(a, b, 1) == 1


def _keyed(words: DataFrame, shorter: bool) -> DataFrame:
    """(key, at, short, word, n): the keys of every word as the shorter of a pair, or as either.

    `short` is the length of the pair's shorter word and half of it the part that one edit can leave alone at the start (side 0) or the
    end (side 1) of both; `at` is the band and the side.
    """
    word, length = F.col("word"), F.col("length")
    bands = words.select("word", "length", "n", *[F.struct(band_mask(word, b).alias("mask"), band_letters(word, b).alias("letters")).alias(f"band{b}") for b in range(BANDS)])

    def keys(short: Column) -> list[Column]:
        half = F.floor(short / 2).cast("int")
        sides = (word.substr(F.lit(1), half), word.substr(length - half + 1, half))
        return [
            F.struct(F.xxhash64(F.lit(b), F.col(f"band{b}.mask"), F.col(f"band{b}.letters"), short, F.lit(s), side).alias("key"), F.lit(2 * b + s).alias("at"), short.alias("short"))
            for b in range(BANDS) for s, side in enumerate(sides)
        ]

    found = keys(length) + ([] if shorter else keys(length - 1))
    return bands.select("word", "length", "n", F.explode(F.array(*found)).alias("k")).select("k.key", "k.at", "k.short", "word", "length", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words that are one edit apart, once; from rows (word, length, n) of distinct words."""
    a = _keyed(words, shorter=True).select("key", "at", "short", F.col("word").alias("a"), F.col("length").alias("a_length"), F.col("n").alias("a_n"))
    b = _keyed(words, shorter=False).select("key", "at", "short", F.col("word").alias("b"), F.col("length").alias("b_length"), F.col("n").alias("b_n"))
    met = a.join(b, ["key", "at", "short"]).where(((F.col("b_length") == F.col("a_length")) & (F.col("a") < F.col("b"))) | (F.col("b_length") == F.col("a_length") + 1))
    half = F.floor(F.col("short") / 2).cast("int")
    side = F.when(F.substring("a", F.lit(1), half) == F.substring("b", F.lit(1), half), 0).otherwise(1)
    same = [band_letters(F.col("a"), i) == band_letters(F.col("b"), i) for i in range(BANDS)]
    band = F.when(same[0], 0).when(same[1], 1).otherwise(2)
    return met.where(one_edit(F.col("a"), F.col("b"))).where(F.col("at") == 2 * band + side).select("a", "a_n", "b", "b_n")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_n: int = 2, ratio: int = 10, every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each word of least_length letters or more that occurs least_n times or more: word, n, n_near, form, form_n and root.

    Near words are one edit apart. A word's form is its near word of largest n (ties: the smallest in code-point order), if that n is at
    least ratio times the word's; root is where forms lead in the end, the word itself without a form.
    Null and empty text has no words, a null id counts as '' where `every` (see variant_words) changes words; repeated rows count each
    time; other columns are not read; very long runs are words like others; an empty table gives an empty result.
    Forms grow by ratio (2 at least) with every step, so links end, and the doubling rounds are bounded by the largest n.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms have to grow")
    words = written(variant_words(docs, least_length, every, id_col, text_col).where(F.col("n") >= least_n))
    both = F.explode(F.array(*[F.struct(F.col(w).alias("word"), F.col(x).alias("near"), F.col(f"{x}_n").alias("near_n")) for w, x in (("a", "b"), ("b", "a"))]))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words).select(both.alias("p")).select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    has_form = -F.col("best.less") >= ratio * F.col("n")
    formed = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has_form, F.col("best.near")).alias("form"), F.when(has_form, -F.col("best.less")).alias("form_n"),
    ))
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = formed.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(1.0, math.log(most, ratio)))) + 1):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
