"""Documents to packed training sequences, in five stages.

Language ID drops text without a language and fills in missing languages; exact dedup and the n-gram Jaccard join (five words, similarity
0.8) keep one document of each group of copies; mixing repeats or leaves out documents so that sources meet their targets; packing
cuts what is left into sequences. Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.llm.common import clear, dropped, modest_batches, modest_reads, noted, read, unused, with_rows, written
from lumenmill.llm.exact_dedup import distinct_documents
from lumenmill.llm.langid import identified
from lumenmill.llm.mixing import mix_documents, word_count
from lumenmill.llm.ngram_join import ngram_components
from lumenmill.llm.packing import pack_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was recognised; a null lang becomes the language found. Text without any letter goes, and so do null and empty text.

    If no text has a language there is nothing to learn from: then only null text and text without a letter go, and lang stays null.
    Each row is judged alone, so repeated rows and rows without an id or source stay or go alike; an empty table stays empty.
    """
    modest_batches(spark, 500)
    modest_reads(spark)
    if not docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).limit(1).count():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = unused(docs, "__lang"), unused(docs, "__score")
    found = identified(docs, lang, score).where(F.col(lang) != "und")
    return found.select(*[F.coalesce("lang", lang).alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each text; null and empty text are one text. A row without an id stays only if all its copies lack one.

    Each row is a document, whatever its id, so of equal rows one stays; nulls in other columns say nothing, and an empty table stays empty.
    """
    return distinct_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that links of similarity 0.8 or more connect; rows without an id come last.

    Each row is a document, whatever its id. Text without words links with nothing and stays. An empty table stays empty.
    """
    row = unused(docs, "__row")
    rows = with_rows(docs, row)
    with noted() as spent:
        groups = ngram_components(rows, width=5, num=80, den=100, id_col=row).select(F.col(row).alias("row"), "component_id")
        ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
        first = F.min(F.struct(F.col("id").isNull(), "id", "row"))
        kept = groups.join(ids, "row").groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("row"))
        gone = written(groups.select("row").join(kept, "row", "left_anti").select(F.col("row").alias(row)))
    clear(spark, spent, keep=gone)  # the tables of the search, which nothing reads now that the rows that go are written
    # They are fewer than those that stay, and a table of known size: if Spark finds it small, no text is shuffled here.
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, counted in words.

    A null source is a source; rows without an id draw each their own; repeated rows are taken alike; text without words draws too. An empty table stays empty.
    """
    return mix_documents(docs, word_count("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens. Null and empty text are an end id alone; repeated rows and rows without an id are packed like others; an empty table gives no pieces."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: SQL has no suffix automata, GRU or tokenizer; tests/llm runs the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet and read again as the next one's documents. What a stage leaves for its result goes once that is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with noted() as spent:
            docs = written(stage(spark, docs, sf_dir))
        clear(spark, spent, keep=docs)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
