"""Removal of lines that many sites share (operator 3), with DataFrame functions only.

A line's spread is the number of distinct sites that have it. Lines of one site only are set aside by a plain aggregate; for the
rest, every task sketches the sites of each line hash as the lines come (HyperLogLog), and the sketches are merged by line hash. Where
the estimate is near the threshold, and only there, the distinct sites are counted exactly; lines at or above the threshold are removed
from every document. Short lines, which may be ordinary sentences, have a higher threshold; blank lines always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmill.llm.common import if_small, text_of, unused, with_rows, written

#: So many removed lines are written into the plan as a set; beyond, documents and lines are joined.
IN_PLAN = 2_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _counts(line: Column) -> Column:
    return F.trim(line) != ""


def line_spread(docs: DataFrame, min_sites: int, min_chars: int, lg_k: int = 10, text_col: str = "text", site_col: str = "source", short_sites: int | None = None) -> DataFrame:
    """(line, needed, estimate, sites): the hash of every line that two sites or more have, blank ones apart, and how many sites would make it go.

    needed is min_sites, or short_sites (default: twice as many) for lines of fewer than min_chars characters. sites is the exact count
    where the estimate lies within four standard errors of needed, null elsewhere. A null site is one site.
    """
    short_sites = 2 * min_sites if short_sites is None else short_sites
    site = F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col(site_col)), F.lit("")))
    lines = docs.select(site.alias("site"), F.explode(F.filter(_lines(text_of(text_col)), _counts)).alias("x"))
    lines = lines.select("site", F.xxhash64("x").alias("line"), F.when(F.length("x") < min_chars, short_sites).otherwise(min_sites).alias("needed"))
    shared = written(lines.groupBy("line").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select("line"))
    estimates = written(lines.join(if_small(shared), "line").groupBy("line", "needed").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("estimate")))
    margin = F.greatest(F.lit(1), F.ceil(4 * 1.04 / math.sqrt(2**lg_k) * F.col("needed")))
    near = written(estimates.where(F.abs(F.col("estimate") - F.col("needed")) <= margin).select("line"))
    exact = lines.join(if_small(near), "line", "left_semi").select("site", "line").distinct().groupBy("line").agg(F.count("*").alias("sites"))
    return estimates.join(exact, "line", "left")


def remove_shared_lines(docs: DataFrame, min_sites: int = 8, min_chars: int = 20, lg_k: int = 10, text_col: str = "text", site_col: str = "source", short_sites: int | None = None) -> DataFrame:
    """The rows of docs, all columns, without the lines that at least min_sites sites share; and __lines, __removed: how many there were and went.

    A line of fewer than min_chars characters goes if short_sites sites share it (default: twice min_sites). Blank lines always stay. Null text stays null with 0 lines; a text of removed lines only becomes empty.
    Repeated rows are cleaned alike, and an empty table stays empty. Lines are compared by their 64-bit hash. docs may have any
    other columns but __lines and __removed, which are the results' names (ValueError).
    """
    if {"__lines", "__removed"} & {c.lower() for c in docs.columns}:
        raise ValueError("docs has a column __lines or __removed")
    spread = line_spread(docs, min_sites, min_chars, lg_k, text_col, site_col, short_sites)
    gone = written(spread.where(F.coalesce(F.col("sites"), F.col("estimate")) >= F.col("needed")).select("line"))
    text, lines = F.col(text_col), _lines(F.col(text_col))
    rest, row, hits = (unused(docs, name) for name in ("__rest", "__row", "__hits"))
    n = F.coalesce(F.size(lines), F.lit(0))
    if gone.limit(IN_PLAN + 1).count() <= IN_PLAN:
        lost = [r.line for r in gone.collect()]
        keep = lambda x: ~_counts(x) | ~F.xxhash64(x).isin(lost)
        out = docs.withColumn(rest, F.filter(lines, keep) if lost else lines)
    else:
        docs_by_row = with_rows(docs, row)
        found = docs_by_row.select(row, F.explode(F.filter(_lines(text_of(text_col)), _counts)).alias("x")).select(row, F.xxhash64("x").alias("line"))
        of_row = found.join(if_small(gone), "line", "left_semi").groupBy(row).agg(F.collect_set("line").alias(hits))
        keep = lambda x: ~_counts(x) | ~F.coalesce(F.array_contains(hits, F.xxhash64(x)), F.lit(False))
        out = docs_by_row.join(of_row, row, "left").withColumn(rest, F.filter(lines, keep))
    cleaned = [F.when(text.isNotNull(), F.array_join(rest, "\n")).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*cleaned, n.alias("__lines"), F.when(text.isNotNull(), n - F.size(rest)).otherwise(0).alias("__removed"))
