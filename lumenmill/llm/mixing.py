"""Mixing sources to target weights (operator 2), with DataFrame functions only.

The tokens of each source are summed, a repetition rate is derived from its target, and each document
is emitted floor(rate) times plus once more if a draw seeded by its id falls under a threshold, which is the fraction of the rate.
With draws that know nothing of each other a source of few or very unequal documents would miss its target. So the threshold is set
for each size class of a source, the largest documents first: it is the fraction, corrected for what the classes before took too
much or too little. The correction is as often up as down, so a document's probability stays the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenmill.llm.common import WORD, if_small, text_of, unused, with_rows, written

#: Parts into which a size class of a source is cut by the draws. Its table has at most so many rows for each of the 63 classes of a source.
PARTS = 1024


def word_count(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row a source: source, source_size and target, from rows (source, size).

    Sources in order of code points, null last, take the weights in turn. They share `share` times all sizes by weight;
    a target stops at cap times its source's size and the excess is shared again by weight until none is above.
    That ends where every target is min(cap * size, level * weight), so the level is found directly: with sources in order of
    cap * size / weight, those before the first whose bound the level reaches are full. The windows run over one row a source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = totals.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1))
    ranked = ranked.withColumn("bound", cap * F.col("source_size"))
    every = Window.partitionBy()
    rising = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.select(
        "*",
        F.row_number().over(rising).alias("place"),
        (share * F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(upto), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))).alias("weight_left"),
    ).withColumn("level", F.col("left") / F.col("weight_left"))
    level = F.min(F.when(F.col("level") <= F.col("bound") / F.col("weight"), F.struct("place", "level"))).over(every)
    return full.select("source", "source_size", F.least(F.col("bound"), F.coalesce(level["level"] * F.col("weight"), F.col("bound"))).alias("target"))


def _uniform(*of: Column) -> Column:
    """A number from 0 to 1 by the hash of its arguments."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / F.lit(float(1 << 53))


def class_thresholds(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """(of, class, cut): in a size class of a source, documents whose part is below cut get one copy more. From rows (source, class, part, size).

    A source's classes are gone through from the largest documents down. A class should take the fraction of its size, less what
    the classes before took beyond theirs: all parts that fit, and the next one with the probability that makes the mean right.
    So a source ends within about one part of its smallest class of its target. One row a source holds the sums of its parts.
    """
    parts = sized.where("size > 0").groupBy("source", "class", "part").agg(F.sum("size").alias("s"))
    upto = F.sum("s").over(Window.partitionBy("source", "class").orderBy("part"))
    classes = parts.withColumn("upto", upto).groupBy("source", "class").agg(F.sort_array(F.collect_list(F.struct("part", "s", "upto"))).alias("parts"), F.sum("s").alias("total"))
    classes = classes.withColumn("u", _uniform(F.lit(seed), F.lit("class"), F.coalesce("source", F.lit("")), "class"))
    rate = F.col("target") / F.col("source_size")
    by_source = classes.groupBy("source").agg(F.sort_array(F.collect_list(F.struct((-F.col("class")).alias("turn"), "total", "u", "parts"))).alias("classes"))
    by_source = by_source.join(if_small(targets), F.col("source").eqNullSafe(F.col("of"))).withColumn("part_rate", rate - F.floor(rate))

    def turn(state: Column, x: Column) -> Column:
        want = F.col("part_rate") * x["total"] - state["over"]
        fit = F.filter(x["parts"], lambda y: y["upto"] <= want)
        taken = F.when(F.size(fit) > 0, F.element_at(fit, -1)["upto"]).otherwise(F.lit(0).cast("long"))
        after = F.get(x["parts"], F.size(fit))
        more = F.coalesce((x["u"] * after["s"]) < (want - taken), F.lit(False))
        cut = F.when(more, after["part"] + 1).when(F.size(fit) > 0, F.element_at(fit, -1)["part"] + 1).otherwise(F.lit(0))
        over = taken + F.when(more, after["s"]).otherwise(F.lit(0).cast("long")) - want
        return F.struct(over.alias("over"), F.concat(state["cuts"], F.array(F.struct((-x["turn"]).alias("class"), cut.alias("cut")))).alias("cuts"))

    start = F.struct(F.lit(0.0).alias("over"), F.expr("cast(array() AS array<struct<class: int, cut: int>>)").alias("cuts"))
    return by_source.select("of", F.explode(F.aggregate("classes", start, turn)["cuts"]).alias("x")).select("of", F.col("x.class").alias("class"), F.col("x.cut").alias("cut"))


def mixing_plan(docs: DataFrame, size: Column, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row for each row of docs: the id, size, source_size, target, rate and copies.

    rate is target / source_size; copies is floor(rate), plus one where the draw by the hash of (seed, id) lies under the threshold of
    the document's size class in its source, which is the fraction of the rate, corrected so that the source comes near its target.
    The same id always draws the same, so reruns agree however the rows are dealt, and repeated rows are taken alike; rows without an
    id draw by their size. With row_col, that column is handed through as __row, and rows without an id draw by it, each its own.
    Documents of size 0 draw against the fraction itself. A source of size 0 has rate 0; null is a source like any other. An empty table gives an empty plan.
    The tables of sources and of thresholds are broadcast only if they have been counted and are small; a hot source is then no key of any shuffle.
    """
    through = ["__row"] if row_col else []
    alone = F.concat(F.lit("row "), F.col(row_col)) if row_col else F.concat(F.lit("size "), size.cast("string"))
    draw = _uniform(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), alone))
    sized = docs.select(*[F.col(row_col).alias("__row") for _ in through], F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), draw.alias("draw"))
    size_class = F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int")
    sized = written(sized.withColumn("class", size_class).withColumn("part", F.floor(F.col("draw") * PARTS).cast("int")))
    targets = written(source_targets(sized, weights, share, cap).withColumnRenamed("source", "of"))
    cuts = written(class_thresholds(sized, targets, seed))
    rated = sized.join(if_small(targets), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    rated = rated.join(if_small(cuts.withColumnRenamed("class", "of_class")), F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class")), "left")
    whole = F.floor("rate")
    more = F.when(F.col("class") < 0, F.col("draw") < F.col("rate") - whole).otherwise(F.coalesce(F.col("part") < F.col("cut"), F.lit(False)))
    return rated.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "rate", (whole + more.cast("long")).alias("copies"), *through)


def mix_documents(docs: DataFrame, size: Column, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mixture itself: the rows of docs, all columns, each as often as the plan says for that row; nulls, ties, repeats and empty tables as there."""
    row, copies, copy = (unused(docs, name) for name in ("__row", "__copies", "__copy"))
    rows = with_rows(docs, row)
    plan = mixing_plan(rows, size, weights, share, cap, seed, id_col, source_col, row_col=row)
    mixed = rows.join(plan.where("copies > 0").select(F.col("__row").alias(row), F.col("copies").alias(copies)), row)
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)
