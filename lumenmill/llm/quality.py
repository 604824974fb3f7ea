"""Quality classifier with hierarchical empirical Bayes (operator 1).

A logistic model gives each document evidence of its own. Grouped aggregation gives the mean evidence of every host and of every
path within a host. Hosts are shrunk toward the global mean and paths toward their host, by prior weights that are estimated from
how much groups differ beyond chance, so a sparse site says little. A document's odds are then moved by its path's posterior odds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmill.llm.common import if_small, text_of, written

FEATURES = ("log_words", "symbols", "upper", "digits", "word_length", "repeated", "one_word")


def features(text: Column) -> list[Column]:
    """Shares and lengths that do not depend on the language, in the order of FEATURES."""
    chars = F.greatest(F.length(text), F.lit(1))
    words = F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")
    n = F.size(words)
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / chars
    distinct = F.size(F.array_distinct(words))
    return [
        F.log1p(n.cast("double")), share(r"[^\p{L}\p{N}\s.,]"), share(r"\p{Lu}"), share(r"\p{N}"), F.least(chars / n, F.lit(30.0)) / 10,
        1 - distinct / n, F.least(F.lit(1.0), n / (distinct * F.lit(8.0))),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, and the means and scales of the columns, by Newton's method with a ridge. One class or no rows give a constant."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(x.shape[1]), float(np.log(p / (1 - p))), np.zeros(x.shape[1]), np.ones(x.shape[1])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    keep = np.full(z.shape[1], ridge * len(y))
    keep[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1]), mean, scale


def _prior_weight(groups: DataFrame, toward: Column) -> float:
    """How many documents the prior is worth: within-group variance over the variance of group means beyond chance (moments), from 1 to 10,000."""
    r = groups.where("n > 1").select(
        F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("within"), F.sum(F.col("n") - 1).alias("df"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - toward, 2)).alias("between"), F.sum("n").alias("rows"), F.count("*").alias("k"),
    ).first()
    if not r.k or not r.df or r.rows <= r.k:
        return 10.0
    within = max(r.within / r.df, 1e-9)
    beyond = (r.between - r.k * within) / r.rows
    return float(min(10_000.0, max(1.0, within / beyond))) if beyond > 0 else 10_000.0


def quality_posteriors(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample_rows: int = 20_000, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each row of docs: the id, evidence, host_posterior, path_posterior, quality and kept (quality >= cut).

    The logistic model learns from at most sample_rows different labelled rows, chosen by the hash of the id, the same on each run; everything else covers all rows.
    A document's label is the mean of its labels' rows; null labels are left out. Null or empty text has its features as '' and is judged
    by them; null host and path are groups of their own. Without labels every document gets the same evidence. Repeated rows weigh as rows.
    An empty table gives an empty result; other columns are not read.
    """
    truth = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.avg(label_col).alias("__y"))
    n = truth.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(3), "__id"), 11) / F.lit(float(1 << 53))
    chosen = truth.where(draw < min(1.0, 0.9 * sample_rows / max(n, 1)))
    x = F.array(*[c.cast("double") for c in features(text_of(text_col))])
    sample = docs.select(F.col(id_col).alias("id"), x.alias("x")).join(if_small(chosen), F.col("id") == F.col("__id")).select("x", "__y").distinct().orderBy(F.xxhash64("x", "__y"), "x", "__y").limit(sample_rows).collect()
    w, bias, mean, scale = fit_logistic(np.array([r[0] for r in sample]).reshape(-1, len(FEATURES)), np.array([r[1] for r in sample], dtype=float))
    linear = F.lit(float(bias))
    for i in range(len(FEATURES)):
        linear = linear + (F.col("x")[i] - F.lit(float(mean[i]))) * F.lit(float(w[i] / scale[i]))
    odds = F.greatest(F.lit(-12.0), F.least(F.lit(12.0), linear))
    own = written(docs.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), x.alias("x")).select("id", "host", "path", odds.alias("odds")).withColumn("p", 1 / (1 + F.exp(-F.col("odds")))))

    sums = lambda *by: own.groupBy(*by).agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    every = sums().first()
    center = every.s / every.n if every.n else 0.5
    hosts = written(sums("host"))
    weight = _prior_weight(hosts, F.lit(float(center)))
    hosts = hosts.select(F.col("host").alias("of_host"), ((F.col("s") + weight * center) / (F.col("n") + weight)).alias("host_posterior"))
    paths = written(sums("host", "path").join(if_small(hosts), F.col("host").eqNullSafe(F.col("of_host"))))
    weight = _prior_weight(paths, F.col("host_posterior"))
    paths = paths.select("of_host", F.col("path").alias("of_path"), "host_posterior", ((F.col("s") + weight * F.col("host_posterior")) / (F.col("n") + weight)).alias("path_posterior"))
    logit = lambda c: F.log(c / (1 - c))
    joined = own.join(if_small(written(paths)), F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")))
    moved = F.col("odds") + logit(F.col("path_posterior")) - F.lit(float(np.log(center / (1 - center))))
    quality = F.round(1 / (1 + F.exp(-moved)), 6)
    return joined.select(F.col("id").alias(id_col), F.round("p", 6).alias("evidence"), F.round("host_posterior", 6).alias("host_posterior"), F.round("path_posterior", 6).alias("path_posterior"), quality.alias("quality"), (quality >= cut).alias("kept"))
