"""Exact top-k search by inner product (operator 4): Fagin's threshold algorithm over sorted per-dimension lists.

All vectors lie in blocks of bounded size, dealt by the hash of their id. In a block every dimension has a list of the rows sorted by
value, read from the top where the query's component is positive and from the bottom where it is negative. Rows that sorted access
meets are scored in full; the sum of what the lists show next bounds every row not yet met, and the search of a block stops once the
kth score exceeds it. A first round searches each query in one block only; its kth score there goes back with the query as a floor, and
the second round leaves a block, even before the first access, as soon as the block's bound lies under that floor. The k best of each
block are then ranked per query. How much the bound saves depends on the vectors: with a few dimensions that matter it stops early,
with even directions in many dimensions no bound of this kind can, and every row is scored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenmill.llm.common import written

FOUND = "query_id long, of long, vec_id long, score long"


def sorted_lists(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by ascending value for each dimension, and those values."""
    order = np.argsort(values, axis=0, kind="stable")
    return order, np.take_along_axis(values, order, axis=0)


def threshold_search(ids: np.ndarray, values: np.ndarray, order: np.ndarray, ordered: np.ndarray, query_id: int, query: np.ndarray, k: int, floor: int | None = None, first: int = 16) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) of a block, by score and then by smaller id, without those under floor; and how many rows were scored.

    Ties at the kth place, or with floor, never stop the search early.
    """
    n = len(values)
    up, down = np.nonzero(query > 0)[0], np.nonzero(query < 0)[0]
    bound = lambda depth: ordered[n - 1 - depth, up] @ query[up] + ordered[depth, down] @ query[down]
    seen = np.zeros(n, dtype=bool)
    best_ids = best_scores = values[:0, 0]
    depth = 0
    while depth < n:
        if floor is not None and bound(depth) < floor:
            break
        step = min(n, max(first, depth * 8))
        if len(up) + len(down) == 0:
            step = n
            new = np.arange(n)
        else:
            met = np.zeros(n, dtype=bool)
            met[order[n - step : n - depth, up].ravel()] = True
            met[order[depth:step, down].ravel()] = True
            new = np.nonzero(met & ~seen)[0]
        seen[new] = True
        depth = step
        new = new[ids[new] != query_id]
        best_scores = np.concatenate([best_scores, values[new] @ query])
        best_ids = np.concatenate([best_ids.astype(ids.dtype), ids[new]])
        if len(best_ids) > k:
            kth = np.partition(best_scores, len(best_scores) - k)[len(best_scores) - k]
            near = np.nonzero(best_scores >= kth)[0]
            pick = near[np.lexsort((best_ids[near], -best_scores[near]))[:k]]
            best_scores, best_ids = best_scores[pick], best_ids[pick]
        if depth < n and len(best_ids) == k and best_scores.min() > bound(depth):
            break
    at = np.lexsort((best_ids, -best_scores))
    found = zip(best_scores[at].tolist(), best_ids[at].tolist(), strict=True)
    return [x for x in found if floor is None or x[0] >= floor], int(seen.sum())


def _matrix(column: pd.Series) -> np.ndarray:
    """The vectors as float64 where every inner product is then exact, else as Python's integers."""
    whole = np.array(column.tolist(), dtype=np.int64).reshape(len(column), -1)
    if whole.shape[1] == 0:
        return np.zeros((len(column), 1))
    return whole.astype(np.float64) if float(np.abs(whole.astype(np.float64)).max(initial=0)) ** 2 * whole.shape[1] < 2**51 else whole.astype(object)


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component x as double; vectors that are null or hold null, NaN or infinity take no part."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(scale * c.cast("double"))).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, query_block: int = 8192) -> DataFrame:
    """query_id, rank from 1, vec_id and score: for each query its k best vectors by inner product, ties to the smaller id.

    vectors and queries have columns vec_id and v (whole numbers). A query never finds a vector of its own id. Vectors of another
    length than the query's are no candidates. Repeated rows count once, and so do repeated queries; a null id takes no part.
    An empty side gives no rows; other columns are not read. block and query_block bound what a task holds; every query meets every block.
    """
    keyed = lambda df: df.where(F.col("vec_id").isNotNull()).select("vec_id", "v", F.size("v").alias("dims")).dropDuplicates(["vec_id", "v"])
    n, m = vectors.count(), queries.count()
    blocks, query_blocks = -(-n // block) or 1, -(-m // query_block) or 1
    dealt = lambda own, parts: F.pmod(F.xxhash64(F.lit(own), "vec_id"), F.lit(parts).cast("long"))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left = keyed(vectors).withColumn("b", dealt("block", blocks))
    right = keyed(queries).withColumn("of", F.xxhash64("v")).withColumn("home", dealt("block", blocks)).withColumn("q", dealt("query", query_blocks))

    def search(data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, int, int]] = []
        if len(data) and len(asked):
            ids, values = data["vec_id"].to_numpy(), _matrix(data["v"])
            order, ordered = sorted_lists(values)
            wanted = _matrix(asked["query"])
            if object in (values.dtype, wanted.dtype) or np.abs(values).max(initial=0) * np.abs(wanted).max(initial=0) * values.shape[1] >= 2**53:
                values, ordered, wanted = (np.vectorize(int, otypes=[object])(x) for x in (values, ordered, wanted))
            for query_id, of, floor, query in zip(asked["query_id"].tolist(), asked["of"].tolist(), asked["floor"].tolist(), wanted, strict=True):
                best, _ = threshold_search(ids, values, order, ordered, query_id, query, k, None if floor == "" else int(floor))
                rows += [(query_id, of, i, max(-(2**63), min(2**63 - 1, int(s)))) for s, i in best]
        return pd.DataFrame(rows, columns=["query_id", "of", "vec_id", "score"]).astype("int64")

    def searched(asked: DataFrame, data: DataFrame) -> DataFrame:
        by = ["b", "q", "dims"]
        return data.groupBy(*by).cogroup(asked.select(*by, F.col("vec_id").alias("query_id"), "of", F.col("v").alias("query"), "floor").groupBy(*by)).applyInPandas(search, FOUND)

    # The first round is worth it where the queries of one block make one group.
    rounds = 2 if 1 < blocks and m <= blocks * query_block else 1
    if rounds == 2:
        first = written(searched(right.withColumn("b", F.col("home")).withColumn("q", F.lit(0).cast("long")).withColumn("floor", F.lit("")), left.withColumn("q", F.lit(0).cast("long"))))
        floors = first.groupBy(F.col("query_id").alias("vec_id"), "of").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
        right = right.join(floors, ["vec_id", "of"], "left").withColumn("floor", F.coalesce(F.col("floor").cast("string"), F.lit(""))).withColumn("b", every(blocks)).where("b <> home")
        found = first.unionByName(searched(right, left.withColumn("q", every(query_blocks))))
    else:
        found = searched(right.withColumn("b", every(blocks)).withColumn("floor", F.lit("")), left.withColumn("q", every(query_blocks)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_nth(column: str, n: int) -> Column:
    return F.pmod(F.col(column), F.lit(n)) == 0
