"""Running numbers over a whole table without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(df: DataFrame, order: str, buckets: int) -> Column:
    """The bucket of each row by quantiles of a numeric column; nulls are in the first."""
    cuts = sorted(set(df.select(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []))
    return F.coalesce(F.size(F.filter(F.lit(cuts), lambda x: x < F.col(order))), F.lit(0)) if cuts else F.lit(0)


def counted_before(df: DataFrame, order: str, flag: Column, name: str, by: tuple[str, ...] = (), buckets: int = 64) -> DataFrame:
    """df with the number of rows of its group for which flag holds and that come before it in the order of a numeric column, as name.

    Quantiles of the column cut the rows into buckets. A row counts within its bucket, and what the group has in earlier buckets is
    added, so neither the table nor a hot group is one task. Of rows of equal order some come first.
    """
    taken = {c.lower() for c in df.columns}
    bucket, own, of, before = (f"__{n}{'_' * sum(c.startswith(f'__{n}') for c in taken)}" for n in ("bucket", "own", "of", "before"))
    rows = df.withColumn(bucket, _buckets(df, order, buckets))
    counts = rows.groupBy(*by, bucket).agg(F.count_if(flag).alias("n"))
    earlier = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"{of}_{c}") for c in by], F.col(bucket).alias(of), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    here = F.col(bucket) == F.col(of)
    for c in by:
        here = here & F.col(c).eqNullSafe(F.col(f"{of}_{c}"))
    upto = Window.partitionBy(*by, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(own, F.coalesce(F.sum(flag.cast("int")).over(upto), F.lit(0))).join(offsets, here).withColumn(name, F.col(own) + F.col(before)).select(*df.columns, name)


def numbered(df: DataFrame, order: str, name: str, by: tuple[str, ...] = (), buckets: int = 64) -> DataFrame:
    """df with its rows' places from 1, as name, in the order of a numeric column: over all rows, or within each group of by.

    Nulls come first; rows of equal order are numbered as they come.
    """
    counted = counted_before(df, order, F.lit(True), name, by, buckets)
    return counted.withColumn(name, F.col(name) + 1)
