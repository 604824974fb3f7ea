"""Rows chosen by lists and by what is there, and plain facts of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def selected(manifest: DataFrame, wanted: DataFrame, key: str = "sample_id") -> DataFrame:
    """The manifest's row for each row of wanted (ordinal, key), which keeps its ordinal; found is false, and the other columns null, where the manifest has none.

    An id that is wanted twice comes twice; a null id is never found. The manifest has one row a key.
    """
    rest = [c for c in manifest.columns if c != key]
    there = manifest.withColumn("found", F.lit(True))
    return wanted.join(there, key, "left").select("ordinal", key, *rest, F.coalesce("found", F.lit(False)).alias("found"))


def with_both_sides(rows: DataFrame, originals: DataFrame, candidates: DataFrame, file: str = "file_name", method: str = "method") -> DataFrame:
    """The rows whose file has an original (file) and which have a candidate (file, method) themselves; rows are not repeated by files that are listed twice."""
    return rows.join(originals.select(file), file, "left_semi").join(candidates.select(file, method), [file, method], "left_semi")


def file_format(path: Column) -> Column:
    """The suffix of a path in lower case, jpeg as jpg; unknown without one."""
    suffix = F.lower(F.regexp_extract(path, r"[^/\\.]\.([^./\\]+)$", 1))
    return F.when(suffix == "", "unknown").when(suffix == "jpeg", "jpg").otherwise(suffix)


def dimensions(width: Column, height: Column) -> Column:
    """Width, height, long and short side, and megapixels to three places."""
    return F.struct(width.alias("width"), height.alias("height"), F.greatest(width, height).alias("long_side"), F.least(width, height).alias("short_side"), F.round(width * height / 1_000_000, 3).alias("megapixels"))


def tail(text: Column, length: int = 1200) -> Column:
    """The last characters of a text, as a log is shown."""
    return F.right(text, F.lit(length))
