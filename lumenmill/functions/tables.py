"""Intermediate tables of iterative operators, and how pixels are dealt out."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels of a partition. Shuffled pixels compress so well that their bytes say little about what a task has to hold.
PIXELS = 1 << 17


def settled(df: DataFrame) -> DataFrame:
    """df computed once, with its lineage cut: a reliable checkpoint in the folder that the cluster shares, so lost executors take nothing with them.

    The folder is spark.checkpoint.dir, or SparkContext.setCheckpointDir; /tmp only where driver and executors are one process.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or "file:///tmp/checkpoints")
    return df.checkpoint(eager=True)


def dealt(px: DataFrame, pixels: int | None = None) -> DataFrame:
    """px dealt out by image: into partitions of about PIXELS if pixels says how many there are or will be, else unless it has been dealt out before.

    That is noted in the metadata of image_id. Where the note is out of date, Spark itself shuffles as windows and groups need it.
    """
    if pixels is None and px.schema["image_id"].metadata.get("dealt"):
        return px
    rows = px.repartition("image_id") if pixels is None else px.repartition(max(1, math.ceil(pixels / PIXELS)), "image_id")
    return rows.withColumn("image_id", F.col("image_id").alias("image_id", metadata={"dealt": True}))


def apart(df: DataFrame) -> DataFrame:
    """df as a side of a join that is sorted and merged. Spark knows nothing of how many rows an explode makes or a checkpoint holds, and would broadcast tables of pixels as small ones."""
    return df.hint("merge")
