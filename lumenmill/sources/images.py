"""Rasters from and to image files: Spark's own image source for reading, a plain PNG encoder for writing."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lumenmill.functions.color import gray

# The suffixes of image files.
SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")
# Fixed values end.


def list_images(spark: SparkSession, *folders: str) -> DataFrame:
    """Paths, sizes and digests of the image files of folders, not of their subfolders; each path once."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load([*folders])
    named = found.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*SUFFIXES))
    return named.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).dropDuplicates(["path"])


@F.pandas_udf(BooleanType())
def _transparent(data: pd.Series) -> pd.Series:
    """Whether some alpha of a four-channel image is under 250."""
    return data.map(lambda d: bool(len(d)) and bool(np.frombuffer(d, np.uint8)[3::4].min() < 250))


def read_images(spark: SparkSession, *folders: str) -> DataFrame:
    """origin, width, height, n_channels, has_alpha, has_real_alpha (some alpha under 250) and data; files that do not decode are left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load([*folders]).select("image.*")
    alpha = F.col("nChannels") == 4
    return rows.select("origin", "width", "height", F.col("nChannels").alias("n_channels"), alpha.alias("has_alpha"), F.when(alpha, _transparent("data")).otherwise(False).alias("has_real_alpha"), "data")


def to_px(images: DataFrame) -> DataFrame:
    """Long form (origin, width, height, y, x, b, g, r); gray images have three equal channels. An image's bytes are cut in its own task, in bands of rows."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for origin, w, h, n, data in batch.itertuples(index=False):
                flat = np.frombuffer(data, np.uint8).reshape(h * w, n)
                band = max(1, 200_000 // max(1, w)) * w
                for first in range(0, h * w, band):
                    part = flat[first : first + band]
                    at = np.arange(first, first + len(part))
                    b, g, r = (part[:, min(i, n - 1) if n < 3 else i].astype(np.int32) for i in range(3))
                    yield pd.DataFrame({"origin": origin, "width": w, "height": h, "y": at // w, "x": at % w, "b": b, "g": g, "r": r})

    return images.select("origin", "width", "height", "n_channels", "data").mapInPandas(cut, "origin string, width long, height long, y long, x long, b int, g int, r int")


def color_rasters(images: DataFrame) -> DataFrame:
    """The pixels of images as the colour metrics take them: image_id is the file."""
    return to_px(images).withColumnRenamed("origin", "image_id")


def gray_rasters(images: DataFrame) -> DataFrame:
    """The pixels of images as the stencils and gray metrics take them: image_id is the file, l the lightness."""
    return to_px(images).select(F.col("origin").alias("image_id"), "width", "height", "y", "x", gray(F.col("b"), F.col("g"), F.col("r")).alias("l"))


def png(width: int, height: int, gray: bytes) -> bytes:
    """An 8-bit gray PNG."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + gray[y * width : (y + 1) * width] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def encode(px: DataFrame) -> DataFrame:
    """One PNG (image_id, width, height, png) for each gray raster of px; one raster is one group."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf["x"].max()) + 1, int(pdf["y"].max()) + 1
        plane = np.zeros((h, w), np.uint8)
        plane[pdf["y"], pdf["x"]] = pdf["l"]
        return pd.DataFrame({"image_id": [key[0]], "width": [w], "height": [h], "png": [png(w, h, plane.tobytes())]})

    return px.groupBy("image_id").applyInPandas(one, "image_id long, width int, height int, png binary")


def write_files(encoded: DataFrame, folder: str) -> DataFrame:
    """Writes each PNG to folder, which all executors must share, by way of a temporary name; returns what was written."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = [os.path.join(folder, f"{i}.png") for i in batch["image_id"]]
            for path, body in zip(paths, batch["png"], strict=True):
                with open(f"{path}.part", "wb") as out:
                    out.write(body)
                os.replace(f"{path}.part", path)
            yield pd.DataFrame({"image_id": batch["image_id"], "path": paths, "bytes": [len(b) for b in batch["png"]]})

    return encoded.mapInPandas(put, "image_id long, path string, bytes long")


def read_manifest(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A manifest CSV: all values are trimmed strings, missing ones empty."""
    rows = spark.read.csv(path, header=True, sep=delimiter, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.select(*[F.coalesce(F.trim(c), F.lit("")).alias(c.strip().lstrip("﻿")) for c in rows.columns])
