"""Neighbourhood operators on the long pixel table (image_id, y, x, value), for rasters of any size.

A raster is partitioned once, by image; windows over its rows and columns then only sort. Borders reflect without repeating
the edge pixel: pixel -k is pixel k, as often as it takes where a raster is smaller than the radius. ``padded`` writes the mirrored border
as rows, so that plain frames cover it. Tables may mix sizes; columns ``width`` and ``height`` are used where a table has them, and are
found once from the pixels where it has not. The results have them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lumenmill.functions.tables import dealt


def row() -> WindowSpec:
    return Window.partitionBy("image_id", "y").orderBy("x")


def column() -> WindowSpec:
    return Window.partitionBy("image_id", "x").orderBy("y")


def sized(px: DataFrame) -> DataFrame:
    """px with the width and height of each pixel's image."""
    if {"width", "height"} <= set(px.columns):
        return px
    image = Window.partitionBy("image_id")
    return dealt(px).select("*", (F.max("x").over(image) + 1).alias("width"), (F.max("y").over(image) + 1).alias("height"))


def _mirrors(axis: str, radius: int | Column, side: Column) -> Column:
    """Where a pixel stands along one axis: its place, and its mirror images within radius of the edge."""
    at, side = F.col(axis).cast("long"), side.cast("long")
    once = F.array_compact(F.array(at, F.when((at >= 1) & (at <= radius), -at), F.when((at <= side - 2) & (at >= side - 1 - radius), 2 * (side - 1) - at)))
    period = 2 * (side - 1)
    turn = lambda t: F.when(side == 1, F.lit(0).cast("long")).otherwise(side - 1 - F.abs(side - 1 - F.pmod(t, period)))
    often = F.filter(F.sequence(F.lit(-radius).cast("long"), side - 1 + radius), lambda t: turn(t) == at)
    return F.when(side > radius, once).otherwise(often)


def padded(px: DataFrame, radius: int | Column) -> DataFrame:
    """px with its size and the mirrored pixels around it; the radius may hang on the image."""
    wide = sized(px).withColumn("x", F.explode(_mirrors("x", radius, F.col("width"))))
    return wide.withColumn("y", F.explode(_mirrors("y", radius, F.col("height"))))


def inside(px: DataFrame) -> DataFrame:
    return px.where((F.col("x") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") >= 0) & (F.col("y") < F.col("height")))


def neighbours(px: DataFrame, value: str = "l", edge: str = "reflect") -> DataFrame:
    """Adds up, down, left, right and the four corners (ul, ur, dl, dr) of every pixel.

    Beyond an edge stands the pixel on the other side, or the pixel itself if there is none (reflect), the pixel itself (repeat), or 0 (zero).
    """

    def pair(name: str, axis: WindowSpec) -> tuple[Column, Column]:
        before, after, own = F.lag(name).over(axis), F.lead(name).over(axis), F.col(name)
        if edge == "zero":
            return F.coalesce(before, F.lit(0)), F.coalesce(after, F.lit(0))
        return (F.coalesce(before, own), F.coalesce(after, own)) if edge == "repeat" else (F.coalesce(before, after, own), F.coalesce(after, before, own))

    left, right = pair(value, row())
    rows = dealt(px).select("*", left.alias("left"), right.alias("right"))
    around = [c.alias(n) for v, names in ((value, ("up", "down")), ("left", ("ul", "dl")), ("right", ("ur", "dr"))) for c, n in zip(pair(v, column()), names, strict=True)]
    return rows.select("*", *around)


def laplacian(v: str = "l") -> Column:
    return (F.col("up") + F.col("down") + F.col("left") + F.col("right") - 4 * F.col(v)).cast("double")


def sobel() -> tuple[Column, Column]:
    c = F.col
    gx = (c("ur") + 2 * c("right") + c("dr")) - (c("ul") + 2 * c("left") + c("dl"))
    gy = (c("dl") + 2 * c("down") + c("dr")) - (c("ul") + 2 * c("up") + c("ur"))
    return gx.cast("double"), gy.cast("double")


def box(px: DataFrame, radius: int, agg, out: str, value: str = "l") -> DataFrame:
    """agg (F.sum, F.max, F.min) over the square of the given radius, one axis after the other."""
    n = Window.currentRow
    rows = padded(dealt(px), radius)
    rows = rows.withColumn("__row", agg(value).over(row().rowsBetween(n - radius, n + radius)))
    return inside(rows.withColumn(out, agg("__row").over(column().rowsBetween(n - radius, n + radius))).drop("__row"))


def _targets(axis: str, size: int, side: Column) -> Column:
    """The target pixels t of one axis whose floor(t * side / size) is this pixel."""
    low, high = ((((F.col(axis) + k) * size + side - 1) / side).cast("long") for k in (0, 1))
    return F.explode(F.when(high > low, F.sequence(low, high - 1)))


def resize_nearest(px: DataFrame, width: int, height: int) -> DataFrame:
    """Every target pixel takes the source pixel at floor(target * side / size)."""
    wide = sized(px).withColumn("tx", _targets("x", width, F.col("width")))
    return wide.withColumn("ty", _targets("y", height, F.col("height"))).select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "l")


def resize_area(px: DataFrame, factor: int) -> DataFrame:
    """Means of factor x factor blocks, rounded half up."""
    return px.groupBy("image_id", F.expr(f"y div {factor}").alias("y"), F.expr(f"x div {factor}").alias("x")).agg(F.floor(F.avg("l") + 0.5).cast("int").alias("l"))


def weights(sigma: float) -> list[float]:
    """A normalised Gaussian of radius ceil(3 sigma), the middle first and then one side."""
    radius = math.ceil(3 * sigma)
    half = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(radius + 1)]
    total = half[0] + 2 * sum(half[1:])
    return [w / total for w in half]


def gaussian(px: DataFrame, sigma: float, out: str, value: str = "l") -> DataFrame:
    """Blurs value, as a double, along rows and then columns; the border reflects."""
    half = weights(sigma)
    rows = padded(dealt(px), len(half) - 1)

    def along(name: str, axis: WindowSpec) -> Column:
        total = F.col(name) * half[0]
        for k, w in enumerate(half[1:], 1):
            total = total + (F.lag(name, k).over(axis) + F.lead(name, k).over(axis)) * w
        return total

    rows = rows.withColumn("__row", along(value, row()))
    return inside(rows.withColumn(out, along("__row", column())).drop("__row"))


def quantized(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(value + 0.5))).cast("int")


def cubic(t: Column) -> Column:
    """The cubic kernel (Keys, a = -0.75), which reaches two pixels."""
    a = -0.75
    return F.when(t <= 1, ((a + 2) * t - (a + 3)) * t * t + 1).otherwise((((t - 5) * t + 8) * t - 4) * a)


def lanczos(t: Column) -> Column:
    """The Lanczos kernel of four lobes."""
    wave = 4 * F.sin(math.pi * t) * F.sin(math.pi * t / 4) / (math.pi * math.pi * t * t)
    return F.when(t == 0, F.lit(1.0)).when(t < 4, wave).otherwise(F.lit(0.0))


def taps(sides: DataFrame, target: int, kernel: Callable[[Column], Column], reach: int) -> DataFrame:
    """(side, src, dst, w): the normalised weights of the 2 * reach source pixels around each target pixel, for every length of an axis; the border repeats."""
    at = (F.col("dst") + 0.5) * F.col("side") / target - 0.5
    rows = sides.select("side", F.explode(F.sequence(F.lit(0), F.lit(target - 1))).alias("dst")).select("side", "dst", at.alias("at"), F.explode(F.sequence(F.lit(1 - reach), F.lit(reach))).alias("o"))
    src = F.floor("at") + F.col("o")
    rows = rows.select("side", "dst", F.greatest(F.lit(0), F.least(F.col("side") - 1, src)).cast("long").alias("src"), kernel(F.abs(F.col("at") - src)).alias("w"))
    sums = rows.groupBy("side", "dst", "src").agg(F.sum("w").alias("w"))
    return sums.select("side", "dst", "src", (F.col("w") / F.sum("w").over(Window.partitionBy("side", "dst"))).alias("w"))


def resize(px: DataFrame, width: int, height: int, kernel: Callable[[Column], Column], reach: int) -> DataFrame:
    """A resized raster: weighted sums along x and then y, rounded and cut to bytes. Weights are one small table by side length, 2 * reach rows a target pixel, however many images there are."""
    px = sized(dealt(px))
    x, y = (F.broadcast(taps(px.select(F.col(c).cast("long").alias("side")).distinct(), n, kernel, reach)) for c, n in (("width", width), ("height", height)))
    wide = px.join(x, (F.col("width") == F.col("side")) & (F.col("x") == F.col("src"))).groupBy("image_id", "height", "y", F.col("dst").alias("tx")).agg(F.sum(F.col("l") * F.col("w")).alias("v"))
    out = wide.join(y, (F.col("height") == F.col("side")) & (F.col("y") == F.col("src"))).groupBy("image_id", F.col("dst").alias("ty"), "tx").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out.select("image_id", F.col("ty").cast("long").alias("y"), F.col("tx").cast("long").alias("x"), quantized(F.round("v", 9)).alias("l"))


def resize_cubic(px: DataFrame, width: int, height: int) -> DataFrame:
    return resize(px, width, height, cubic, 2)


def resize_lanczos(px: DataFrame, width: int, height: int) -> DataFrame:
    return resize(px, width, height, lanczos, 4)
