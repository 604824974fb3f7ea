"""Summed-area tables: the sum over any window of a raster in four lookups, and the crops that they choose.

A table holds at (y, x) the sum over all pixels up to there. Rows are summed first and columns then, in two windows over pixels that are
dealt out by image. Windows may have a size of their own in every image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenmill.functions.tables import dealt
from lumenmill.operators import stencils as st

AT = ["image_id", "y", "x"]


def summed_area(px: DataFrame, *values: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, y, x), the columns to keep, and each value summed over the pixels above and to the left, this one included. Places may begin anywhere, also below 0."""
    rows = dealt(px).select(*AT, *keep, *values)
    upto = lambda axis: axis.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*AT, *keep, *[F.sum(v).over(upto(st.row())).alias(v) for v in values])
    return rows.select(*AT, *keep, *[F.sum(v).over(upto(st.column())).alias(v) for v in values])


def window_sums(table: DataFrame, windows: DataFrame, key: list[str], *values: str) -> DataFrame:
    """windows (image_id, key, x0, y0, x1, y1, any others: both ends included and inside the table) with the sum of each value over them.

    Corners and the table's rows are laid together, by place, so that they stay in the partition of their image.
    """
    corners = [(F.col("x1"), F.col("y1"), 1), (F.col("x0") - 1, F.col("y1"), -1), (F.col("x1"), F.col("y0") - 1, -1), (F.col("x0") - 1, F.col("y0") - 1, 1)]
    # A corner outside the table has no row there and adds nothing.
    own = [c for c in windows.columns if c != "image_id"]
    of = F.struct(*own).alias("of")
    wanted = windows.select("image_id", of, F.explode(F.array(*[F.struct(y.alias("y"), x.alias("x"), F.lit(sign).alias("sign")) for x, y, sign in corners])).alias("c"))
    both = wanted.select("image_id", "c.y", "c.x", "of", "c.sign").unionByName(table.select(*AT, *values), allowMissingColumns=True)
    found = both.select("image_id", "of", "sign", *[F.max(v).over(Window.partitionBy(*AT)).alias(v) for v in values]).where(F.col("of").isNotNull())
    sums = found.groupBy("image_id", *[F.col(f"of.{c}").alias(f"key{i}") for i, c in enumerate(key)]).agg(F.first("of").alias("of"), *[F.sum(F.col(v) * F.col("sign")).alias(v) for v in values])
    return sums.select("image_id", "of.*", *values)


def _images(px: DataFrame) -> DataFrame:
    return st.sized(px).select("image_id", "width", "height").distinct()


def best_windows(px: DataFrame, value: str, sizes: list[tuple[int, int]], step: int = 1) -> DataFrame:
    """(image_id, window_width, window_height, y, x, mean): for every size (width, height) the window of largest mean, the first in reading order on a tie.

    Windows begin on every step-th row and column and lie inside the image; a size beyond the image is cut to it.
    """
    asked = F.explode(F.array(*[F.struct(F.lit(w).cast("long").alias("w"), F.lit(h).cast("long").alias("h")) for w, h in sizes]))
    rows = _images(px).withColumn("s", asked).select("image_id", "width", "height", F.col("s.w").alias("window_width"), F.col("s.h").alias("window_height"), F.least("s.w", "width").alias("w"), F.least("s.h", "height").alias("h"))
    starts = lambda side, size: F.explode(F.sequence(F.lit(0).cast("long"), F.col(side) - F.col(size), F.lit(step).cast("long")))
    rows = rows.withColumn("x0", starts("width", "w")).withColumn("y0", starts("height", "h"))
    rows = rows.select("image_id", "window_width", "window_height", "x0", "y0", (F.col("x0") + F.col("w") - 1).alias("x1"), (F.col("y0") + F.col("h") - 1).alias("y1"), (F.col("w") * F.col("h")).alias("n"))
    key = ["window_width", "window_height", "x0", "y0"]
    sums = window_sums(summed_area(px, value), rows, key, value)
    top = F.max(F.struct(F.round(F.col(value) / F.col("n"), 6).alias("mean"), (-F.col("y0")).alias("y"), (-F.col("x0")).alias("x"))).alias("top")
    return sums.groupBy("image_id", "window_width", "window_height").agg(top).select("image_id", "window_width", "window_height", (-F.col("top.y")).alias("y"), (-F.col("top.x")).alias("x"), F.col("top.mean").alias("mean"))


def _clamped(at: Column, size: str, side: str) -> Column:
    """A crop's first place: around a pixel, cut towards 0, inside the image."""
    start = at - F.col(size) / 2
    return F.greatest(F.lit(0), F.least(F.col(side) - F.col(size), F.when(start < 0, F.ceil(start)).otherwise(F.floor(start)))).cast("long")


def peak_crops(px: DataFrame, values: list[str], width: Column, height: Column, parts: int) -> DataFrame:
    """(image_id, of, x0, y0, x1, y1): for each value, by its place in values, a crop around the pixel whose surroundings have its largest mean, the first in reading order on a tie.

    width and height of a crop are columns over the image's width and height. Surroundings are a parts-th of the crop, 8 at least;
    the border reflects. Ends are exclusive.
    """
    cut = {"crop_w": width.cast("long"), "crop_h": height.cast("long")}
    around = {f"k{a}": F.greatest(F.lit(8).cast("long"), F.floor(F.col(f"crop_{a}") / parts)) for a in "wh"}
    rows = st.sized(px).select(*AT, "width", "height", *values).withColumns(cut).withColumns(around).drop(*cut)
    border = st.padded(rows, F.greatest(F.floor(F.col("kw") / 2), F.floor(F.col("kh") / 2)))
    table = summed_area(border, *values, keep=("width", "height", "kw", "kh"))
    # A place of the table is a corner of the surroundings of four pixels, and adds its sum to them.
    ends = lambda at, k: F.explode(F.array(F.struct((F.col(at) + 1 + F.floor(F.col(k) / 2) - F.col(k)).alias("at"), F.lit(1).alias("sign")), F.struct((F.col(at) + 1 + F.floor(F.col(k) / 2)).alias("at"), F.lit(-1).alias("sign"))))
    corners = table.withColumn("y", ends("y", "kh")).where("y.at >= 0 AND y.at < height").withColumn("x", ends("x", "kw")).where("x.at >= 0 AND x.at < width")
    sums = corners.groupBy("image_id", "width", "height", F.col("y.at").alias("at_y"), F.col("x.at").alias("at_x")).agg(*[F.sum(F.col(v) * F.col("y.sign") * F.col("x.sign")).alias(v) for v in values])
    best = F.array(*[F.max(F.struct(F.round(v, 6).alias("sum"), (-F.col("at_y")).alias("y"), (-F.col("at_x")).alias("x"))) for v in values])
    found = sums.groupBy("image_id", "width", "height").agg(best.alias("best")).select("image_id", "width", "height", F.posexplode("best").alias("of", "best")).withColumns(cut)
    x0, y0 = _clamped(-F.col("best.x"), "crop_w", "width"), _clamped(-F.col("best.y"), "crop_h", "height")
    return found.select("image_id", "of", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("crop_w")).alias("x1"), (y0 + F.col("crop_h")).alias("y1"))


def texture_crops(px: DataFrame, width: int = 360, height: int = 240) -> DataFrame:
    """The crop of strongest texture: absolute Laplacian."""
    rows = st.sized(st.neighbours(px)).select(*AT, "width", "height", F.abs(st.laplacian()).alias("v"))
    return peak_crops(rows, ["v"], F.least(F.lit(width), F.col("width")), F.least(F.lit(height), F.col("height")), 6).drop("of")


def edge_crops(px: DataFrame, width: int = 360, height: int = 240) -> DataFrame:
    """The crop of strongest edges: size of the gradient."""
    gx, gy = st.sobel()
    rows = st.sized(st.neighbours(px)).select(*AT, "width", "height", F.sqrt(gx * gx + gy * gy).alias("v"))
    return peak_crops(rows, ["v"], F.least(F.lit(width), F.col("width")), F.least(F.lit(height), F.col("height")), 6).drop("of")


def review_crops(px: DataFrame, width: tuple[int, int] = (180, 420), height: tuple[int, int] = (150, 300), most: int = 4) -> DataFrame:
    """(image_id, place, label, x0, y0, x1, y1): the first `most` crops for a review, of texture, shadow, edges and the middle, in this order; equal ones once, under the first label.

    Crops are a quarter of the image, within the bounds of width and height and inside the image.
    """
    w, h = (F.least(F.col(side), F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.col(side) / 4)))) for side, (least, most) in (("width", width), ("height", height)))
    gx, gy = st.sobel()
    signals = {"texture": F.abs(st.laplacian()), "shadow": F.greatest(F.lit(0), F.lit(105) - F.col("l")), "edge": F.sqrt(gx * gx + gy * gy)}
    rows = st.sized(st.neighbours(px)).select(*AT, "width", "height", *[v.alias(n) for n, v in signals.items()])
    middle = _images(px).select("image_id", "width", "height", w.cast("long").alias("crop_w"), h.cast("long").alias("crop_h"))
    x0, y0 = _clamped(F.floor(F.col("width") / 2), "crop_w", "width"), _clamped(F.floor(F.col("height") / 2), "crop_h", "height")
    middle = middle.select("image_id", F.lit(3).alias("of"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("crop_w")).alias("x1"), (y0 + F.col("crop_h")).alias("y1"))
    names = F.array(*[F.lit(n) for n in ("face_or_texture", "shadow_or_compression", "background_text_edge", "center_subject")])
    out = peak_crops(rows, list(signals), w, h, 5).unionByName(middle).withColumn("of", F.struct(F.col("of").alias("place"), F.element_at(names, F.col("of") + 1).alias("label")))
    once = out.groupBy("image_id", "x0", "y0", "x1", "y1").agg(F.min("of").alias("of")).select("image_id", "of.place", "of.label", "x0", "y0", "x1", "y1")
    return once.withColumn("turn", F.row_number().over(Window.partitionBy("image_id").orderBy("place"))).where(F.col("turn") <= most).drop("turn")


def focus_boxes(px: DataFrame, share: float = 0.32, least: int = 80, steps: int = 5) -> DataFrame:
    """(image_id, x0, y0, x1, y1): of steps x steps boxes the one whose outlines have the largest mean plus deviation, the first in reading order on a tie; ends are exclusive.

    An image of at most `least` pixels on a side is its own box. Outlines: eight times a pixel less its neighbours, cut to bytes; the border stays as it is.
    """
    c = F.col
    rows = st.sized(st.neighbours(px))
    border = (c("x") == 0) | (c("y") == 0) | (c("x") == c("width") - 1) | (c("y") == c("height") - 1)
    around = sum((c(n) for n in ("up", "down", "left", "right", "ul", "ur", "dl", "dr")), F.lit(0))
    outline = F.when(border, c("l")).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), 8 * c("l") - around))).cast("long")
    rows = rows.select(*AT, "width", "height", outline.alias("v")).withColumn("sq", c("v") * c("v"))
    images = rows.select("image_id", "width", "height").distinct()
    small = (c("width") <= least) | (c("height") <= least)
    cut = lambda side: F.greatest(F.lit(least), F.least(c(side), F.floor(c(side) * share))).cast("long")
    grid = images.where(~small).select("image_id", "width", "height", cut("width").alias("w"), cut("height").alias("h"))
    place = lambda side, size, i: F.floor((c(side) - c(size)) * c(i) / max(1, steps - 1)).cast("long")
    for axis in ("iy", "ix"):
        grid = grid.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    grid = grid.select("image_id", "iy", "ix", place("width", "w", "ix").alias("x0"), place("height", "h", "iy").alias("y0"), "w", "h")
    grid = grid.select("*", (c("x0") + c("w") - 1).alias("x1"), (c("y0") + c("h") - 1).alias("y1"))
    sums = window_sums(summed_area(rows, "v", "sq"), grid, ["iy", "ix"], "v", "sq")
    n = c("w") * c("h")
    mean = c("v") / n
    score = F.round(mean + F.sqrt(F.greatest(F.lit(0.0), c("sq") / n - mean * mean)), 6)
    top = F.max(F.struct(score.alias("score"), (-c("iy")).alias("iy"), (-c("ix")).alias("ix"), "x0", "y0", (c("x1") + 1).alias("x1"), (c("y1") + 1).alias("y1"))).alias("top")
    best = sums.groupBy("image_id").agg(top).select("image_id", "top.x0", "top.y0", "top.x1", "top.y1")
    zero = F.lit(0).cast("long")
    return best.unionByName(images.where(small).select("image_id", zero.alias("x0"), zero.alias("y0"), c("width").alias("x1"), c("height").alias("y1")))
