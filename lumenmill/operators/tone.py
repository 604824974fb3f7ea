"""Contrast by tile: histograms of a grid of tiles become lookup tables, and every pixel blends the tables of the four tiles around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmill.functions.tables import apart, dealt
from lumenmill.operators import stencils as st


def tile_size(side: str, tiles: int) -> Column:
    """A tile's length along one axis. If the tiles don't divide both sides of an image, both go on to the next multiple."""
    whole = (F.col("width") % tiles == 0) & (F.col("height") % tiles == 0)
    return (F.floor(F.col(side) / tiles) + F.when(whole, 0).otherwise(1)).cast("long")


def tile_tables(px: DataFrame, clip: float, tiles: int, value: str = "l") -> DataFrame:
    """(image_id, table): a tile's histogram, clipped at clip times its mean, cumulated in 256 values (upto), and how what was cut off is dealt out again (area, each, rest, step).

    An image whose sides the tiles don't divide goes on behind its right and lower edges, reflected. The whole part of the excess goes to every
    value alike, the rest to values at even distances.
    """
    c = F.col
    rows = st.sized(dealt(px)).select("image_id", "y", "x", "width", "height", value)
    more = lambda side: tile_size(side, tiles) * tiles
    border = st.padded(rows, F.greatest(more("width") - c("width"), more("height") - c("height")))
    border = border.where((c("x") >= 0) & (c("y") >= 0) & (c("x") < more("width")) & (c("y") < more("height")))
    ty, tx = F.floor(c("y") / tile_size("height", tiles)), F.floor(c("x") / tile_size("width", tiles))
    area = tile_size("width", tiles) * tile_size("height", tiles)
    counts = border.groupBy("image_id", ty.alias("ty"), tx.alias("tx"), area.alias("area"), c(value).alias("v")).agg(F.count("*").alias("n"))
    limit = F.greatest(F.lit(1), F.floor(clip * c("area") / 256))
    tile = ["image_id", "ty", "tx"]
    clipped = counts.select(*tile, "area", "v", F.least("n", limit).alias("n"), F.greatest(F.lit(0), c("n") - limit).alias("excess"))
    whole = clipped.groupBy(*tile, "area").agg(F.sum("excess").alias("excess"), F.array_sort(F.collect_list(F.struct(c("v").cast("int").alias("v"), "n"))).alias("bins"))
    each, rest = F.floor(c("excess") / 256), c("excess") % 256
    whole = whole.select(*tile, "area", "bins", each.alias("each"), rest.alias("rest"), F.greatest(F.lit(1), F.floor(256 / F.greatest(F.lit(1), rest))).alias("step"))
    # Values without pixels are many: the sum of the bins up to a value stands there as often as values follow until the next bin.
    sums = F.aggregate("bins", F.array(F.lit(0)), lambda done, bin: F.concat(done, F.array(F.element_at(done, -1) + bin["n"].cast("int"))))
    last = F.size("bins")
    until = F.transform("sums", lambda n, i: F.array_repeat(n, F.when(i < last, F.get(c("bins"), i)["v"]).otherwise(256) - F.when(i > 0, F.get(c("bins"), i - 1)["v"]).otherwise(0)))
    upto = whole.withColumn("sums", sums).withColumn("upto", F.flatten(until))
    return upto.select("image_id", F.struct(*[c(n).cast("int").alias(n) for n in ("ty", "tx", "area", "each", "rest", "step")], "upto").alias("table"))


def local_equalized(px: DataFrame, clip: float = 2.0, tiles: int = 8, value: str = "l") -> DataFrame:
    """px (image_id, y, x, value, width, height) with each value replaced by the blend of the tables of the four tiles around its pixel (CLAHE).

    Tables of one image are one row of tiles * tiles * 256 values; pixels meet it by image.
    """
    c = F.col
    tables = tile_tables(px, clip, tiles, value).groupBy("image_id").agg(F.array_sort(F.collect_list("table")).alias("tables"))
    rows = st.sized(dealt(px))

    def axis(at: str, side: str) -> tuple[Column, Column, Column]:
        spot = c(at) / tile_size(side, tiles) - 0.5
        low = F.floor(spot)
        return F.greatest(F.lit(0), low).cast("int"), F.least(F.lit(tiles - 1), low + 1).cast("int"), spot - low

    (y1, y2, ya), (x1, x2, xa) = axis("y", "height"), axis("x", "width")

    def look(ty: Column, tx: Column) -> Column:
        t, v = F.get("tables", ty * tiles + tx), c(value).cast("int")
        extra = F.least(t["rest"], F.floor(v / t["step"]) + 1)
        return F.least(F.lit(255), F.rint((F.get(t["upto"], v) + t["each"] * (v + 1) + extra) * 255.0 / t["area"]))

    blend = (look(y1, x1) * (1 - xa) + look(y1, x2) * xa) * (1 - ya) + (look(y2, x1) * (1 - xa) + look(y2, x2) * xa) * ya
    return rows.join(apart(tables), "image_id").select("image_id", "width", "height", "y", "x", F.rint(F.round(blend, 9)).cast("int").alias(value))


def micro_contrast(px: DataFrame, amount: float) -> DataFrame:
    """Lightness with stronger local contrast; amount from 0, which changes nothing, to 1."""
    amount = max(0.0, min(1.0, amount))
    return st.sized(px).select("image_id", "width", "height", "y", "x", "l") if amount == 0 else local_equalized(px, 1.0 + amount * 1.6)
