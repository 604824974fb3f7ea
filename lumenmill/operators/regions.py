"""Connected regions of masks, edges with hysteresis, and straight lines, over all images of a table at once.

A mask is the table of its pixels (image_id, y, x). A row of pixels is cut into runs; runs of neighbouring rows that touch, also at a
corner, are linked by an interval join; and links are contracted in rounds, all images together, until none is left. Rounds grow with the
logarithm of the largest region's runs, however it winds. Edges keep weak pixels whose region has a strong one, so they stand on regions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lumenmill.functions.tables import apart, dealt, settled
from lumenmill.operators import stencils as st

#: Columns of a tile: runs meet in the tiles that they reach, so a row with many runs is no product.
TILE = 64
RUN = ["image_id", "y", "x0"]


def runs(mask: DataFrame, strong: Column | None = None) -> DataFrame:
    """(image_id, y, x0, x1, strong): the maximal runs of each row, both ends included, and whether strong holds in any of their pixels. Repeated pixels count once."""
    pixels = dealt(mask).groupBy("image_id", "y", "x").agg(F.bool_or(F.lit(True) if strong is None else strong).alias("strong"))
    island = F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x"))
    return pixels.select("image_id", "y", "x", "strong", island.alias("island")).groupBy("image_id", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.bool_or("strong").alias("strong")).drop("island")


def touching(found: DataFrame) -> DataFrame:
    """(image_id, a, b): pairs of runs of neighbouring rows that touch, each pair once; a and b are (y, x0)."""
    reach = lambda low, high: F.explode(F.sequence(F.floor(low / TILE), F.floor(high / TILE)))
    x0, x1 = F.col("x0"), F.col("x1")
    upper = found.select("image_id", (F.col("y") + 1).alias("below"), F.struct("y", "x0").alias("a"), (x0 - 1).alias("from"), (x1 + 1).alias("to"), reach(x0 - 1, x1 + 1).alias("tile"))
    lower = found.select("image_id", F.col("y").alias("below"), F.struct("y", "x0").alias("b"), "x0", "x1", reach(x0, x1).alias("tile"))
    met = upper.join(apart(lower), ["image_id", "below", "tile"]).where((F.col("from") <= x1) & (x0 <= F.col("to")))
    first = F.floor(F.greatest(F.col("from"), x0) / TILE)
    return met.where(F.col("tile") == first).select("image_id", "a", "b")


def contracted(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(image_id, node, root): nodes with links, and the smallest node that each is connected with; from links (image_id, a, b).

    In each round every node moves to that of its neighbours, or itself, whose hash is smallest in this round, and on to where that one
    moved; links between nodes that have met go. At most about half of the nodes stay apart in a round, whatever the shape.
    """
    both = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    edges = settled(links.select("image_id", both.alias("e")).select("image_id", "e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
    places = edges.select("image_id", F.col("u").alias("node")).distinct().withColumn("at", F.col("node"))
    for turn in range(rounds):
        if edges.isEmpty():
            break
        key = lambda c, turn=turn: F.struct(F.xxhash64("image_id", c, F.lit(turn)).alias("h"), F.col(c).alias("to"))
        step = edges.groupBy("image_id", "u").agg(F.min(key("v")).alias("best")).select("image_id", "u", F.least(F.col("best"), key("u")).getField("to").alias("to"))
        on = step.select("image_id", F.col("u").alias("to"), F.col("to").alias("next"))
        moves = settled(step.join(apart(on), ["image_id", "to"]).select("image_id", "u", F.col("next").alias("to")))
        places = settled(places.join(apart(moves.withColumnRenamed("u", "at")), ["image_id", "at"], "left").select("image_id", "node", F.coalesce("to", "at").alias("at")))
        edges = edges.join(apart(moves), ["image_id", "u"]).select("image_id", F.col("to").alias("u"), "v")
        edges = edges.join(apart(moves.withColumnRenamed("u", "v").withColumnRenamed("to", "w")), ["image_id", "v"]).select("image_id", "u", F.col("w").alias("v"))
        edges = settled(edges.where(F.col("u") != F.col("v")).distinct())
    else:
        raise RuntimeError("links were not contracted")
    smallest = places.groupBy("image_id", "at").agg(F.min("node").alias("root"))
    return places.join(apart(smallest), ["image_id", "at"]).select("image_id", "node", "root")


def labelled_runs(mask: DataFrame, strong: Column | None = None) -> DataFrame:
    """(image_id, y, x0, x1, strong, region): the runs and the first pixel (y, x) of the region that each belongs to, in reading order."""
    found = settled(runs(mask, strong))
    roots = contracted(touching(found)).select("image_id", F.col("node.y").alias("y"), F.col("node.x0").alias("x0"), F.struct(F.col("root.y").alias("y"), F.col("root.x0").alias("x")).alias("root"))
    return found.join(apart(roots), RUN, "left").select(*RUN, "x1", "strong", F.coalesce("root", F.struct(F.col("y"), F.col("x0").alias("x"))).alias("region"))


def _pixels(found: DataFrame) -> DataFrame:
    """(image_id, y, x): the pixels of runs."""
    return found.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def _region() -> WindowSpec:
    """All runs of a region."""
    return Window.partitionBy("image_id", "region")


def regions(mask: DataFrame) -> DataFrame:
    """One row a region of a mask, 8-connected: image_id, first_y, first_x (its first pixel in reading order), area, x0, y0, width, height, mean_x and mean_y."""
    length = F.col("x1") - F.col("x0") + 1
    m = labelled_runs(mask).groupBy("image_id", "region").agg(
        F.sum(length).alias("area"), F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("y").alias("top"), F.max("y").alias("bottom"),
        F.sum(length * (F.col("x0") + F.col("x1")) / 2).alias("sum_x"), F.sum(length * F.col("y")).alias("sum_y"),
    )
    return m.select(
        "image_id", F.col("region.y").alias("first_y"), F.col("region.x").alias("first_x"), "area", F.col("left").alias("x0"), F.col("top").alias("y0"),
        (F.col("right") - F.col("left") + 1).alias("width"), (F.col("bottom") - F.col("top") + 1).alias("height"),
        F.round(F.col("sum_x") / F.col("area"), 4).alias("mean_x"), F.round(F.col("sum_y") / F.col("area"), 4).alias("mean_y"),
    )


def region_stats(sizes: DataFrame, mask: DataFrame, least_area: int = 12) -> DataFrame:
    """One row an image of sizes (image_id, width, height): count of regions of least_area pixels or more, the mask's share of the image, the largest region's share,
    and the shares of regions whose middle is in the top, middle and bottom third. Images without regions have zeros."""
    found = regions(mask).select("image_id", "area", (F.col("y0") + F.col("height") * 0.5).alias("center"))
    both = sizes.select("image_id", F.col("height").alias("rows"), (F.col("width") * F.col("height")).alias("total")).join(apart(found), "image_id", "left")
    large = F.col("area") >= least_area
    third = F.when(F.col("center") < F.col("rows") / 3, 0).when(F.col("center") < F.col("rows") * 2 / 3, 1).otherwise(2)
    share = lambda of: F.round(F.coalesce(of, F.lit(0)) / F.first("total"), 6)
    return both.groupBy("image_id").agg(
        F.count_if(large).alias("region_count"), share(F.sum("area")).alias("mask_ratio"), share(F.max(F.when(large, F.col("area")))).alias("largest_ratio"),
        *[share(F.sum(F.when(large & (third == i), F.col("area")))).alias(f"{name}_ratio") for i, name in enumerate(("top", "middle", "bottom"))],
    )


def stable_regions(mask: DataFrame, least_area: int = 8, least_side: int = 5) -> DataFrame:
    """The pixels of a mask's regions that are large and long enough; the others are speckles."""
    of = {
        "area": F.sum(F.col("x1") - F.col("x0") + 1).over(_region()), "width": F.max("x1").over(_region()) - F.min("x0").over(_region()) + 1,
        "height": F.max("y").over(_region()) - F.min("y").over(_region()) + 1,
    }
    return _pixels(labelled_runs(mask).withColumns(of).where((F.col("area") >= least_area) & (F.greatest("width", "height") >= least_side)))


def edge_thresholds(px: DataFrame) -> DataFrame:
    """(image_id, low, high): thresholds of edges from each image's median."""
    low = F.greatest(F.lit(18.0), 0.58 * F.col("median"))
    m = px.groupBy("image_id").agg(F.percentile("l", 0.5).alias("median")).withColumn("low", F.floor(low))
    return m.select("image_id", F.col("low").cast("int").alias("low"), F.floor(F.least(F.lit(210.0), F.greatest(F.col("low") + 24.0, 1.28 * F.col("median")))).cast("int").alias("high"))


#: tan(22.5 degrees) and tan(67.5 degrees) part the four directions.
_TAN_LOW, _TAN_HIGH = 0.41421356237, 2.41421356237


def thinned(px: DataFrame, squared: bool) -> DataFrame:
    """(image_id, y, x, size): the gradient where it is largest across its direction, else null. Beyond the image gradients are 0 and pixels repeat."""
    c = F.col
    gx, gy = st.sobel()
    size = F.sqrt(gx * gx + gy * gy) if squared else F.abs(gx) + F.abs(gy)
    rows = st.neighbours(px.select("image_id", "y", "x", "l"), edge="repeat").select("image_id", "y", "x", gx.alias("gx"), gy.alias("gy"), size.alias("size"))
    rows = st.neighbours(rows, "size", edge="zero")
    flat, steep = F.abs(c("gy")) < F.abs(c("gx")) * _TAN_LOW, F.abs(c("gy")) > F.abs(c("gx")) * _TAN_HIGH
    down = (c("gx") * c("gy")) >= 0
    peak = (
        F.when(flat, (c("size") > c("left")) & (c("size") >= c("right"))).when(steep, (c("size") > c("up")) & (c("size") >= c("down")))
        .when(down, (c("size") > c("ul")) & (c("size") > c("dr"))).otherwise((c("size") > c("ur")) & (c("size") > c("dl")))
    )
    return rows.select("image_id", "y", "x", F.when(peak, c("size")).alias("size"))


def edges(px: DataFrame, low: float | None = None, high: float | None = None, squared: bool = True) -> DataFrame:
    """(image_id, y, x): edge pixels. Gradients are thinned to one pixel across; those over `high` are edges, and those over `low` are where they hang together with one.

    Without low and high each image has its own thresholds, from its median. squared: gradient sizes are Euclidean, else sums of both parts.
    """
    size = thinned(px, squared).where("size IS NOT NULL")
    if low is None or high is None:
        size = size.join(apart(edge_thresholds(dealt(px))), "image_id")
    else:
        size = size.withColumns({"low": F.lit(low), "high": F.lit(high)})
    return _held(size.where(F.col("size") > F.col("low")).select("image_id", "y", "x", (F.col("size") > F.col("high")).alias("strong")))


def _held(weak: DataFrame) -> DataFrame:
    """The pixels of (image_id, y, x, strong) whose region has a strong one."""
    return _pixels(labelled_runs(weak, F.col("strong")).withColumn("held", F.bool_or("strong").over(_region())).where("held"))


def edge_sets(px: DataFrame, thresholds: dict[str, tuple[float, float]], squared: bool = True) -> DataFrame:
    """(image_id, y, x) and a column by name for each pair of thresholds (low, high): whether the pixel is an edge under it. All pairs are gone through together; pixels that are edges under none are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high")) for n, (low, high) in thresholds.items()]))
    size = thinned(px, squared).where("size IS NOT NULL").select("image_id", "y", "x", "size", pairs.alias("by")).where("size > by.low")
    held = _held(size.select(F.struct(F.col("image_id").alias("id"), F.col("by.name").alias("name")).alias("image_id"), "y", "x", (F.col("size") > F.col("by.high")).alias("strong")))
    return held.groupBy(F.col("image_id.id").alias("image_id"), "y", "x").agg(*[F.bool_or(F.col("image_id.name") == n).alias(n) for n in thresholds])


#: Directions of lines, in whole degrees; cosines and sines to six places, so that places on a line are the same everywhere.
DEGREES = 180
#: A pixel of a mask weighs as much as so many others where it votes in every direction.
VOTES = 8


def _turned(theta: Column | int) -> tuple[Column, Column]:
    return F.round(F.cos(F.radians(theta)), 6), F.round(F.sin(F.radians(theta)), 6)


def _directions() -> Column:
    """All directions with their cosines and sines (theta, c, s): one constant."""
    return F.array(*[F.struct(F.lit(t).alias("theta"), c.alias("c"), s.alias("s")) for t in range(DEGREES) for c, s in [_turned(F.lit(t))]])


def _rho() -> Column:
    return F.floor(F.col("x") * F.col("d.c") + F.col("y") * F.col("d.s") + 0.5)


def line_peaks(mask: DataFrame, least_votes: int) -> DataFrame:
    """(image_id, theta, rho, votes): lines x cos + y sin = rho that have least_votes pixels or more, and more than the lines beside them (ties: the smaller theta, then rho)."""
    votes = mask.select("image_id", "x", "y", F.explode(_directions()).alias("d")).groupBy("image_id", F.col("d.theta").alias("theta"), _rho().alias("rho")).agg(F.count("*").alias("votes"))
    many = settled(votes.where(F.col("votes") >= least_votes))
    # A line beside a peak that has fewer votes than least_votes can't beat it, so it need not be looked at.
    beside = F.array(*[F.struct((F.col("theta") + t).alias("theta"), (F.col("rho") + r).alias("rho"), F.lit((t, r) < (0, 0)).alias("after")) for t in (-1, 0, 1) for r in (-1, 0, 1) if (t, r) != (0, 0)])
    other = many.select("image_id", F.col("votes").alias("other"), F.explode(beside).alias("b")).select("image_id", "b.theta", "b.rho", "other", "b.after")
    beaten = many.join(apart(other), ["image_id", "theta", "rho"]).where((F.col("other") > F.col("votes")) | ((F.col("other") == F.col("votes")) & ~F.col("after")))
    return many.join(apart(beaten.select("image_id", "theta", "rho").distinct()), ["image_id", "theta", "rho"], "left_anti")


def line_segments(mask: DataFrame, least_votes: int = 55, least_length: int = 24, most_gap: int = 5) -> DataFrame:
    """(image_id, theta, rho, x0, y0, x1, y1, length, pixels): straight segments of a mask of distinct pixels.

    Each pixel goes to the line with most votes that passes it (ties: the smaller theta, then rho). Along a line pixels are cut where they
    stand more than most_gap apart; what is at least least_length long is a segment, from its first pixel to its last.
    """
    mask = settled(mask.select("image_id", "y", "x"))
    weight = mask.count() * VOTES
    mask = dealt(mask, weight)
    peaks = dealt(settled(line_peaks(mask, least_votes)), weight)
    # Pixels are looked up only in directions in which their image has a peak.
    asked = peaks.groupBy("image_id").agg(F.collect_set("theta").alias("asked")).select("image_id", F.filter(_directions(), lambda d: F.array_contains("asked", d["theta"])).alias("asked"))
    cells = mask.join(apart(asked), "image_id").select("image_id", "y", "x", F.explode("asked").alias("d"))
    cells = cells.select("image_id", "y", "x", F.col("d.theta").alias("theta"), _rho().alias("rho"), F.round(F.col("y") * F.col("d.c") - F.col("x") * F.col("d.s"), 6).alias("t"))
    best = F.max(F.struct("votes", (-F.col("theta")).alias("theta"), (-F.col("rho")).alias("rho"), "t")).alias("best")
    # Peaks are laid beside the pixels of their line, in the partition of their image.
    votes = F.max("votes").over(Window.partitionBy("image_id", "theta", "rho")).alias("votes")
    on = cells.unionByName(peaks, allowMissingColumns=True).select("image_id", "y", "x", "theta", "rho", "t", votes)
    on = on.where("x IS NOT NULL AND votes IS NOT NULL").groupBy("image_id", "y", "x").agg(best)
    on = on.select("image_id", "y", "x", (-F.col("best.theta")).alias("theta"), (-F.col("best.rho")).alias("rho"), "best.t")
    line = Window.partitionBy("image_id", "theta", "rho").orderBy("t", "y", "x")
    gap = F.when(F.col("t") - F.lag("t").over(line) > most_gap, 1).otherwise(0)
    cut = on.withColumn("gap", gap).withColumn("part", F.sum("gap").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.struct("t", "y", "x")
    m = cut.groupBy("image_id", "theta", "rho", "part").agg(F.min(end).alias("a"), F.max(end).alias("b"), F.count("*").alias("pixels"))
    return m.where(F.col("b.t") - F.col("a.t") >= least_length).select(
        "image_id", "theta", "rho", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"), F.round(F.col("b.t") - F.col("a.t"), 4).alias("length"), "pixels"
    )


def line_density(sizes: DataFrame, segments: DataFrame, full: int = 90) -> DataFrame:
    """(image_id, segments, line_score): how many segments an image of sizes has, and that over `full`, at most 1."""
    found = sizes.select("image_id").distinct().join(apart(segments.groupBy("image_id").agg(F.count("*").alias("n"))), "image_id", "left")
    return found.select("image_id", F.coalesce("n", F.lit(0)).cast("long").alias("segments"), F.round(F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / full), 6).alias("line_score"))
