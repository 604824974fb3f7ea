"""Metrics by image: each is one aggregate over the pixels of a raster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenmill.functions.color import gray, hsv, lab
from lumenmill.functions.scalars import clip, labels, log_score, normalize, score
from lumenmill.operators import points as pt
from lumenmill.operators import stencils as st


def _r(column, n: int = 4):
    return F.round(column, n)


def basic_metrics(px: DataFrame) -> DataFrame:
    """Brightness, contrast and sharpness: mean, deviation, and variance of the Laplacian."""
    rows = st.neighbours(px).withColumn("lap", st.laplacian())
    flat = F.when(F.abs("lap") < 2.5, F.col("l"))
    noise = F.coalesce(F.stddev_pop(flat), F.stddev_pop("l") * 0.35)
    return rows.groupBy("image_id").agg(
        _r(F.avg("l")).alias("brightness"), _r(F.stddev_pop("l")).alias("contrast"), _r(F.var_pop("lap")).alias("sharpness"),
        _r(F.avg(F.abs("lap"))).alias("mean_abs_laplacian"), _r(F.percentile(F.abs("lap"), 0.95)).alias("p95_abs_laplacian"), _r(score(noise, 1.8, 18.0)).alias("noise_score"),
    )


def box_contrast(px: DataFrame) -> DataFrame:
    """Mean distance from the mean of the 9 x 9 square, and its share of the clarity score."""
    rows = st.box(px, 4, F.sum, "total")
    local = F.avg(F.abs(F.col("l") - F.col("total") / 81.0))
    return rows.groupBy("image_id").agg(_r(local).alias("local_contrast"), _r(score(local, 4.0, 22.0)).alias("local_contrast_score"))


def sobel_edges(px: DataFrame) -> DataFrame:
    gx, gy = st.sobel()
    size = F.sqrt(gx * gx + gy * gy)
    return st.neighbours(px).select("image_id", size.alias("size")).groupBy("image_id").agg(
        _r(F.avg("size")).alias("edge_score"), _r(F.avg((F.col("size") > 200).cast("double"))).alias("strong_edge_ratio"), _r(F.max("size")).alias("max_gradient")
    )


def dilate_erode(px: DataFrame) -> DataFrame:
    """Sums of the 3 x 3 maximum, the minimum, and their difference (the morphological gradient)."""
    up = st.box(px, 1, F.max, "hi").groupBy("image_id").agg(F.sum("hi").alias("dilated_sum"))
    down = st.box(px, 1, F.min, "lo").groupBy("image_id").agg(F.sum("lo").alias("eroded_sum"))
    return up.join(down, "image_id").withColumn("gradient_sum", F.col("dilated_sum") - F.col("eroded_sum"))


def block_probe(px: DataFrame) -> DataFrame:
    """Jumps at 8-pixel block edges against jumps inside blocks, dirt in shadows, and blur."""
    rows = px.repartition("image_id").select("*", F.lag("l").over(st.row()).alias("before"), F.lag("l").over(st.column()).alias("above"))
    at = lambda axis, before, phase: F.avg(F.when(F.col(axis) % 8 == phase, F.abs(F.col("l") - F.col(before))))
    shadow = F.when(F.col("l") < 76, F.col("l"))
    probes = rows.groupBy("image_id").agg(
        (at("x", "before", 0) + at("y", "above", 0)).alias("boundary"), (at("x", "before", 4) + at("y", "above", 4)).alias("inner"),
        F.stddev_pop(shadow).alias("dirt"), F.avg((F.col("l") < 76).cast("double")).alias("dark"),
    )
    sharp = st.neighbours(px).groupBy("image_id").agg(F.var_pop(st.laplacian()).alias("sharp"))
    return probes.join(sharp, "image_id").select(
        "image_id", _r(clip((F.col("boundary") - F.col("inner") * 1.08) / 10.0, 0, 1)).alias("compression_risk"),
        _r(F.when(F.col("dirt").isNull(), 0.0).otherwise(clip(F.col("dark") * 1.25 + F.col("dirt") / 95.0, 0, 1))).alias("shadow_dirt_risk"),
        _r(clip((130.0 - F.col("sharp")) / 130.0, 0, 1)).alias("blur_risk"),
    )


def color_state(px3: DataFrame) -> DataFrame:
    """Highlight risk without texture, colour pollution, and mean gray: HSV statistics of each image."""
    h, s, v = hsv(F.col("b"), F.col("g"), F.col("r"))
    rows = px3.select("image_id", h.alias("h"), s.alias("s"), v.alias("v"), gray(F.col("b"), F.col("g"), F.col("r")).alias("l"))
    m = rows.groupBy("image_id").agg(
        F.avg((F.col("v") > 246).cast("double")).alias("clipped"), F.avg(F.when(F.col("v") > 215, F.col("s"))).alias("bright_s"),
        F.avg((F.col("s") > 185).cast("double")).alias("high_s"), F.coalesce(F.stddev_pop(F.when(F.col("s") > 35, F.col("h"))), F.lit(0.0)).alias("spread"), F.avg("l").alias("mean_gray"),
    )
    pollution = clip(normalize(F.col("high_s"), 0.06, 0.38) * 0.55 + normalize(F.col("spread"), 36, 70) * 0.45, 0, 1)
    highlight = F.when(F.col("bright_s").isNull(), 0.0).otherwise(normalize(F.col("clipped"), 0.01, 0.18) * 0.45 + normalize(F.col("bright_s"), 16, 86) * 0.25)
    return m.select("image_id", _r("mean_gray").alias("mean_gray"), _r(highlight).alias("highlight_part"), _r(pollution).alias("color_pollution"))


def color_drift(before: DataFrame, after: DataFrame, image_type: str = "unknown", corrected: bool = False) -> DataFrame:
    """Colour differences of two versions of each image, pixel by pixel, and the reasons why they count as drift."""
    old, new = ([F.col(f"{c}{k}") for c in "bgr"] for k in (0, 1))
    both = before.select("image_id", "y", "x", *[F.col(c).alias(f"{c}0") for c in "bgr"]).join(after.select("image_id", "y", "x", *[F.col(c).alias(f"{c}1") for c in "bgr"]), ["image_id", "y", "x"])
    (h0, s0, v0), (h1, s1, _) = hsv(*old), hsv(*new)
    delta = F.sqrt(sum(((p - q) * (p - q) for p, q in zip(lab(*old), lab(*new), strict=True)), F.lit(0.0)))
    turn = F.abs(h0 - h1)
    rows = both.select("image_id", h0.alias("h"), (s0 / 255.0).alias("s"), (v0 / 255.0).alias("v"), (s1 / 255.0).alias("s1"), delta.alias("d"), (F.least(turn, 180.0 - turn) * 2.0).alias("turn"))
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    masks = {
        "skin_tone_delta": (h >= 2) & (h <= 24) & (s >= 0.10) & (s <= 0.58) & (v >= 0.28) & (v <= 0.96),
        "brand_color_delta": ((h <= 8) | (h >= 170)) & (s > 0.42) & (v > 0.16),
        "highlight_color_delta": (v > 0.82) & (s > 0.05),
        "shadow_color_delta": (v < 0.22) & (s > 0.05),
    }
    m = rows.groupBy("image_id").agg(
        _r(F.avg("d")).alias("mean_delta_e"), _r(F.percentile("d", 0.95)).alias("p95_delta_e"), _r(F.avg("s1") - F.avg("s")).alias("saturation_delta"), _r(F.avg("turn")).alias("mean_hue_delta"),
        *[_r(F.coalesce(F.avg(F.when(c, F.col("d"))), F.lit(0.0))).alias(k) for k, c in masks.items()],
    )
    reasons = labels(
        (F.abs("saturation_delta") > (0.014 if corrected else 0.010), "saturation_delta"),
        (F.col("p95_delta_e") > (4.2 if image_type in ("text_poster", "product_kv") else 3.6), "p95_delta_e"),
        (F.col("skin_tone_delta") > 3.0, "skin_tone_delta"), (F.col("brand_color_delta") > 2.8, "brand_color_delta"),
        (F.col("highlight_color_delta") > 3.4, "highlight_color_delta"), (F.col("shadow_color_delta") > 3.4, "shadow_color_delta"),
    )
    return m.withColumn("drift_reasons", F.array_join(reasons, ";"))


def pixel_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Mean absolute difference and PSNR of two gray versions; identical images have a null PSNR."""
    both = before.join(after.withColumnRenamed("l", "m"), ["image_id", "y", "x"])
    d = F.col("l") - F.col("m")
    mse = F.avg((d * d).cast("double"))
    psnr = F.when(mse > 0, 10.0 * F.log10(255.0 * 255.0 / mse))
    return both.groupBy("image_id").agg(_r(F.avg(F.abs(d))).alias("mean_abs_diff"), F.max(F.abs(d)).alias("max_abs_diff"), _r(psnr).alias("psnr"))


def best_window(px: DataFrame, size: int = 8, step: int = 6) -> DataFrame:
    """The square of a 5 x 5 grid that has the largest mean absolute Laplacian; the first in reading order on a tie."""
    starts = lambda axis: F.explode(F.filter(F.sequence(F.lit(0), F.lit(4 * step), F.lit(step)), lambda s: (F.col(axis) >= s) & (F.col(axis) < s + size)))
    rows = st.neighbours(px).select("image_id", "y", "x", F.abs(st.laplacian()).alias("a")).withColumn("wx", starts("x")).withColumn("wy", starts("y"))
    means = rows.groupBy("image_id", "wy", "wx").agg(_r(F.avg("a")).alias("pooled"))
    top = F.max(F.struct("pooled", (-F.col("wy")).alias("ny"), (-F.col("wx")).alias("nx"))).alias("top")
    return means.groupBy("image_id").agg(top).select("image_id", (-F.col("top.ny")).cast("long").alias("y"), (-F.col("top.nx")).cast("long").alias("x"), F.col("top.pooled").alias("pooled"))


def mask_sets(px: DataFrame) -> DataFrame:
    """Sizes of two masks, bright pixels and steep ones, and of their union, intersection and difference; sets of pixels."""
    gx, gy = st.sobel()
    at = ["image_id", "y", "x"]
    bright = px.where("l > 150").select(*at)
    steep = st.neighbours(px).where(F.sqrt(gx * gx + gy * gy) > 220).select(*at)
    kinds = {"bright": bright, "steep": steep, "union": bright.union(steep).distinct(), "both": bright.intersect(steep), "bright_only": bright.exceptAll(steep)}
    sizes = [df.groupBy("image_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(k)) for k, df in kinds.items()]
    out = sizes[0]
    for more in sizes[1:]:
        out = out.unionByName(more)
    return out.groupBy("image_id").agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{k}") for k in kinds])


def texture(px: DataFrame) -> DataFrame:
    """Share of pixels that stand out from their blur, and the scored mean of the finest detail."""
    rows = st.gaussian(st.gaussian(px, 1.35, "wide"), 1.15, "narrow")
    high = F.abs(F.col("l") - st.quantized(F.col("wide")))
    fine = F.abs(F.col("l") - st.quantized(F.col("narrow")))
    return rows.groupBy("image_id").agg(_r(F.avg((high > 8).cast("double"))).alias("texture_density"), log_score(F.avg(fine), 16.0).alias("high_frequency_score"))


def mid_frequency(px: DataFrame) -> DataFrame:
    """Deviation of the band between two blurs, from 0 to 1."""
    rows = st.gaussian(st.gaussian(px, 1.4, "mid"), 6.0, "low")
    band = F.abs(st.quantized(F.col("mid")) - st.quantized(F.col("low")))
    return rows.groupBy("image_id").agg(_r(normalize(F.stddev_pop(band), 4.0, 32.0)).alias("mid_frequency_score"), _r(F.stddev_pop(band)).alias("band_deviation"))


def local_contrast(px: DataFrame) -> DataFrame:
    """Mean local deviation under a Gaussian window, from 0 to 1."""
    rows = st.gaussian(st.gaussian(px.withColumn("sq", F.col("l") * F.col("l")), 2.0, "mean"), 2.0, "mean_sq", "sq")
    local = F.avg(F.sqrt(F.greatest(F.lit(0.0), F.col("mean_sq") - F.col("mean") * F.col("mean"))))
    return rows.groupBy("image_id").agg(_r(clip(local / 22.0, 0, 1)).alias("local_contrast"), _r(local).alias("mean_local_deviation"))


def smooth_regions(before: DataFrame, after: DataFrame) -> DataFrame:
    """How much flat regions changed between two gray versions: difference, gradient difference, and the guard's levels."""
    def grads(px: DataFrame, tag: str) -> DataFrame:
        blurred = st.gaussian(px.select("image_id", "y", "x", "l"), 2.2, "blur").select("image_id", "y", "x", "blur")
        gx, gy = st.sobel()
        return st.neighbours(blurred, "blur").select("image_id", "y", "x", F.col("blur").alias(f"b{tag}"), F.sqrt(gx * gx + gy * gy).alias(f"g{tag}"))

    both = grads(before, "0").join(grads(after, "1"), ["image_id", "y", "x"])
    flat = F.when(F.col("g0") < 60, F.lit(1))
    m = both.groupBy("image_id").agg(
        F.avg(flat * F.abs(F.col("b1") - F.col("b0"))).alias("d"), F.avg(F.abs(F.col("b1") - F.col("b0"))).alias("every"), F.percentile(flat * F.abs(F.col("g1") - F.col("g0")), 0.95).alias("band"),
    )
    d = F.coalesce("d", "every")
    level = lambda v: F.when(v >= 0.72, "high").when(v >= 0.42, "medium").otherwise("low")
    band = F.coalesce("band", F.lit(0.0)) / 22.0
    return m.select("image_id", _r(d).alias("flat_diff"), _r(clip(1 - d / 18.0, 0, 1)).alias("uniformity"), _r(F.coalesce("band", F.lit(0.0))).alias("band_signal"), level(d / 18.0).alias("gradient_risk"), level(band).alias("band_risk"))


def point_sums(px: DataFrame) -> DataFrame:
    """Mean lightness after each lightness curve."""
    v = F.col("l").cast("double")
    curves = {"highlights": pt.compress_highlights(v, 0.8), "clipped": pt.compress_clipped(v), "specular": pt.compress_specular(v, 0.5), "shadows": pt.breathe_shadows(v, 0.7)}
    return px.groupBy("image_id").agg(_r(F.avg(v)).alias("plain"), *[_r(F.avg(c) + 1e-9).alias(k) for k, c in curves.items()])


def skin_and_saturation(px3: DataFrame) -> DataFrame:
    """Skin and ink shares, and mean saturation before and after the saturation operators."""
    h, s, v = hsv(F.col("b"), F.col("g"), F.col("r"))
    rows = px3.select("image_id", h.alias("h"), s.alias("s"), v.alias("v"))
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    tamed_s, tamed_v = pt.tame_hdr(s, v, 0.6)
    return rows.groupBy("image_id").agg(
        _r(F.avg(pt.skin(h, s, v).cast("double"))).alias("skin_ratio"), _r(0.75 * F.avg((s < 34).cast("double")) + 0.25 * F.stddev_pop(v) / 80.0).alias("gray_ink"), _r(F.avg(s)).alias("mean_s"),
        _r(F.avg(pt.saturate(s, 1.08))).alias("richer_s"), _r(F.avg(tamed_s)).alias("tamed_s"), _r(F.avg(tamed_v)).alias("tamed_v"), _r(F.avg(pt.clamp_saturation(s / 255.0, s / 255.0 * 1.05))).alias("clamped_s"),
    )


def channel_match(px3: DataFrame) -> DataFrame:
    """The red channel moved to the blue one's mean and deviation."""
    return pt.match_channel(px3, "b", "r", "m").groupBy("image_id").agg(_r(F.avg("m"), 3).alias("mean_matched"), _r(F.stddev_pop("m"), 3).alias("deviation_matched"), _r(F.avg("b"), 3).alias("mean_reference"))


def artifact_masks(px: DataFrame) -> DataFrame:
    """Sizes of the block mask (jumps on the 8-pixel grid, widened, in flat places) and of the adaptive threshold's strokes."""
    rows = px.repartition("image_id").select("*", F.lag("l").over(st.row()).alias("before"), F.lag("l").over(st.column()).alias("above"))
    jump = ((F.col("x") >= 8) & (F.col("x") % 8 == 0) & (F.abs(F.col("l") - F.col("before")) > 8)) | ((F.col("y") >= 8) & (F.col("y") % 8 == 0) & (F.abs(F.col("l") - F.col("above")) > 8))
    grid = st.box(rows.select("image_id", "y", "x", F.coalesce(jump, F.lit(False)).cast("int").alias("l")), 1, F.max, "wide").select("image_id", "y", "x", "wide")
    flat = st.neighbours(px).select("image_id", "y", "x", (F.abs(st.laplacian()) < 60).alias("flat"))
    stroke = st.box(px, 8, F.sum, "total").select("image_id", "y", "x", (F.col("l") <= F.floor(F.col("total") / 289.0 + 0.5) - 8).alias("stroke"))
    return grid.join(flat, ["image_id", "y", "x"]).join(stroke, ["image_id", "y", "x"]).groupBy("image_id").agg(
        F.count_if((F.col("wide") == 1) & F.col("flat")).alias("n_block"), F.count_if(F.col("stroke")).alias("n_stroke"), F.sum("wide").alias("n_grid")
    )


def unsharp(px: DataFrame, sigma: float = 1.2, amount: float = 0.35) -> DataFrame:
    """The raster with part of its fine detail added again."""
    rows = st.gaussian(px, sigma, "blur")
    return rows.select("image_id", "y", "x", st.quantized(F.round(F.col("l") * (1 + amount) - F.col("blur") * amount, 9)).alias("l"))


def morphology(px: DataFrame) -> DataFrame:
    """Sums of the 3 x 3 closing, opening, black hat and top hat: maxima of minima and minima of maxima."""
    rows = st.box(st.box(px, 1, F.max, "hi"), 1, F.min, "lo")
    rows = st.box(st.box(rows, 1, F.min, "closed", "hi"), 1, F.max, "opened", "lo")
    hat = F.greatest(F.col("closed") - F.col("l"), F.col("l") - F.col("opened"))
    return rows.groupBy("image_id").agg(F.sum("closed").alias("closed_sum"), F.sum("opened").alias("opened_sum"), F.sum(F.col("closed") - F.col("l")).alias("black_hat_sum"), F.sum(F.col("l") - F.col("opened")).alias("top_hat_sum"), F.max(hat).alias("max_hat"))


def stretched(px: DataFrame) -> DataFrame:
    """Every pixel between its image's smallest and largest value, on 0 to 255; flat images are 0."""
    low, high = F.min("l").over(pt.image()), F.max("l").over(pt.image())
    return px.repartition("image_id").select("image_id", "y", "x", F.when(high > low, F.floor((F.col("l") - low) * 255 / (high - low) + 0.5)).otherwise(0).cast("int").alias("l"))


def color_cast(px3: DataFrame) -> DataFrame:
    """The cast of near-neutral pixels: its direction and strength, how much of the image is neutral, and the correction it allows."""
    _, s, v = hsv(F.col("b"), F.col("g"), F.col("r"))
    _, a, b = lab(F.col("b"), F.col("g"), F.col("r"))
    rows = px3.select("image_id", (s / 255.0).alias("s"), (v / 255.0).alias("v"), a.alias("a"), b.alias("bb"))
    neutral = (F.col("s") < 0.32) & (F.col("v") > 0.22) & (F.col("v") < 0.88)
    m = rows.groupBy("image_id").agg(
        F.avg(neutral.cast("double")).alias("share"), F.avg((F.col("s") > 0.62).cast("double")).alias("vivid"), F.coalesce(F.avg(F.when(neutral, F.col("a"))) - 128, F.lit(0.0)).alias("da"), F.coalesce(F.avg(F.when(neutral, F.col("bb"))) - 128, F.lit(0.0)).alias("db"),
    )
    size = F.sqrt(F.col("da") * F.col("da") + F.col("db") * F.col("db"))
    way = F.when(size < 1.4, "none").when(F.abs("da") >= F.abs("db"), F.when(F.col("da") > 0, "magenta").otherwise("green")).otherwise(F.when(F.col("db") > 0, "yellow").otherwise("blue"))
    why = F.when(F.col("vivid") > 0.9, "brand_or_text_color_protected").when(F.col("share") < 0.035, "low_neutral_confidence").when(size < 1.8, "no_reliable_cast").otherwise("")
    return m.select("image_id", _r("share").alias("neutral_share"), way.alias("direction"), _r(size).alias("cast_strength"), why.alias("skip_reason"), _r(F.when(why == "", clip(size / 18.0, 0.035, 0.16)).otherwise(0.0)).alias("correction"))
