"""Point operators: each pixel alone, or with statistics of its image or the same pixel of another version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lumenmill.functions.scalars import clip


def bend_above(v: Column, knee: float, factor: float) -> Column:
    """Values over the knee keep factor of their distance to it: the shape of all highlight compressions."""
    return F.when(v > knee, knee + (v - knee) * factor).otherwise(v)


def compress_highlights(lightness: Column, strength: float) -> Column:
    return bend_above(lightness, 190.0, 1 - 0.28 * strength)


def compress_clipped(lightness: Column, amount: float = 0.18) -> Column:
    return bend_above(lightness, 238.0, 1 - min(max(amount, 0.0), 0.5))


def compress_specular(value: Column, strength: float) -> Column:
    return bend_above(value, 210.0, 1 - 0.45 * strength)


def breathe_shadows(lightness: Column, strength: float) -> Column:
    return F.when(lightness < 72, lightness + (72.0 - lightness) * 0.18 * strength).otherwise(lightness)


def tame_hdr(saturation: Column, value: Column, strength: float) -> tuple[Column, Column]:
    bright = value > 205
    return F.when(bright, saturation * (1 - 0.18 * strength)).otherwise(saturation), F.when(bright, value - (value - 205.0) * 0.22 * strength).otherwise(value)


def saturate(saturation: Column, factor: float) -> Column:
    return clip(saturation * factor, 0, 255)


def clamp_saturation(reference: Column, candidate: Column, margin: float = 0.008) -> Column:
    """Saturations from 0 to 1; the candidate stays within margin of the reference."""
    return F.least(candidate, clip(reference + margin, 0, 1))


def skin(h: Column, s: Column, v: Column) -> Column:
    near = s.between(20, 190) & v.between(55, 245)
    return (h.between(0, 28) & near) | (h.between(160, 179) & s.between(20, 175) & v.between(55, 245))


def blend(a: Column, b: Column, amount: float) -> Column:
    return a * (1 - amount) + b * amount


def match_channel(rows: DataFrame, reference: str, channel: str, out: str, strength: float = 0.96) -> DataFrame:
    """Moves a channel of each image to the mean and deviation of its reference; deviations under 1 count as 1."""
    every = image()
    mean = lambda c: F.avg(c).over(every)
    spread = lambda c: F.greatest(F.stddev_pop(c).over(every), F.lit(1.0))
    matched = (F.col(channel) - mean(channel)) / spread(channel) * spread(reference) + mean(reference)
    return rows.repartition("image_id").withColumn(out, clip(blend(F.col(channel), matched, strength), 0, 255))


def image() -> WindowSpec:
    return Window.partitionBy("image_id")
