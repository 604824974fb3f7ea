"""Colour spaces on the 8-bit scale that image libraries use: hue 0 to 179, saturation, value and Lab 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gray(b: Column, g: Column, r: Column) -> Column:
    return F.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5).cast("int")


def hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    d = (v - low).cast("double")
    s = F.when(v == 0, 0.0).otherwise(F.floor(255.0 * d / v + 0.5))
    turn = F.when(d == 0, 0.0).when(v == r, 60.0 * (g - b) / d).when(v == g, 120.0 + 60.0 * (b - r) / d).otherwise(240.0 + 60.0 * (r - g) / d)
    h = F.floor(F.when(turn < 0, turn + 360.0).otherwise(turn) / 2 + 0.5)
    return F.when(h >= 180, h - 180).otherwise(h).cast("double"), s.cast("double"), v.cast("double")


def linear(c: Column) -> Column:
    """A byte of sRGB as light, from 0 to 1."""
    return F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))


def xyz(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """CIE XYZ under D65 of linear channels."""
    return (0.412453 * r + 0.357580 * g + 0.180423 * b) / 0.950456, 0.212671 * r + 0.715160 * g + 0.072169 * b, (0.019334 * r + 0.119193 * g + 0.950227 * b) / 1.088754


def root(t: Column) -> Column:
    return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(7.787 * t + 16.0 / 116.0)


def lab(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """CIE Lab of sRGB under D65, scaled to bytes and rounded."""
    x, y, z = xyz(linear(b), linear(g), linear(r))
    return lab_of_roots(y, root(x), root(y), root(z))


def lab_of_roots(y: Column, root_x: Column, root_y: Column, root_z: Column) -> tuple[Column, Column, Column]:
    """The same of Y and the roots of XYZ: where these are columns of their own, no power is taken twice."""
    light = F.when(y > 0.008856, 116.0 * root_y - 16.0).otherwise(903.3 * y)
    byte = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(c + 0.5).cast("double")))
    return byte(light * 255.0 / 100.0), byte(500.0 * (root_x - root_y) + 128.0), byte(200.0 * (root_y - root_z) + 128.0)
