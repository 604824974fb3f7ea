"""Scalar building blocks that policies and metrics share."""

from __future__ import annotations

from functools import reduce

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_or_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def normalize(value: Column, low: float, high: float) -> Column:
    """Position of value between low and high, from 0 to 1; 0 for an empty range."""
    return clip((value - low) / (high - low), 0.0, 1.0) if high > low else F.lit(0.0)


def score(value: Column, low: float, high: float) -> Column:
    return clip((value - low) / (high - low) * 100.0, 0.0, 100.0) if high > low else F.lit(0.0)


def log_score(value: Column, scale: float) -> Column:
    return F.round(clip(F.log1p(F.greatest(value, F.lit(0.0))) * scale, 0.0, 100.0), 4)


def ladder(*rungs: tuple[Column, object], otherwise: object) -> Column:
    """The value of the first condition that holds; null conditions do not hold."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    first, *rest = rungs
    built = reduce(lambda so_far, rung: so_far.when(rung[0], as_column(rung[1])), rest, F.when(first[0], as_column(first[1])))
    return built.otherwise(as_column(otherwise))


def half_up(value: Column, digits: int) -> Column:
    """Rounds a value of at least 0 half up, also where binary fractions fall just short of the half."""
    return F.round(value + 1e-9, digits)


def three_levels(value: Column, low: float, high: float, names: tuple[str, str, str]) -> Column:
    """names[0] below low, names[1] below high, names[2] from there on."""
    return ladder((value < low, names[0]), (value < high, names[1]), otherwise=names[2])


def risk_label(value: Column) -> Column:
    return three_levels(value, 0.34, 0.67, ("low", "medium", "high"))


def grade(value: Column) -> Column:
    return three_levels(value, 0.34, 0.67, ("weak", "moderate", "strong"))


def risk_level(value: Column, medium: float, high: float) -> Column:
    return three_levels(value, medium, high, ("low", "medium", "high"))


def risk_within(value: Column, low_limit: float, high_limit: float) -> Column:
    return ladder((value <= low_limit, "low"), (value <= high_limit, "medium"), otherwise="high")


def risk_from_gain(primary: Column, secondary: Column) -> Column:
    worst = F.least(primary, secondary)
    return ladder((worst < -1.2, "high"), (worst < -0.25, "medium"), otherwise="low")


def labels(*pairs: tuple[Column, str], default: str | None = None) -> Column:
    """The names whose conditions hold, in order; the default alone if none does."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))
    return found if default is None else F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def truthy_text(value: Column) -> Column:
    """Whether a flag given as text means yes."""
    return F.lower(F.trim(value)).isin("1", "true", "yes", "y", "on", "debug")


def sanitize(value: Column, missing: str) -> Column:
    """A value as part of a file name: characters that file systems refuse become _, white space one space, no space or dot at the ends."""
    text = F.trim(F.when(value.isNull() | (value == ""), F.lit(missing)).otherwise(value))
    clean = F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(clean, r"^[ .]+|[ .]+$", ""), "^$", F.lit(re.sub(r"([\\$])", r"\\\1", missing)))


# What a redacted text must not contain, in order.
SECRET = r"(?i)(api[_-]?key|token|cookie|authorization|password|secret)[\"']?\s*[:=]\s*[\"']?[^\"'\s,}]+"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"
#: The same matches, but tried only where a run of such characters begins (or the last match ended), so that long runs take linear time.
EMAIL_ONCE = r"(?:\G|(?<![\p{L}\p{N}_.+-]))[\p{L}\p{N}_.+-]++@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}"
IPV4 = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
MAC = r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"
# Fixed values end.


def redact(text: Column, network: bool = False) -> Column:
    out = F.regexp_replace(text, SECRET, "<redacted>")
    out = F.when(out.contains("@"), F.regexp_replace(out, EMAIL_ONCE, "<redacted>")).otherwise(out)
    return F.regexp_replace(F.regexp_replace(out, IPV4, "<ip>"), MAC, "<mac>") if network else out


def fixed2(value: Column) -> Column:
    """A number of at least 0 as text with two decimals, half up."""
    n = F.floor(value * 100 + 0.5).cast("long")
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
