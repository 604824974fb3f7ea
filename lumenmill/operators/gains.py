"""What an image won and lost between two versions: regions of several kinds side by side, in one aggregate over the pixels of each version."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmill.functions.color import gray, hsv, lab_of_roots, linear, root, xyz
from lumenmill.functions.scalars import clip, labels, ladder, log_score, risk_from_gain, risk_within
from lumenmill.functions.tables import apart, settled
from lumenmill.operators import planes
from lumenmill.operators import points as pt

c = F.col
AT = ["image_id", "y", "x"]


#: The largest reach of a stencil here.
REACH = 8
MADE = "lap double, steep double, wide int, narrow int, around long, total long, text_edge boolean, dark_edge boolean"


def _made(l: np.ndarray) -> Iterator[planes.Band]:  # noqa: E741
    """What the stencils say of each pixel of a gray plane."""
    size = planes.thinned(l)
    marks = {"text_edge": planes.edges(size, 60, 160), "dark_edge": planes.edges(size, 45, 135)}
    for first, last, block in planes.bands(l, REACH):
        near = planes.within(block, REACH - 1)
        gx, gy = (g.astype(np.float64) for g in planes.sobel(near))
        yield first, last, {
            "lap": planes.laplacian(near).astype(np.float64), "steep": np.sqrt(gx * gx + gy * gy), "wide": planes.quantized(planes.blurred(block, 1.35, REACH)), "narrow": planes.quantized(planes.blurred(block, 1.15, REACH)),
            "around": planes.box_sum(planes.within(block, REACH - 3), 3), "total": planes.box_sum(block, REACH), **{n: m[first:last] for n, m in marks.items()},
        }


def version_signals(px3: DataFrame, text: DataFrame | None = None, strokes: bool = False) -> DataFrame:
    """One row an image of (image_id, y, x, b, g, r): sharpness, edges, text, and the detail of each region.

    text (image_id, y, x, weight): a soft mask of text; pixels that it lacks weigh 0, and over 0.12 counts. With strokes, a plain stand-in for
    one: pixels weigh 1 that are at least 8 darker than the mean of the 17 x 17 square around them. An image with hardly any text
    takes its sharpness for the text's. A region of at most a thousandth of the image takes the detail of the whole.
    """
    h, s, v = c("h"), c("s"), c("v")
    px = px3.select(*AT, gray(c("b"), c("g"), c("r")).alias("l"), *[v.alias(n) for v, n in zip(hsv(c("b"), c("g"), c("r")), "hsv", strict=True)])
    # Only what the masks say of a colour goes along with its pixel.
    px = px.select(*AT, "l", pt.skin(h, s, v).alias("face"), (s > 35).alias("vivid"))
    px = px if text is None else px.join(apart(text.select(*AT, "weight")), AT, "left")
    rows = planes.on_planes(px, _made, MADE, keep=[n for n in px.columns if n not in ("y", "x")])
    weight = (c("l") <= F.floor(c("total") / 289.0 + 0.5) - 8).cast("double") if strokes else F.lit(0.0) if text is None else F.coalesce("weight", F.lit(0.0))
    rows = rows.select(
        "image_id", "lap", "steep", F.abs(c("l") - c("narrow")).alias("fine"), (weight > 0.12).alias("texty"), c("text_edge").cast("double").alias("edge"), F.abs(c("l") - c("around") / 49.0).alias("contrast"),
        "face", (c("dark_edge") & (c("l") < 95)).alias("hair"), ((F.abs(c("l") - c("wide")) > 7) & (c("vivid") | (c("l") < 115))).alias("fabric"), (c("l") < 88).alias("dark"),
    )
    within = lambda mask, value: F.avg(F.when(mask, value))
    share = lambda mask: F.avg(mask.cast("double"))
    m = rows.groupBy("image_id").agg(
        F.var_pop("lap").alias("sharpness"), F.avg("steep").alias("edges"), share(c("texty")).alias("text_density"),
        F.greatest(within(c("texty"), c("edge")) * 255 * 1.35, within(c("texty"), c("steep")) * 0.62 + within(c("texty"), F.abs("lap")) * 0.18 + within(c("texty"), c("contrast")) * 1.45).alias("strokes"),
        *[F.when(share(c(r)) > 0.001, within(c(r), c("fine"))).otherwise(F.avg("fine")).alias(r) for r in ("face", "hair", "fabric", "dark")],
    )
    plain = (c("text_density") < 0.0005) | c("strokes").isNull() | (c("strokes") <= 0.01)
    return m.select("image_id", "sharpness", "edges", "text_density", F.when(plain, c("sharpness")).otherwise(c("strokes")).alias("text"), "face", "hair", "fabric", "dark")


def pair_difference(pairs: DataFrame) -> DataFrame:
    """(image_id, color_delta, diff): mean absolute differences of the Lab bytes and of the channels, over pixels that have both versions (b0, g0, r0 and b1, g1, r1).

    Both are sums of whole numbers, divided once, so they do not hang on the order of pixels.
    """
    apart_by = lambda old, new: sum((F.abs(p - q) for p, q in zip(old, new, strict=True)), F.lit(0))
    of = lambda i, names="bgr": [c(f"{n}{i}") for n in names]
    # Parts that are used several times are columns one after the other, so that none is computed again.
    rows = pairs.select("image_id", apart_by(of(0), of(1)).alias("diff"), *[linear(c(f"{n}{i}")).alias(f"{n}{i}") for i in (0, 1) for n in "bgr"])
    rows = rows.select("image_id", "diff", *[v.alias(f"{n}{i}") for i in (0, 1) for n, v in zip("xyz", xyz(*of(i)), strict=True)])
    rows = rows.select("image_id", "diff", "y0", "y1", *[root(c(f"{n}{i}")).alias(f"r{n}{i}") for i in (0, 1) for n in "xyz"])
    rows = rows.select("image_id", "diff", apart_by(*[lab_of_roots(c(f"y{i}"), c(f"rx{i}"), c(f"ry{i}"), c(f"rz{i}")) for i in (0, 1)]).alias("lab"))
    return rows.groupBy("image_id").agg(*[(F.sum(n) / (F.count(n) * 3.0)).alias(to) for n, to in (("lab", "color_delta"), ("diff", "diff"))])


def version_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """The difference over all pixels that both tables have."""
    return pair_difference(before.select(*AT, *[c(k).alias(f"{k}0") for k in "bgr"]).join(apart(after.select(*AT, *[c(k).alias(f"{k}1") for k in "bgr"])), AT))


def _r(value: Column, n: int = 4) -> Column:
    return F.round(value, n)


def quality_gains(
    before: DataFrame, after: DataFrame, text_before: DataFrame | None = None, text_after: DataFrame | None = None, text_density: Column | None = None, strokes: bool = False, difference: DataFrame | None = None,
) -> DataFrame:
    """The quality metrics of two versions of each image, of equal size: scores of the later one, gains over the earlier one, and risks.

    text_density: by default the earlier version's share of text. strokes: the stand-in of version_signals takes the place of masks of text.
    difference: that of the two versions where it is known; else their pixels are joined. Images without a partner give no row.
    """
    old, new = (version_signals(px, text, strokes) for px, text in ((before, text_before), (after, text_after)))
    names = [n for n in old.columns if n != "image_id"]
    difference = version_difference(before, after) if difference is None else difference
    rows = old.select("image_id", *[c(n).alias(f"{n}0") for n in names]).join(apart(new.select("image_id", *[c(n).alias(f"{n}1") for n in names])), "image_id").join(apart(difference), "image_id")
    rows = settled(rows)  # a row an image; whoever reads the result again does not go through the pixels again
    scores = {"clarity": ("sharpness", 11.0), "text_clarity": ("text", 10.5), "edge_quality": ("edges", 15.5), "face_detail": ("face", 16.0), "hair_texture": ("hair", 16.0), "fabric_texture": ("fabric", 16.0), "dark_detail": ("dark", 16.0)}
    both = lambda k: [log_score(c(f"{scores[k][0]}{i}"), scores[k][1]) for i in (0, 1)]
    rows = rows.select("*", *[both(k)[1].alias(f"{k}_score") for k in scores], *[_r(both(k)[1] - both(k)[0]).alias(f"{k}_gain") for k in scores])
    delta, diff = c("color_delta"), c("diff")
    rows = rows.select("*", _r(clip(100.0 - delta * 3.2, 0, 100)).alias("color_fidelity_score"), _r(clip(92.0 - F.abs(diff - 1.8) * 4.0, 0, 100)).alias("detail_stability_score"), risk_within(delta, 1.15, 2.2).alias("compression_damage_risk"))
    pseudo = F.greatest(F.lit(0.0), (0.2 - c("clarity_gain")) + (0.1 - c("edge_quality_gain")))
    artifact = ladder(((c("color_fidelity_score") < 88) | (c("compression_damage_risk") == "high"), "high"), (c("color_fidelity_score") < 93, "medium"), otherwise="low")
    finest = F.least("hair_texture_gain", "fabric_texture_gain")
    density = c("text_density0") if text_density is None else text_density
    visual = c("clarity_score") * 0.22 + c("text_clarity_score") * F.when(density >= 0.01, 0.22).otherwise(0.12) + c("edge_quality_score") * 0.22 + c("detail_stability_score") * 0.16 + c("color_fidelity_score") * 0.18
    kept = [f"{k}_{w}" for k in scores for w in ("score", "gain")]
    return rows.select(
        "image_id", *kept, "color_fidelity_score", "detail_stability_score", "compression_damage_risk", artifact.alias("artifact_risk"), ladder(((pseudo <= 0.4) & (diff > 0.05), "low"), otherwise="medium").alias("pseudo_hd_risk"),
        _r(clip(c("text_clarity_score") - F.greatest(F.lit(0.0), delta - 0.8) * 4.0, 0, 100)).alias("text_edge_clean_score"),
        _r(clip(c("text_clarity_score") * 0.74 + c("edge_quality_score") * 0.26 - F.greatest(F.lit(0.0), delta - 1.0) * 2.0, 0, 100)).alias("small_text_readability_score"),
        _r(c("text_density0"), 6).alias("before_text_region_density"), _r(c("text_density1"), 6).alias("after_text_region_density"), _r(c("text_density1") - c("text_density0"), 6).alias("text_region_density_delta"),
        risk_from_gain(c("clarity_gain"), finest).alias("over_smoothing_risk"), risk_from_gain(finest, c("detail_stability_score") - 78.0).alias("texture_loss_risk"), _r(visual).alias("visual_score"),
        _r(diff, 6).alias("pixel_diff_from_reference"), _r(delta, 6).alias("color_delta"), density.alias("text_density"),
    )


def base_gate(density: Column) -> tuple[Column, Column, Column]:
    """Whether a version passes, its level, and the names of what failed, over the columns of quality_gains."""
    texty = density >= 0.015
    checks = [
        (c("color_fidelity_score") >= 88, "color_fidelity_score"), (c("artifact_risk") != "high", "artifact_risk"), (c("pseudo_hd_risk") != "high", "pseudo_hd_risk"), (c("detail_stability_score") >= 55, "detail_stability_score"),
        (c("clarity_score") >= 15, "clarity_score"), (c("clarity_gain") >= -0.5, "clarity_gain"), (c("edge_quality_gain") >= -0.5, "edge_quality_gain"),
        (~texty | (c("text_clarity_score") >= 24), "text_clarity_score"), (~texty | (c("text_clarity_gain") >= -0.8), "text_clarity_gain"),
    ]
    failed = labels(*[(~ok, name) for ok, name in checks])
    passed = F.size(failed) == 0
    level = ladder((~passed, "failed"), ((c("visual_score") >= 72) & (c("color_fidelity_score") >= 95), "excellent"), (c("visual_score") >= 50, "standard"), otherwise="acceptable")
    return passed, level, F.array_join(failed, ";")
