"""Ordered rule ladders: from the features of an image to its type, sizes, formats, strengths and strategies.

Every policy maps columns to columns, so the same rule serves batch and streaming input; the first rung that holds decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmill.functions.scalars import clip, grade, half_up, labels, ladder, risk_label
from lumenmill.sources.rules import token_hits

c = F.col
TEXT_TYPES = ("text_poster", "ppt_page")

# Names, presets and strengths that results are compared with.
ISSUES = [
    ("high_frequency_pollution", "高频污染偏高"), ("ai_dirty_score", "AI脏感偏高"), ("sharpening_risk", "锐化风险偏高"),
    ("highlight_risk", "高光风险偏高"), ("color_pollution", "色彩污染偏高"), ("atmosphere_deficiency", "空气感不足"),
]
WEAK_MID = "中频结构偏弱"
ASPECTS = [("16:9", 16 / 9), ("21:9", 21 / 9), ("1:1", 1.0), ("9:16", 9 / 16)]
MID_STRENGTH = {"product_kv": 0.13, "architecture": 0.14, "landscape": 0.13, "mixed": 0.12, "portrait": 0.08, "unknown": 0.10, "general": 0.10}
# Fixed values end.


def classify_type() -> Column:
    ratio = c("width") / F.greatest(c("height"), F.lit(1))
    return ladder(
        ((c("skin_ratio") >= 0.045) & (c("dark_ratio") >= 0.18), "portrait"),
        ((ratio >= 2.0) & (c("edge_density") >= 0.075) & (c("low_saturation_ratio") >= 0.55), "ppt_page"),
        ((c("text_density") >= 0.045) & (c("edge_density") >= 0.055), "ppt_page"),
        (c("text_density") >= 0.018, "text_poster"),
        ((c("edge_density") >= 0.11) & (c("low_saturation_ratio") >= 0.34), "architecture"),
        ((c("texture_density") >= 0.12) | ((c("edge_density") >= 0.095) & (c("low_saturation_ratio") >= 0.36)), "mixed"),
        ((c("edge_density") < 0.035) & (c("low_saturation_ratio") < 0.42), "product_kv"),
        otherwise="unknown",
    )


def classify_degradation(sharpness: Column, noise: Column) -> Column:
    per_pixel = c("input_size_bytes") / F.greatest(c("width") * c("height"), F.lit(1))
    return ladder(
        (F.least("width", "height") < 720, "low_resolution"), (sharpness < 45, "blur"), ((c("input_size_bytes") > 0) & (per_pixel < 0.8), "jpeg_artifact"), (noise > 12, "noise"), otherwise="mixed",
    )


def aspect_label() -> Column:
    ratio = c("width") / F.greatest(c("height"), F.lit(1))
    return ladder(*[(F.abs(ratio - value) <= 0.025, name) for name, value in ASPECTS], otherwise="custom")


def target_size(df: DataFrame) -> DataFrame:
    """Adds aspect, target_width, target_height, resize_policy and was_upscaled; a size never shrinks, and sizes round half to even."""
    w, h = c("width"), c("height")
    ratio = w / F.greatest(h, F.lit(1))
    up = lambda a, b: F.greatest(F.lit(1.0), *[F.lit(float(n)) / F.greatest(x, F.lit(1)) for n, x in ((a, w), (b, h)) if n])
    small = (w <= 1920) & (h <= 1080)
    scale = ladder(
        (c("output_profile") == "fidelity_original", 1.0),
        (ratio >= 2.05, F.when(w >= 2048, 1.0).otherwise(2048.0 / F.greatest(w, F.lit(1)))),
        (c("aspect") == "16:9", up(1920, 1080)), (c("aspect") == "1:1", up(1080, 1080)), (c("aspect") == "9:16", up(1080, 1920)),
        ((w >= 1080) & (h >= 1080), 1.0), (w >= h, up(None, 1080)), otherwise=up(1080, None),
    )
    exact = (c("output_profile") != "fidelity_original") & (ratio < 2.05) & (c("aspect") == "16:9") & small
    wide = (ratio >= 2.05) & (w < 2048) & (c("output_profile") != "fidelity_original")
    tw = F.when(exact | wide, F.when(exact, 1920).otherwise(2048)).otherwise(F.bround(w * c("scale"), 0).cast("int"))
    th = F.when(exact, 1080).otherwise(F.bround(h * c("scale"), 0).cast("int"))
    keep, grew = "keep_original_size_clean_enhance", c("scale") > 1.0
    named = lambda name: F.when(grew, name).otherwise(keep)
    policy = ladder(
        (c("output_profile") == "fidelity_original", keep), (ratio >= 2.05, F.when(w >= 2048, keep).otherwise("upscale_long_edge_to_2048_keep_aspect")),
        (exact, "upscale_to_1920x1080_keep_aspect"), (c("aspect") == "16:9", named("upscale_to_1920x1080_keep_aspect")), (c("aspect") == "1:1", named("upscale_to_1080_square_keep_aspect")),
        (c("aspect") == "9:16", named("upscale_to_1080x1920_keep_aspect")), ((w >= 1080) & (h >= 1080), keep),
        (w >= h, "upscale_short_edge_to_1080_keep_aspect"), otherwise=named("upscale_short_edge_to_1080_keep_aspect"),
    )
    sized = df.withColumn("aspect", aspect_label()).withColumn("scale", scale).withColumn("tw", F.greatest(F.lit(1), tw)).withColumn("th", F.greatest(F.lit(1), th)).withColumn("policy", policy)
    shrinks = (c("tw") < w) | (c("th") < h)
    out = sized.withColumn("target_width", F.when(shrinks, w).otherwise(c("tw"))).withColumn("target_height", F.when(shrinks, h).otherwise(c("th"))).withColumn("resize_policy", F.when(shrinks, keep).otherwise(c("policy")))
    return out.withColumn("was_upscaled", (c("target_width") > w) | (c("target_height") > h)).drop("scale", "tw", "th", "policy")


def choose_format() -> Column:
    """The output format: real transparency needs png, then what was asked for, then the profile."""
    asked = F.lower(F.coalesce("requested_format", F.lit("")))
    asked = F.when(asked == "jpeg", "jpg").when(asked.isin("png", "jpg", "webp"), asked).otherwise("auto")
    return ladder((c("has_real_alpha"), "png"), (asked != "auto", asked), (c("output_profile") == "preview_light", "webp"), otherwise="jpg")


def mid_frequency_strength() -> Column:
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in MID_STRENGTH.items() for x in kv])[c("image_type")], F.lit(0.10)) + F.when(c("mode") == "texture", 0.03).otherwise(0.0)
    return F.when((c("output_profile") == "preview_light") | (c("mode") == "text_safe") | c("image_type").isin(*TEXT_TYPES), 0.0).otherwise(clip(base, 0.0, 0.18))


def material_policy(df: DataFrame) -> DataFrame:
    """Adds material_eligible, material_strength and material_reason."""
    tex, edge = c("texture_density"), c("edge_density")
    reason = ladder(
        (c("output_profile") == "preview_light", "preview_light_profile"), ((c("mode") == "text_safe") | c("image_type").isin(*TEXT_TYPES), "text_safe_or_text_poster"),
        ((c("text_density") >= 0.18) & (tex < 0.035), "high_text_or_gradient_risk"), ((edge >= 0.10) & (c("low_saturation_ratio") > 0.65), "fine_line_table_risk"),
        ((c("image_type") == "unknown") & (c("dark_ratio") > 0.12) & (edge > 0.025) & (tex > 0.05), "small_text_or_technical_graphic_risk"),
        ((edge >= 0.075) & (tex < 0.035), "fine_line_structure_risk"), ((tex < 0.003) & (edge < 0.003), "synthetic_gradient_risk"),
        (tex < 0.006, "very_low_texture_conservative"), ((tex < 0.018) & ~c("image_type").isin("architecture", "landscape"), "low_texture_conservative"),
        ((c("low_saturation_ratio") > 0.92) & (tex < 0.028), "flat_low_saturation_conservative"), otherwise="eligible",
    )
    caps = {"very_low_texture_conservative": 0.025, "low_texture_conservative": 0.055, "flat_low_saturation_conservative": 0.06}
    held = df.withColumn("why", reason)
    open_ = (c("why") == "eligible") | c("why").isin(*caps)
    capped = F.least(mid_frequency_strength(), F.coalesce(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[c("why")], F.lit(1.0)))
    strength = F.when(open_, clip(capped * F.when(c("has_alpha"), 0.45).otherwise(1.0), 0.0, 0.18)).otherwise(0.0)
    noted = F.when(open_ & c("has_alpha"), F.when(c("why") == "eligible", "alpha_safe_reduced").otherwise(F.concat("why", F.lit("+alpha_safe_reduced")))).otherwise(c("why"))
    return held.withColumn("material_strength", F.round(strength, 4)).withColumn("material_eligible", strength > 0).withColumn("material_reason", noted).drop("why")


def edge_policy(df: DataFrame) -> DataFrame:
    """Adds edge_strength, edge_reason and the flags halo_risk and ringing_risk."""
    tex, edge = c("texture_density"), c("edge_density")
    text = (c("mode") == "text_safe") | c("image_type").isin(*TEXT_TYPES) | (c("text_density") >= 0.018)
    gradient, fine = (tex < 0.003) & (edge < 0.003), (edge >= 0.10) & (c("low_saturation_ratio") > 0.65)
    contrast = (edge >= 0.008) | (c("dark_ratio") >= 0.12)
    ringing = (tex >= 0.075) | fine
    rungs = [
        (c("output_profile") == "preview_light", 0.0, "preview_light_profile"), (text, 0.0, "text_edge_protected"), (gradient, 0.0, "gradient_protected"), (fine, 0.0, "fine_line_protected"),
        (~(contrast | c("has_alpha") | ringing), 0.0, "no_edge_risk"), (c("image_type") == "portrait", 0.035, "portrait_skin_safe"), (c("has_alpha"), 0.025, "alpha_edge_safe"),
        (ringing, 0.04, "ringing_guard"), (c("image_type").isin("architecture", "product_kv") | contrast, 0.045, "eligible"),
    ]
    return (
        df.withColumn("edge_strength", ladder(*[(w, s) for w, s, _ in rungs], otherwise=0.05)).withColumn("edge_reason", ladder(*[(w, n) for w, _, n in rungs], otherwise="eligible"))
        .withColumn("halo_risk", contrast | c("has_alpha")).withColumn("ringing_risk", ringing)
    )


def low_quality_reasons() -> Column:
    """Why an image counts as degraded, in order; the profile is the one reason, mixed_degradation from three, none without."""
    jpeg = F.lower("requested_format").isin("jpg", "jpeg") & ((c("compression_risk") > 0.018) | (c("input_size_bytes") < F.greatest(F.lit(1.0), c("width") * c("height") * 0.18)))
    small = F.least("width", "height")
    return labels(
        ((small > 0) & (small < 420), "low_resolution"), (jpeg, "jpeg_compression"), (c("blur_risk") > 0.18, "soft_focus"), (c("local_contrast") < 0.34, "low_contrast"), (c("shadow_dirt_risk") > 0.18, "dirty_shadow"),
    )


def low_quality_policy(df: DataFrame) -> DataFrame:
    """Adds degradation_reasons, degradation_profile and restore_strength (before the skip gates)."""
    held = df.withColumn("found", low_quality_reasons())
    plus = {"low_resolution": 0.018, "jpeg_compression": 0.014, "dirty_shadow": 0.012, "low_contrast": 0.008, "soft_focus": 0.006}
    added = sum((F.when(F.array_contains("found", k), v).otherwise(0.0) for k, v in plus.items()), F.lit(0.025))
    kind = ladder((c("image_type") == "portrait", 0.56), (c("image_type").isin("architecture", "landscape"), 1.04), (c("image_type") == "product_kv", 0.55), otherwise=1.0)
    strength = clip(added * kind * F.when(c("text_density") > 0.006, 0.72).otherwise(1.0), 0.0, 0.115)
    profile = ladder((F.size("found") >= 3, "mixed_degradation"), (F.size("found") > 0, F.element_at("found", 1)), otherwise="none")
    return held.withColumn("degradation_reasons", F.array_join("found", ";")).withColumn("degradation_profile", profile).withColumn("restore_strength", F.when(F.size("found") > 0, half_up(strength, 4)).otherwise(0.0)).drop("found")


def visual_policy(df: DataFrame) -> DataFrame:
    """The report of an analysed image: premium score, mode, issues, hints, actions and labels from its seven values."""
    mid, dirty, high = c("mid_frequency_score"), c("ai_dirty_score"), c("high_frequency_pollution")
    premium = ((1 - dirty) * 0.22 + (1 - high) * 0.18 + mid * 0.18 + (1 - c("highlight_risk")) * 0.14 + (1 - c("color_pollution")) * 0.14 + (1 - c("atmosphere_deficiency") * 0.7) * 0.14) * 100
    mode = ladder(
        ((c("color_pollution") > 0.62) | (dirty > 0.58), "ai_commercial_kv"), ((c("highlight_risk") > 0.58) & (mid < 0.45), "cinematic"), (c("sharpening_risk") > 0.62, "ppt_business"), otherwise="ai_commercial_kv",
    )
    issues = labels(*[(c(k) >= 0.5, name) for k, name in ISSUES], (mid < 0.34, WEAK_MID))
    hints = labels(
        (c("highlight_risk") >= 0.35, "reflective_or_glossy_surface"), (mid < 0.42, "weak_volume_structure"), (c("color_pollution") >= 0.35, "color_unification_needed"),
        (c("atmosphere_deficiency") >= 0.45, "background_depth_needed"), default="generic_commercial_visual",
    )
    return (
        df.withColumn("premium_score", F.bround(F.round(premium, 9), 0).cast("int")).withColumn("recommended_mode", mode).withColumn("issues", F.array_join(issues, ";"))
        .withColumn("material_hints", F.array_join(hints, ";")).withColumn("dirty_label", risk_label(dirty)).withColumn("mid_grade", grade(mid))
    )


#: Token groups that shift a strategy: tokens, and what is added to which strength.
TOKEN_RULES = [
    # Tokens and shifts.
    (("高频污染", "diffusion", "假HDR", "电子锐边", "AI 毛刺"), {"high_frequency_control": 0.18, "sharpen": -0.1, "atmosphere": 0.08, "texture_cleanliness": 0.08}),
    (("中频结构不足", "中频结构偏弱", "材质体积不足", "结构丢失"), {"mid_frequency_restore": 0.22, "sharpen": -0.04, "premium_style": 0.05}),
    (("高光", "假反射", "硬 HDR 光", "爆高光"), {"light_compression": 0.16, "atmosphere": 0.06}),
    # Fixed values end.
]


def strategy(df: DataFrame, rules: DataFrame | str, issues: str = "issues", mode: str = "recommended_mode") -> DataFrame:
    """Adds nine strengths: linear in the scores, then shifted by the tokens found in the issues or the rules' text, then by the mode.

    rules: rule documents with their text, as from sources.rules.read_rules, or one text. They give one flag for each group of tokens.
    """
    groups = [tokens for tokens, _ in TOKEN_RULES]
    in_rules = [any(t in rules for t in g) for g in groups] if isinstance(rules, str) else token_hits(rules, groups)
    dirty, high = c("ai_dirty_score"), c("high_frequency_pollution")
    out = {
        "noise_reduction": 0.28 + dirty * 0.55, "high_frequency_control": 0.25 + high * 0.6, "mid_frequency_restore": 0.24 + (1 - c("mid_frequency_score")) * 0.55,
        "light_compression": 0.22 + c("highlight_risk") * 0.58, "atmosphere": 0.22 + c("atmosphere_deficiency") * 0.58, "color_harmony": 0.2 + c("color_pollution") * 0.62,
        "sharpen": 0.22 - high * 0.12 - c("sharpening_risk") * 0.14, "texture_cleanliness": 0.72 + dirty * 0.2, "premium_style": F.lit(0.82),
    }
    out = {k: clip(v, 0, 1) for k, v in out.items()}
    for (tokens, shift), found in zip(TOKEN_RULES, in_rules, strict=True):
        hit = F.lit(found)
        for t in tokens:
            hit = hit | c(issues).contains(t)
        for k, by in shift.items():
            out[k] = F.when(hit, clip(out[k] + by, 0, 1)).otherwise(out[k])
    business, cinema = c(mode) == "ppt_business", c(mode) == "cinematic"
    out["sharpen"] = F.when(business, F.greatest(out["sharpen"], F.lit(0.16))).when(cinema, clip(out["sharpen"] - 0.08, 0, 1)).otherwise(out["sharpen"])
    out["texture_cleanliness"] = F.when(business, F.greatest(out["texture_cleanliness"], F.lit(0.78))).otherwise(out["texture_cleanliness"])
    for k, by in (("atmosphere", 0.18), ("light_compression", 0.1)):
        out[k] = F.when(cinema, clip(out[k] + by, 0, 1)).otherwise(out[k])
    return df.select("*", *[half_up(v, 4).alias(f"{k}_strength") for k, v in out.items()])
