"""Quality gates and the delivery decision, as conjunctions and ladders over the metrics of an image."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmill.functions.scalars import half_up, labels, ladder
from lumenmill.operators.policies import TEXT_TYPES

c = F.col


def visual_level() -> Column:
    """failed, acceptable, standard or excellent."""
    texty = (c("text_density") >= 0.015) | c("image_type").isin(*TEXT_TYPES)
    portrait, mixed = c("image_type") == "portrait", c("image_type") == "mixed"
    floor = F.when(c("image_type").isin(*TEXT_TYPES), -2.0).otherwise(-1.2)
    unless = lambda when, then: ~when | then
    passed = (c("color_fidelity_score") >= 91) & (c("detail_stability_score") >= 64) & (c("clarity_score") >= 15) & (c("clarity_gain") >= -0.25) & (c("edge_quality_gain") >= -0.25)
    for risk in ("artifact_risk", "pseudo_hd_risk", "over_smoothing_risk", "texture_loss_risk"):
        passed = passed & (c(risk) != "high")
    passed = passed & unless(texty, (c("text_clarity_score") >= 24) & (c("text_clarity_gain") >= floor))
    passed = passed & unless(portrait, (c("face_detail_gain") >= -0.4) & (c("hair_texture_gain") >= -0.4)) & unless(mixed, (c("fabric_texture_gain") >= -0.35) & (c("hair_texture_gain") >= -0.35))
    standard = (c("color_fidelity_score") >= 94) & (c("detail_stability_score") >= 78) & (c("edge_quality_gain") >= 0) & (c("clarity_gain") >= 0)
    for risk in ("pseudo_hd_risk", "over_smoothing_risk", "texture_loss_risk"):
        standard = standard & (c(risk) == "low")
    standard = standard & unless(texty, (c("text_clarity_gain") >= 0) & (c("small_text_readability_score") >= 26))
    standard = standard & unless(portrait, (c("face_detail_gain") >= 0) & (c("hair_texture_gain") >= 0)) & unless(mixed, c("fabric_texture_gain") >= 0)
    excellent = (c("visual_score") >= 74) & (c("text_clarity_gain") >= 0.6) & (c("edge_quality_gain") >= 0.6) & (c("detail_stability_score") >= 86) & (c("color_fidelity_score") >= 96)
    return ladder((~passed, "failed"), (standard & excellent, "excellent"), (standard, "standard"), otherwise="acceptable")


def compression_gate(df: DataFrame) -> DataFrame:
    """Adds compression_allowed, quality_drop and the reasons against a smaller candidate."""
    preview, texty = c("output_profile") == "preview_light", c("text_density") >= 0.035
    limit = lambda light, strict, text: F.when(preview, light).otherwise(strict) + F.when(texty, text).otherwise(0.0)
    primitive = (c("pixel_diff") <= limit(1.9, 1.05, -0.18)) & (c("color_delta") <= limit(1.65, 1.0, -0.12)) & (c("edge_ratio") >= limit(0.9, 0.965, 0.025))
    kind = c("image_type")
    floors = {
        "text_clarity_gain": F.lit(-0.05), "edge_quality_gain": F.lit(-0.05), "face_detail_gain": F.when(kind == "portrait", -0.15).otherwise(-0.35),
        "hair_texture_gain": F.when(kind.isin("portrait", "mixed"), -0.12).otherwise(-0.28), "fabric_texture_gain": F.when(kind == "mixed", -0.12).otherwise(-0.28), "dark_detail_gain": F.lit(-0.25),
    }
    risks = ("over_smoothing_risk", "texture_loss_risk", "pseudo_hd_risk")
    reasons = labels(*[(c(k) < f, k) for k, f in floors.items()], *[(c(k) != "low", k) for k in risks], (~primitive, "primitive_gate_failed"))
    drop = F.greatest(F.lit(0.0), c("color_delta") + F.greatest(F.lit(0.0), 1.0 - c("edge_ratio")) * 4.0)
    return df.withColumn("gate_reasons", F.array_join(reasons, ";")).withColumn("compression_allowed", F.size(reasons) == 0).withColumn("quality_drop", F.round(drop, 6))


def delivery_guard(df: DataFrame, passed: Column) -> DataFrame:
    """Adds visible_benefit, size_fallback_reason, delivery_status, delivery_reason, delivery_risk and recommended_usage."""
    gain = lambda k: F.greatest(F.lit(0.0), F.coalesce(c(k), F.lit(0.0)))
    bonus = lambda k, low, span: F.greatest(F.lit(0.0), (c(k) - low) / span)
    benefit = gain("clarity_gain") * 0.32 + gain("text_clarity_gain") * 0.18 + gain("edge_quality_gain") * 0.24 + bonus("detail_stability_score", 78.0, 12.0) * 0.16 + bonus("color_fidelity_score", 94.0, 8.0) * 0.10
    held = df.withColumn("visible_benefit", half_up(benefit, 6)).withColumn("passed", passed)
    fallback = ladder(
        ((c("size_growth") > 8.0) & (c("visible_benefit") < 0.35), "large_size_low_visible_benefit"), ((c("size_growth") > 14.0) & (c("visible_benefit") < 0.85), "very_large_size_limited_benefit"), otherwise="",
    )
    held = held.withColumn("size_fallback_reason", fallback)
    reason = ladder(
        (~c("passed"), "quality_1080p_gate_not_fully_passed"), (c("smooth_region_fallback"), "smooth_region_guard"), (c("size_fallback_reason") != "", c("size_fallback_reason")), otherwise="delivery_guard_pass",
    )
    fine = c("delivery_reason") == "delivery_guard_pass"
    usage = ladder(
        (c("image_type").isin(*TEXT_TYPES) & ~c("passed"), "manual_review_required"), (c("size_growth") > 8.0, "screen_1080p;web_delivery;manual_review_required"), otherwise="screen_1080p;ppt_delivery;web_delivery",
    )
    held = held.withColumn("delivery_reason", reason).withColumn("recommended_usage", usage)
    return held.withColumn("delivery_status", F.when(fine, "PASS").otherwise("PASS_WITH_LIMITATION")).withColumn("delivery_risk", F.when(fine, "low").otherwise("medium")).drop("passed")


# What marks a delivery as limited wherever it stands in its texts.
LIMITED = (
    "PASS_WITH_LIMITATION", "manual_review", "quality_1080p_gate_not_fully_passed", "smooth_region_guard", "very_large_size_limited_benefit", "limited_benefit", "size_guard",
    "quality_gate_not_fully_passed",
)
# Fixed values end.


def shown_status(status: Column, texts: list[Column], text_score: Column, texture_score: Column, edge_score: Column) -> Column:
    """What a report shows: FAIL, PASS_WITH_LIMITATION, PASS or WAITING. A null score is one that is missing and says nothing."""
    joined = F.concat_ws(" ", *texts)
    limited = F.upper(status) == "PASS_WITH_LIMITATION"
    for t in LIMITED:
        limited = limited | joined.contains(t)
    low = F.coalesce(text_score < 60, F.lit(False)) | F.coalesce(texture_score < 60, F.lit(False)) | F.coalesce(edge_score < 65, F.lit(False))
    return ladder((F.upper(status).isin("FAIL", "REJECT"), "FAIL"), (F.coalesce(limited, F.lit(False)) | low, "PASS_WITH_LIMITATION"), (F.upper(status) == "PASS", "PASS"), otherwise="WAITING")


# The labels that a report shows.
NOT_RECOMMENDED, LOW_BENEFIT, MANUAL_REVIEW, CLEAR_GAIN, SLIGHT_GAIN, PROTECTED = "不建议通过", "低收益提示", "建议人工复核", "明显提升", "轻微提升", "保护通过"
TEXT_LOW, TEXTURE_WEAK, EDGE_REVIEW, SIZE_BENEFIT_LOW, SIZE_GROWTH_HIGH = "文字清晰度偏低", "材质收益偏弱", "边缘质量需复核", "体积收益比偏低", "文件体积增长明显"
GATE_NOT_PASSED, SMOOTH_PROTECTED, BENEFIT_LIMITED, COLOR_REVIEW, NO_REASON = "1080P 质量门未完全通过", "平滑区域保护触发", "可见收益有限", "颜色 / 品牌色需确认", "暂无明确复核风险"
KIND_LABELS = {
    "alpha": "透明 PNG", "text": "中文文字 / 海报", "product": "产品 / 品牌 KV", "portrait": "人物 / 商业照片", "architecture": "建筑 / 空间",
    "gradient": "合成渐变 / 高光", "landscape": "风景 / 场景", "other": "普通图像",
}
# Fixed values end.


def kind_tag(kind: Column, has_alpha: Column) -> Column:
    """The label of an image's kind, by words in its name; alpha goes first."""
    low = F.lower(F.coalesce(kind, F.lit("unknown")))
    has = lambda *words: reduce(or_, [low.contains(w) for w in words])
    return ladder(
        (has_alpha, KIND_LABELS["alpha"]), (has("text"), KIND_LABELS["text"]), (has("product", "kv"), KIND_LABELS["product"]), (has("portrait", "person", "face"), KIND_LABELS["portrait"]),
        (has("architecture", "building"), KIND_LABELS["architecture"]), (has("gradient", "synthetic"), KIND_LABELS["gradient"]), (has("landscape"), KIND_LABELS["landscape"]), otherwise=KIND_LABELS["other"],
    )


def benefit_tag(status: Column, growth: Column, benefit: Column, clarity: Column, texture: Column) -> Column:
    yes = lambda x: F.coalesce(x, F.lit(False))
    return ladder(
        (status == "FAIL", NOT_RECOMMENDED),
        ((status == "PASS_WITH_LIMITATION") & yes(growth > 10) & (benefit.isNull() | (benefit < 3)), LOW_BENEFIT), (status == "PASS_WITH_LIMITATION", MANUAL_REVIEW),
        (yes(benefit >= 4) | yes((clarity >= 85) & (texture >= 60)), CLEAR_GAIN), (yes(benefit >= 2) | yes(clarity >= 70), SLIGHT_GAIN), otherwise=PROTECTED,
    )


def review_tags(text_score: Column, texture_score: Column, edge_score: Column, growth: Column, benefit: Column, text: Column, color_score: Column) -> Column:
    bulky = (growth > 10) & (benefit < 3)
    return labels(
        (text_score < 60, TEXT_LOW), (texture_score < 60, TEXTURE_WEAK), (edge_score < 65, EDGE_REVIEW), (bulky, SIZE_BENEFIT_LOW),
        (~F.coalesce(bulky, F.lit(False)) & (growth > 30), SIZE_GROWTH_HIGH), (text.contains("quality_1080p_gate_not_fully_passed") | text.contains("quality_gate_not_fully_passed"), GATE_NOT_PASSED),
        (text.contains("smooth_region_guard"), SMOOTH_PROTECTED), (text.contains("limited_benefit"), BENEFIT_LIMITED), (color_score < 95, COLOR_REVIEW), default=NO_REASON,
    )
