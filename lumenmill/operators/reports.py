"""Further ladders around a finished image: its kind by scores, what a compression candidate is good for, what went wrong, what a report says."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmill.functions.scalars import clip, fixed2, half_up, ladder

c = F.col


def kind_by_scores(text: Column, edge: Column, line: Column, skin: Column, ink: Column, highlight: Column) -> tuple[Column, Column]:
    """The kind with the largest score, the first of equals, and that score."""
    scores = [
        ("text_poster", clip(text * 36.0 + edge * 1.2 + line * 0.25, 0, 1)), ("architecture", clip(line * 0.75 + edge * 0.8 - skin * 1.2, 0, 1)),
        ("artifact", clip(F.when(highlight > 0.015, highlight * 1.8 + edge * 0.55 - line * 0.35).otherwise(edge * 0.18), 0, 1)), ("portrait_indoor", clip(skin * 3.0 + highlight * 0.25, 0, 1)),
        ("ink_gray", F.when((ink > 0.62) & (text < 0.001), ink).otherwise(0.0)), ("general", F.lit(0.28)),
    ]
    best = F.array_max(F.array(*[F.struct(v.alias("score"), F.lit(-i).alias("rank"), F.lit(name).alias("name")) for i, (name, v) in enumerate(scores)]))
    return best["name"], half_up(clip(best["score"], 0, 1), 4)


# Strengths of the fidelity modes, and what image kinds add to them.
BASE = {"repair": 0.22, "text": 0.34, "edge": 0.24, "structure": 0.24, "post_edge": 0.12, "highlight": 0.88}
BY_MODE = {
    "text_safe": {"repair": 0.18, "text": 0.56, "edge": 0.20, "structure": 0.20, "post_edge": 0.10},
    "ai_image_clean": {"repair": 0.36, "text": 0.30, "edge": 0.17, "structure": 0.20, "post_edge": 0.08, "highlight": 0.92},
    "sharp_4k": {"repair": 0.23, "text": 0.38, "edge": 0.34, "structure": 0.34, "post_edge": 0.18},
}
BY_KIND = {
    "text_poster": {"text": 0.18, "edge": -0.04}, "architecture": {"edge": 0.12, "structure": 0.14}, "artifact": {"highlight": 0.08, "structure": 0.10, "edge": -0.04},
    "portrait_indoor": {"edge": -0.10, "structure": -0.08, "highlight": 0.08}, "ink_gray": {"repair": -0.08, "edge": -0.12, "structure": -0.10, "post_edge": -0.06},
}
# Fixed values end.


def mode_strengths(mode: Column, kind: Column) -> dict[str, Column]:
    """Six strengths from two tables: the mode's value or the base, plus what the kind adds, within 0 and 0.72 (highlight: 1)."""
    out = {}
    for name, base in BASE.items():
        value, extra = F.lit(base), F.lit(0.0)
        for m, table in BY_MODE.items():
            value = F.when(mode == m, table.get(name, base)).otherwise(value)
        for k, table in BY_KIND.items():
            extra = F.when(kind == k, table.get(name, 0.0)).otherwise(extra)
        out[name] = half_up(clip(value + extra, 0, 1.0 if name == "highlight" else 0.72), 4)
    return out


def candidate_verdict(kind: Column, method: Column, saved: Column, psnr: Column, alpha_kept: Column) -> Column:
    """(verdict, scope, risk) of a compression candidate."""
    say = lambda verdict, scope, risk: F.struct(F.lit(verdict).alias("verdict"), F.lit(scope).alias("scope"), F.lit(risk).alias("risk"))
    lossy, product = method.isin("jpg_q90", "webp_q90"), kind.isin("product_ad", "commercial_png")
    return ladder(
        ((kind == "contact_sheet_preview") & method.isin("jpg_q90", "jpg_q92", "webp_q90", "webp_q94"), say("candidate", "preview_only", "low")), (kind == "contact_sheet_preview", say("manual_review", "preview_only", "medium")),
        ((kind == "transparent_png") & (method == "png_optimize") & alpha_kept, say("candidate", "transparent_png_lossless", "low")),
        ((kind == "transparent_png") & method.isin("webp_q90_alpha", "webp_q94_alpha"), say("experiment_only", "webp_alpha_experiment", "medium")), (kind == "transparent_png", say("reject", "do_not_use", "high")),
        ((kind == "text_ppt_logo") & (method == "png_optimize") & (psnr >= 48), say("candidate", "text_logo_conservative", "low")),
        ((kind == "text_ppt_logo") & method.isin("jpg_q95", "webp_q94"), say("manual_review", "text_logo_manual_only", "medium")), (kind == "text_ppt_logo", say("reject", "do_not_use", "high")),
        (product & (method == "jpg_q95") & (saved > 0.15), say("candidate", "final_product_ad_candidate", "medium")), (product & method.isin("jpg_q92", "webp_q94") & (saved > 0.2), say("manual_review", "final_experiment_only", "medium")),
        (product & (method == "png_optimize"), say("manual_review", "lossless_png_fallback", "low")), (product & lossy, say("reject", "do_not_use", "high")), (product, say("reject", "do_not_use", "medium")),
        ((kind == "ordinary_non_alpha") & method.isin("webp_q90", "webp_q94") & (saved > 0.2), say("experiment_only", "ordinary_webp_experiment", "medium")),
        ((kind == "ordinary_non_alpha") & (saved <= 0), say("reject", "do_not_use", "low")), otherwise=say("manual_review", "manual_qa", "medium"),
    )


def problem(input_exists: Column, n_inputs: Column, can_write: Column, tool: Column, models: Column, reason: Column, status: Column, skipped: Column) -> Column:
    """The first problem of a run that holds."""
    return ladder(
        (~input_exists, "BLOCKED_INPUT_DIR_MISSING"), ((n_inputs <= 0) | (reason == "missing_input_images"), "BLOCKED_INPUT_EMPTY"), (~can_write, "BLOCKED_OUTPUT_PERMISSION"),
        (~tool, "BLOCKED_TOOL_MISSING"), (~models, "BLOCKED_MODEL_MISSING"), (status == "BLOCKED", "FAILED_MODEL_RUN"), (skipped > 0, "PASS_WITH_NOTES"), otherwise="PASS",
    )


def screen_size(df: DataFrame) -> DataFrame:
    """Adds screen_width, screen_height and screen_rule: large images come down to a short edge of 1080, none grows, odd shapes have no size."""
    ratio, short = c("width") / F.greatest(c("height"), F.lit(1)), F.least("width", "height")
    rule = ladder(((c("width") <= 0) | (c("height") <= 0), "invalid_dimensions"), ((ratio < 0.45) | (ratio > 2.4), "aspect_ratio_not_supported"), (short <= 1080, "source_not_upscaled"), otherwise="short_edge_1080")
    size = lambda v: F.when(c("screen_rule") == "source_not_upscaled", c(v)).when(c("screen_rule") == "short_edge_1080", F.greatest(F.lit(1), F.bround(c(v) * (1080.0 / short), 0).cast("int")))
    return df.withColumn("screen_rule", rule).withColumn("screen_width", size("width")).withColumn("screen_height", size("height"))


def fidelity(color: Column, noise_change: Column, clarity_gain: Column, text_gain: Column, edge_gain: Column, structure_gain: Column) -> tuple[Column, Column]:
    """The fidelity score of a before/after pair, and whether its gain is only apparent."""
    gained = (clarity_gain > 2) | (text_gain > 3) | (edge_gain > 3) | (structure_gain > 2)
    score = 0.35 * color + 0.22 * F.greatest(F.lit(0.0), 100 - F.greatest(noise_change, F.lit(0.0))) + 0.23 * clip(50 + edge_gain, 0, 100) + 0.20 * clip(50 + text_gain, 0, 100)
    return half_up(clip(score, 0, 100), 2), ~(gained & (noise_change <= 8) & (color >= 82))


# What a report says for the good and for the kind of review, and how a result should be used.
SIGNALS = ("清晰度基础较好", "文字清晰度通过", "边缘质量通过", "材质保持通过", "默认保真色彩稳定", "存在可见收益信号")
NO_SIGNAL = "当前更偏保护型输出，建议查看局部后判断收益。"
REVIEWS = {
    "fail": "不可交付复核", "color": "颜色与品牌保护复核", "text": "文字与 Logo 保护复核", "benefit": "低收益复核", "smooth": "低频平滑区复核",
    "safety": "安全保护复核", "routine": "常规交付确认",
}
USAGES = {
    "PASS": "可用于 1080P 本地交付，正式使用前建议快速查看成品。",
    "PASS_WITH_LIMITATION": "已生成本地预览，建议查看文字、Logo、边缘、品牌色和关键局部后使用。",
    "FAIL": "不建议作为正式成品使用，请回到原图或调整输入后重新处理。",
    "WAITING": "等待任务完成后再判断用途。",
}
SHOWN_LABELS = {"FAIL": "不建议交付", "PASS_WITH_LIMITATION": "已生成｜建议查看后使用", "PASS": "可交付", "WAITING": "等待判定"}
# Fixed values end.


def by_status(status: Column, values: dict[str, str]) -> Column:
    """The value of a shown status; any other status waits."""
    return ladder(*[(status == k, v) for k, v in values.items() if k != "WAITING"], otherwise=values["WAITING"])


def suggested_usage(status: Column, raw: Column) -> Column:
    """The usage that came with a result, else the one that its status stands for."""
    return F.when(raw.isNotNull() & (raw != ""), raw).otherwise(by_status(status, USAGES))


def positive_signals(clarity: Column, text: Column, edge: Column, texture: Column, color: Column, benefit: Column) -> Column:
    pairs = zip((clarity, text, edge, texture, color, benefit), (70, 60, 65, 60, 95, 2), SIGNALS, strict=True)
    found = F.array_compact(F.array(*[F.when(v >= least, F.concat(F.lit(f"{name}："), fixed2(v))) for v, least, name in pairs]))
    return F.when(F.size(found) == 0, F.array(F.lit(NO_SIGNAL))).otherwise(found)


def review_type(status: Column, tags: Column) -> Column:
    joined = F.array_join(tags, " ")
    has = lambda *words: reduce(or_, [joined.contains(w) for w in words])
    return ladder(
        (status == "FAIL", REVIEWS["fail"]), (has("颜色", "品牌色"), REVIEWS["color"]), (has("文字"), REVIEWS["text"]), (has("体积", "收益"), REVIEWS["benefit"]),
        (has("平滑"), REVIEWS["smooth"]), (status == "PASS_WITH_LIMITATION", REVIEWS["safety"]), otherwise=REVIEWS["routine"],
    )
