"""Plans and advice by row: next actions and strengths, output plans, what may be enhanced, usage texts, boxes, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenmill.functions.scalars import clip, half_up, labels, ladder
from lumenmill.operators import policies

c = F.col

# The actions by score and limit, the strengths (name, score, base, weight), profiles, formats, tokens of names, and the usage texts.
ACTION_DIRTY = "优先抑制 diffusion 纹理、AI颗粒和高频脏纹理"
ACTION_MID = "恢复中频商业结构，保护体积、材质层次和主体筋骨"
ACTION_LIGHT = "压缩高光并平滑光影过渡，减少假HDR和数码高光"
ACTION_COLOR = "统一色彩关系，控制 AI 蓝、AI 橙和 HDR 彩色污染"
ACTION_AIR = "降低全画面同等清晰感，建立主体与背景的空气层次"
ACTION_NONE = "保持克制增强，避免破坏当前商业质感"
STRENGTHS = [
    ("noise_reduction_strength", "ai_dirty_score", 0.28, 0.55), ("high_frequency_control_strength", "high_frequency_pollution", 0.25, 0.6), ("light_compression_strength", "highlight_risk", 0.22, 0.58),
    ("atmosphere_strength", "atmosphere_deficiency", 0.22, 0.58), ("color_harmony_strength", "color_pollution", 0.2, 0.62),
]
OUTPUT_PROFILES, DEFAULT_PROFILE = ("delivery_1080p", "preview_light", "fidelity_original"), "delivery_1080p"
OUTPUT_FORMATS, DEFAULT_FORMAT = ("auto", "png", "jpg", "webp"), "auto"
COMMERCIAL_TOKENS = ("指南", "清单", "服务", "护肤", "地图", "广告", "产品", "包装", "海报")
PORTRAIT_TOKENS = ("人像", "头像", "面部", "写真", "证件照")
LOW_BENEFIT = "低收益提示"
USAGE_FAIL = "当前不建议直接用于正式交付。建议回到原图检查文字、Logo、边缘和低频区域后再决定是否重新处理。"
USAGE_LOW = "原图质量或保护约束较强，增强收益有限。建议对比原图和输出图后决定是否使用输出图。"
USAGE_BY_KIND = [
    ("文字|海报|信息|poster|text|infographic", "适合公众号配图、PPT 内容页和客户方案配图；正式使用前建议查看标题、小字、细线、标签文字和白底洁净度。"),
    ("产品|品牌|KV|product|brand", "适合产品视觉提案、品牌 KV 预览和 PPT 封面；正式使用前建议查看 Logo、包装文字、品牌色、高光和产品轮廓。"),
    ("人物|照片|portrait|person|photo", "适合内部预览、资料整理和商业视觉初稿；正式使用前建议查看人脸、手部、肤色、现场文字和 Logo。"),
    ("建筑|空间|文旅|architecture|building", "适合 PPT 封面、文旅海报和视觉提案；正式使用前建议查看小字、建筑边缘、墙面暗部和复杂纹理。"),
]
USAGE_OTHER = "适合本地预览、PPT 草案和方案初稿；正式使用前建议查看文字、Logo、主体边缘、颜色和低频平滑区域。"
# Fixed values end.


def next_actions() -> Column:
    """What to do next for an analysed image, in order; one default if nothing stands out."""
    return labels(
        (c("ai_dirty_score") >= 0.34, ACTION_DIRTY), (c("mid_frequency_score") < 0.5, ACTION_MID), (c("highlight_risk") >= 0.34, ACTION_LIGHT),
        (c("color_pollution") >= 0.34, ACTION_COLOR), (c("atmosphere_deficiency") >= 0.45, ACTION_AIR), default=ACTION_NONE,
    )


def suggested_strengths() -> list[Column]:
    """Six strengths from 0 to 1, each linear in one score; weak middle frequencies ask for more of theirs."""
    linear = [half_up(clip(base + c(score) * weight, 0.0, 1.0), 4).alias(name) for name, score, base, weight in STRENGTHS]
    return [*linear, half_up(clip(0.24 + (1 - c("mid_frequency_score")) * 0.55, 0.0, 1.0), 4).alias("mid_frequency_restore_strength")]


def output_profile(asked: Column) -> Column:
    found = F.lower(F.trim(asked))
    return F.when(found.isin(*OUTPUT_PROFILES), found).otherwise(DEFAULT_PROFILE)


def output_format(asked: Column) -> Column:
    found = F.regexp_replace(F.lower(F.trim(asked)), r"^\.+", "")
    found = F.when(found == "jpeg", "jpg").otherwise(found)
    return F.when(found.isin(*OUTPUT_FORMATS), found).otherwise(DEFAULT_FORMAT)


def output_plan(rows: DataFrame) -> DataFrame:
    """Rows with the plan of their output: profile and format as selected, target size, aspect and resize policy.

    Reads width, height, has_real_alpha, output_profile and requested_format as they were asked for; unknown or null ones have the defaults.
    """
    asked = rows.withColumn("output_profile", output_profile(c("output_profile"))).withColumn("requested_format", output_format(c("requested_format")))
    return policies.target_size(asked).withColumn("selected_output_profile", c("output_profile")).withColumn("selected_output_format", policies.choose_format())


def long_edge_size(width: Column, height: Column, long_edge: int = 1920) -> tuple[Column, Column]:
    """The older target: 1920 x 1080 for 16:9 and for sizes that are none, else the longer edge at long_edge."""
    full = (width <= 0) | (height <= 0) | (F.abs(width / F.greatest(height, F.lit(1)) - 16 / 9) <= 0.025)
    scale = F.lit(float(long_edge)) / F.greatest(width, height, F.lit(1))
    sized = lambda edge, whole: F.when(full, whole).otherwise(F.greatest(F.lit(1), F.bround(edge * scale, 0).cast("int")))
    return sized(width, 1920), sized(height, 1080)


def _any_of(text: Column, tokens: tuple[str, ...]) -> Column:
    return text.rlike("|".join(tokens))


def enhance_scope(name: Column) -> Column:
    """Whether an image is a commercial one to enhance, a portrait to skip, or uncertain, as 'scope|reason'. Names decide first, then ratios."""
    text, edge, vivid, light, skin = (c(k) for k in ("text_ratio", "edge_ratio", "high_sat_ratio", "light_bg_ratio", "skin_ratio"))
    return ladder(
        (_any_of(name, PORTRAIT_TOKENS), "portrait|skip_portrait_name"), (_any_of(name, COMMERCIAL_TOKENS), "commercial_non_portrait|commercial_name"),
        ((text > 0.08) & (edge > 0.035), "commercial_non_portrait|strong_text_commercial_metrics"), ((text > 0.018) & (light > 0.35), "commercial_non_portrait|info_poster_metrics"),
        ((edge > 0.08) & (light > 0.20), "commercial_non_portrait|city_or_map_metrics"), ((vivid > 0.08) & (edge > 0.045), "commercial_non_portrait|product_metrics"),
        ((skin > 0.035) & (skin < 0.70) & (edge < 0.075) & (light < 0.70), "portrait|skip_portrait_metrics"), otherwise="uncertain|skip_uncertain",
    )


def usage_by_kind(own: Column, status: Column, benefit: Column, kind: Column) -> Column:
    """The usage that a report recommends: its own if it has one, else by status, benefit and kind of image."""
    kinds = [(kind.rlike(f"(?i){pattern}"), usage) for pattern, usage in USAGE_BY_KIND]
    return ladder((F.trim(own) != "", own), (status == "FAIL", USAGE_FAIL), (benefit == LOW_BENEFIT, USAGE_LOW), *kinds, otherwise=USAGE_OTHER)


def clamped_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """A box moved inside an image, as left, top, right and bottom; a box larger than the image is cut."""
    left, top = (F.greatest(F.lit(0), F.least(at, F.greatest(F.lit(0), all_ - size))) for at, size, all_ in ((x, w, width), (y, h, height)))
    return left, top, F.least(width, left + w), F.least(height, top + h)


def scaled_box(box: tuple[Column, ...], original: tuple[Column, Column], target: tuple[Column, Column]) -> tuple[Column, ...]:
    """A box (left, top, right, bottom, none below 0) in another size of its image; it keeps a pixel in each direction."""
    by = [t / F.greatest(F.lit(1), o) for o, t in zip(original, target, strict=True)]
    left, top, right, bottom = (F.floor(at * by[i % 2]).cast("int") for i, at in enumerate(box))
    return left, top, F.greatest(right, left + 1), F.greatest(bottom, top + 1)


def report_rows(processed: DataFrame, skipped: DataFrame) -> DataFrame:
    """Processed and skipped rows as one report; columns that one of them lacks are null there."""
    return processed.withColumn("state", F.lit("processed")).unionByName(skipped.withColumn("state", F.lit("skipped")), allowMissingColumns=True)


def rows_by_file(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The values of each file's rows, sorted. A file has as many as there are methods, so the lists are short."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias("values"), F.count("*").alias("n"))


def first_present(*values: Column) -> Column:
    """The first value that is neither null nor an empty text."""
    return F.coalesce(*[F.when(v.cast("string") != "", v) for v in values])


def int_or_null(value: Column) -> Column:
    """A text as a whole number, or null if it is none or does not fit 64 bits."""
    return F.when(value.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(value).try_cast("long"))


def metric_deltas(before: DataFrame, after: DataFrame, key: str, *fields: str) -> DataFrame:
    """What samples of both runs have more in the second, by field."""
    new = after.select(key, *[c(f).alias(f"{f}_after") for f in fields])
    return before.join(new, key).select(key, *[F.round(c(f"{f}_after") - c(f), 4).alias(f"{f}_delta") for f in fields])
