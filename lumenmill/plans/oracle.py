"""DuckDB SQL for the queries: written apart from the operators, on the same views."""

from __future__ import annotations

import math

from lumenmill.sources import fixtures as fx

PX = """e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
p AS (SELECT vec_id // 16 AS image_id, ((vec_id % 16) // 4) * 8 + (i // 8) AS y, ((vec_id % 16) % 4) * 8 + (i % 8) AS x,
      CAST(LEAST(255, GREATEST(0, FLOOR(128 + 256 * CAST(v AS DOUBLE) + 0.5))) AS INT) AS l FROM e),
ok AS (SELECT image_id FROM p GROUP BY image_id HAVING COUNT(*) = 1024),
px AS (SELECT p.* FROM p JOIN ok USING (image_id))"""
PX3 = PX + """, px3 AS (SELECT b.image_id // 3 AS image_id, b.y, b.x, b.l AS b, g.l AS g, r.l AS r FROM px b
  JOIN px g ON g.image_id = b.image_id + 1 AND g.y = b.y AND g.x = b.x JOIN px r ON r.image_id = b.image_id + 2 AND r.y = b.y AND r.x = b.x WHERE b.image_id % 3 = 0)"""


def _at(t: str) -> str:
    """The pixel that stands at t beyond the border."""
    return f"abs(31 - abs(31 - ({t})))"


AROUND = {"up": (-1, 0), "down": (1, 0), "lf": (0, -1), "rt": (0, 1), "ul": (-1, -1), "ur": (-1, 1), "dl": (1, -1), "dr": (1, 1)}
NB = (
    PX + ", nb AS (SELECT c.image_id, c.y, c.x, c.l, " + ", ".join(f"{n}.l AS {n}" for n in AROUND) + " FROM px c "
    + " ".join(f"JOIN px {n} ON {n}.image_id = c.image_id AND {n}.y = {_at(f'c.y + ({dy})')} AND {n}.x = {_at(f'c.x + ({dx})')}" for n, (dy, dx) in AROUND.items())
    + """), lap AS (SELECT *, CAST(up + down + lf + rt - 4 * l AS DOUBLE) AS lap,
        sqrt(CAST((ur + 2 * rt + dr - ul - 2 * lf - dl) ** 2 + (dl + 2 * down + dr - ul - 2 * up - ur) ** 2 AS DOUBLE)) AS grad FROM nb)"""
)


def _box(radius: int) -> str:
    return f""", bx AS (SELECT c.image_id, c.y, c.x, c.l, sum(n.l) AS total, max(n.l) AS hi, min(n.l) AS lo FROM px c, range(-{radius}, {radius + 1}) dy(j), range(-{radius}, {radius + 1}) dx(k)
      JOIN px n ON n.image_id = c.image_id AND n.y = {_at("c.y + j")} AND n.x = {_at("c.x + k")} GROUP BY ALL)"""


def _clip(v: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"GREATEST(CAST({low} AS DOUBLE), LEAST(CAST({high} AS DOUBLE), {v}))"


def _norm(v: str, low: float, high: float) -> str:
    return _clip(f"(({v}) - {low}) / CAST({high - low} AS DOUBLE)")


def _hsv(b: str, g: str, r: str, tag: str = "") -> str:
    v, low = f"GREATEST({b}, {g}, {r})", f"LEAST({b}, {g}, {r})"
    d = f"CAST({v} - {low} AS DOUBLE)"
    turn = f"CASE WHEN {d} = 0 THEN 0.0 WHEN {v} = {r} THEN 60.0 * ({g} - {b}) / {d} WHEN {v} = {g} THEN 120.0 + 60.0 * ({b} - {r}) / {d} ELSE 240.0 + 60.0 * ({r} - {g}) / {d} END"
    full = f"FLOOR(CAST((CASE WHEN ({turn}) < 0 THEN ({turn}) + 360.0 ELSE ({turn}) END) AS DOUBLE) / 2 + 0.5)"
    return f"CASE WHEN {full} >= 180 THEN {full} - 180 ELSE {full} END AS h{tag}, CASE WHEN {v} = 0 THEN 0.0 ELSE FLOOR(255.0 * {d} / {v} + 0.5) END AS s{tag}, CAST({v} AS DOUBLE) AS v{tag}"


def _lab(b: str, g: str, r: str, tag: str) -> str:
    straight = lambda c: f"(CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / CAST(12.92 AS DOUBLE) ELSE pow((CAST({c} AS DOUBLE) / 255.0 + 0.055) / 1.055, 2.4) END)"
    mix = lambda kr, kg, kb, n: f"((CAST({kr} AS DOUBLE) * {straight(r)} + CAST({kg} AS DOUBLE) * {straight(g)} + CAST({kb} AS DOUBLE) * {straight(b)}) / CAST({n} AS DOUBLE))"
    x, y, z = mix(0.412453, 0.357580, 0.180423, 0.950456), mix(0.212671, 0.715160, 0.072169, 1), mix(0.019334, 0.119193, 0.950227, 1.088754)
    third = "CAST(1 AS DOUBLE) / 3"
    root = lambda t: f"(CASE WHEN {t} > 0.008856 THEN pow({t}, {third}) ELSE CAST(7.787 AS DOUBLE) * {t} + CAST(16 AS DOUBLE) / 116 END)"
    byte = lambda v: f"GREATEST(0.0, LEAST(255.0, FLOOR({v} + 0.5)))"
    light = f"(CASE WHEN {y} > 0.008856 THEN 116 * pow({y}, {third}) - 16 ELSE CAST(903.3 AS DOUBLE) * {y} END)"
    return f"{byte(f'{light} * 255 / 100')} AS l{tag}, {byte(f'500 * ({root(x)} - {root(y)}) + 128')} AS a{tag}, {byte(f'200 * ({root(y)} - {root(z)}) + 128')} AS bb{tag}"


def _blur(sigma: float, src: str, out: str, value: str = "l") -> str:
    """CTEs: out has value blurred as v; weights from the formula, normalised."""
    r = math.ceil(3 * sigma)
    return f""", w_{out} AS (SELECT k, exp(-k * k / CAST({2 * sigma * sigma} AS DOUBLE)) / sum(exp(-k * k / CAST({2 * sigma * sigma} AS DOUBLE))) OVER () AS w FROM range(-{r}, {r + 1}) t(k)),
      x_{out} AS (SELECT c.image_id, c.y, c.x, sum(n.{value} * w) AS v FROM {src} c, w_{out} JOIN {src} n ON n.image_id = c.image_id AND n.y = c.y AND n.x = {_at("c.x + k")} GROUP BY ALL),
      {out} AS (SELECT c.image_id, c.y, c.x, sum(n.v * w) AS v FROM x_{out} c, w_{out} JOIN x_{out} n ON n.image_id = c.image_id AND n.x = c.x AND n.y = {_at("c.y + k")} GROUP BY ALL)"""


def _grad(src: str, out: str) -> str:
    """CTE: the Sobel size of column v."""
    s = "+ ".join(f"CASE WHEN j = {dy} AND k = {dx} THEN {w} * n.v ELSE 0 END" for (dy, dx), w in {(-1, 1): 1, (0, 1): 2, (1, 1): 1, (-1, -1): -1, (0, -1): -2, (1, -1): -1}.items())
    t = "+ ".join(f"CASE WHEN j = {dy} AND k = {dx} THEN {w} * n.v ELSE 0 END" for (dy, dx), w in {(1, -1): 1, (1, 0): 2, (1, 1): 1, (-1, -1): -1, (-1, 0): -2, (-1, 1): -1}.items())
    return f""", {out} AS (SELECT c.image_id, c.y, c.x, any_value(c.v) AS v, sqrt(sum({s}) ** 2 + sum({t}) ** 2) AS g FROM {src} c, range(-1, 2) a(j), range(-1, 2) b(k)
      JOIN {src} n ON n.image_id = c.image_id AND n.y = {_at("c.y + j")} AND n.x = {_at("c.x + k")} GROUP BY c.image_id, c.y, c.x)"""


def _byte(v: str) -> str:
    return f"CAST(GREATEST(0, LEAST(255, FLOOR({v} + 0.5))) AS INT)"


def _taps(name: str, target: int) -> str:
    at = f"((dst + 0.5) * CAST(32 AS DOUBLE) / {target} - 0.5)"
    return f"""{name} AS (SELECT LEAST(31, GREATEST(0, CAST(floor({at}) AS INT) + o)) AS src, dst, CASE WHEN abs({at} - floor({at}) - o) <= 1 THEN (1.25 * abs({at} - floor({at}) - o) - 2.25) * pow(abs({at} - floor({at}) - o), 2) + 1
      ELSE (((abs({at} - floor({at}) - o) - 5) * abs({at} - floor({at}) - o) + 8) * abs({at} - floor({at}) - o) - 4) * -0.75 END AS w FROM range({target}) a(dst), range(-1, 3) b(o))"""


F_ = "f AS (SELECT " + ", ".join(fx.FEATURES) + " FROM lineitem)"
K = "l_orderkey, l_linenumber"
TEXTY = "image_type IN ('text_poster', 'ppt_page')"
STAGES = "st AS (SELECT " + ", ".join(fx.STAGES) + " FROM events)"
BEFORE, AFTER = "SELECT " + ", ".join(fx.RUN) + " FROM orders", "SELECT " + ", ".join(fx.RUN_AFTER) + " FROM orders WHERE o_orderkey % 11 <> 0"

TYPE = """CASE WHEN skin_ratio >= 0.045 AND dark_ratio >= 0.18 THEN 'portrait' WHEN width / CAST(height AS DOUBLE) >= 2.0 AND edge_density >= 0.075 AND low_saturation_ratio >= 0.55 THEN 'ppt_page'
 WHEN text_density >= 0.045 AND edge_density >= 0.055 THEN 'ppt_page' WHEN text_density >= 0.018 THEN 'text_poster' WHEN edge_density >= 0.11 AND low_saturation_ratio >= 0.34 THEN 'architecture'
 WHEN texture_density >= 0.12 OR (edge_density >= 0.095 AND low_saturation_ratio >= 0.36) THEN 'mixed' WHEN edge_density < 0.035 AND low_saturation_ratio < 0.42 THEN 'product_kv' ELSE 'unknown' END"""

MATERIAL = f"""CASE WHEN output_profile = 'preview_light' THEN 'preview_light_profile' WHEN mode = 'text_safe' OR {TEXTY} THEN 'text_safe_or_text_poster'
 WHEN text_density >= 0.18 AND texture_density < 0.035 THEN 'high_text_or_gradient_risk' WHEN edge_density >= 0.10 AND low_saturation_ratio > 0.65 THEN 'fine_line_table_risk'
 WHEN image_type = 'unknown' AND dark_ratio > 0.12 AND edge_density > 0.025 AND texture_density > 0.05 THEN 'small_text_or_technical_graphic_risk'
 WHEN edge_density >= 0.075 AND texture_density < 0.035 THEN 'fine_line_structure_risk' WHEN texture_density < 0.003 AND edge_density < 0.003 THEN 'synthetic_gradient_risk'
 WHEN texture_density < 0.006 THEN 'very_low_texture_conservative' WHEN texture_density < 0.018 AND image_type NOT IN ('architecture', 'landscape') THEN 'low_texture_conservative'
 WHEN low_saturation_ratio > 0.92 AND texture_density < 0.028 THEN 'flat_low_saturation_conservative' ELSE 'eligible' END"""

PASSED = f"""(color_fidelity_score >= 91 AND artifact_risk <> 'high' AND pseudo_hd_risk <> 'high' AND over_smoothing_risk <> 'high' AND texture_loss_risk <> 'high' AND detail_stability_score >= 64
 AND clarity_score >= 15 AND clarity_gain >= -0.25 AND edge_quality_gain >= -0.25
 AND (NOT (text_density >= 0.015 OR {TEXTY}) OR (text_clarity_score >= 24 AND text_clarity_gain >= CASE WHEN {TEXTY} THEN -2.0 ELSE -1.2 END))
 AND (image_type <> 'portrait' OR (face_detail_gain >= -0.4 AND hair_texture_gain >= -0.4)) AND (image_type <> 'mixed' OR (fabric_texture_gain >= -0.35 AND hair_texture_gain >= -0.35)))"""
STANDARD = f"""(color_fidelity_score >= 94 AND pseudo_hd_risk = 'low' AND over_smoothing_risk = 'low' AND texture_loss_risk = 'low' AND detail_stability_score >= 78 AND edge_quality_gain >= 0 AND clarity_gain >= 0
 AND (NOT (text_density >= 0.015 OR {TEXTY}) OR (text_clarity_gain >= 0 AND small_text_readability_score >= 26))
 AND (image_type <> 'portrait' OR (face_detail_gain >= 0 AND hair_texture_gain >= 0)) AND (image_type <> 'mixed' OR fabric_texture_gain >= 0))"""
BENEFIT = """ROUND(1e-9 + GREATEST(0.0, clarity_gain) * 0.32 + GREATEST(0.0, text_clarity_gain) * 0.18 + GREATEST(0.0, edge_quality_gain) * 0.24
 + GREATEST(0.0, (detail_stability_score - 78) / 12) * 0.16 + GREATEST(0.0, (color_fidelity_score - 94) / 8) * 0.10, 6)"""
DELIVERED = F_ + f""", g1 AS (SELECT *, {PASSED} AS passed, {BENEFIT} AS visible_benefit FROM f),
g2 AS (SELECT *, CASE WHEN size_growth > 8 AND visible_benefit < 0.35 THEN 'large_size_low_visible_benefit' WHEN size_growth > 14 AND visible_benefit < 0.85 THEN 'very_large_size_limited_benefit' ELSE '' END AS size_fallback_reason FROM g1),
g3 AS (SELECT *, CASE WHEN NOT passed THEN 'quality_1080p_gate_not_fully_passed' WHEN smooth_region_fallback THEN 'smooth_region_guard' WHEN size_fallback_reason <> '' THEN size_fallback_reason ELSE 'delivery_guard_pass' END AS delivery_reason,
  CASE WHEN {TEXTY} AND NOT passed THEN 'manual_review_required' WHEN size_growth > 8 THEN 'screen_1080p;web_delivery;manual_review_required' ELSE 'screen_1080p;ppt_delivery;web_delivery' END AS recommended_usage FROM g2),
g AS (SELECT *, CASE WHEN delivery_reason = 'delivery_guard_pass' THEN 'PASS' ELSE 'PASS_WITH_LIMITATION' END AS delivery_status,
  CASE WHEN delivery_reason = 'delivery_guard_pass' THEN 'low' ELSE 'medium' END AS delivery_risk FROM g3)"""

EDGE = [
    ("output_profile = 'preview_light'", 0.0, "preview_light_profile"), (f"mode = 'text_safe' OR {TEXTY} OR text_density >= 0.018", 0.0, "text_edge_protected"),
    ("texture_density < 0.003 AND edge_density < 0.003", 0.0, "gradient_protected"), ("edge_density >= 0.10 AND low_saturation_ratio > 0.65", 0.0, "fine_line_protected"),
    ("NOT (edge_density >= 0.008 OR dark_ratio >= 0.12 OR has_alpha OR texture_density >= 0.075)", 0.0, "no_edge_risk"), ("image_type = 'portrait'", 0.035, "portrait_skin_safe"),
    ("has_alpha", 0.025, "alpha_edge_safe"), ("texture_density >= 0.075", 0.04, "ringing_guard"), ("image_type IN ('architecture', 'product_kv') OR edge_density >= 0.008 OR dark_ratio >= 0.12", 0.045, "eligible"),
]


def _case(rungs: list, pick: int, otherwise: str) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)"
    return "CASE " + " ".join(f"WHEN {r[0]} THEN {show(r[pick])}" for r in rungs) + f" ELSE {otherwise} END"


def _list(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {w} THEN '{n}' END" for w, n in pairs) + "], lambda t: t IS NOT NULL)"


LOW = _list(
    ("LEAST(width, height) > 0 AND LEAST(width, height) < 420", "low_resolution"), ("lower(requested_format) IN ('jpg', 'jpeg') AND (compression_risk > 0.018 OR input_size_bytes < GREATEST(1.0, width * height * CAST(0.18 AS DOUBLE)))", "jpeg_compression"),
    ("blur_risk > 0.18", "soft_focus"), ("local_contrast < 0.34", "low_contrast"), ("shadow_dirt_risk > 0.18", "dirty_shadow"),
)
ISSUES = _list(
    ("high_frequency_pollution >= 0.5", "高频污染偏高"), ("ai_dirty_score >= 0.5", "AI脏感偏高"), ("sharpening_risk >= 0.5", "锐化风险偏高"), ("highlight_risk >= 0.5", "高光风险偏高"),
    ("color_pollution >= 0.5", "色彩污染偏高"), ("atmosphere_deficiency >= 0.5", "空气感不足"), ("mid_frequency_score < 0.34", "中频结构偏弱"),
)
HINTS = _list(("highlight_risk >= 0.35", "reflective_or_glossy_surface"), ("mid_frequency_score < 0.42", "weak_volume_structure"), ("color_pollution >= 0.35", "color_unification_needed"), ("atmosphere_deficiency >= 0.45", "background_depth_needed"))
MODE = "CASE WHEN color_pollution > 0.62 OR ai_dirty_score > 0.58 THEN 'ai_commercial_kv' WHEN highlight_risk > 0.58 AND mid_frequency_score < 0.45 THEN 'cinematic' WHEN sharpening_risk > 0.62 THEN 'ppt_business' ELSE 'ai_commercial_kv' END"
LEVELS = lambda v, names: f"CASE WHEN {v} < 0.34 THEN '{names[0]}' WHEN {v} < 0.67 THEN '{names[1]}' ELSE '{names[2]}' END"

HIGH_TOKEN, MID_TOKEN = "(issues LIKE '%高频污染%')", "(issues LIKE '%中频结构偏弱%')"
STRATEGY = f"""{F_}, a AS (SELECT *, array_to_string({ISSUES}, ';') AS issues, {MODE} AS m FROM f),
s0 AS (SELECT *, {_clip('0.28 + ai_dirty_score * 0.55')} AS noise, {_clip('0.25 + high_frequency_pollution * 0.6')} AS high, {_clip('0.24 + (1 - mid_frequency_score) * 0.55')} AS mid,
  {_clip('0.22 + highlight_risk * 0.58')} AS light, {_clip('0.22 + atmosphere_deficiency * 0.58')} AS air, {_clip('0.2 + color_pollution * 0.62')} AS harmony,
  {_clip('0.22 - high_frequency_pollution * 0.12 - sharpening_risk * 0.14')} AS sharp, {_clip('0.72 + ai_dirty_score * 0.2')} AS clean, CAST(0.82 AS DOUBLE) AS premium FROM a),
s1 AS (SELECT * REPLACE (CASE WHEN {HIGH_TOKEN} THEN {_clip('high + 0.18')} ELSE high END AS high, CASE WHEN {HIGH_TOKEN} THEN {_clip('sharp - 0.1')} ELSE sharp END AS sharp,
  CASE WHEN {HIGH_TOKEN} THEN {_clip('air + 0.08')} ELSE air END AS air, CASE WHEN {HIGH_TOKEN} THEN {_clip('clean + 0.08')} ELSE clean END AS clean) FROM s0),
s2 AS (SELECT * REPLACE (CASE WHEN {MID_TOKEN} THEN {_clip('mid + 0.22')} ELSE mid END AS mid, CASE WHEN {MID_TOKEN} THEN {_clip('sharp - 0.04')} ELSE sharp END AS sharp,
  CASE WHEN {MID_TOKEN} THEN {_clip('premium + 0.05')} ELSE premium END AS premium, {_clip('light + 0.16')} AS light, {_clip('air + 0.06')} AS air) FROM s1)
SELECT {K}, ROUND(noise + 1e-9, 4) AS noise_reduction_strength, ROUND(high + 1e-9, 4) AS high_frequency_control_strength, ROUND(mid + 1e-9, 4) AS mid_frequency_restore_strength,
  ROUND(CASE WHEN m = 'cinematic' THEN {_clip('light + 0.1')} ELSE light END + 1e-9, 4) AS light_compression_strength, ROUND(CASE WHEN m = 'cinematic' THEN {_clip('air + 0.18')} ELSE air END + 1e-9, 4) AS atmosphere_strength,
  ROUND(harmony + 1e-9, 4) AS color_harmony_strength, ROUND(CASE m WHEN 'ppt_business' THEN GREATEST(sharp, 0.16) WHEN 'cinematic' THEN {_clip('sharp - 0.08')} ELSE sharp END + 1e-9, 4) AS sharpen_strength,
  ROUND(CASE WHEN m = 'ppt_business' THEN GREATEST(clean, 0.78) ELSE clean END + 1e-9, 4) AS texture_cleanliness_strength, ROUND(premium + 1e-9, 4) AS premium_style_strength FROM s2"""

PROBE = "pf AS (SELECT " + ", ".join(fx.PROBE_FILES) + """ FROM documents), m(method, format, percent, for_alpha) AS (VALUES ('png_optimize', 'png', 100, false), ('jpg_q95', 'jpg', 62, false), ('jpg_q92', 'jpg', 50, false),
 ('jpg_q90', 'jpg', 41, false), ('webp_q94', 'webp', 44, false), ('webp_q90', 'webp', 33, false), ('png_optimize', 'png', 100, true), ('webp_q94_alpha', 'webp', 47, true), ('webp_q90_alpha', 'webp', 36, true)),
r1 AS (SELECT *, CASE WHEN regexp_matches(lower(file_name), 'contact|compare') THEN 'contact_sheet' WHEN regexp_matches(lower(file_name), 'preview|thumb|report') THEN 'preview' ELSE 'final' END AS role FROM pf),
r2 AS (SELECT *, CASE WHEN role <> 'final' THEN 'contact_sheet_preview' WHEN has_alpha THEN 'transparent_png' WHEN regexp_matches(lower(file_name), 'ppt|slide|text|logo|brand|ui|poster|cn|chinese|map') THEN 'text_ppt_logo'
  WHEN regexp_matches(lower(file_name), 'product|kv|ad|poster|pack|banner|commerce') THEN 'product_ad' WHEN file_name LIKE '%.png' AND width * height <= 3000000 THEN 'commercial_png' ELSE 'ordinary_non_alpha' END AS image_type FROM r1),
r3 AS (SELECT *, (original_size_bytes * percent) // 100 AS candidate_size_bytes FROM r2 JOIN m ON has_alpha = for_alpha),
pr AS (SELECT *, original_size_bytes - candidate_size_bytes AS saved_bytes, ROUND((original_size_bytes - candidate_size_bytes) / CAST(GREATEST(original_size_bytes, 1) AS DOUBLE), 6) AS saved_ratio,
  CASE WHEN role <> 'final' THEN CASE WHEN format = 'png' THEN 'medium' ELSE 'low' END WHEN has_alpha THEN CASE WHEN format = 'png' THEN 'low' ELSE 'medium' END
       WHEN image_type = 'text_ppt_logo' THEN CASE method WHEN 'png_optimize' THEN 'low' WHEN 'jpg_q95' THEN 'medium' WHEN 'webp_q94' THEN 'medium' ELSE 'high' END
       WHEN image_type IN ('product_ad', 'commercial_png') OR format = 'webp' THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN role <> 'final' THEN 'preview_only' WHEN has_alpha THEN 'cautious' WHEN image_type = 'text_ppt_logo' AND method NOT IN ('png_optimize', 'jpg_q95', 'webp_q94') THEN 'not_recommended'
       WHEN image_type IN ('text_ppt_logo', 'product_ad', 'commercial_png') THEN 'cautious' ELSE 'candidate' END AS recommended_use FROM r3)"""


def _clean(v: str) -> str:
    """A name's part: '' and null are missing."""
    ill = rf"""regexp_replace(trim(CASE WHEN {v} IS NULL OR {v} = '' THEN 'missing' ELSE {v} END, ' '), '[<>:"/\\|?*\x00-\x1f]', '_', 'g')"""
    out = rf"regexp_replace(regexp_replace({ill}, '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
    return f"(CASE WHEN {out} = '' THEN 'missing' ELSE {out} END)"


SOURCES = r"""src AS (SELECT doc_id AS ordinal, regexp_replace(substr(text, 1, 24), '[\s]+', ' ', 'g') || CASE WHEN doc_id % 2 = 0 THEN '.png' ELSE '.jpg' END AS source_name, lang AS industry,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE substr(text, 1, 12) END AS title FROM documents)"""


def _stems(rendered: str) -> str:
    return rf"""{SOURCES}, n1 AS (SELECT *, row_number() OVER (ORDER BY ordinal) - 1 AS position FROM src), n2 AS (SELECT *, {rendered} AS rendered FROM n1),
n3 AS (SELECT *, regexp_replace(substr({_clean('rendered')}, 1, 36), '[ ._]+$', '') AS cut FROM n2),
names AS (SELECT ordinal, source_name, position, CASE WHEN cut = '' THEN 'missing' ELSE cut END AS stem, regexp_extract(source_name, '(\.[^.]*)$', 1) AS extension, industry IS NULL OR industry = '' OR title IS NULL OR title = '' AS lacks FROM n3)"""


TITLE = f"{_clean('industry')} || '_' || {_clean('title')}"
REDACT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '(?i)(api[_-]?key|token|cookie|authorization|password|secret)["'']?\s*[:=]\s*["'']?[^"''\s,}]+', '<redacted>', 'g'), '[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[A-Za-z]{2,}', '<redacted>', 'g'),
 '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b', '<ip>', 'g'), '\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b', '<mac>', 'g')"""
W = "PARTITION BY task_id ORDER BY ts, event_id"
ENDS = STAGES + """, en AS (SELECT task_id, min(ts) AS started_at, count(*) AS n_events, arg_max(task_status, {'t': ts, 'e': event_id}) AS latest,
  arg_min(task_status, {'t': ts, 'e': event_id}) FILTER (task_status IN ('completed', 'failed')) AS final, min({'t': ts, 'e': event_id}) FILTER (task_status IN ('completed', 'failed')) AS fin FROM st GROUP BY task_id)"""
RATIO = "width / CAST(GREATEST(height, 1) AS DOUBLE)"
ASPECT = f"CASE WHEN abs({RATIO} - CAST(16 AS DOUBLE) / 9) <= 0.025 THEN '16:9' WHEN abs({RATIO} - CAST(21 AS DOUBLE) / 9) <= 0.025 THEN '21:9' WHEN abs({RATIO} - 1.0) <= 0.025 THEN '1:1' WHEN abs({RATIO} - 0.5625) <= 0.025 THEN '9:16' ELSE 'custom' END"
D = lambda n, x: f"CAST({n} AS DOUBLE) / GREATEST({x}, 1)"
TARGET = f"""{F_}, t1 AS (SELECT *, {ASPECT} AS aspect, {RATIO} AS ratio FROM f),
t2 AS (SELECT *, CASE WHEN output_profile = 'fidelity_original' THEN 'orig' WHEN ratio >= 2.05 THEN CASE WHEN width >= 2048 THEN 'orig' ELSE 'wide' END
   WHEN aspect = '16:9' THEN CASE WHEN width <= 1920 AND height <= 1080 THEN 'exact' ELSE '16' END WHEN aspect = '1:1' THEN 'square' WHEN aspect = '9:16' THEN 'tall'
   WHEN width >= 1080 AND height >= 1080 THEN 'orig' WHEN width >= height THEN 'short_h' ELSE 'short_w' END AS kind FROM t1),
t3 AS (SELECT *, CASE kind WHEN 'wide' THEN {D(2048, 'width')} WHEN '16' THEN GREATEST(1.0, {D(1920, 'width')}, {D(1080, 'height')}) WHEN 'square' THEN GREATEST(1.0, {D(1080, 'width')}, {D(1080, 'height')})
   WHEN 'tall' THEN GREATEST(1.0, {D(1080, 'width')}, {D(1920, 'height')}) WHEN 'short_h' THEN GREATEST(1.0, {D(1080, 'height')}) WHEN 'short_w' THEN GREATEST(1.0, {D(1080, 'width')}) ELSE 1.0 END AS scale FROM t2),
t4 AS (SELECT *, CASE kind WHEN 'exact' THEN 1920 WHEN 'wide' THEN 2048 ELSE CAST(round_even(width * scale, 0) AS INT) END AS tw, CASE kind WHEN 'exact' THEN 1080 ELSE CAST(round_even(height * scale, 0) AS INT) END AS th,
   CASE WHEN kind = 'wide' THEN 'upscale_long_edge_to_2048_keep_aspect' WHEN kind = 'exact' OR (kind = '16' AND scale > 1) THEN 'upscale_to_1920x1080_keep_aspect' WHEN kind = 'square' AND scale > 1 THEN 'upscale_to_1080_square_keep_aspect'
   WHEN kind = 'tall' AND scale > 1 THEN 'upscale_to_1080x1920_keep_aspect' WHEN kind = 'short_h' OR (kind = 'short_w' AND scale > 1) THEN 'upscale_short_edge_to_1080_keep_aspect' ELSE 'keep_original_size_clean_enhance' END AS policy FROM t3),
t5 AS (SELECT *, tw < width OR th < height AS shrinks FROM t4)
SELECT {K}, aspect, CASE WHEN shrinks THEN width ELSE tw END AS target_width, CASE WHEN shrinks THEN height ELSE th END AS target_height,
  CASE WHEN shrinks THEN 'keep_original_size_clean_enhance' ELSE policy END AS resize_policy, NOT shrinks AND (tw > width OR th > height) AS was_upscaled FROM t5"""
ASKED = "CASE lower(coalesce(requested_format, '')) WHEN 'jpeg' THEN 'jpg' WHEN 'jpg' THEN 'jpg' WHEN 'png' THEN 'png' WHEN 'webp' THEN 'webp' ELSE 'auto' END"
LIMITED = "(upper(raw) = 'PASS_WITH_LIMITATION' OR regexp_matches(coalesce(joined, ''), 'PASS_WITH_LIMITATION|manual_review|quality_1080p_gate_not_fully_passed|smooth_region_guard|limited_benefit|size_guard|quality_gate_not_fully_passed'))"

_fixed2 = lambda v: f"(CAST(CAST(floor(floor(({v}) * 100 + 0.5) / 100) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST(CAST(floor(({v}) * 100 + 0.5) AS BIGINT) % 100 AS VARCHAR), 2, '0'))"
SIGNALS = [
    ("(clarity_score * 1.5)", 70, "清晰度基础较好"), ("text_clarity_score", 60, "文字清晰度通过"), ("(edge_quality_gain + 64)", 65, "边缘质量通过"), ("visual_score", 60, "材质保持通过"),
    ("color_fidelity_score", 95, "默认保真色彩稳定"), ("visible_benefit", 2, "存在可见收益信号"),
]
REPORT = f"""{DELIVERED}, ra AS (SELECT *, CASE WHEN l_orderkey % 60 = 0 THEN 'reject' WHEN l_orderkey % 50 = 0 THEN '' ELSE delivery_status END AS raw, delivery_reason AS joined FROM g),
rb AS (SELECT *, CASE WHEN upper(raw) IN ('FAIL', 'REJECT') THEN 'FAIL' WHEN {LIMITED} OR text_clarity_score + 40 < 60 OR visual_score + 20 < 60 OR edge_quality_gain + 70 < 65 THEN 'PASS_WITH_LIMITATION' WHEN upper(raw) = 'PASS' THEN 'PASS' ELSE 'WAITING' END AS shown FROM ra),
rp AS (SELECT *, CASE shown WHEN 'FAIL' THEN '不建议交付' WHEN 'PASS_WITH_LIMITATION' THEN '已生成｜建议查看后使用' WHEN 'PASS' THEN '可交付' ELSE '等待判定' END AS user_status_label,
  CASE WHEN l_orderkey % 5 <> 0 THEN recommended_usage WHEN shown = 'PASS' THEN '可用于 1080P 本地交付，正式使用前建议快速查看成品。' WHEN shown = 'PASS_WITH_LIMITATION' THEN '已生成本地预览，建议查看文字、Logo、边缘、品牌色和关键局部后使用。'
    WHEN shown = 'FAIL' THEN '不建议作为正式成品使用，请回到原图或调整输入后重新处理。' ELSE '等待任务完成后再判断用途。' END AS suggested_usage FROM rb)"""

SQL = {
    "raster_basic_metrics": f"""WITH {NB} SELECT image_id, ROUND(avg(l), 4) AS brightness, ROUND(stddev_pop(l), 4) AS contrast, ROUND(var_pop(lap), 4) AS sharpness, ROUND(avg(abs(lap)), 4) AS mean_abs_laplacian,
        ROUND(quantile_cont(abs(lap), 0.95), 4) AS p95_abs_laplacian, ROUND({_clip("(coalesce(stddev_pop(l) FILTER (abs(lap) < 2.5), stddev_pop(l) * 0.35) - 1.8) / CAST(16.2 AS DOUBLE) * 100", 0, 100)}, 4) AS noise_score FROM lap GROUP BY image_id""",
    "raster_box_contrast": f"WITH {PX}{_box(4)} SELECT image_id, ROUND(avg(abs(l - total / 81.0)), 4) AS local_contrast, ROUND({_clip('(avg(abs(l - total / 81.0)) - 4) / CAST(18 AS DOUBLE) * 100', 0, 100)}, 4) AS local_contrast_score FROM bx GROUP BY image_id",
    "raster_sobel_edge_score": f"WITH {NB} SELECT image_id, ROUND(avg(grad), 4) AS edge_score, ROUND(avg(CAST(grad > 200 AS INT)), 4) AS strong_edge_ratio, ROUND(max(grad), 4) AS max_gradient FROM lap GROUP BY image_id",
    "raster_dilate_erode": f"WITH {PX}{_box(1)} SELECT image_id, CAST(sum(hi) AS BIGINT) AS dilated_sum, CAST(sum(lo) AS BIGINT) AS eroded_sum, CAST(sum(hi) - sum(lo) AS BIGINT) AS gradient_sum FROM bx GROUP BY image_id",
    "raster_block_probe": f"""WITH {NB}, d AS (SELECT *, abs(l - lf) AS dx, abs(l - up) AS dy FROM lap),
        m AS (SELECT image_id, avg(dx) FILTER (x % 8 = 0 AND x > 0) + avg(dy) FILTER (y % 8 = 0 AND y > 0) AS boundary, avg(dx) FILTER (x % 8 = 4) + avg(dy) FILTER (y % 8 = 4) AS inn,
              stddev_pop(l) FILTER (l < 76) AS dirt, avg(CAST(l < 76 AS INT)) AS dark, var_pop(lap) AS sharp FROM d GROUP BY image_id)
        SELECT image_id, ROUND({_clip('(boundary - inn * 1.08) / 10')}, 4) AS compression_risk, ROUND(CASE WHEN dirt IS NULL THEN 0.0 ELSE {_clip('dark * 1.25 + dirt / 95')} END, 4) AS shadow_dirt_risk,
               ROUND({_clip('(130 - sharp) / 130')}, 4) AS blur_risk FROM m""",
    "raster_color_state": f"""WITH {PX3}, c AS (SELECT image_id, {_hsv('b', 'g', 'r')}, FLOOR(0.114 * b + 0.587 * g + 0.299 * r + 0.5) AS l FROM px3),
        m AS (SELECT image_id, avg(CAST(v > 246 AS INT)) AS clipped, avg(s) FILTER (v > 215) AS bright, avg(CAST(s > 185 AS INT)) AS high, coalesce(stddev_pop(h) FILTER (s > 35), 0) AS spread, avg(l) AS mean_gray FROM c GROUP BY image_id)
        SELECT image_id, ROUND(mean_gray, 4) AS mean_gray, ROUND(CASE WHEN bright IS NULL THEN 0.0 ELSE {_norm('clipped', 0.01, 0.18)} * 0.45 + {_norm('bright', 16, 86)} * 0.25 END, 4) AS highlight_part,
               ROUND({_clip(f"{_norm('high', 0.06, 0.38)} * 0.55 + {_norm('spread', 36, 70)} * 0.45")}, 4) AS color_pollution FROM m""",
    "raster_color_drift": f"""WITH {PX3}, w AS (SELECT *, b * 9 // 10 AS b1, LEAST(255, r + 8) AS r1 FROM px3), c AS (SELECT image_id, {_hsv('b', 'g', 'r')}, {_hsv('b1', 'g', 'r1', '1')}, {_lab('b', 'g', 'r', '0')}, {_lab('b1', 'g', 'r1', '1')} FROM w),
        k AS (SELECT image_id, h, s / 255 AS s, v / 255 AS v, s1 / 255 AS s1, sqrt((l0 - l1) ** 2 + (a0 - a1) ** 2 + (bb0 - bb1) ** 2) AS d, LEAST(abs(h - h1), 180 - abs(h - h1)) * 2 AS turn FROM c),
        m AS (SELECT image_id, ROUND(avg(d), 4) AS mean_delta_e, ROUND(quantile_cont(d, 0.95), 4) AS p95_delta_e, ROUND(avg(s1) - avg(s), 4) AS saturation_delta, ROUND(avg(turn), 4) AS mean_hue_delta,
              ROUND(coalesce(avg(d) FILTER (h BETWEEN 2 AND 24 AND s BETWEEN 0.10 AND 0.58 AND v BETWEEN 0.28 AND 0.96), 0), 4) AS skin_tone_delta,
              ROUND(coalesce(avg(d) FILTER ((h <= 8 OR h >= 170) AND s > 0.42 AND v > 0.16), 0), 4) AS brand_color_delta,
              ROUND(coalesce(avg(d) FILTER (v > 0.82 AND s > 0.05), 0), 4) AS highlight_color_delta, ROUND(coalesce(avg(d) FILTER (v < 0.22 AND s > 0.05), 0), 4) AS shadow_color_delta FROM k GROUP BY image_id)
        SELECT *, array_to_string({_list(("abs(saturation_delta) > 0.010", "saturation_delta"), ("p95_delta_e > 3.6", "p95_delta_e"), ("skin_tone_delta > 3.0", "skin_tone_delta"), ("brand_color_delta > 2.8", "brand_color_delta"), ("highlight_color_delta > 3.4", "highlight_color_delta"), ("shadow_color_delta > 3.4", "shadow_color_delta"))}, ';') AS drift_reasons FROM m""",
    "raster_pixel_difference": f"""WITH {PX}{_box(1)}, d AS (SELECT image_id, abs(l - CAST(FLOOR(total / 9.0 + 0.5) AS INT)) AS d FROM bx)
        SELECT image_id, ROUND(avg(d), 4) AS mean_abs_diff, max(d) AS max_abs_diff, ROUND(CASE WHEN avg(d * d) > 0 THEN 10 * log10(65025 / avg(d * d)) END, 4) AS psnr FROM d GROUP BY image_id""",
    "raster_resize_nearest": f"WITH {PX} SELECT image_id, ty AS y, tx AS x, l FROM px, range(20) a(ty), range(48) b(tx) WHERE px.y = ty * 32 // 20 AND px.x = tx * 32 // 48",
    "raster_resize_area": f"WITH {PX} SELECT image_id, y // 4 AS y, x // 4 AS x, CAST(FLOOR(avg(l) + 0.5) AS INT) AS l FROM px GROUP BY 1, 2, 3",
    "raster_best_window": f"""WITH {NB}, m AS (SELECT image_id, i * 6 AS wy, j * 6 AS wx, ROUND(avg(abs(lap)), 4) AS pooled FROM lap, range(5) a(i), range(5) b(j) WHERE y >= i * 6 AND y < i * 6 + 8 AND x >= j * 6 AND x < j * 6 + 8 GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pooled DESC, wy, wx) AS n FROM m) SELECT image_id, wy AS y, wx AS x, pooled FROM o WHERE n = 1""",
    "raster_quality_summary": f"""WITH {NB}, m AS (SELECT image_id, ROUND(avg(l), 4) AS brightness, ROUND(stddev_pop(l), 4) AS contrast, ROUND(var_pop(lap), 4) AS sharpness FROM lap GROUP BY image_id)
        SELECT CASE WHEN sharpness < 17000 THEN 'soft' WHEN sharpness < 19000 THEN 'normal' ELSE 'sharp' END AS level, count(*) AS n, ROUND(avg(brightness), 3) AS mean_brightness, ROUND(avg(contrast), 3) AS mean_contrast FROM m GROUP BY 1""",
    "raster_texture": f"""WITH {PX}{_blur(1.35, "px", "g1")}{_blur(1.15, "px", "g2")} SELECT px.image_id, ROUND(avg(CAST(abs(l - {_byte('g1.v')}) > 8 AS INT)), 4) AS texture_density,
        ROUND({_clip(f"ln(1 + avg(abs(l - {_byte('g2.v')}))) * 16", 0, 100)}, 4) AS high_frequency_score FROM px JOIN g1 USING (image_id, y, x) JOIN g2 USING (image_id, y, x) GROUP BY px.image_id""",
    "raster_mid_frequency": f"""WITH {PX}{_blur(1.4, "px", "g1")}{_blur(6.0, "px", "g2")}, m AS (SELECT image_id, stddev_pop(abs({_byte('g1.v')} - {_byte('g2.v')})) AS s FROM g1 JOIN g2 USING (image_id, y, x) GROUP BY image_id)
        SELECT image_id, ROUND({_norm('s', 4.0, 32.0)}, 4) AS mid_frequency_score, ROUND(s, 4) AS band_deviation FROM m""",
    "raster_local_contrast": f"""WITH {PX}, sq AS (SELECT *, l * l AS q FROM px){_blur(2.0, "sq", "g1")}{_blur(2.0, "sq", "g2", "q")},
        m AS (SELECT image_id, avg(sqrt(GREATEST(0.0, g2.v - g1.v * g1.v))) AS s FROM g1 JOIN g2 USING (image_id, y, x) GROUP BY image_id) SELECT image_id, ROUND({_clip('s / 22')}, 4) AS local_contrast, ROUND(s, 4) AS mean_local_deviation FROM m""",
    "raster_smooth_region": f"""WITH {PX}, af AS (SELECT image_id, y, x, CASE WHEN l > 140 THEN 140 + (l - 140) // 2 ELSE l END AS l FROM px){_blur(2.2, "px", "g0")}{_blur(2.2, "af", "g1")}{_grad("g0", "s0")}{_grad("g1", "s1")},
        m AS (SELECT image_id, avg(abs(s1.v - s0.v)) FILTER (s0.g < 60) AS d, avg(abs(s1.v - s0.v)) AS e, coalesce(quantile_cont(abs(s1.g - s0.g), 0.95) FILTER (s0.g < 60), 0) AS band FROM s0 JOIN s1 USING (image_id, y, x) GROUP BY image_id), n AS (SELECT image_id, coalesce(d, e) AS d, band FROM m)
        SELECT image_id, ROUND(d, 4) AS flat_diff, ROUND({_clip('1 - d / 18')}, 4) AS uniformity, ROUND(band, 4) AS band_signal, CASE WHEN d / 18 >= 0.72 THEN 'high' WHEN d / 18 >= 0.42 THEN 'medium' ELSE 'low' END AS gradient_risk,
          CASE WHEN band / 22 >= 0.72 THEN 'high' WHEN band / 22 >= 0.42 THEN 'medium' ELSE 'low' END AS band_risk FROM n""",
    "raster_highlight_compress": f"""WITH {PX} SELECT image_id, ROUND(avg(l), 4) AS plain, ROUND(avg(CASE WHEN l > 190 THEN 190 + (l - 190) * (1 - 0.28 * 0.8) ELSE l END) + 1e-9, 4) AS highlights, ROUND(avg(CASE WHEN l > 238 THEN 238 + (l - 238) * 0.82 ELSE l END) + 1e-9, 4) AS clipped,
        ROUND(avg(CASE WHEN l > 210 THEN 210 + (l - 210) * 0.775 ELSE l END) + 1e-9, 4) AS specular, ROUND(avg(CASE WHEN l < 72 THEN l + (72 - l) * 0.126 ELSE l END) + 1e-9, 4) AS shadows FROM px GROUP BY image_id""",
    "raster_skin_saturation": f"""WITH {PX3}, c AS (SELECT image_id, {_hsv('b', 'g', 'r')} FROM px3) SELECT image_id,
        ROUND(avg(CAST((h BETWEEN 0 AND 28 AND s BETWEEN 20 AND 190 AND v BETWEEN 55 AND 245) OR (h BETWEEN 160 AND 179 AND s BETWEEN 20 AND 175 AND v BETWEEN 55 AND 245) AS INT)), 4) AS skin_ratio,
        ROUND(0.75 * avg(CAST(s < 34 AS INT)) + 0.25 * stddev_pop(v) / 80, 4) AS gray_ink, ROUND(avg(s), 4) AS mean_s, ROUND(avg(LEAST(255, s * 1.08)), 4) AS richer_s, ROUND(avg(CASE WHEN v > 205 THEN s * (1 - 0.18 * 0.6) ELSE s END), 4) AS tamed_s,
        ROUND(avg(CASE WHEN v > 205 THEN v - (v - 205) * 0.22 * 0.6 ELSE v END), 4) AS tamed_v, ROUND(avg(LEAST(s / 255 * 1.05, LEAST(1.0, s / 255 + 0.008))), 4) AS clamped_s FROM c GROUP BY image_id""",
    "raster_channel_match": f"""WITH {PX3}, t AS (SELECT image_id, avg(b) AS mb, avg(r) AS mr, GREATEST(stddev_pop(b), 1.0) AS sb, GREATEST(stddev_pop(r), 1.0) AS sr FROM px3 GROUP BY image_id),
        k AS (SELECT image_id, b, {_clip('r * (1 - CAST(0.96 AS DOUBLE)) + ((r - mr) / sr * sb + mb) * 0.96', 0, 255)} AS m FROM px3 JOIN t USING (image_id)) SELECT image_id, ROUND(avg(m), 3) AS mean_matched, ROUND(stddev_pop(m), 3) AS deviation_matched, ROUND(avg(b), 3) AS mean_reference FROM k GROUP BY image_id""",
    "raster_artifact_masks": f"""WITH {NB}, j AS (SELECT image_id, y, x, l, lap, CASE WHEN (x >= 8 AND x % 8 = 0 AND abs(l - lf) > 8) OR (y >= 8 AND y % 8 = 0 AND abs(l - up) > 8) THEN 1 ELSE 0 END AS hit FROM lap),
        d AS (SELECT c.image_id, c.y, c.x, any_value(c.lap) AS lap, max(n.hit) AS wide FROM j c, range(-1, 2) a(dy), range(-1, 2) b(dx) JOIN j n ON n.image_id = c.image_id AND n.y = {_at('c.y + dy')} AND n.x = {_at('c.x + dx')} GROUP BY c.image_id, c.y, c.x),
        t AS (SELECT c.image_id, c.y, c.x, any_value(c.l) AS l, sum(n.l) AS total FROM px c, range(-8, 9) a(dy), range(-8, 9) b(dx) JOIN px n ON n.image_id = c.image_id AND n.y = {_at('c.y + dy')} AND n.x = {_at('c.x + dx')} GROUP BY c.image_id, c.y, c.x)
        SELECT d.image_id, count(*) FILTER (wide = 1 AND abs(lap) < 60) AS n_block, count(*) FILTER (l <= floor(total / 289.0 + 0.5) - 8) AS n_stroke, CAST(sum(wide) AS BIGINT) AS n_grid FROM d JOIN t USING (image_id, y, x) GROUP BY d.image_id""",
    "raster_unsharp": f"""WITH {PX}{_blur(1.2, "px", "g1")} SELECT px.image_id, px.y, px.x, {_byte('ROUND(l * CAST(1.35 AS DOUBLE) - g1.v * 0.35, 9)')} AS l FROM px JOIN g1 USING (image_id, y, x)""",
    "raster_resize_cubic": f"""WITH {PX}, {_taps('tx', 45)}, {_taps('ty', 40)}, h AS (SELECT image_id, y, dst AS dx, sum(l * w) AS v FROM px JOIN tx ON x = src GROUP BY ALL)
        SELECT image_id, dst AS y, dx AS x, {_byte('ROUND(sum(v * w), 9)')} AS l FROM h JOIN ty ON y = src GROUP BY image_id, dst, dx""",
    "mask_set_ops": f"""WITH {NB} SELECT image_id, count(*) FILTER (l > 150) AS n_bright, count(*) FILTER (grad > 220) AS n_steep, count(*) FILTER (l > 150 OR grad > 220) AS n_union, count(*) FILTER (l > 150 AND grad > 220) AS n_both,
        count(*) FILTER (l > 150 AND NOT grad > 220) AS n_bright_only FROM lap GROUP BY image_id HAVING count(*) FILTER (l > 150 OR grad > 220) > 0""",
    "classify_type": f"""WITH {F_} SELECT {K}, {TYPE} AS image_type, CASE WHEN LEAST(width, height) < 720 THEN 'low_resolution' WHEN clarity_score * 2 < 45 THEN 'blur'
        WHEN input_size_bytes > 0 AND input_size_bytes / CAST(GREATEST(width * height, 1) AS DOUBLE) < 0.8 THEN 'jpeg_artifact' WHEN small_text_readability_score / 4 > 12 THEN 'noise' ELSE 'mixed' END AS degradation FROM f""",
    "target_size_plan": f"WITH {TARGET}",
    "choose_format": f"WITH {F_} SELECT {K}, CASE WHEN has_real_alpha THEN 'png' WHEN {ASKED} <> 'auto' THEN {ASKED} WHEN output_profile = 'preview_light' THEN 'webp' ELSE 'jpg' END AS output_format FROM f",
    "material_policy": f"""WITH {F_}, w AS (SELECT *, {MATERIAL} AS why, CASE WHEN output_profile = 'preview_light' OR mode = 'text_safe' OR {TEXTY} THEN 0.0 ELSE
          {_clip("CASE image_type WHEN 'product_kv' THEN 0.13 WHEN 'architecture' THEN 0.14 WHEN 'landscape' THEN 0.13 WHEN 'mixed' THEN 0.12 WHEN 'portrait' THEN 0.08 ELSE 0.10 END + CASE WHEN mode = 'texture' THEN 0.03 ELSE 0.0 END", 0, 0.18)} END AS base FROM f),
        o AS (SELECT *, why = 'eligible' OR why LIKE '%_conservative' AS good FROM w),
        s AS (SELECT *, CASE WHEN good THEN {_clip("LEAST(base, CASE why WHEN 'very_low_texture_conservative' THEN 0.025 WHEN 'low_texture_conservative' THEN 0.055 WHEN 'flat_low_saturation_conservative' THEN 0.06 ELSE 1.0 END) * CASE WHEN has_alpha THEN 0.45 ELSE 1.0 END", 0, 0.18)} ELSE 0.0 END AS strength FROM o)
        SELECT {K}, strength > 0 AS material_eligible, ROUND(strength, 4) AS material_strength, CASE WHEN good AND has_alpha THEN CASE WHEN why = 'eligible' THEN 'alpha_safe_reduced' ELSE why || '+alpha_safe_reduced' END ELSE why END AS material_reason FROM s""",
    "edge_policy": f"""WITH {F_} SELECT {K}, {_case(EDGE, 1, "CAST(0.05 AS DOUBLE)")} AS edge_strength, {_case(EDGE, 2, "'eligible'")} AS edge_reason, (edge_density >= 0.008 OR dark_ratio >= 0.12 OR has_alpha) AS halo_risk,
        (texture_density >= 0.075 OR (edge_density >= 0.10 AND low_saturation_ratio > 0.65)) AS ringing_risk FROM f""",
    "low_quality_policy": f"""WITH {F_}, w AS (SELECT *, {LOW} AS why FROM f), s AS (SELECT *, {_clip('''(CAST(0.025 AS DOUBLE) + CASE WHEN list_contains(why, 'low_resolution') THEN 0.018 ELSE 0 END + CASE WHEN list_contains(why, 'jpeg_compression') THEN 0.014 ELSE 0 END
          + CASE WHEN list_contains(why, 'dirty_shadow') THEN 0.012 ELSE 0 END + CASE WHEN list_contains(why, 'low_contrast') THEN 0.008 ELSE 0 END + CASE WHEN list_contains(why, 'soft_focus') THEN 0.006 ELSE 0 END)
          * CASE WHEN image_type = 'portrait' THEN 0.56 WHEN image_type IN ('architecture', 'landscape') THEN 1.04 WHEN image_type = 'product_kv' THEN 0.55 ELSE 1.0 END * CASE WHEN text_density > 0.006 THEN 0.72 ELSE 1.0 END''', 0, 0.115)} AS strength FROM w)
        SELECT {K}, array_to_string(why, ';') AS degradation_reasons, CASE WHEN len(why) >= 3 THEN 'mixed_degradation' WHEN len(why) > 0 THEN why[1] ELSE 'none' END AS degradation_profile,
          CASE WHEN len(why) > 0 THEN ROUND(strength + 1e-9, 4) ELSE 0.0 END AS restore_strength FROM s""",
    "visual_policy": f"""WITH {F_} SELECT {K}, CAST(round_even(ROUND(((1 - ai_dirty_score) * 0.22 + (1 - high_frequency_pollution) * 0.18 + mid_frequency_score * 0.18 + (1 - highlight_risk) * 0.14 + (1 - color_pollution) * 0.14
          + (1 - atmosphere_deficiency * 0.7) * 0.14) * 100, 9), 0) AS INT) AS premium_score, {MODE} AS recommended_mode, array_to_string({ISSUES}, ';') AS issues,
        CASE WHEN len({HINTS}) = 0 THEN 'generic_commercial_visual' ELSE array_to_string({HINTS}, ';') END AS material_hints, {LEVELS('ai_dirty_score', ('low', 'medium', 'high'))} AS dirty_label,
        {LEVELS('mid_frequency_score', ('weak', 'moderate', 'strong'))} AS mid_grade FROM f""",
    "strategy_from_rules": f"WITH {STRATEGY}",
    "visual_gate": f"""WITH {F_} SELECT {K}, CASE WHEN NOT {PASSED} THEN 'failed' WHEN {STANDARD} AND visual_score >= 74 AND text_clarity_gain >= 0.6 AND edge_quality_gain >= 0.6 AND detail_stability_score >= 86 AND color_fidelity_score >= 96 THEN 'excellent'
        WHEN {STANDARD} THEN 'standard' ELSE 'acceptable' END AS level FROM f""",
    "compression_gate": f"""WITH {F_}, l AS (SELECT *, output_profile = 'preview_light' AS pv, text_density >= 0.035 AS tx FROM f), r AS (SELECT *, {_list(
            ("text_clarity_gain < -0.05", "text_clarity_gain"), ("edge_quality_gain < -0.05", "edge_quality_gain"), ("face_detail_gain < CASE WHEN image_type = 'portrait' THEN -0.15 ELSE -0.35 END", "face_detail_gain"),
            ("hair_texture_gain < CASE WHEN image_type IN ('portrait', 'mixed') THEN -0.12 ELSE -0.28 END", "hair_texture_gain"), ("fabric_texture_gain < CASE WHEN image_type = 'mixed' THEN -0.12 ELSE -0.28 END", "fabric_texture_gain"),
            ("dark_detail_gain < -0.25", "dark_detail_gain"), ("over_smoothing_risk <> 'low'", "over_smoothing_risk"), ("texture_loss_risk <> 'low'", "texture_loss_risk"), ("pseudo_hd_risk <> 'low'", "pseudo_hd_risk"),
            ("NOT (pixel_diff <= CASE WHEN pv THEN CAST(1.9 AS DOUBLE) ELSE 1.05 END + CASE WHEN tx THEN CAST(-0.18 AS DOUBLE) ELSE 0 END AND color_delta <= CASE WHEN pv THEN CAST(1.65 AS DOUBLE) ELSE 1.0 END + CASE WHEN tx THEN CAST(-0.12 AS DOUBLE) ELSE 0 END AND edge_ratio >= CASE WHEN pv THEN CAST(0.9 AS DOUBLE) ELSE 0.965 END + CASE WHEN tx THEN CAST(0.025 AS DOUBLE) ELSE 0 END)", "primitive_gate_failed"))} AS why FROM l)
        SELECT {K}, len(why) = 0 AS compression_allowed, ROUND(GREATEST(0.0, color_delta + GREATEST(0.0, 1 - edge_ratio) * 4), 6) AS quality_drop, array_to_string(why, ';') AS gate_reasons FROM r""",
    "delivery_guard": f"WITH {DELIVERED} SELECT {K}, visible_benefit, size_fallback_reason, delivery_status, delivery_reason, delivery_risk, recommended_usage FROM g",
    "delivery_summary": f"""WITH {DELIVERED} SELECT image_type, count(*) AS total, count(*) FILTER (delivery_status = 'PASS') AS n_pass, count(*) FILTER (delivery_status = 'PASS_WITH_LIMITATION') AS n_limited,
        count(*) FILTER (size_fallback_reason <> '') AS n_size_fallback, count(*) FILTER (smooth_region_fallback) AS n_smooth_fallback, ROUND(avg(size_growth), 4) AS mean_size_ratio FROM g GROUP BY image_type""",
    "delivery_status": f"""WITH {DELIVERED}, a AS (SELECT *, CASE WHEN l_orderkey % 60 = 0 THEN 'reject' WHEN l_orderkey % 50 = 0 THEN '' ELSE delivery_status END AS raw, CASE WHEN l_linenumber = 1 THEN NULL ELSE visual_score END AS tex,
          CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE delivery_reason || ' ' || recommended_usage END AS joined FROM g),
        b AS (SELECT *, CASE WHEN upper(raw) IN ('FAIL', 'REJECT') THEN 'FAIL' WHEN {LIMITED} OR text_clarity_score + 30 < 60 OR coalesce(tex < 60, false) OR edge_quality_gain * 5 + 63 < 65 THEN 'PASS_WITH_LIMITATION' WHEN upper(raw) = 'PASS' THEN 'PASS' ELSE 'WAITING' END AS shown FROM a)
        SELECT {K}, shown, CASE WHEN shown = 'FAIL' THEN '不建议通过' WHEN shown = 'PASS_WITH_LIMITATION' AND size_growth > 10 AND visible_benefit * 5 < 3 THEN '低收益提示' WHEN shown = 'PASS_WITH_LIMITATION' THEN '建议人工复核'
          WHEN visible_benefit * 5 >= 4 OR (clarity_score * 2 >= 85 AND coalesce(tex >= 60, false)) THEN '明显提升' WHEN visible_benefit * 5 >= 2 OR clarity_score * 2 >= 70 THEN '轻微提升' ELSE '保护通过' END AS benefit_tag FROM b""",
    "review_tags": f"""WITH {DELIVERED}, t AS (SELECT *, {_list(("text_clarity_score + 10 < 60", "文字清晰度偏低"), ("visual_score < 60", "材质收益偏弱"), ("edge_quality_gain * 5 + 63 < 65", "边缘质量需复核"),
          ("size_growth > 10 AND visible_benefit * 5 < 3", "体积收益比偏低"), ("NOT (size_growth > 10 AND visible_benefit * 5 < 3) AND size_growth > 30", "文件体积增长明显"), ("delivery_reason = 'quality_1080p_gate_not_fully_passed'", "1080P 质量门未完全通过"),
          ("delivery_reason = 'smooth_region_guard'", "平滑区域保护触发"), ("delivery_reason LIKE '%limited_benefit%'", "可见收益有限"), ("color_fidelity_score < 95", "颜色 / 品牌色需确认"))} AS tags FROM g)
        SELECT {K}, CASE WHEN len(tags) = 0 THEN '暂无明确复核风险' ELSE array_to_string(tags, ';') END AS tags FROM t""",
    "risk_labels": f"""WITH {F_} SELECT {K}, CASE WHEN LEAST(face_detail_gain, hair_texture_gain) * 2 < -1.2 THEN 'high' WHEN LEAST(face_detail_gain, hair_texture_gain) * 2 < -0.25 THEN 'medium' ELSE 'low' END AS gain_risk,
        CASE WHEN pixel_diff <= 0.8 THEN 'low' WHEN pixel_diff <= 1.6 THEN 'medium' ELSE 'high' END AS diff_risk, ROUND({_clip('ln(1 + GREATEST(clarity_score, 0.0)) * 16', 0, 100)}, 4) AS clarity_log FROM f""",
    "mode_profile": """WITH p(i, profile, output_suffix, cleanup_strength, micro_contrast, sharpness, high_frequency_guard, glass_weight, style_tags) AS (VALUES
          (0, 'cosmetics', '_cosmetics_master', 0.42, 0.28, 0.14, 0.72, 0.8, 'premium,clean,transparent'), (1, 'food', '_food_master', 0.28, 0.36, 0.18, 0.55, NULL, 'fresh,warm,appetizing'),
          (2, 'architecture', '_architecture_master', 0.32, 0.42, 0.22, 0.58, 0.45, 'cg,clean,spatial'), (3, 'cinematic', '_cinematic_master', 0.38, 0.24, 0.08, 0.82, NULL, 'cinematic,air,soft'),
          (4, 'ppt_business', '_ppt_business_master', 0.25, 0.45, 0.20, 0.46, NULL, 'business,ppt,readable'), (5, 'ai_commercial_kv', '_commercial_kv_master', 0.45, 0.32, 0.13, 0.75, 0.35, 'kv,premium,cg'),
          (6, 'portrait_commercial', '_portrait_commercial_master', 0.48, 0.22, 0.05, 0.86, NULL, 'portrait,beauty,soft_light,clean_skin'), (7, 'luxury_product', '_luxury_product_master', 0.36, 0.34, 0.10, 0.76, 0.55, 'luxury,reflection,black_gold,premium'))
        SELECT coalesce(profile, 'unknown') AS profile, count(*) AS n, output_suffix, CAST(cleanup_strength AS DOUBLE) AS cleanup_strength, CAST(micro_contrast AS DOUBLE) AS micro_contrast, CAST(sharpness AS DOUBLE) AS sharpness,
          CAST(high_frequency_guard AS DOUBLE) AS high_frequency_guard, CAST(glass_weight AS DOUBLE) AS glass_weight, style_tags,
          CASE WHEN profile IS NULL THEN 'Unknown profile ''unknown''. Available profiles: ai_commercial_kv, architecture, cinematic, cosmetics, food, luxury_product, portrait_commercial, ppt_business' END AS profile_error
        FROM part LEFT JOIN p ON p_partkey % 9 = i GROUP BY ALL""",
    "batch_summary": f"""WITH {STAGES} SELECT stage, count(*) AS total, count(*) FILTER (task_status = 'completed') AS completed, count(*) FILTER (task_status = 'failed') AS failed,
        count(*) FILTER (task_status IN ('pending', 'processing')) AS waiting, ROUND(coalesce(sum(value), 0) / count(*), 4) AS mean_value FROM st GROUP BY stage""",
    "regression_diff": f"""WITH b AS ({BEFORE}), a AS ({AFTER}) SELECT b.sample_id, a.sample_id IS NOT NULL AS found, b.level IS NOT DISTINCT FROM a.level AS level_match, b.score IS NOT DISTINCT FROM a.score AS score_match,
        b.format IS NOT DISTINCT FROM a.format AS format_match, b.level IS NOT DISTINCT FROM a.level AND b.score IS NOT DISTINCT FROM a.score AND b.format IS NOT DISTINCT FROM a.format AS all_match FROM b LEFT JOIN a USING (sample_id)""",
    "regression_counts": f"""WITH b AS ({BEFORE}), a AS ({AFTER}), d AS (SELECT a.sample_id IS NOT NULL AS found, b.level IS NOT DISTINCT FROM a.level AS lv, b.score IS NOT DISTINCT FROM a.score AS sc, b.format IS NOT DISTINCT FROM a.format AS fm FROM b LEFT JOIN a USING (sample_id))
        SELECT count(*) AS samples, count(*) FILTER (found) AS n_found, count(*) FILTER (lv) AS n_level_match, count(*) FILTER (sc) AS n_score_match, count(*) FILTER (fm) AS n_format_match, count(*) FILTER (lv AND sc AND fm) AS n_all_match FROM d""",
    "first_match_lookup": "SELECT CAST(n_nationkey AS BIGINT) AS item, CAST(min(c_custkey) AS BIGINT) AS row FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey OR length(c_mktsegment) = n_nationkey GROUP BY n_nationkey",
    "latest_output_per_input": f"WITH {STAGES} SELECT task_id, stage, arg_max(event_id, {{'t': ts, 'e': event_id}}) AS latest_event, max(ts) AS latest_ts FROM st GROUP BY task_id, stage",
    "compression_probe": f"WITH {PROBE} SELECT doc_id, method, role, image_type, candidate_size_bytes, saved_bytes, saved_ratio, risk_level, recommended_use FROM pr",
    "probe_method_summary": f"WITH {PROBE} SELECT method, count(*) AS n, ROUND(avg(saved_ratio), 6) AS mean_saved_ratio, count(*) FILTER (risk_level = 'high') AS n_high_risk FROM pr GROUP BY method",
    "probe_counts": f"WITH {PROBE} SELECT 'image_type' AS field, image_type AS value, count(*) AS n FROM pr GROUP BY 2 UNION ALL SELECT 'recommended_use', recommended_use, count(*) FROM pr GROUP BY 2 UNION ALL SELECT 'risk_level', risk_level, count(*) FROM pr GROUP BY 2",
    "probe_top30": f"WITH {PROBE} SELECT doc_id, file_name, method, saved_bytes, saved_ratio FROM pr WHERE risk_level = 'low' AND saved_ratio > 0.15 ORDER BY saved_ratio DESC, doc_id, method LIMIT 30",
    "rename_stems": "WITH " + _stems(TITLE + " || '_' || CASE WHEN position < 999 THEN lpad(CAST(position + 1 AS VARCHAR), 3, '0') ELSE CAST(position + 1 AS VARCHAR) END") + " SELECT ordinal, position, stem, extension, lacks FROM names",
    "rename_conflicts": "WITH " + _stems(TITLE) + " SELECT lower(stem || extension) AS name, count(*) AS n, min(ordinal) AS first_ordinal FROM names GROUP BY 1 HAVING count(*) > 1",
    "redact_text": f"SELECT doc_id, sha256({REDACT}) AS redacted_sha256, {REDACT} <> text AS changed FROM documents",
    "sanitized_names": f"SELECT doc_id, {_clean('substr(text, 1, 30)')} AS part FROM documents",
    "task_progress": f"""WITH {STAGES}, o AS (SELECT *, row_number() OVER ({W}) AS index, count(*) OVER (PARTITION BY task_id) AS total, bool_or(task_status IN ('completed', 'failed')) OVER ({W} ROWS UNBOUNDED PRECEDING) AS done FROM st)
        SELECT task_id, event_id, task_status, index, total, done, CASE WHEN done THEN 100 ELSE LEAST(99, CAST(round_even(index / CAST(total AS DOUBLE) * 100, 0) AS INT)) END AS progress FROM o""",
    "task_terminal_state": f"""WITH {ENDS} SELECT en.task_id, any_value(coalesce(final, latest)) AS task_status, any_value(started_at) AS started_at, any_value(fin.t) AS ended_at, any_value(n_events) AS n_events,
        count(*) FILTER (fin IS NOT NULL AND (st.ts > fin.t OR (st.ts = fin.t AND st.event_id > fin.e))) AS n_ignored FROM en JOIN st USING (task_id) GROUP BY en.task_id""",
    "task_timeout": f"WITH {ENDS} SELECT task_id, CASE WHEN fin IS NULL OR fin.t > started_at + INTERVAL 36000 SECOND THEN 'failed' ELSE coalesce(final, latest) END AS task_status, CASE WHEN fin IS NULL OR fin.t > started_at + INTERVAL 36000 SECOND THEN 'timeout' END AS error FROM en",
    "task_sessions": f"""WITH {STAGES}, n AS (SELECT *, CASE WHEN ts - lag(ts) OVER ({W}) <= INTERVAL 86400 SECOND THEN 0 ELSE 1 END AS new FROM st), s AS (SELECT *, sum(new) OVER ({W}) AS session FROM n)
        SELECT task_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2""",
    "task_windows": f"WITH {STAGES} SELECT date_trunc('day', ts) AS window_start, task_status, count(*) AS n FROM st GROUP BY 1, 2",
    "problem_code": """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 23 = 0 THEN 'BLOCKED_INPUT_DIR_MISSING' WHEN o_orderkey % 19 <= 0 OR o_orderkey % 7 = 0 THEN 'BLOCKED_INPUT_EMPTY' WHEN o_orderkey % 17 = 0 THEN 'BLOCKED_OUTPUT_PERMISSION'
        WHEN o_orderkey % 13 = 0 THEN 'BLOCKED_TOOL_MISSING' WHEN o_orderpriority LIKE '1-%' THEN 'BLOCKED_MODEL_MISSING' WHEN o_orderstatus = 'P' THEN 'FAILED_MODEL_RUN' WHEN o_orderkey % 3 > 0 THEN 'PASS_WITH_NOTES' ELSE 'PASS' END AS problem FROM orders""",
    "type_scores": f"""WITH {F_}, s AS (SELECT {K}, {_clip('text_density / 10 * 36 + edge_density * 1.2 + texture_density * 4 * 0.25')} AS a, {_clip('texture_density * 4 * 0.75 + edge_density * 0.8 - skin_ratio * 1.2')} AS b,
          {_clip('CASE WHEN dark_ratio / 4 > 0.015 THEN dark_ratio / 4 * 1.8 + edge_density * 0.55 - texture_density * 4 * 0.35 ELSE edge_density * 0.18 END')} AS c, {_clip('skin_ratio * 3 + dark_ratio / 4 * 0.25')} AS d,
          CASE WHEN low_saturation_ratio > 0.62 AND text_density / 10 < 0.001 THEN low_saturation_ratio ELSE 0.0 END AS e FROM f), m AS (SELECT *, GREATEST(a, b, c, d, e, 0.28) AS top FROM s)
        SELECT {K}, CASE top WHEN a THEN 'text_poster' WHEN b THEN 'architecture' WHEN c THEN 'artifact' WHEN d THEN 'portrait_indoor' WHEN e THEN 'ink_gray' ELSE 'general' END AS kind, ROUND({_clip('top')} + 1e-9, 4) AS confidence FROM m""",
    "mode_strengths": f"""WITH {F_}, m AS (SELECT * REPLACE (CASE l_linenumber WHEN 2 THEN 'sharp_4k' WHEN 3 THEN 'ai_image_clean' ELSE mode END AS mode) FROM f) SELECT {K},
        ROUND({_clip("CAST(CASE mode WHEN 'text_safe' THEN 0.18 WHEN 'ai_image_clean' THEN 0.36 WHEN 'sharp_4k' THEN 0.23 ELSE 0.22 END AS DOUBLE) + CASE image_type WHEN 'ink_gray' THEN -0.08 ELSE 0 END", 0, 0.72)} + 1e-9, 4) AS repair_strength,
        ROUND({_clip("CAST(CASE mode WHEN 'text_safe' THEN 0.56 WHEN 'ai_image_clean' THEN 0.30 WHEN 'sharp_4k' THEN 0.38 ELSE 0.34 END AS DOUBLE) + CASE image_type WHEN 'text_poster' THEN 0.18 ELSE 0 END", 0, 0.72)} + 1e-9, 4) AS text_strength,
        ROUND({_clip("CAST(CASE mode WHEN 'text_safe' THEN 0.20 WHEN 'ai_image_clean' THEN 0.17 WHEN 'sharp_4k' THEN 0.34 ELSE 0.24 END AS DOUBLE) + CASE image_type WHEN 'text_poster' THEN -0.04 WHEN 'architecture' THEN 0.12 ELSE 0 END", 0, 0.72)} + 1e-9, 4) AS edge_strength,
        ROUND({_clip("CAST(CASE mode WHEN 'text_safe' THEN 0.20 WHEN 'ai_image_clean' THEN 0.20 WHEN 'sharp_4k' THEN 0.34 ELSE 0.24 END AS DOUBLE) + CASE image_type WHEN 'architecture' THEN 0.14 ELSE 0 END", 0, 0.72)} + 1e-9, 4) AS structure_strength,
        ROUND(CAST(CASE mode WHEN 'text_safe' THEN 0.10 WHEN 'ai_image_clean' THEN 0.08 WHEN 'sharp_4k' THEN 0.18 ELSE 0.12 END AS DOUBLE) + 1e-9, 4) AS post_edge_strength, ROUND(CAST(CASE mode WHEN 'ai_image_clean' THEN 0.92 ELSE 0.88 END AS DOUBLE) + 1e-9, 4) AS highlight_strength FROM m""",
    "qa_decision": f"""WITH {PROBE}, q AS (SELECT *, method AS m2, doc_id % 20 + 38 AS psnr, doc_id % 4 <> 0 AS kept FROM pr),
        w AS (SELECT *, CASE image_type
          WHEN 'contact_sheet_preview' THEN CASE WHEN m2 IN ('jpg_q90', 'jpg_q92', 'webp_q90', 'webp_q94') THEN 'candidate|preview_only|low' ELSE 'manual_review|preview_only|medium' END
          WHEN 'transparent_png' THEN CASE WHEN m2 = 'png_optimize' AND kept THEN 'candidate|transparent_png_lossless|low' WHEN m2 IN ('webp_q90_alpha', 'webp_q94_alpha') THEN 'experiment_only|webp_alpha_experiment|medium' ELSE 'reject|do_not_use|high' END
          WHEN 'text_ppt_logo' THEN CASE WHEN m2 = 'png_optimize' AND psnr >= 48 THEN 'candidate|text_logo_conservative|low' WHEN m2 IN ('jpg_q95', 'webp_q94') THEN 'manual_review|text_logo_manual_only|medium' ELSE 'reject|do_not_use|high' END
          WHEN 'ordinary_non_alpha' THEN CASE WHEN m2 IN ('webp_q90', 'webp_q94') AND saved_ratio > 0.2 THEN 'experiment_only|ordinary_webp_experiment|medium' WHEN saved_ratio <= 0 THEN 'reject|do_not_use|low' ELSE 'manual_review|manual_qa|medium' END
          ELSE CASE WHEN m2 = 'jpg_q95' AND saved_ratio > 0.15 THEN 'candidate|final_product_ad_candidate|medium' WHEN m2 IN ('jpg_q92', 'webp_q94') AND saved_ratio > 0.2 THEN 'manual_review|final_experiment_only|medium'
            WHEN m2 = 'png_optimize' THEN 'manual_review|lossless_png_fallback|low' WHEN m2 IN ('jpg_q90', 'webp_q90') THEN 'reject|do_not_use|high' ELSE 'reject|do_not_use|medium' END END AS v FROM q)
        SELECT doc_id, method, split_part(v, '|', 1) AS verdict, split_part(v, '|', 2) AS scope, split_part(v, '|', 3) AS risk FROM w""",
    "screen_size_plan": f"""WITH {F_}, r AS (SELECT *, CASE WHEN width / CAST(height AS DOUBLE) < 0.45 OR width / CAST(height AS DOUBLE) > 2.4 THEN 'aspect_ratio_not_supported' WHEN LEAST(width, height) <= 1080 THEN 'source_not_upscaled' ELSE 'short_edge_1080' END AS screen_rule FROM f)
        SELECT {K}, CASE screen_rule WHEN 'source_not_upscaled' THEN width WHEN 'short_edge_1080' THEN CAST(round_even(width * (CAST(1080 AS DOUBLE) / LEAST(width, height)), 0) AS INT) END AS screen_width,
          CASE screen_rule WHEN 'source_not_upscaled' THEN height WHEN 'short_edge_1080' THEN CAST(round_even(height * (CAST(1080 AS DOUBLE) / LEAST(width, height)), 0) AS INT) END AS screen_height, screen_rule FROM r""",
    "quality_compare": f"""WITH {F_} SELECT {K}, ROUND({_clip("0.35 * (color_fidelity_score - 8) + 0.22 * GREATEST(0.0, 100 - GREATEST(blur_risk * 20, 0.0)) + 0.23 * GREATEST(0.0, LEAST(100.0, 50 + edge_quality_gain * 2)) + 0.20 * GREATEST(0.0, LEAST(100.0, 50 + text_clarity_gain * 2))", 0, 100)} + 1e-9, 2) AS fidelity_score,
        NOT ((clarity_gain > 2 OR text_clarity_gain * 2 > 3 OR edge_quality_gain * 2 > 3 OR hair_texture_gain > 2) AND blur_risk * 20 <= 8 AND color_fidelity_score - 8 >= 82) AS is_apparent FROM f""",
    "report_summary": f"""WITH {DELIVERED}, x AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {v} >= {least} THEN '{name}：' || {_fixed2(v)} END" for v, least, name in SIGNALS)}], lambda t: t IS NOT NULL) AS sig FROM g)
        SELECT {K}, CASE WHEN len(sig) = 0 THEN '当前更偏保护型输出，建议查看局部后判断收益。' ELSE array_to_string(sig, ';') END AS signals, CASE WHEN color_fidelity_score + 3 < 95 THEN '颜色与品牌保护复核' WHEN text_clarity_score + 20 < 60 THEN '文字与 Logo 保护复核'
          WHEN (size_growth > 10 AND visible_benefit * 5 < 3) OR size_growth > 30 OR delivery_reason LIKE '%limited_benefit%' OR visual_score + 5 < 60 THEN '低收益复核' WHEN delivery_reason = 'smooth_region_guard' THEN '低频平滑区复核'
          WHEN delivery_status = 'PASS_WITH_LIMITATION' THEN '安全保护复核' ELSE '常规交付确认' END AS review_type FROM x""",
    "image_kind_tag": f"""WITH {F_} SELECT {K}, CASE WHEN has_real_alpha THEN '透明 PNG' WHEN image_type LIKE '%text%' THEN '中文文字 / 海报' WHEN image_type LIKE '%product%' OR image_type LIKE '%kv%' THEN '产品 / 品牌 KV'
        WHEN image_type LIKE '%portrait%' THEN '人物 / 商业照片' WHEN image_type LIKE '%architecture%' THEN '建筑 / 空间' WHEN image_type LIKE '%landscape%' THEN '风景 / 场景' ELSE '普通图像' END AS kind_label FROM f""",
    "batch_report": f"WITH {REPORT} SELECT {K}, shown, user_status_label, suggested_usage FROM rp",
    "batch_report_summary": f"WITH {REPORT} SELECT count(*) AS total, count(*) FILTER (shown = 'PASS') AS n_pass, count(*) FILTER (shown = 'PASS_WITH_LIMITATION') AS n_manual_review, count(*) FILTER (shown = 'FAIL') AS n_not_recommended FROM rp",
    "rename_plan": "WITH " + _stems(TITLE) + """, r AS (SELECT *, row_number() OVER (PARTITION BY lower(stem), lower(extension) ORDER BY ordinal) AS turn FROM names)
        SELECT ordinal, source_name, CASE WHEN turn = 1 THEN stem || extension ELSE stem || '_' || CASE WHEN turn < 100 THEN lpad(CAST(turn AS VARCHAR), 2, '0') ELSE CAST(turn AS VARCHAR) END || extension END AS target_name,
          CASE WHEN turn = 1 THEN 'ok' ELSE 'renamed_duplicate' END AS conflict_status, CASE WHEN lacks THEN 'needs_confirmation' WHEN turn > 1 THEN 'conflict_resolved' ELSE 'ready' END AS status FROM r""",
    "raster_morphology": f"""WITH {PX}{_box(1)}, b2 AS (SELECT c.image_id, c.y, c.x, any_value(c.l) AS l, min(n.hi) AS closed, max(n.lo) AS opened FROM bx c, range(-1, 2) a(j), range(-1, 2) b(k)
          JOIN bx n ON n.image_id = c.image_id AND n.y = {_at('c.y + j')} AND n.x = {_at('c.x + k')} GROUP BY c.image_id, c.y, c.x)
        SELECT image_id, CAST(sum(closed) AS BIGINT) AS closed_sum, CAST(sum(opened) AS BIGINT) AS opened_sum, CAST(sum(closed - l) AS BIGINT) AS black_hat_sum, CAST(sum(l - opened) AS BIGINT) AS top_hat_sum, max(GREATEST(closed - l, l - opened)) AS max_hat FROM b2 GROUP BY image_id""",
    "raster_stretch": f"WITH {PX}, m AS (SELECT image_id, min(l) AS lo, max(l) AS hi FROM px GROUP BY image_id) SELECT image_id, y, x, CAST(CASE WHEN hi > lo THEN FLOOR((l - lo) * 255 / CAST(hi - lo AS DOUBLE) + 0.5) ELSE 0 END AS INT) AS l FROM px JOIN m USING (image_id)",
    "raster_color_cast": f"""WITH {PX3}, c AS (SELECT image_id, {_hsv('b', 'g', 'r')}, {_lab('b', 'g', 'r', '0')} FROM px3), n AS (SELECT *, s / 255 < 0.32 AND v / 255 > 0.22 AND v / 255 < 0.88 AS ok FROM c),
        m AS (SELECT image_id, avg(CAST(ok AS INT)) AS share, avg(CAST(s / 255 > 0.62 AS INT)) AS vivid, coalesce(avg(a0) FILTER (ok) - 128, 0) AS da, coalesce(avg(bb0) FILTER (ok) - 128, 0) AS db FROM n GROUP BY image_id),
        z AS (SELECT *, sqrt(da * da + db * db) AS size FROM m), y AS (SELECT *, CASE WHEN vivid > 0.9 THEN 'brand_or_text_color_protected' WHEN share < 0.035 THEN 'low_neutral_confidence' WHEN size < 1.8 THEN 'no_reliable_cast' ELSE '' END AS why FROM z)
        SELECT image_id, ROUND(share, 4) AS neutral_share, CASE WHEN size < 1.4 THEN 'none' WHEN abs(da) >= abs(db) THEN CASE WHEN da > 0 THEN 'magenta' ELSE 'green' END WHEN db > 0 THEN 'yellow' ELSE 'blue' END AS direction,
          ROUND(size, 4) AS cast_strength, why AS skip_reason, ROUND(CASE WHEN why = '' THEN {_clip('size / 18', 0.035, 0.16)} ELSE 0.0 END, 4) AS correction FROM y""",
    "free_names": f"WITH {PROBE} SELECT doc_id, file_name AS name FROM pf WHERE lower(file_name) NOT IN (SELECT lower(file_name) FROM pf WHERE doc_id % 3 = 0)",
    "probe_risk_sets": f"WITH {PROBE} SELECT method, string_agg(DISTINCT image_type, ',' ORDER BY image_type) AS types, coalesce(string_agg(DISTINCT image_type, ',' ORDER BY image_type) FILTER (risk_level = 'high'), '') AS high_risk_types FROM pr GROUP BY method",
    "probe_method_order": f"WITH {PROBE} SELECT method, max(doc_id) AS last_doc, CAST(CASE method WHEN 'jpg_q95' THEN 1 WHEN 'webp_q94' THEN 2 WHEN 'png_optimize' THEN 3 ELSE 4 END AS BIGINT) AS place FROM pr GROUP BY method",
    "stage_order": f"""WITH {STAGES}, s AS (SELECT DISTINCT task_id, stage FROM st), w(stage) AS (VALUES ('click'), ('export'), ('view')), t AS (SELECT DISTINCT task_id FROM st)
        SELECT task_id, coalesce((SELECT string_agg(stage, ',' ORDER BY stage) FROM s WHERE s.task_id = t.task_id AND stage NOT IN ('click', 'export', 'view')), '') AS unsupported,
          coalesce((SELECT string_agg(w.stage, ',' ORDER BY w.stage) FROM w WHERE w.stage NOT IN (SELECT stage FROM s WHERE s.task_id = t.task_id)), '') AS missing FROM t""",
    "client_progress": f"""WITH {STAGES}, o AS (SELECT *, row_number() OVER ({W}) AS index, count(*) OVER (PARTITION BY task_id) AS total, bool_or(task_status IN ('completed', 'failed')) OVER ({W} ROWS UNBOUNDED PRECEDING) AS done FROM st),
        p AS (SELECT task_id, event_id, GREATEST(35, CASE WHEN done THEN 100 ELSE LEAST(99, CAST(round_even(index / CAST(total AS DOUBLE) * 100, 0) AS INT)) END) AS shown FROM o) SELECT task_id, event_id, shown, CAST(LEAST(4, FLOOR(shown / CAST(100 AS DOUBLE) * 5)) AS INT) AS stage_index FROM p""",
}

_strength = lambda name, v, base, weight: f"ROUND({_clip(f'CAST({base} AS DOUBLE) + {v} * CAST({weight} AS DOUBLE)')} + 1e-9, 4) AS {name}"
_scaled = lambda v, of, to: f"CAST(FLOOR({v} * ({to} / CAST(GREATEST(1, {of}) AS DOUBLE))) AS INT)"
SQL |= {
    "next_actions": f"""WITH {F_}, a AS (SELECT *, {_list(("ai_dirty_score >= 0.34", "优先抑制 diffusion 纹理、AI颗粒和高频脏纹理"), ("mid_frequency_score < 0.5", "恢复中频商业结构，保护体积、材质层次和主体筋骨"), ("highlight_risk >= 0.34", "压缩高光并平滑光影过渡，减少假HDR和数码高光"),
          ("color_pollution >= 0.34", "统一色彩关系，控制 AI 蓝、AI 橙和 HDR 彩色污染"), ("atmosphere_deficiency >= 0.45", "降低全画面同等清晰感，建立主体与背景的空气层次"))} AS found FROM f)
        SELECT {K}, CASE WHEN len(found) = 0 THEN '保持克制增强，避免破坏当前商业质感' ELSE array_to_string(found, ';') END AS actions, {_strength("noise_reduction_strength", "ai_dirty_score", 0.28, 0.55)},
          {_strength("high_frequency_control_strength", "high_frequency_pollution", 0.25, 0.6)}, {_strength("mid_frequency_restore_strength", "(1 - mid_frequency_score)", 0.24, 0.55)}, {_strength("light_compression_strength", "highlight_risk", 0.22, 0.58)},
          {_strength("atmosphere_strength", "atmosphere_deficiency", 0.22, 0.58)}, {_strength("color_harmony_strength", "color_pollution", 0.2, 0.62)} FROM a""",
    "output_plan": "WITH " + TARGET.replace(f"\nSELECT {K}, aspect", f"\nSELECT {K}, output_profile AS selected_output_profile, CASE WHEN has_real_alpha THEN 'png' WHEN {ASKED} <> 'auto' THEN {ASKED} WHEN output_profile = 'preview_light' THEN 'webp' ELSE 'jpg' END AS selected_output_format, aspect"),
    "long_edge_size": f"""WITH {F_}, w AS (SELECT {K}, CASE WHEN l_orderkey % 50 = 0 THEN 0 ELSE width END AS width, height FROM f), s AS (SELECT *, width <= 0 OR abs(width / CAST(GREATEST(height, 1) AS DOUBLE) - CAST(16 AS DOUBLE) / 9) <= 0.025 AS whole,
          CAST(1920 AS DOUBLE) / GREATEST(width, height, 1) AS scale FROM w) SELECT {K}, CASE WHEN whole THEN 1920 ELSE GREATEST(1, CAST(round_even(width * scale, 0) AS INT)) END AS target_width, CASE WHEN whole THEN 1080 ELSE GREATEST(1, CAST(round_even(height * scale, 0) AS INT)) END AS target_height FROM s""",
    "enhance_scope": f"""WITH {F_}, v AS (SELECT {K}, CASE WHEN l_orderkey % 12 = 0 THEN 'portrait|skip_portrait_name' WHEN l_orderkey % 12 = 1 THEN 'commercial_non_portrait|commercial_name'
          WHEN text_density > 0.08 AND edge_density > 0.035 THEN 'commercial_non_portrait|strong_text_commercial_metrics' WHEN text_density > 0.018 AND highlight_risk > 0.35 THEN 'commercial_non_portrait|info_poster_metrics'
          WHEN edge_density > 0.08 AND highlight_risk > 0.20 THEN 'commercial_non_portrait|city_or_map_metrics' WHEN color_pollution / 5 > 0.08 AND edge_density > 0.045 THEN 'commercial_non_portrait|product_metrics'
          WHEN skin_ratio > 0.035 AND skin_ratio < 0.70 AND edge_density < 0.075 AND highlight_risk < 0.70 THEN 'portrait|skip_portrait_metrics' ELSE 'uncertain|skip_uncertain' END AS s FROM f)
        SELECT {K}, split_part(s, '|', 1) AS scope, split_part(s, '|', 2) AS reason FROM v""",
    "report_usage": f"""WITH {F_} SELECT {K}, CASE WHEN l_orderkey % 10 = 0 THEN '仅供存档' WHEN l_orderkey % 7 = 0 THEN '当前不建议直接用于正式交付。建议回到原图检查文字、Logo、边缘和低频区域后再决定是否重新处理。'
          WHEN l_linenumber = 4 THEN '原图质量或保护约束较强，增强收益有限。建议对比原图和输出图后决定是否使用输出图。'
          WHEN regexp_matches(image_type, 'poster|text|infographic', 'i') THEN '适合公众号配图、PPT 内容页和客户方案配图；正式使用前建议查看标题、小字、细线、标签文字和白底洁净度。'
          WHEN regexp_matches(image_type, 'kv|product|brand', 'i') THEN '适合产品视觉提案、品牌 KV 预览和 PPT 封面；正式使用前建议查看 Logo、包装文字、品牌色、高光和产品轮廓。'
          WHEN regexp_matches(image_type, 'portrait|person|photo', 'i') THEN '适合内部预览、资料整理和商业视觉初稿；正式使用前建议查看人脸、手部、肤色、现场文字和 Logo。'
          WHEN regexp_matches(image_type, 'architecture|building', 'i') THEN '适合 PPT 封面、文旅海报和视觉提案；正式使用前建议查看小字、建筑边缘、墙面暗部和复杂纹理。'
          ELSE '适合本地预览、PPT 草案和方案初稿；正式使用前建议查看文字、Logo、主体边缘、颜色和低频平滑区域。' END AS suggested_usage FROM f""",
    "crop_box": f"""WITH {F_}, o AS (SELECT *, GREATEST(0, LEAST(CAST(l_orderkey * 7 % 3200 - 200 AS INT), GREATEST(0, width - 160))) AS x0, GREATEST(0, LEAST(CAST(l_orderkey * 11 % 2300 - 200 AS INT), GREATEST(0, height - 120))) AS y0 FROM f),
        b AS (SELECT *, LEAST(width, x0 + 160) AS x1, LEAST(height, y0 + 120) AS y1 FROM o)
        SELECT {K}, x0, y0, x1, y1, {_scaled("x0", "width", 1920)} AS x0_scaled, {_scaled("y0", "height", 1080)} AS y0_scaled, GREATEST({_scaled("x1", "width", 1920)}, {_scaled("x0", "width", 1920)} + 1) AS x1_scaled,
          GREATEST({_scaled("y1", "height", 1080)}, {_scaled("y0", "height", 1080)} + 1) AS y1_scaled FROM b""",
    "report_rows": f"""WITH {PROBE} SELECT doc_id, file_name, CASE WHEN doc_id % 4 <> 0 THEN original_size_bytes END AS original_size_bytes, CASE WHEN doc_id % 4 <> 0 THEN NULL WHEN has_alpha THEN 'alpha' ELSE 'excluded' END AS skip_reason,
        CASE WHEN doc_id % 4 = 0 THEN 'skipped' ELSE 'processed' END AS state FROM pf""",
    "probe_rows_by_file": f"WITH {PROBE} SELECT file_name, string_agg(method, ',' ORDER BY method) AS values, count(*) AS n FROM pr GROUP BY file_name",
    "parsed_numbers": """WITH v AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' 12 ' WHEN 2 THEN '3.5' ELSE CAST(o_orderkey AS VARCHAR) END AS value FROM orders)
        SELECT o_orderkey, value, CASE WHEN o_orderkey % 4 <> 2 THEN TRY_CAST(trim(value) AS BIGINT) END AS number FROM v""",
    "run_deltas": "SELECT o_orderkey AS sample_id, CAST(CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS score_delta FROM orders WHERE o_orderkey % 11 <> 0",
    "task_requests": f"""WITH {STAGES}, o AS (SELECT *, row_number() OVER ({W}) AS index, count(*) OVER (PARTITION BY task_id) AS total, bool_or(task_status IN ('completed', 'failed')) OVER ({W} ROWS UNBOUNDED PRECEDING) AS done FROM st),
        s AS (SELECT task_id, min(ts) AS t FROM st GROUP BY task_id), r AS (SELECT task_id AS request_id, CASE WHEN task_id % 50 = 0 THEN (SELECT task_id FROM s ORDER BY t DESC, task_id DESC LIMIT 1) WHEN task_id % 7 >= 2 THEN task_id END AS task_id FROM s)
        SELECT request_id, r.task_id, CAST(index AS INT) AS index, total, done FROM r JOIN o ON o.task_id = r.task_id UNION ALL SELECT request_id, NULL, i, 2, i = 2 FROM r, (VALUES (1), (2)) v(i) WHERE r.task_id IS NULL""",
}
