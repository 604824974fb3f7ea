"""Deterministic inputs for the image operators, as views over the driver's tables (see FIXTURES.md).

The lists of expressions are plain SQL that both engines read, so the oracle builds the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.functions.tables import dealt

SIDE = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray rasters of 32 x 32: (image_id, y, x, l). Sixteen embeddings of 64 values are the 8 x 8 tiles of one raster."""
    tiles = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    pixel = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 256 * F.col("v").cast("double") + 0.5))).cast("int")
    rows = tiles.select(
        F.expr("vec_id div 16").alias("image_id"),
        F.expr("((vec_id % 16) div 4) * 8 + (i div 8)").alias("y"),
        F.expr("((vec_id % 16) % 4) * 8 + (i % 8)").alias("x"),
        pixel.alias("l"),
    )
    whole = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 16").alias("image_id")).agg(F.sum(F.size("embedding")).alias("pixels")).where(f"pixels = {SIDE * SIDE}")
    return rows.join(whole.select("image_id"), "image_id", "left_semi")


def px3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour rasters (image_id, y, x, b, g, r) of three gray rasters each."""
    channel = F.element_at(F.array(F.lit("b"), F.lit("g"), F.lit("r")), (F.col("image_id") % 3 + 1).cast("int"))
    rows = px(spark, sf_dir).select(F.expr("image_id div 3").alias("image_id"), "y", "x", channel.alias("channel"), "l")
    planes = rows.groupBy("image_id", "y", "x").agg(*[F.max(F.when(F.col("channel") == c, F.col("l"))).alias(c) for c in "bgr"])
    return planes.where("b IS NOT NULL AND g IS NOT NULL AND r IS NOT NULL")


#: Drawings of many sizes, one a supplier k: a soft ground with a bright block, a dark rule, a slanting stroke, dots and rows of small strokes.
DRAWING_SIZE = ["s_suppkey AS image_id", "24 + (s_suppkey * 7) % 29 AS width", "22 + (s_suppkey * 11) % 19 AS height"]
DRAWING_PIXEL = """CASE WHEN x BETWEEN 3 + image_id % 5 AND 12 + image_id % 7 AND y BETWEEN 3 AND 9 + image_id % 4 THEN 210
 WHEN y = 14 + image_id % 3 AND x BETWEEN 2 AND width - 4 THEN 20 WHEN x - y = image_id % 6 - 2 AND y > 4 THEN 235
 WHEN (x * y + image_id) % 31 = 0 AND y > 17 AND x < 20 THEN 10 WHEN y BETWEEN height - 5 AND height - 3 AND x % 3 = 0 AND x > 20 THEN 15
 ELSE 80 + abs((x * 2 + y + image_id) % 60 - 30) END"""


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray rasters of mixed sizes, none square by rule: (image_id, width, height, y, x, l). Images are dealt out before their pixels are made."""
    rows = table(spark, sf_dir, "supplier").selectExpr(*DRAWING_SIZE)
    rows = dealt(rows, rows.agg(F.sum(F.col("width") * F.col("height"))).first()[0] or 0)
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return rows.select("image_id", F.col("width").cast("long"), F.col("height").cast("long"), F.col("y").cast("long"), F.col("x").cast("long"), F.expr(DRAWING_PIXEL).cast("int").alias("l"))


#: Two colour versions of a drawing; the second adds grain, and more of it in some.
COLORS = {"b": "l", "g": "(l * 3 + x % 40) // 4", "r": "LEAST(255, l + 30)"}
GRAIN = "GREATEST(0, LEAST(255, {v} + CASE WHEN image_id % 3 = 0 THEN 0 WHEN image_id % 3 = 1 THEN {v} % 7 - 3 ELSE ({v} % 5 - 2) * 6 END))"


def color_drawings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The drawings in colour, before and after: (image_id, width, height, y, x, b, g, r)."""
    at = ["image_id", "width", "height", "y", "x"]
    before = drawings(spark, sf_dir).selectExpr(*at, *[f"CAST({v.replace('//', 'div')} AS INT) AS {k}" for k, v in COLORS.items()])
    return before, before.selectExpr(*at, *[f"CAST({GRAIN.format(v=k)} AS INT) AS {k}" for k in COLORS])


def color_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions of each pixel side by side: (image_id, y, x, b0, g0, r0, b1, g1, r1)."""
    at = ["image_id", "y", "x"]
    before, _ = color_drawings(spark, sf_dir)
    return before.selectExpr(*at, *[f"{k} AS {k}0" for k in COLORS], *[f"CAST({GRAIN.format(v=k)} AS INT) AS {k}1" for k in COLORS])


def _share(k: int, j: int, scale: float, off: float = 0.0) -> str:
    return f"((l_orderkey * {k} + l_linenumber * {j}) % 1000) / CAST({scale} AS DOUBLE) + CAST({off} AS DOUBLE)"


#: One row a line item; the ranges make every branch of the ladders occur.
FEATURES = [
    "l_orderkey", "l_linenumber",
    f"{_share(37, 101, 10000)} AS skin_ratio", f"{_share(53, 211, 6000)} AS edge_density", f"{_share(71, 307, 6000)} AS texture_density",
    f"{_share(89, 401, 2000)} AS dark_ratio", f"{_share(97, 503, 1000)} AS low_saturation_ratio", f"{_share(113, 601, 12000)} AS text_density",
    "CAST(120 + (l_partkey * 17) % 2800 AS INT) AS width", "CAST(80 + (l_partkey * 29) % 1900 AS INT) AS height",
    "CAST(1000 + (l_partkey * 7919) % 3000000 AS BIGINT) AS input_size_bytes",
    "(l_suppkey % 7 = 0) AS has_alpha", "(l_suppkey % 14 = 0) AS has_real_alpha",
    "CASE l_partkey % 5 WHEN 0 THEN 'fidelity_original' WHEN 1 THEN 'preview_light' ELSE 'delivery_1080p' END AS output_profile",
    "CASE l_suppkey % 6 WHEN 0 THEN 'text_safe' WHEN 1 THEN 'texture' ELSE 'fidelity' END AS mode",
    "CASE l_partkey % 4 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'png' WHEN 2 THEN 'tiff' ELSE 'auto' END AS requested_format",
    "CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN 'portrait' WHEN 1 THEN 'mixed' WHEN 2 THEN 'text_poster' WHEN 3 THEN 'ppt_page' WHEN 4 THEN 'architecture' "
    "WHEN 5 THEN 'landscape' WHEN 6 THEN 'product_kv' WHEN 7 THEN 'general' ELSE 'unknown' END AS image_type",
    f"{_share(59, 17, 1000)} AS high_frequency_pollution", f"{_share(61, 19, 1000)} AS ai_dirty_score", f"{_share(67, 23, 1000)} AS sharpening_risk",
    f"{_share(73, 29, 1000)} AS mid_frequency_score", f"{_share(79, 31, 1000)} AS highlight_risk", f"{_share(83, 41, 1000)} AS color_pollution",
    f"{_share(101, 43, 1000)} AS atmosphere_deficiency",
    f"{_share(31, 47, 80, 89.5)} AS color_fidelity_score", f"{_share(29, 53, 25, 62)} AS detail_stability_score", f"{_share(23, 59, 20, 14)} AS clarity_score",
    f"{_share(19, 61, 250, -0.8)} AS clarity_gain", f"{_share(17, 67, 250, -0.7)} AS edge_quality_gain", f"{_share(13, 71, 200, -2.2)} AS text_clarity_gain",
    f"{_share(11, 73, 15, 22)} AS text_clarity_score", f"{_share(7, 79, 20, 24)} AS small_text_readability_score", f"{_share(41, 83, 300, -0.9)} AS face_detail_gain",
    f"{_share(43, 89, 300, -0.8)} AS hair_texture_gain", f"{_share(47, 97, 300, -0.7)} AS fabric_texture_gain", f"{_share(103, 37, 300, -0.6)} AS dark_detail_gain",
    f"{_share(107, 11, 20, 50)} AS visual_score",
    f"{_share(109, 13, 400)} AS pixel_diff", f"{_share(127, 7, 500)} AS color_delta", f"{_share(131, 5, 5000, 0.88)} AS edge_ratio",
    f"{_share(137, 3, 20)} AS size_growth", f"{_share(139, 2, 80)} AS compression_risk",
    f"{_share(149, 9, 1000)} AS shadow_dirt_risk", f"{_share(151, 21, 1000)} AS local_contrast", f"{_share(157, 27, 1500)} AS blur_risk",
    *[f"CASE WHEN (l_orderkey * {k} + l_linenumber) % 20 < 15 THEN 'low' WHEN (l_orderkey * {k} + l_linenumber) % 20 < 18 THEN 'medium' ELSE 'high' END AS {c}"
      for k, c in ((3, "artifact_risk"), (7, "pseudo_hd_risk"), (11, "over_smoothing_risk"), (13, "texture_loss_risk"))],
    "((l_orderkey + l_linenumber * 3) % 11 = 0) AS smooth_region_fallback",
]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*FEATURES)


STAGES = [
    "user_id AS task_id", "event_id", "ts", "event_type AS stage", "value",
    "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS task_status",
]


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task event stream: (task_id, event_id, ts, stage, value, task_status)."""
    return table(spark, sf_dir, "events").selectExpr(*STAGES)


PROBE_FILES = [
    "doc_id",
    "CONCAT(source, '_', CASE doc_id % 6 WHEN 0 THEN 'contact_sheet' WHEN 1 THEN 'slide' WHEN 2 THEN 'product' WHEN 3 THEN 'plain' WHEN 4 THEN 'preview' ELSE 'photo' END, "
    "'_', CAST(doc_id AS VARCHAR(20)), CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '.jpg' END) AS file_name",
    "(doc_id % 5 = 0) AS has_alpha", "n_chars AS original_size_bytes", "CAST(400 + doc_id % 1700 AS INT) AS width", "CAST(300 + doc_id % 900 AS INT) AS height",
]


#: Stand-in sizes of candidates, in percent of the file: nothing here encodes images.
PROBE_PERCENT = {"png_optimize": 100, "jpg_q95": 62, "jpg_q92": 50, "jpg_q90": 41, "webp_q94": 44, "webp_q90": 33, "webp_q94_alpha": 47, "webp_q90_alpha": 36}


def probe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*PROBE_FILES)


RUN = [
    "o_orderkey AS sample_id", "o_orderstatus AS level", "o_totalprice AS score", "o_orderpriority AS format",
]
RUN_AFTER = [
    "o_orderkey AS sample_id", "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS level",
    "CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS score", "o_orderpriority AS format",
]


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the same samples: some are missing, changed or without a level in the second."""
    orders = table(spark, sf_dir, "orders")
    return orders.selectExpr(*RUN), orders.where("o_orderkey % 11 <> 0").selectExpr(*RUN_AFTER)


def naming_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of a naming plan: (ordinal, source_name, industry, title, keywords); a title of '' counts as missing."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ordinal"),
        F.concat(F.regexp_replace(F.substring("text", 1, 24), r"[\s]+", " "), F.when(F.col("doc_id") % 2 == 0, ".png").otherwise(".jpg")).alias("source_name"),
        F.col("lang").alias("industry"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.substring("text", 1, 12)).alias("title"),
        F.col("source").alias("keywords"),
    )
