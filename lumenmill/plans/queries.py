"""The queries by name: each applies operators to the fixture views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.functions.scalars import log_score, redact, risk_from_gain, risk_within, sanitize
from lumenmill.operators import batch, gates, metrics, planning, policies, reports, stencils
from lumenmill.sources import fixtures as fx
from lumenmill.streaming import tasks

KEY = ("l_orderkey", "l_linenumber")


def raster_basic_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.basic_metrics(fx.px(spark, d))


def raster_box_contrast(spark: SparkSession, d: str) -> DataFrame:
    return metrics.box_contrast(fx.px(spark, d))


def raster_sobel_edge_score(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sobel_edges(fx.px(spark, d))


def raster_dilate_erode(spark: SparkSession, d: str) -> DataFrame:
    return metrics.dilate_erode(fx.px(spark, d))


def raster_block_probe(spark: SparkSession, d: str) -> DataFrame:
    return metrics.block_probe(fx.px(spark, d))


def raster_color_state(spark: SparkSession, d: str) -> DataFrame:
    return metrics.color_state(fx.px3(spark, d))


def raster_color_drift(spark: SparkSession, d: str) -> DataFrame:
    """The second version is the first with 9/10 of its blue and eight more of its red."""
    before = fx.px3(spark, d)
    after = before.select("image_id", "y", "x", F.floor(F.col("b") * 9 / 10).cast("int").alias("b"), "g", F.least(F.lit(255), F.col("r") + 8).alias("r"))
    return metrics.color_drift(before, after)


def raster_pixel_difference(spark: SparkSession, d: str) -> DataFrame:
    """Gray rasters against their 3 x 3 means."""
    px = fx.px(spark, d)
    after = stencils.box(px, 1, F.sum, "total").select("image_id", "y", "x", F.floor(F.col("total") / 9.0 + 0.5).cast("int").alias("l"))
    return metrics.pixel_difference(px, after)


def raster_resize_nearest(spark: SparkSession, d: str) -> DataFrame:
    return stencils.resize_nearest(fx.px(spark, d), 48, 20)


def raster_resize_area(spark: SparkSession, d: str) -> DataFrame:
    return stencils.resize_area(fx.px(spark, d), 4)


def raster_best_window(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_window(fx.px(spark, d))


def raster_quality_summary(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every raster, its sharpness level, and the summary by level."""
    m = metrics.basic_metrics(fx.px(spark, d))
    level = F.when(F.col("sharpness") < 17000, "soft").when(F.col("sharpness") < 19000, "normal").otherwise("sharp")
    return m.withColumn("level", level).groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("brightness"), 3).alias("mean_brightness"), F.round(F.avg("contrast"), 3).alias("mean_contrast"))


def raster_texture(spark: SparkSession, d: str) -> DataFrame:
    return metrics.texture(fx.px(spark, d))


def raster_mid_frequency(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mid_frequency(fx.px(spark, d))


def raster_local_contrast(spark: SparkSession, d: str) -> DataFrame:
    return metrics.local_contrast(fx.px(spark, d))


def raster_smooth_region(spark: SparkSession, d: str) -> DataFrame:
    """Gray rasters against their highlights compressed."""
    px = fx.px(spark, d)
    after = px.withColumn("l", F.when(F.col("l") > 140, 140 + F.floor((F.col("l") - 140) / 2)).otherwise(F.col("l")).cast("int"))
    return metrics.smooth_regions(px, after)


def raster_highlight_compress(spark: SparkSession, d: str) -> DataFrame:
    return metrics.point_sums(fx.px(spark, d))


def raster_skin_saturation(spark: SparkSession, d: str) -> DataFrame:
    return metrics.skin_and_saturation(fx.px3(spark, d))


def raster_channel_match(spark: SparkSession, d: str) -> DataFrame:
    return metrics.channel_match(fx.px3(spark, d))


def raster_artifact_masks(spark: SparkSession, d: str) -> DataFrame:
    return metrics.artifact_masks(fx.px(spark, d))


def raster_unsharp(spark: SparkSession, d: str) -> DataFrame:
    return metrics.unsharp(fx.px(spark, d))


def raster_resize_cubic(spark: SparkSession, d: str) -> DataFrame:
    return stencils.resize_cubic(fx.px(spark, d), 45, 40)


def raster_png(spark: SparkSession, d: str) -> DataFrame:
    """Encoded rasters; their bytes are checked by a round trip."""
    from lumenmill.sources.images import encode

    return encode(fx.px(spark, d)).select("image_id", "width", "height", F.length("png").alias("bytes"), F.sha2("png", 256).alias("sha256"))


def mask_set_ops(spark: SparkSession, d: str) -> DataFrame:
    return metrics.mask_sets(fx.px(spark, d))


def classify_type(spark: SparkSession, d: str) -> DataFrame:
    return fx.features(spark, d).select(*KEY, policies.classify_type().alias("image_type"), policies.classify_degradation(F.col("clarity_score") * 2, F.col("small_text_readability_score") / 4).alias("degradation"))


def target_size_plan(spark: SparkSession, d: str) -> DataFrame:
    return policies.target_size(fx.features(spark, d)).select(*KEY, "aspect", "target_width", "target_height", "resize_policy", "was_upscaled")


def choose_format(spark: SparkSession, d: str) -> DataFrame:
    return fx.features(spark, d).select(*KEY, policies.choose_format().alias("output_format"))


def material_policy(spark: SparkSession, d: str) -> DataFrame:
    return policies.material_policy(fx.features(spark, d)).select(*KEY, "material_eligible", "material_strength", "material_reason")


def edge_policy(spark: SparkSession, d: str) -> DataFrame:
    return policies.edge_policy(fx.features(spark, d)).select(*KEY, "edge_strength", "edge_reason", "halo_risk", "ringing_risk")


def low_quality_policy(spark: SparkSession, d: str) -> DataFrame:
    return policies.low_quality_policy(fx.features(spark, d)).select(*KEY, "degradation_reasons", "degradation_profile", "restore_strength")


def visual_policy(spark: SparkSession, d: str) -> DataFrame:
    return policies.visual_policy(fx.features(spark, d)).select(*KEY, "premium_score", "recommended_mode", "issues", "material_hints", "dirty_label", "mid_grade")


def strategy_from_rules(spark: SparkSession, d: str) -> DataFrame:
    out = policies.strategy(policies.visual_policy(fx.features(spark, d)), "高光")
    return out.select(*KEY, *[k for k in out.columns if k.endswith("_strength")])


def visual_gate(spark: SparkSession, d: str) -> DataFrame:
    return fx.features(spark, d).select(*KEY, gates.visual_level().alias("level"))


def compression_gate(spark: SparkSession, d: str) -> DataFrame:
    return gates.compression_gate(fx.features(spark, d)).select(*KEY, "compression_allowed", "quality_drop", "gate_reasons")


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    return gates.delivery_guard(fx.features(spark, d).withColumn("level", gates.visual_level()), F.col("level") != "failed")


def delivery_guard(spark: SparkSession, d: str) -> DataFrame:
    return _delivered(spark, d).select(*KEY, "visible_benefit", "size_fallback_reason", "delivery_status", "delivery_reason", "delivery_risk", "recommended_usage")


def delivery_summary(spark: SparkSession, d: str) -> DataFrame:
    return _delivered(spark, d).groupBy("image_type").agg(
        F.count("*").alias("total"), F.count_if(F.col("delivery_status") == "PASS").alias("n_pass"), F.count_if(F.col("delivery_status") == "PASS_WITH_LIMITATION").alias("n_limited"),
        F.count_if(F.col("size_fallback_reason") != "").alias("n_size_fallback"), F.count_if(F.col("smooth_region_fallback")).alias("n_smooth_fallback"), F.round(F.avg("size_growth"), 4).alias("mean_size_ratio"),
    )


def delivery_status(spark: SparkSession, d: str) -> DataFrame:
    """The report centre's view: status and benefit tag of each delivered row; every 50th row has no status yet, every 60th was rejected."""
    rows = _delivered(spark, d)
    raw = F.when(F.col("l_orderkey") % 60 == 0, "reject").when(F.col("l_orderkey") % 50 == 0, "").otherwise(F.col("delivery_status"))
    texture = F.when(F.col("l_linenumber") == 1, None).otherwise(F.col("visual_score"))
    # No texts on every third row, and scores moved up, so that each status occurs.
    texts = [F.when(F.col("l_orderkey") % 3 == 0, None).otherwise(F.col(k)) for k in ("delivery_reason", "recommended_usage")]
    status = gates.shown_status(raw, texts, F.col("text_clarity_score") + 30, texture, F.col("edge_quality_gain") * 5 + 63)
    tag = gates.benefit_tag(F.col("shown"), F.col("size_growth"), F.col("visible_benefit") * 5, F.col("clarity_score") * 2, texture)
    return rows.withColumn("shown", status).select(*KEY, "shown", tag.alias("benefit_tag"))


def review_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = _delivered(spark, d)
    tags = gates.review_tags(F.col("text_clarity_score") + 10, F.col("visual_score"), F.col("edge_quality_gain") * 5 + 63, F.col("size_growth"), F.col("visible_benefit") * 5, F.concat_ws(" ", "delivery_reason", "recommended_usage"), F.col("color_fidelity_score"))
    return rows.select(*KEY, F.array_join(tags, ";").alias("tags"))


def risk_labels(spark: SparkSession, d: str) -> DataFrame:
    f = fx.features(spark, d)
    return f.select(
        *KEY, risk_from_gain(F.col("face_detail_gain") * 2, F.col("hair_texture_gain") * 2).alias("gain_risk"), risk_within(F.col("pixel_diff"), 0.8, 1.6).alias("diff_risk"), log_score(F.col("clarity_score"), 16.0).alias("clarity_log"),
    )


def mode_profile(spark: SparkSession, d: str) -> DataFrame:
    """Parts by the profile that their type stands for; one in nine has a name that no profile has."""
    names = F.array(*[F.lit(p[0]) for p in batch.PROFILES], F.lit("unknown"))
    rows = fx.table(spark, d, "part").select(F.get(names, (F.col("p_partkey") % 9).cast("int")).alias("profile"))
    return batch.with_profile(rows).groupBy("profile").agg(
        F.count("*").alias("n"), F.max("output_suffix").alias("output_suffix"), F.max("cleanup_strength").alias("cleanup_strength"), F.max("micro_contrast").alias("micro_contrast"),
        F.max("sharpness").alias("sharpness"), F.max("high_frequency_guard").alias("high_frequency_guard"), F.max(F.try_element_at("material_weights", F.lit("glass"))).alias("glass_weight"),
        F.max(F.array_join("style_tags", ",")).alias("style_tags"), F.max("profile_error").alias("profile_error"),
    )


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return batch.batch_summary(fx.stages(spark, d), "task_status", "stage")


def regression_diff(spark: SparkSession, d: str) -> DataFrame:
    return batch.regression_diff(*fx.runs(spark, d))


def regression_counts(spark: SparkSession, d: str) -> DataFrame:
    return batch.match_counts(batch.regression_diff(*fx.runs(spark, d)))


def first_match_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Nations as items, customers as rows: the first customer of a nation or whose segment's number is the nation's."""
    items = fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("item"))
    rows = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("custkey"), F.col("c_nationkey").cast("long").alias("name1"), F.length("c_mktsegment").cast("long").alias("name2"))
    return batch.first_match(items, rows, "item", ("name1", "name2"), "custkey")


def latest_output_per_input(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each task and stage."""
    e = fx.stages(spark, d)
    return e.groupBy("task_id", "stage").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest_event"), F.max("ts").alias("latest_ts"))


def _probed(spark: SparkSession, d: str) -> DataFrame:
    return batch.probe(fx.probe_files(spark, d), fx.PROBE_PERCENT)


def compression_probe(spark: SparkSession, d: str) -> DataFrame:
    return _probed(spark, d).select("doc_id", "method", "role", "image_type", "candidate_size_bytes", "saved_bytes", "saved_ratio", "risk_level", "recommended_use")


def probe_method_summary(spark: SparkSession, d: str) -> DataFrame:
    return batch.method_summary(_probed(spark, d))


def probe_counts(spark: SparkSession, d: str) -> DataFrame:
    return batch.counts_by(_probed(spark, d), "image_type", "recommended_use", "risk_level")


def probe_top30(spark: SparkSession, d: str) -> DataFrame:
    return batch.top_candidates(_probed(spark, d))


def rename_stems(spark: SparkSession, d: str) -> DataFrame:
    return batch.stems(fx.naming_sources(spark, d)).select("ordinal", "position", "stem", "extension", "lacks")


def rename_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return batch.taken_names(batch.stems(fx.naming_sources(spark, d), "{industry}_{title}"))


def rename_plan(spark: SparkSession, d: str) -> DataFrame:
    return batch.rename_plan(batch.stems(fx.naming_sources(spark, d), "{industry}_{title}"))


def redact_text(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "documents").select("doc_id", "text", redact(F.col("text"), network=True).alias("redacted"))
    return rows.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), (F.col("redacted") != F.col("text")).alias("changed"))


def sanitized_names(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "documents").select("doc_id", sanitize(F.substring("text", 1, 30), "missing").alias("part"))


def task_progress(spark: SparkSession, d: str) -> DataFrame:
    return tasks.progress(fx.stages(spark, d))


def task_terminal_state(spark: SparkSession, d: str) -> DataFrame:
    return tasks.terminal_state(fx.stages(spark, d))


def task_timeout(spark: SparkSession, d: str) -> DataFrame:
    return tasks.timeouts(fx.stages(spark, d), 36_000)


def task_sessions(spark: SparkSession, d: str) -> DataFrame:
    return tasks.sessions(fx.stages(spark, d))


def task_windows(spark: SparkSession, d: str) -> DataFrame:
    return tasks.stream_windows(fx.stages(spark, d), "1 day")


def problem_code(spark: SparkSession, d: str) -> DataFrame:
    """The first problem of a run that holds; the facts come from orders."""
    k = F.col("o_orderkey")
    o = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), reports.problem(
        k % 23 != 0, k % 19, k % 17 != 0, k % 13 != 0, ~F.col("o_orderpriority").startswith("1-"), F.when(k % 7 == 0, "missing_input_images"), F.when(F.col("o_orderstatus") == "P", "BLOCKED").otherwise("DONE"), k % 3,
    ).alias("problem"))
    return o


def type_scores(spark: SparkSession, d: str) -> DataFrame:
    kind, confidence = reports.kind_by_scores(F.col("text_density") / 10, F.col("edge_density"), F.col("texture_density") * 4, F.col("skin_ratio"), F.col("low_saturation_ratio"), F.col("dark_ratio") / 4)
    return fx.features(spark, d).select(*KEY, kind.alias("kind"), confidence.alias("confidence"))


def mode_strengths(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("l_linenumber") == 2, "sharp_4k").when(F.col("l_linenumber") == 3, "ai_image_clean").otherwise(F.col("mode"))
    return fx.features(spark, d).select(*KEY, *[v.alias(f"{k}_strength") for k, v in reports.mode_strengths(mode, F.col("image_type")).items()])


def qa_decision(spark: SparkSession, d: str) -> DataFrame:
    rows = _probed(spark, d)
    verdict = reports.candidate_verdict(F.col("image_type"), F.col("method"), F.col("saved_ratio"), (F.col("doc_id") % 20 + 38).cast("double"), F.col("doc_id") % 4 != 0)
    return rows.select("doc_id", "method", verdict.alias("v")).select("doc_id", "method", "v.verdict", "v.scope", "v.risk")


def screen_size_plan(spark: SparkSession, d: str) -> DataFrame:
    return reports.screen_size(fx.features(spark, d)).select(*KEY, "screen_width", "screen_height", "screen_rule")


def quality_compare(spark: SparkSession, d: str) -> DataFrame:
    score, apparent = reports.fidelity(F.col("color_fidelity_score") - 8, F.col("blur_risk") * 20, F.col("clarity_gain"), F.col("text_clarity_gain") * 2, F.col("edge_quality_gain") * 2, F.col("hair_texture_gain"))
    return fx.features(spark, d).select(*KEY, score.alias("fidelity_score"), apparent.alias("is_apparent"))


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    """Signals and the kind of review of each delivered row."""
    rows = _delivered(spark, d)
    tags = gates.review_tags(F.col("text_clarity_score") + 20, F.col("visual_score") + 5, F.col("edge_quality_gain") * 5 + 65, F.col("size_growth"), F.col("visible_benefit") * 5, F.col("delivery_reason"), F.col("color_fidelity_score") + 3)
    signals = reports.positive_signals(F.col("clarity_score") * 1.5, F.col("text_clarity_score"), F.col("edge_quality_gain") + 64, F.col("visual_score"), F.col("color_fidelity_score"), F.col("visible_benefit"))
    return rows.select(*KEY, F.array_join(signals, ";").alias("signals"), reports.review_type(F.col("delivery_status"), tags).alias("review_type"))


def image_kind_tag(spark: SparkSession, d: str) -> DataFrame:
    return fx.features(spark, d).select(*KEY, gates.kind_tag(F.col("image_type"), F.col("has_real_alpha")).alias("kind_label"))


def batch_report(spark: SparkSession, d: str) -> DataFrame:
    """The report's rows: shown status, its label, benefit and suggested usage; every fifth row came without a usage of its own."""
    rows = _delivered(spark, d)
    raw = F.when(F.col("l_orderkey") % 60 == 0, "reject").when(F.col("l_orderkey") % 50 == 0, "").otherwise(F.col("delivery_status"))
    rows = rows.withColumn("shown", gates.shown_status(raw, [F.col("delivery_reason")], F.col("text_clarity_score") + 40, F.col("visual_score") + 20, F.col("edge_quality_gain") + 70))
    usage = reports.suggested_usage(F.col("shown"), F.when(F.col("l_orderkey") % 5 == 0, "").otherwise(F.col("recommended_usage")))
    return rows.select(*KEY, "shown", reports.by_status(F.col("shown"), reports.SHOWN_LABELS).alias("user_status_label"), usage.alias("suggested_usage"))


def batch_report_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = batch_report(spark, d)
    count = lambda status: F.count_if(F.col("shown") == status)
    return rows.agg(F.count("*").alias("total"), count("PASS").alias("n_pass"), count("PASS_WITH_LIMITATION").alias("n_manual_review"), count("FAIL").alias("n_not_recommended"))


def raster_morphology(spark: SparkSession, d: str) -> DataFrame:
    return metrics.morphology(fx.px(spark, d))


def raster_stretch(spark: SparkSession, d: str) -> DataFrame:
    return metrics.stretched(fx.px(spark, d))


def raster_color_cast(spark: SparkSession, d: str) -> DataFrame:
    return metrics.color_cast(fx.px3(spark, d))


def free_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of part-like files that no finished run has: document files against those of every third document, in capitals."""
    files = fx.probe_files(spark, d).select("doc_id", F.col("file_name").alias("name"))
    return batch.free_names(files, files.where("doc_id % 3 = 0").select(F.upper("name").alias("name")))


def probe_risk_sets(spark: SparkSession, d: str) -> DataFrame:
    return batch.risk_sets(_probed(spark, d))


def probe_method_order(spark: SparkSession, d: str) -> DataFrame:
    return batch.in_order(_probed(spark, d), ["jpg_q95", "webp_q94", "png_optimize"])


def stage_order(spark: SparkSession, d: str) -> DataFrame:
    """The stages that a task has seen against those that are supported."""
    seen = fx.stages(spark, d).groupBy("task_id").agg(F.array_sort(F.collect_set("stage")).alias("stages"))
    more, less = batch.unsupported(F.col("stages"), F.array(*[F.lit(x) for x in ("click", "export", "view")]))
    return seen.select("task_id", more.alias("unsupported"), less.alias("missing"))


def client_progress(spark: SparkSession, d: str) -> DataFrame:
    """What a client shows: at least 35 percent, and the stage of five that this stands for."""
    rows = tasks.progress(fx.stages(spark, d))
    shown = F.greatest(F.lit(35), F.col("progress"))
    return rows.select("task_id", "event_id", shown.alias("shown"), F.least(F.lit(4), F.floor(shown / 100 * 5)).cast("int").alias("stage_index"))


def next_actions(spark: SparkSession, d: str) -> DataFrame:
    return fx.features(spark, d).select(*KEY, F.array_join(planning.next_actions(), ";").alias("actions"), *planning.suggested_strengths())


def output_plan(spark: SparkSession, d: str) -> DataFrame:
    """Profiles and formats as people type them: in capitals, with blanks and dots, unknown or not at all."""
    asked = F.expr("CASE WHEN output_profile <> 'delivery_1080p' THEN CONCAT('  ', UPPER(output_profile)) WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 3 = 1 THEN 'studio_4k' ELSE output_profile END")
    rows = fx.features(spark, d).withColumn("output_profile", asked).withColumn("requested_format", F.expr("CASE WHEN l_orderkey % 2 = 0 THEN CONCAT('.', requested_format, ' ') ELSE requested_format END"))
    return planning.output_plan(rows).select(*KEY, "selected_output_profile", "selected_output_format", "aspect", "target_width", "target_height", "resize_policy", "was_upscaled")


def long_edge_size(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.features(spark, d).withColumn("width", F.expr("CASE WHEN l_orderkey % 50 = 0 THEN 0 ELSE width END"))
    w, h = planning.long_edge_size(F.col("width"), F.col("height"))
    return rows.select(*KEY, w.alias("target_width"), h.alias("target_height"))


def enhance_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.features(spark, d).select(
        *KEY, F.expr("CASE l_orderkey % 12 WHEN 0 THEN '客户头像' WHEN 1 THEN '夏季广告' ELSE 'img' END").alias("name"), "skin_ratio", F.col("text_density").alias("text_ratio"),
        F.col("edge_density").alias("edge_ratio"), (F.col("color_pollution") / 5).alias("high_sat_ratio"), F.col("highlight_risk").alias("light_bg_ratio"),
    )
    found = F.split(planning.enhance_scope(F.col("name")), r"\|")
    return rows.select(*KEY, found[0].alias("scope"), found[1].alias("reason"))


def report_usage(spark: SparkSession, d: str) -> DataFrame:
    own, status = F.expr("CASE WHEN l_orderkey % 10 = 0 THEN '仅供存档' WHEN l_orderkey % 10 = 1 THEN ' ' END"), F.expr("CASE WHEN l_orderkey % 7 = 0 THEN 'FAIL' ELSE 'PASS' END")
    benefit = F.when(F.col("l_linenumber") == 4, planning.LOW_BENEFIT)
    return fx.features(spark, d).select(*KEY, planning.usage_by_kind(own, status, benefit, F.col("image_type")).alias("suggested_usage"))


def crop_box(spark: SparkSession, d: str) -> DataFrame:
    """A crop of 160 x 120 moved inside its image, and the same crop in the image at 1920 x 1080."""
    rows = fx.features(spark, d).withColumn("x", F.expr("CAST(l_orderkey * 7 % 3200 - 200 AS INT)")).withColumn("y", F.expr("CAST(l_orderkey * 11 % 2300 - 200 AS INT)"))
    box = planning.clamped_box(F.col("x"), F.col("y"), F.lit(160), F.lit(120), F.col("width"), F.col("height"))
    inside = rows.select(*KEY, "width", "height", *[b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"), strict=True)])
    scaled = planning.scaled_box(tuple(F.col(n) for n in ("x0", "y0", "x1", "y1")), (F.col("width"), F.col("height")), (F.lit(1920), F.lit(1080)))
    return inside.select(*KEY, "x0", "y0", "x1", "y1", *[b.alias(f"{n}_scaled") for b, n in zip(scaled, ("x0", "y0", "x1", "y1"), strict=True)])


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth file was skipped, with a reason; the others have a size."""
    files = fx.probe_files(spark, d)
    skipped = files.where("doc_id % 4 = 0").select("doc_id", "file_name", F.when(F.col("has_alpha"), "alpha").otherwise("excluded").alias("skip_reason"))
    return planning.report_rows(files.where("doc_id % 4 <> 0").select("doc_id", "file_name", "original_size_bytes"), skipped)


def probe_rows_by_file(spark: SparkSession, d: str) -> DataFrame:
    return planning.rows_by_file(_probed(spark, d), "file_name", "method")


def parsed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The first value present of three, and as a whole number."""
    values = [F.expr(e) for e in ("CASE WHEN o_orderkey % 3 = 0 THEN '' END", "CASE o_orderkey % 4 WHEN 0 THEN ' 12 ' WHEN 1 THEN '' WHEN 2 THEN '3.5' END", "CAST(o_orderkey AS STRING)")]
    found = fx.table(spark, d, "orders").select("o_orderkey", planning.first_present(*values).alias("value"))
    return found.select("o_orderkey", "value", planning.int_or_null(F.col("value")).alias("number"))


def run_deltas(spark: SparkSession, d: str) -> DataFrame:
    before, after = fx.runs(spark, d)
    return planning.metric_deltas(before, after, "sample_id", "score")


def task_requests(spark: SparkSession, d: str) -> DataFrame:
    """One request by task: some ask for the latest task, some for one that is unknown."""
    events = fx.stages(spark, d)
    asked = F.expr("CASE WHEN task_id % 50 = 0 THEN 'default' WHEN task_id % 7 = 0 THEN CONCAT('x', CAST(task_id AS STRING)) WHEN task_id % 7 = 1 THEN '-1' ELSE CAST(task_id AS STRING) END")
    return tasks.requested(events.select(F.col("task_id").alias("request_id"), asked.alias("asked")).distinct(), events)


ALL = (
    next_actions, output_plan, long_edge_size, enhance_scope, report_usage, crop_box, report_rows, probe_rows_by_file, parsed_numbers, run_deltas, task_requests,
    raster_basic_metrics, raster_box_contrast, raster_sobel_edge_score, raster_dilate_erode, raster_block_probe, raster_color_state, raster_color_drift, raster_pixel_difference, raster_resize_nearest,
    raster_resize_area, raster_best_window, raster_quality_summary, raster_texture, raster_mid_frequency, raster_local_contrast, raster_smooth_region, raster_highlight_compress, raster_skin_saturation, raster_channel_match,
    raster_artifact_masks, raster_unsharp, raster_resize_cubic, raster_png, mask_set_ops, classify_type, target_size_plan, choose_format, material_policy, edge_policy, low_quality_policy, visual_policy,
    strategy_from_rules, visual_gate, compression_gate, delivery_guard, delivery_summary, delivery_status, review_tags, risk_labels, mode_profile, batch_summary, regression_diff, regression_counts,
    first_match_lookup, latest_output_per_input, compression_probe, probe_method_summary, probe_counts, probe_top30, rename_stems, rename_conflicts, rename_plan, redact_text, sanitized_names,
    task_progress, task_terminal_state, task_timeout, task_sessions, task_windows, problem_code, type_scores,
    mode_strengths, qa_decision, screen_size_plan, quality_compare, report_summary, raster_morphology, raster_stretch, raster_color_cast, free_names, probe_risk_sets, probe_method_order, stage_order,
    client_progress, image_kind_tag, batch_report, batch_report_summary,
)
