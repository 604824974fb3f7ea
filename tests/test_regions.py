"""Regions, edges, lines, summed areas and local contrast against brute force and on planted shapes."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenmill.operators import areas, gains, regions, stencils, tone

MASK = "image_id long, y long, x long"
PX = MASK + ", l int"


def flooded(pixels):
    """Regions of a set of (y, x), 8-connected: first pixel, all pixels."""
    left, found = set(pixels), []
    for start in sorted(pixels):
        if start in left:
            stack, region = [start], set()
            left.discard(start)
            while stack:
                y, x = stack.pop()
                region.add((y, x))
                for p in ((y + j, x + k) for j in (-1, 0, 1) for k in (-1, 0, 1)):
                    if p in left:
                        left.discard(p)
                        stack.append(p)
            found.append((start, region))
    return found


def spiral(side):
    """A line of one pixel that winds inward, two pixels apart: one region with about side runs in every row."""
    pixels, y, x, dy, dx = set(), 0, 0, 0, 1
    inside = lambda a, b: 0 <= a < side and 0 <= b < side
    while True:
        pixels.add((y, x))
        ahead = (y + dy, x + dx), (y + 2 * dy, x + 2 * dx)
        if not inside(*ahead[0]) or inside(*ahead[1]) and ahead[1] in pixels:
            dy, dx = dx, -dy
            if not inside(y + dy, x + dx) or (y + 2 * dy, x + 2 * dx) in pixels:
                return pixels
        y, x = y + dy, x + dx


def test_regions_of_any_shape(spark):
    rng = random.Random(3)
    images = [spiral(41), {(y, x) for y in range(12) for x in range(12) if (x + y) % 2}, {(0, 0)}, {(5, x) for x in range(0, 400, 2)} | {(6, x) for x in range(1, 400, 4)}]
    images += [{(y, x) for y in range(30) for x in range(150) if rng.random() < share} for share in (0.1, 0.35, 0.45, 0.6)]
    df = spark.createDataFrame([(i, y, x) for i, image in enumerate(images) for y, x in image] * 2, MASK).withColumn("region", F.lit("clash"))
    got = {(r.image_id, r.first_y, r.first_x): (r.area, r.x0, r.y0, r.width, r.height, r.mean_x, r.mean_y) for r in regions.regions(df).collect()}
    want = {}
    for i, image in enumerate(images):
        for (y, x), region in flooded(image):
            ys, xs = [p[0] for p in region], [p[1] for p in region]
            want[i, y, x] = (len(region), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, round(sum(xs) / len(xs), 4), round(sum(ys) / len(ys), 4))
    assert {k: v[:5] for k, v in got.items()} == {k: v[:5] for k, v in want.items()}
    assert all(abs(a - b) < 2e-4 for k in want for a, b in zip(got[k][5:], want[k][5:], strict=True))
    assert sum(k[0] == 0 for k in got) == 1 and len(spiral(41)) > 800


def test_regions_of_nothing(spark):
    none = spark.createDataFrame([], MASK)
    assert regions.regions(none).collect() == [] and regions.stable_regions(none).collect() == []
    sizes = spark.createDataFrame([(1, 10, 10)], "image_id long, width long, height long")
    assert [tuple(r) for r in regions.region_stats(sizes, none).collect()] == [(1, 0, 0.0, 0.0, 0.0, 0.0, 0.0)]


def test_thirds(spark):
    mask = [(1, y, x) for y in range(4) for x in range(5)] + [(1, 15, x) for x in range(3)] + [(1, y, x) for y in range(26, 30) for x in range(10)]
    sizes = spark.createDataFrame([(1, 20, 30)], "image_id long, width long, height long")
    r = regions.region_stats(sizes, spark.createDataFrame(mask, MASK)).first()
    assert tuple(r) == (1, 2, round(63 / 600, 6), round(40 / 600, 6), round(20 / 600, 6), 0.0, round(40 / 600, 6))


def image(spark, rows, key=0):
    return spark.createDataFrame([(key, y, x, v) for y, line in enumerate(rows) for x, v in enumerate(line)], PX)


def test_weak_edges_stay_where_they_hang_on_strong_ones(spark):
    """A step that fades from 200 to 20 along its length, and a weak step alone."""
    rows = [[100] * 60 for _ in range(40)]
    for y in range(40):
        for x in range(20, 40):
            rows[y][x] = 100 + max(20, 200 - 5 * y) // 2
        for x in range(50, 60):
            rows[y][x] = 110
    got = {(r.y, r.x) for r in regions.edges(image(spark, rows), 30, 300, squared=False).collect()}
    columns = Counter(x for _, x in got)
    assert columns and all(18 <= x <= 41 for x in columns) and max(y for y, _ in got) == 39
    strong_only = {(r.y, r.x) for r in regions.edges(image(spark, rows), 300, 300, squared=False).collect()}
    assert strong_only < got and max(y for y, _ in strong_only) < 30


def test_flat_images_have_no_edges(spark):
    assert regions.edges(image(spark, [[148] * 24] * 36)).collect() == []


def test_planted_segments_are_found(spark):
    """Two rules in one line with a wide gap between them, an upright, a diagonal, and speckles."""
    rng = random.Random(2)
    flat = [(10, x) for x in [*range(5, 45), *range(60, 100)]]
    upright = [(y, 120) for y in range(20, 70)]
    slant = [(30 + t, 20 + t) for t in range(40)]
    speckles = [(rng.randrange(90, 120), rng.randrange(0, 130)) for _ in range(30)]
    mask = spark.createDataFrame([(7, y, x) for y, x in {*flat, *upright, *slant, *speckles}], MASK)
    got = {(r.theta, r.x0, r.y0, r.x1, r.y1) for r in regions.line_segments(mask, least_votes=30, least_length=20, most_gap=5).collect()}
    ends = {(t, *sorted([(x0, y0), (x1, y1)])) for t, x0, y0, x1, y1 in got}
    assert ends == {(90, (5, 10), (44, 10)), (90, (60, 10), (99, 10)), (0, (120, 20), (120, 69)), (135, (20, 30), (59, 69))}


@pytest.mark.parametrize("start", [0, -3])
def test_windows_in_four_lookups(spark, start):
    rng = random.Random(start)
    sizes = {1: (9, 7), 2: (1, 1), 3: (5, 20)}
    values = {(i, y, x): rng.randrange(50) for i, (w, h) in sizes.items() for y in range(start, start + h) for x in range(start, start + w)}
    px = spark.createDataFrame([(*k, v) for k, v in values.items()], MASK + ", v long")
    asked = []
    for i, (w, h) in sizes.items():
        for n in range(30):
            (x0, x1), (y0, y1) = (sorted(rng.randrange(start, start + s) for _ in range(2)) for s in (w, h))
            asked.append((i, n, x0, y0, x1, y1))
    windows = spark.createDataFrame(asked, "image_id long, n long, x0 long, y0 long, x1 long, y1 long")
    got = {(r.image_id, r.n): r.v for r in areas.window_sums(areas.summed_area(px, "v"), windows, ["n"], "v").collect()}
    assert got == {(i, n): sum(v for (j, y, x), v in values.items() if j == i and x0 <= x <= x1 and y0 <= y <= y1) for i, n, x0, y0, x1, y1 in asked}


def test_crops_go_where_the_detail_is(spark):
    rows = [[120] * 200 for _ in range(150)]
    for y in range(100, 130):
        for x in range(140, 180):
            rows[y][x] = 255 * ((x + y) % 2)
    px = image(spark, rows)
    for crops in (areas.texture_crops(px, 60, 48), areas.focus_boxes(px)):
        x0, y0, x1, y1 = tuple(crops.first())[1:]
        assert 0 <= x0 < 160 and x0 + 20 < 160 < x1 <= 200 and y0 < 115 < y1 <= 150
    assert [tuple(r) for r in areas.focus_boxes(image(spark, [[1] * 80] * 90)).collect()] == [(0, 0, 0, 80, 90)]
    assert [tuple(r)[1:] for r in areas.review_crops(px, most=4).orderBy("place").collect()][-1][1] in ("background_text_edge", "center_subject")


def test_local_contrast_spreads_and_keeps_flat_images(spark):
    flat = tone.local_equalized(image(spark, [[128] * 24] * 36), 2.0).collect()
    assert len(flat) == 24 * 36 and len({r.l for r in flat}) == 1
    rng = random.Random(1)
    dull = image(spark, [[120 + rng.randrange(16) for _ in range(67)] for _ in range(45)])
    spread = lambda df: df.agg(F.stddev("l")).first()[0]
    assert spread(tone.micro_contrast(dull, 1.0)) > 1.5 * spread(dull)
    assert spread(tone.micro_contrast(dull, 0)) == pytest.approx(spread(dull))


def test_padding_by_a_column(spark):
    df = image(spark, [[1, 2, 3], [4, 5, 6]])
    assert {(r.y, r.x): r.l for r in stencils.padded(df, F.lit(2)).collect()} == {(r.y, r.x): r.l for r in stencils.padded(df, 2).collect()}


def test_edges_of_several_thresholds_at_once(spark):
    rng = random.Random(8)
    px = image(spark, [[rng.randrange(0, 255, 40) for _ in range(30)] for _ in range(20)])
    both = regions.edge_sets(px, {"soft": (45, 135), "hard": (200, 600)}, squared=False).collect()
    for name, low, high in (("soft", 45, 135), ("hard", 200, 600)):
        assert {(r.y, r.x) for r in both if r[name]} == {(r.y, r.x) for r in regions.edges(px, low, high, squared=False).collect()}


def test_gains_of_an_image_that_did_not_change_and_of_a_blurred_one(spark):
    rng = random.Random(3)
    gray = [[rng.randrange(60, 200) for _ in range(33)] for _ in range(21)]
    rgb = lambda px: px.select("image_id", "y", "x", *[F.col("l").alias(k) for k in "bgr"])
    px = image(spark, gray)
    soft = stencils.gaussian(px, 1.5, "v").select("image_id", "y", "x", stencils.quantized(F.col("v")).alias("l"))
    same, lost = gains.quality_gains(rgb(px), rgb(px)).first(), gains.quality_gains(rgb(px), rgb(soft)).first()
    assert all(same[k] == 0 for k in same.asDict() if k.endswith("_gain")) and same.color_fidelity_score == 100 and same.pixel_diff_from_reference == 0
    assert lost.clarity_gain < -5 and lost.edge_quality_gain < 0 and lost.over_smoothing_risk == "high" and lost.color_fidelity_score < 100
    assert gains.quality_gains(rgb(px), rgb(px).where("false")).collect() == []
