"""Stencils on whole planes against those by windows and joins, and what the gains write and read on the way."""

import random

import pytest
from pyspark.sql import functions as F

from lumenmill.functions import tables
from lumenmill.functions.color import gray
from lumenmill.operators import gains, planes, regions, stencils
from lumenmill.plans import drawings

SF = "/root/testdata/sf0.001"
PX = "image_id string, y long, x long, b int, g int, r int"
SIZES = [(1, 1), (1, 9), (7, 1), (2, 3), (3, 2), (9, 8), (23, 41), (70, 60)]


def images(spark, seed=5):
    rng, rows = random.Random(seed), []
    for i, (h, w) in enumerate(SIZES):
        steps = rng.choice((1, 7, 60))
        rows += [(f"i{i}", y, x, *[rng.randrange(0, 256, steps) // (1 + (x > w // 2)) for _ in "bgr"]) for y in range(h) for x in range(w)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, PX)


def by_windows(px3):
    """What gains._made says, from windows and joins."""
    px = px3.select("image_id", "y", "x", gray(F.col("b"), F.col("g"), F.col("r")).alias("l"))
    gx, gy = stencils.sobel()
    rows = stencils.neighbours(px).withColumns({"lap": stencils.laplacian(), "steep": F.sqrt(gx * gx + gy * gy)})
    rows = stencils.gaussian(stencils.gaussian(rows, 1.35, "wide"), 1.15, "narrow")
    rows = stencils.box(stencils.box(rows, 3, F.sum, "around"), 8, F.sum, "total")
    marks = regions.edge_sets(px, {"text_edge": (60, 160), "dark_edge": (45, 135)}, squared=False)
    rows = rows.withColumns({n: stencils.quantized(F.round(n, 9)) for n in ("wide", "narrow")})
    return rows.join(marks, ["image_id", "y", "x"], "left").fillna(False, ["text_edge", "dark_edge"])


@pytest.mark.parametrize("batch", [10, 10_000])
def test_planes_say_what_windows_say(spark, batch, monkeypatch):
    """Also where an image is many Arrow batches and many bands."""
    monkeypatch.setattr(planes, "BAND", 300 if batch == 10 else planes.BAND)
    names = ["lap", "steep", "wide", "narrow", "around", "total", "text_edge", "dark_edge"]
    px3 = images(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        px = px3.withColumn("l", gray(F.col("b"), F.col("g"), F.col("r")))
        got = {(r.image_id, r.y, r.x): r for r in planes.on_planes(px, gains._made, gains.MADE).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = by_windows(px3).collect()
    assert len(got) == len(want) == sum(h * w for h, w in SIZES)
    for r in want:
        for n in names:
            assert got[r.image_id, r.y, r.x][n] == pytest.approx(r[n], abs=1e-9), (r.image_id, r.y, r.x, n)
    assert 0 < sum(r.text_edge for r in want) < sum(r.dark_edge for r in want)


def test_edges_wind_far_from_a_strong_pixel():
    np = planes.np
    size = np.full((41, 41), -1)
    for y in range(0, 41, 2):
        size[y] = 50
        if y + 1 < 41:
            size[y + 1, 0 if y % 4 else 40] = 50
    assert not planes.edges(size, 45, 135).any()
    size[40, 40] = 200
    assert (planes.edges(size, 45, 135) == (size > 45)).all() and planes.edges(size, 60, 160).sum() == 1


def test_a_repeated_pixel_counts_as_often_and_a_missing_one_is_told(spark):
    px3 = images(spark).where("image_id = 'i6'")
    assert gains.version_signals(px3.union(px3)).drop("sharpness").first() == pytest.approx(gains.version_signals(px3).drop("sharpness").first())
    for odd in (px3.where("NOT (y = 4 AND x = 7)"), px3.withColumn("y", F.col("y") - 1), px3.withColumn("g", F.when(F.col("x") != 3, F.col("g")))):
        with pytest.raises(Exception, match="lacks pixels|has no l"):
            gains.version_signals(odd).collect()


def test_masks_of_text_and_their_stand_in(spark):
    px3 = images(spark)
    total = stencils.box(px3.withColumn("l", gray(F.col("b"), F.col("g"), F.col("r"))), 8, F.sum, "total")
    mask = total.where("l <= floor(total / 289.0 + 0.5) - 8").select("image_id", "y", "x", F.lit(1.0).alias("weight"))
    by = lambda df: {r.image_id: tuple(r)[1:] for r in df.collect()}
    a, b, none = by(gains.version_signals(px3, mask)), by(gains.version_signals(px3, strokes=True)), by(gains.version_signals(px3))
    assert all(a[k] == pytest.approx(b[k]) for k in a) and len(a) == len(none) == len(SIZES)
    assert a["i6"][2] > 0.1 and all(v[2] == 0 and v[3] == v[0] for v in none.values())


def test_the_difference_does_not_hang_on_the_order_of_pixels(spark):
    px = images(spark).select("image_id", "y", "x", *[F.col(k).alias(f"{k}0") for k in "bgr"], *[((F.col(k) * 7 + F.col("x")) % 256).alias(f"{k}1") for k in "bgr"])
    results = {tuple(sorted(map(tuple, gains.pair_difference(px.repartition(n).orderBy(F.xxhash64("y", "x", F.lit(n)))).collect()))) for n in (1, 3, 4)}
    assert len(results) == 1


@pytest.mark.parametrize("name", ["gains", "gates"])
def test_no_pixel_is_written_or_joined(spark, monkeypatch, name):
    written = []

    def settled(df):
        written.append((df.count(), df._jdf.queryExecution().optimizedPlan().toString()))
        return tables.settled(df)

    for module in (regions, gains):
        monkeypatch.setattr(module, "settled", settled)
    df = getattr(drawings, f"drawing_{name}")(spark, SF)
    [(rows, plan)] = written
    assert rows == df.count() == drawings.fx.table(spark, SF, "supplier").count()
    assert plan.count("Join") == 2 and plan.count("MapInArrow") == 2
