"""Properties and brute force for what SQL does not check."""

import random
import re
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenmill.functions.ranks import numbered
from lumenmill.functions.scalars import labels, ladder, normalize, redact, sanitize, truthy_text
from lumenmill.operators import batch, policies, stencils
from lumenmill.streaming import tasks


def test_published_target_sizes(spark):
    sizes = {(500, 333): (1622, 1080), (160, 100): (1728, 1080), (320, 180): (1920, 1080), (120, 80): (1620, 1080)}
    df = spark.createDataFrame([(w, h, "delivery_1080p") for w, h in sizes], "width int, height int, output_profile string")
    assert {(r.width, r.height): (r.target_width, r.target_height) for r in policies.target_size(df).collect()} == sizes


def test_ladder_takes_the_first_rung_that_holds(spark):
    x = F.col("x")
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int").select(ladder((x > 3, "big"), (x > 0, "small"), otherwise="none").alias("v"), labels((x > 0, "a"), (x > 3, "b"), default="c").alias("l"))
    assert [(r.v, r.l) for r in df.collect()] == [("small", ["a"]), ("big", ["a", "b"]), ("none", ["c"])]


def test_scalars(spark):
    one = spark.createDataFrame([("  a<b>:c \n d.. ", "YES ", "token = abc, mail me@x.org")], "n string, t string, r string")
    got = one.select(sanitize(F.col("n"), "m"), truthy_text(F.col("t")), redact(F.col("r")), normalize(F.lit(3.0), 5, 5), sanitize(F.lit(" . "), "m")).first()
    assert tuple(got) == ("a_b__c _ d", True, "<redacted>, mail <redacted>", 0.0, "m")


#: One pixel, one row, one column, sides under every radius, and sides that are not equal.
SIZES = [(1, 1), (1, 7), (5, 1), (2, 3), (6, 6), (19, 4), (64, 48)]


def reflected(t, side):
    while not 0 <= t < side:
        t = 0 if side == 1 else -t if t < 0 else 2 * (side - 1) - t
    return t


@pytest.fixture(scope="module")
def mixed(spark):
    """Images of all sizes in one table, and as lists."""
    rng = random.Random(1)
    images = [[[rng.randrange(256) for _ in range(w)] for _ in range(h)] for w, h in SIZES]
    df = spark.createDataFrame([(i, y, x, v) for i, image in enumerate(images) for y, line in enumerate(image) for x, v in enumerate(line)], "image_id long, y long, x long, l int")
    return df.repartition(3), images


@pytest.mark.parametrize("radius", [1, 3, 6])
def test_box_reflects_at_the_border(mixed, radius):
    df, images = mixed
    span = range(-radius, radius + 1)
    total = lambda image, y, x: sum(image[reflected(y + j, len(image))][reflected(x + k, len(image[0]))] for j in span for k in span)
    want = {(i, y, x): total(image, y, x) for i, image in enumerate(images) for y in range(len(image)) for x in range(len(image[0]))}
    assert {(r.image_id, r.y, r.x): r.s for r in stencils.box(df, radius, F.sum, "s").collect()} == want


def test_neighbours_of_images_of_any_size(mixed):
    df, images = mixed
    at = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1), "ul": (-1, -1), "ur": (-1, 1), "dl": (1, -1), "dr": (1, 1)}
    got = stencils.neighbours(df).collect()
    assert len(got) == sum(w * h for w, h in SIZES)
    for r in got:
        image = images[r.image_id]
        for name, (j, k) in at.items():
            assert r[name] == image[reflected(r.y + j, len(image))][reflected(r.x + k, len(image[0]))]


def test_gaussian_of_images_of_any_size(mixed):
    df, images = mixed
    half = stencils.weights(2.0)
    kernel = {k: half[abs(k)] for k in range(1 - len(half), len(half))}
    for r in stencils.gaussian(df, 2.0, "v").collect():
        image = images[r.image_id]
        want = sum(a * b * image[reflected(r.y + j, len(image))][reflected(r.x + k, len(image[0]))] for j, a in kernel.items() for k, b in kernel.items())
        assert abs(r.v - want) < 1e-6


def test_resizes_of_images_of_any_size(mixed):
    df, images = mixed
    want = {(i, y, x): image[y * len(image) // 5][x * len(image[0]) // 9] for i, image in enumerate(images) for y in range(5) for x in range(9)}
    assert {(r.image_id, r.y, r.x): r.l for r in stencils.resize_nearest(df, 9, 5).collect()} == want
    for resize in (stencils.resize_cubic, stencils.resize_lanczos):
        same = resize(df.where("image_id = 5"), 19, 4).collect()
        assert {(r.y, r.x): r.l for r in same} == {(y, x): images[5][y][x] for y in range(4) for x in range(19)}
        assert resize(df, 9, 5).count() == len(SIZES) * 45


def test_rename_plan_of_one_large_family(spark):
    n = 30_000
    df = spark.range(n).select(F.col("id").alias("ordinal"), F.lit("x").alias("source_name"), F.lit("en_missing").alias("stem"), F.lit(".png").alias("extension"), F.lit(False).alias("lacks"))
    start = time.monotonic()
    got = {r.ordinal: r.target_name for r in batch.rename_plan(df).collect()}
    assert time.monotonic() - start < 45  # number by number from the start, this takes n * n / 2 steps
    assert got == {i: "en_missing.png" if i == 0 else f"en_missing_{i + 1:02d}.png" for i in range(n)}


def one_by_one(names, existing=()):
    used, want = {e.lower() for e in existing}, {}
    for i, stem, ext in names:
        name, n = stem + ext, 1
        while name.lower() in used:
            n += 1
            name = f"{stem}_{n:02d}{ext}"
        used.add(name.lower())
        want[i] = (name, "needs_confirmation" if i % 5 == 0 else "ready" if n == 1 else "conflict_resolved")
    return want


@pytest.mark.parametrize("seed", [4, 5])
def test_rename_plan_against_one_by_one(spark, seed):
    rng = random.Random(seed)
    names = [(i, rng.choice(["a", "A", "b", "a_02", "a_02_02", "a_03", "c", "dd_7", "a_99", "b_100", "b_002"]), rng.choice([".png", ".jpg"])) for i in range(120)]
    df = spark.createDataFrame([(i, s + e, i, s, e, i % 5 == 0) for i, s, e in names], "ordinal long, source_name string, position long, stem string, extension string, lacks boolean")
    existing = ["a.png", "A_04.PNG", "b_02.jpg", "a_02.jpg", "zz.png", "a_02_02_03.png", "noext"]
    for there in ([], existing):
        plan = batch.rename_plan(df, spark.createDataFrame([(e,) for e in there], "name string") if there else None)
        assert {r.ordinal: (r.target_name, r.status) for r in plan.collect()} == one_by_one(names, there)


def test_rename_plan_of_camera_names(spark):
    """One file beside many literal numbers out of its reach, and a family of many files whose numbers are all taken literally."""
    n = 5_000
    names = [(0, "img", ".jpg"), *[(i, f"img_{100_000 + i}", ".jpg") for i in range(1, n)]]
    names += [(n + i, "dsc", ".jpg") if i % 2 else (n + i, f"dsc_{i + 2:02d}", ".jpg") for i in range(n)]
    df = spark.createDataFrame([(i, s + e, i, s, e, i % 5 == 0) for i, s, e in names], "ordinal long, source_name string, position long, stem string, extension string, lacks boolean")
    start = time.monotonic()
    got = {r.ordinal: (r.target_name, r.status) for r in batch.rename_plan(df).collect()}
    assert time.monotonic() - start < 90
    assert got == one_by_one(names)


def test_fields_come_from_the_file_then_the_system_or_by_hand(spark):
    rows = [(1, "x.jpeg", "Food", "", None), (2, "y.png", None, "t", ""), (3, "z", "a", "b", "By hand. "), (4, "w." + "e" * 60, "c", "d", None)]
    df = spark.createDataFrame(rows, "ordinal long, source_name string, industry string, title string, given string")
    got = batch.stems(df, "{industry}-{mode}_{title}_{index}", system={"industry": F.lit("any"), "mode": F.lit("m")}, manual="given").orderBy("ordinal").collect()
    assert [(r.stem, r.extension, r.lacks) for r in got] == [("Food-m_missing_001", ".jpeg", True), ("any-m_t_002", ".png", False), ("By hand", "", False), ("c", "." + "e" * 60, False)]


def test_numbers_of_a_hot_group(spark):
    rng = random.Random(8)
    data = [(i, "hot" if i % 3 else rng.choice([None, "a", "b"])) for i in rng.sample(range(10**6), 2000)]
    df = spark.createDataFrame(data, "ordinal long, key string").repartition(5)
    place, want = {}, {}
    for i, key in sorted(data):
        place[key] = want[i] = place.get(key, 0) + 1
    assert {r.ordinal: r.n for r in numbered(df, "ordinal", "n", by=("key",), buckets=16).collect()} == want
    assert [r.n for r in numbered(df, "ordinal", "n").orderBy("ordinal").collect()] == list(range(1, 2001))
    assert numbered(df.where("false"), "ordinal", "n").collect() == []


def test_mail_addresses_in_long_runs(spark):
    texts = ["a.b+c@d.org", "x@y.comz@w.de", "a@b.com_x@y.org", "@a.bc a@b a@b.c", "é_1@ü.io,b@c.dd", "a" * 200_000, "a." * 50_000 + "@", "m@" * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    start = time.monotonic()
    got = [r[0] for r in df.select(redact(F.col("t"))).collect()]
    assert time.monotonic() - start < 20
    assert got == [re.sub(r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", "<redacted>", t) if len(t) < 1000 else t for t in texts]


def test_live_tasks_end_like_the_batch(spark, tmp_path):
    """Events in any order and twice, in several micro-batches; some tasks never end, some end too late, some have events after their end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, start = random.Random(5), datetime(2024, 1, 1)
    events, number = [], iter(range(10**6))
    for task in range(30):
        at, run = rng.randrange(0, 400), ["pending", *["processing"] * rng.randrange(4), *rng.choice([["completed"], ["failed"], ["completed", "failed", "processing"], []])]
        for status in run:
            events.append((task, next(number), start + timedelta(seconds=at), status))
            at += rng.choice([0, 5, 40, 70])
    last = [(-1, 10**6 + i, start + timedelta(hours=h), "pending") for i, h in enumerate((2, 30))]
    schema = "task_id long, event_id long, ts timestamp, task_status string"
    df = spark.createDataFrame(events, schema)
    want = {r.task_id: (r.task_status, r.error) for r in tasks.timeouts(df, 180).collect()}
    assert {v for v in want.values()} == {("completed", None), ("failed", None), ("failed", "timeout")}
    source = tmp_path / "in"
    shuffled = rng.sample(events, len(events)) + rng.sample(events, 20)
    late = [(0, 5 * 10**6, start, "failed")]
    for i, part in enumerate([shuffled[:50], shuffled[50:], [last[0]], [(-1, 10**6 + 8, start + timedelta(hours=2), "pending")], late + [(t, 6 * 10**6 + t, start + timedelta(hours=2), "failed") for t in range(5)], [last[1]], [(-1, 10**6 + 9, start + timedelta(hours=31), "pending")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / f"n={i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{source}/*")
    run = tasks.live_tasks(stream, 180).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    shown = spark.table("live").where("task_id >= 0").collect()
    results = [r for r in shown if r.kind == "result"]
    assert len(results) == 30 and {r.task_id: (r.task_status, r.error) for r in results} == want
    assert sorted(r.task_id for r in shown if r.kind == "done") == list(range(30))
    for task in range(30):
        own = sorted((e for e in events if e[0] == task), key=lambda e: (e[2], e[1]))
        deadline = own[0][2] + timedelta(seconds=180)
        upto = next((i + 1 for i, e in enumerate(own) if e[3] in tasks.TERMINAL), len(own))
        line = sorted((r for r in shown if r.task_id == task and r.kind == "event"), key=lambda r: r["index"])
        assert [(r["index"], r.event_id, r.at) for r in line] == [(i + 1, e[1], e[2]) for i, e in enumerate(own[:upto]) if e[2] <= deadline]
        assert all((r.progress == 100) == (r.task_status in tasks.TERMINAL) for r in line)
    state = lambda batch: {r.key.task_id for r in spark.read.format("statestore").option("operatorId", 0).option("batchId", batch).option("stateVarName", "info").load(str(tmp_path / "cp")).collect()}
    assert len(state(1)) == 30 and state(max(int(f.name) for f in (tmp_path / "cp" / "commits").iterdir() if f.name.isdigit())) <= {-1}


def test_deadline(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, start, "pending"), (1, 2, start + timedelta(seconds=100), "completed"), (2, 3, start, "pending"), (2, 4, start + timedelta(seconds=200), "completed")], "task_id long, event_id long, ts timestamp, task_status string")
    assert {r.task_id: (r.task_status, r.error) for r in tasks.timeouts(df, 180).collect()} == {1: ("completed", None), 2: ("failed", "timeout")}
