"""Plans of the queries on drawings: pixels are dealt out by image before they are made, and none of their tables is broadcast."""

import pytest

from lumenmill.functions import tables
from lumenmill.operators import gains, regions
from lumenmill.plans import drawings, records

SF = "/root/testdata/sf0.001"
LOCAL = ("metrics", "edges_sobel", "box_contrast", "texture", "morphology", "focus_boxes", "texture_crops", "edge_crops", "review_crops", "best_windows")
JOINED = ("regions", "region_stats", "canny", "edge_density", "stable_edges", "segments", "line_score", "local_contrast", "gains", "gates")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LOCAL)
def test_pixels_stay_in_the_partition_of_their_image(spark, monkeypatch, name):
    monkeypatch.setattr(tables, "PIXELS", 500)
    text = plan(getattr(drawings, f"drawing_{name}")(spark, SF))
    assert "Join" not in text and "ENSURE_REQUIREMENTS" not in text and "REPARTITION_BY_NUM" in text


@pytest.mark.parametrize("name", JOINED)
def test_no_table_of_pixels_is_broadcast(spark, monkeypatch, name):
    plans = []

    def settled(df):
        plans.append(plan(df))
        return tables.settled(df)

    for module in (regions, gains):
        monkeypatch.setattr(module, "settled", settled)
    plans.append(plan(getattr(drawings, f"drawing_{name}")(spark, SF)))
    assert not [p for p in plans if "Broadcast" in p or "NestedLoop" in p or "Cartesian" in p]


def test_drawings_are_made_in_partitions_of_few_pixels(spark, monkeypatch):
    monkeypatch.setattr(tables, "PIXELS", 500)
    sizes = drawings.fx.drawings(spark, SF).groupBy("image_id").count().collect()
    assert drawings.fx.drawings(spark, SF).rdd.getNumPartitions() == -(-sum(r["count"] for r in sizes) // 500) > 4


def test_resize_looks_its_weights_up_beside_the_pixels(spark):
    text = plan(drawings.drawing_resize_lanczos(spark, SF))
    assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") == 2


def test_rule_documents_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(records, "TREES", 50)
    assert records.rule_tree(spark, SF).rdd.getNumPartitions() == 4
