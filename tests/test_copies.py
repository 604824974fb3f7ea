"""Copy plans: all files or none, whatever fails."""

import os

import pytest
from pyspark.sql import functions as F

from lumenmill.sources.copies import CopyWriter, Staged, apply_copy_plan


@pytest.fixture
def files(tmp_path):
    made = tmp_path / "in"
    made.mkdir()
    for i in range(12):
        (made / f"a{i}.png").write_bytes(bytes([i]) * (i + 1))
    return made


def plan_of(spark, rows):
    return spark.createDataFrame(rows, "source_path string, target_name string").repartition(4)


def held(folder):
    return {p: (folder / p).read_bytes() for p in sorted(os.listdir(folder))} if folder.exists() else {}


def test_copies_all(spark, files, tmp_path):
    out = tmp_path / "out"
    plan = plan_of(spark, [(str(files / f"a{i}.png"), f"b{i}.png") for i in range(12)]).withColumn("n", F.lit(1))
    got = apply_copy_plan(plan, str(out)).collect()
    assert held(out) == {f"b{i}.png": bytes([i]) * (i + 1) for i in range(12)}
    assert {r.target_path for r in got} == {str(out / f"b{i}.png") for i in range(12)} and all(r.applied and r.n == 1 for r in got)
    apply_copy_plan(plan_of(spark, []), str(out))
    assert len(held(out)) == 12


@pytest.mark.parametrize("bad", [("gone.png", "x.png"), ("a1.png", "taken.png"), ("a1.png", "b0.png"), ("a1.png", "../x.png"), ("a1.png", ".."), ("a1.png", None), (None, "x.png"), ("a1.png", "")])
def test_one_failure_leaves_nothing(spark, files, tmp_path, bad):
    out = tmp_path / "out"
    out.mkdir()
    (out / "taken.png").write_bytes(b"before")
    rows = [(str(files / f"a{i}.png"), f"b{i}.png") for i in range(12)]
    with pytest.raises(Exception):  # noqa: B017, PT011
        apply_copy_plan(plan_of(spark, [*rows, (bad[0] and str(files / bad[0]), bad[1])]), str(out))
    assert held(out) == {"taken.png": b"before"}
    apply_copy_plan(plan_of(spark, rows), str(out))
    assert len(held(out)) == 13


def test_only_attempts_that_succeeded_are_published(spark, files, tmp_path):
    """A lost attempt, a retry and a speculative twin of one task: its files come once."""
    out = tmp_path / "out"
    out.mkdir()
    writer = CopyWriter(str(out))
    rows = [{"source_path": str(files / f"a{i}.png"), "target_name": f"b{i}.png"} for i in range(3)]
    with pytest.raises(FileNotFoundError):
        writer.write(iter([*rows, {"source_path": str(files / "gone"), "target_name": "x"}]))
    writer.write(iter(rows))
    last = writer.write(iter(rows))
    writer.commit([last, None])
    assert sorted(held(out)) == ["b0.png", "b1.png", "b2.png"]


def test_a_name_taken_before_the_commit_undoes_it(files, tmp_path):
    out = tmp_path / "out"
    out.mkdir()
    writer = CopyWriter(str(out))
    staged = [writer.write(iter([{"source_path": str(files / f"a{i}.png"), "target_name": f"b{i}.png"}])) for i in range(4)]
    (out / "b2.png").write_bytes(b"other")
    with pytest.raises(FileExistsError):
        writer.commit(staged)
    assert held(out) == {"b2.png": b"other"}
    writer.abort([Staged(s.folder) for s in staged])
    assert held(out) == {"b2.png": b"other"}
