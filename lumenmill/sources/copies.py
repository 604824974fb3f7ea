"""A copy plan carried out by the tasks of one job, all of it or nothing."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Folders of unfinished jobs begin so; they lie in the target folder, so that publishing a file is a link within one file system.
STAGING = ".copying-"


@dataclass
class Staged(WriterCommitMessage):
    """What a task that succeeded reports: its own folder, whatever the number of files in it."""

    folder: str


class CopyWriter(DataSourceWriter):
    """Tasks copy into a folder of their own attempt; the commit publishes those of the attempts that succeeded, and removes the rest."""

    def __init__(self, folder: str):
        self.folder = folder
        self.staging = os.path.join(folder, STAGING + uuid.uuid4().hex)

    def write(self, iterator: Iterator[Row]) -> Staged:
        own = os.path.join(self.staging, uuid.uuid4().hex)
        os.makedirs(own)
        for row in iterator:
            source, target = row["source_path"], row["target_name"]
            if not source or not target or target in (".", "..") or os.path.basename(target) != target:
                raise ValueError(f"no file name to copy to, or nothing to copy: {source!r} to {target!r}")
            staged = os.path.join(own, target)
            if os.path.exists(staged) or os.path.exists(os.path.join(self.folder, target)):
                raise FileExistsError(f"target exists: {target}")
            shutil.copy2(source, staged)
        return Staged(own)

    def _published(self, messages: list[Staged | None]) -> Iterator[tuple[str, str]]:
        for message in messages:
            if message is not None and os.path.isdir(message.folder):
                for entry in os.scandir(message.folder):
                    yield entry.path, os.path.join(self.folder, entry.name)

    def commit(self, messages: list[Staged | None]) -> None:
        """Links never replace a file, so a name that is taken meanwhile, or twice in the plan, undoes the whole job."""
        try:
            for staged, target in self._published(messages):
                os.link(staged, target)
        except OSError:
            self.abort(messages)
            raise
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        """Removes what this job has published, known by its inode, and all that it has staged."""
        for staged, target in self._published(messages):
            if os.path.exists(target) and os.path.samefile(staged, target):
                os.unlink(target)
        shutil.rmtree(self.staging, ignore_errors=True)


class FileCopies(DataSource):
    """Write-only source `file_copies` of rows (source_path, target_name); the path is a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "file_copies"

    def schema(self) -> str:
        return "source_path string, target_name string"

    def writer(self, schema: StructType, overwrite: bool) -> CopyWriter:
        if overwrite:
            raise ValueError("file_copies never replaces files: use mode append")
        return CopyWriter(self.options["path"])


def apply_copy_plan(plan: DataFrame, folder: str, source: str = "source_path", target: str = "target_name") -> DataFrame:
    """Copies each source file to its target name in folder; returns the plan with target_path and applied.

    All or nothing: a missing source, a null, a name that is no plain file name, a name that exists in folder or comes twice in the plan
    fails the job, and then folder holds what it held before. Lost tasks are run again without doubling files. An empty plan copies nothing.
    The names are not brought together: the driver goes through the tasks' folders one entry at a time. If the driver itself is killed
    while it publishes, files published so far stay, beside a folder whose name begins with STAGING.
    """
    os.makedirs(folder, exist_ok=True)
    spark = plan.sparkSession
    spark.dataSource.register(FileCopies)
    named: list[Column] = [F.col(source).alias("source_path"), F.col(target).alias("target_name")]
    plan.select(*named).write.format("file_copies").mode("append").save(folder)
    return plan.withColumns({"target_path": F.concat(F.lit(f"{folder.rstrip('/')}/"), F.col(target)), "applied": F.lit(True)})
