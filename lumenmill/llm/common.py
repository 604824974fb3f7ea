"""Small helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from typing import TypeVar

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: A side of a join is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 20_000
#: What separates words everywhere in this subpackage: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


#: Folders that written() has made and that are still there.
_made: set[str] = set()


#: Sets that are told of every folder that written() makes, by thread.
_noting: ContextVar[tuple[set[str], ...]] = ContextVar("noting", default=())


@contextlib.contextmanager
def noted() -> Iterator[set[str]]:
    """The folders of tables that written() makes within, in this thread; for clear(), once what reads them has been written itself."""
    mine: set[str] = set()
    token = _noting.set((*_noting.get(), mine))
    try:
        yield mine
    finally:
        _noting.reset(token)


def clear(spark: SparkSession, paths: set[str] | None = None, keep: DataFrame | None = None) -> None:
    """Removes these tables from written(), or all that still stand, but not what keep reads. For callers that have used up the results; it also runs when Python ends."""
    read_from = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()} if keep is not None and _made else set()
    for path in _made & (_made if paths is None else paths):
        if path.rpartition("/")[2] not in read_from:
            _delete(spark, path)
            _made.discard(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); in /tmp only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    if not _made:
        atexit.unregister(_clear_quietly)
        atexit.register(_clear_quietly, spark)
    path = f"{base}/lumenmill-{uuid.uuid4().hex}"
    _made.add(path)
    for mine in _noting.get():
        mine.add(path)
    return path


def _clear_quietly(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        clear(spark)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut and it is computed once, and lost executors take nothing with them."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, or the first longer one that is no column of df, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def is_table(df: DataFrame) -> bool:
    """Whether df is a Parquet file or folder just as it was read: then its rows have places in files, which are the same on each read."""
    files = df.inputFiles()
    folders = {f.rpartition("/")[0] for f in files}
    if len(folders) != 1:
        return False
    names = [*folders, *(files if len(files) == 1 else [])]
    # A path counts as it was given: in full, or without the name of the file system.
    given = {x for n in names for x in (n, re.sub(r"^\w+://[^/]*", "", n))}

    def same(path: str) -> bool:
        try:
            return df.sameSemantics(df.sparkSession.read.schema(df.schema).parquet(path))
        except AnalysisException:  # no such path in the default file system
            return False

    return any(same(path) for path in given)


#: Of a row's number the lower bits are its place in its file, the upper ones a hash of the file's path.
PLACE_BITS = 24


def with_rows(df: DataFrame, name: str = "__row") -> DataFrame:
    """df with a unique number of each row: decisions by it hold for that row alone, whatever its id.

    The rows of a table as read are numbered by where they lie, which needs no copy of the table; that no two numbers are equal is
    counted by file first. Any other df, which could come out otherwise when computed again, is written with the numbers.
    """
    if is_table(df):
        path, place = (df.metadataColumn("_metadata")[x] for x in ("file_path", "row_index"))
        for seed in range(3):
            file = F.shiftleft(F.xxhash64(F.lit(seed), path), PLACE_BITS)
            by_file = df.select(path.alias("path"), file.alias("file"), place.alias("place")).groupBy("path", "file").agg(F.max("place").alias("last"))
            seen = by_file.agg(F.count("*").alias("files"), F.countDistinct("file").alias("hashes"), F.max("last").alias("last")).first()
            if seen.files == seen.hashes and (seen.last or 0) < 1 << PLACE_BITS:
                return df.withColumn(name, file + place)
    return written(df.withColumn(name, F.monotonically_increasing_id()))


def dropped(df: DataFrame) -> None:
    """Removes the files of a table from written(), once nothing reads it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles() if "/lumenmill-" in f}:
        _delete(df.sparkSession, path)
        _made.difference_update([m for m in _made if m.rpartition("/")[2] == path.rpartition("/")[2]])


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is: then Spark shuffles, and splits skewed keys."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def give_back() -> None:
    """At the end of a task: memory that Python workers, which live on, have freed goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: What kept() holds in this worker: at most one thing.
_kept: dict[object, object] = {}


def put_away() -> None:
    """Lets go of what kept() holds, and gives the memory back."""
    if _kept:
        _kept.clear()
        give_back()


def kept(key: object, make: Callable[[], T]) -> T:
    """What make() gives, kept until another key is asked for. Workers live on from one stage to the next; tables and caches of several stages would add up."""
    if key not in _kept:
        put_away()
        _kept[key] = make()
    return _kept[key]


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_az(text: Column) -> Column:
    """A-Z in lower case and nothing else, whatever the language."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def modest_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of whole documents that fit a small executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def modest_reads(spark: SparkSession, rows: int = 1024) -> None:
    """Vectors of the Parquet reader that hold so many whole documents, not 4096: their arrays double as they grow, and are the largest that a scan makes."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


def most_frequent(counts: DataFrame, count: str, most: int) -> pd.DataFrame:
    """Rows of the largest counts, at most so many, the largest first and the rest of the columns breaking ties.

    A histogram over powers of 2**(1/16), of bounded size, gives the smallest count with which all rows are few enough; only
    those rows come to the driver, whatever the number of partitions.
    """
    step = F.floor(F.log2(count) * 16)
    histogram = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for r in histogram:
        total += r.n
        if total > most:
            break
        least = r.step
    rows = counts.where(step >= least if least is not None else F.lit(False)).toPandas()
    return rows.sort_values([count, *[c for c in rows.columns if c != count]], ascending=[False] + [True] * (len(rows.columns) - 1), ignore_index=True)
