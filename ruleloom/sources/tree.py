"""Listing and reading of file trees, names with a leading dot or underscore included.

Spark's own file readers skip such names without a word. Folders are listed on the executors, one
round for each level, whose folders are dealt anew to all cores. Symbolic links are neither followed
nor listed, so a loop of links ends nowhere. Files are read on the executors, too, in tasks of about
equal numbers of bytes.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ruleloom.session import staged

#: Bytes of contents handed on together, entries of a folder handed on together.
BATCH_BYTES = 16 << 20
ENTRIES = 10_000
#: Folders that a task lists, and bytes that it reads, about.
FOLDERS_PER_TASK = 200
BYTES_PER_TASK = 128 << 20
#: A row holds at most 2 GB; larger files cannot be one.
LARGEST_FILE = 2_000_000_000
#: Files whose sizes are summed together while reading is planned.
FILES_PER_PLAN = 50_000

_LISTED = "path string, folder boolean, size long"


def _opened(uri: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what precedes that path in a URI."""
    system, path = fs.FileSystem.from_uri(uri)
    return system, path, uri[: len(uri) - len(path)] if uri.endswith(path) else ""


def _local_entries(folder: str) -> Iterator[tuple[str, bool, int]]:
    """Plain files and folders; links and special files are left out."""
    with os.scandir(folder) as found:
        for entry in found:
            kind = entry.stat(follow_symlinks=False)
            if stat.S_ISDIR(kind.st_mode) or stat.S_ISREG(kind.st_mode):
                yield os.path.join(folder, entry.name), stat.S_ISDIR(kind.st_mode), kind.st_size


def _entries(uri: str) -> Iterator[tuple[str, bool, int]]:
    """What a folder holds, or the file itself: path, whether it is a folder, bytes."""
    system, path, before = _opened(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        yield before + info.path, False, info.size
    elif isinstance(system, fs.LocalFileSystem):
        yield from ((before + p, folder, size) for p, folder, size in _local_entries(path))
    else:  # object stores have no links
        for x in system.get_file_info(fs.FileSelector(path)):
            yield before + x.path, x.type == fs.FileType.Directory, x.size or 0


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list[tuple[str, bool, int]]) -> pa.RecordBatch:
        paths, folders, sizes = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_()), pa.array(sizes, pa.int64())], names=["path", "folder", "size"])

    rows: list[tuple[str, bool, int]] = []
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            for entry in _entries(uri):
                rows.append(entry)
                if len(rows) >= ENTRIES:
                    yield made(rows)
                    rows = []
    yield made(rows)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths: list[str] = []
    data: list[bytes] = []
    size = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(data, pa.binary())], names=["path", "content"])

    for batch in batches:
        for uri, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if paths and size + expected > BATCH_BYTES:
                yield made()
                paths, data, size = [], [], 0
            system, path, _ = _opened(uri)
            with system.open_input_stream(path) as f:
                data.append(f.read())
            paths.append(uri)
            size += len(data[-1])
    if paths:
        yield made()


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` and ``size`` of every plain file at or below ``root``; links below it are left out."""
    folders = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    files = spark.createDataFrame([], "path string, size long")
    while True:
        level = staged(folders.mapInArrow(_listed, _LISTED), "tree")
        files = files.unionByName(level.where("not folder").select("path", "size"))
        folders = level.where("folder").select("path")
        count = folders.count()
        if not count:
            return files
        # A level that came out of one folder lies in one file; its own listing is dealt to all.
        folders = folders.repartition(-(-count // FOLDERS_PER_TASK), "path")


def too_large(files: DataFrame, largest: int = LARGEST_FILE) -> DataFrame:
    """Listed files that cannot be read as one row."""
    return files.where(F.col("size") > largest)


def planned(files: DataFrame, bytes_per_task: int = BYTES_PER_TASK) -> tuple[DataFrame, int]:
    """Listed files with a ``task`` number each, tasks of about ``bytes_per_task``, and the number of tasks.

    Files go into shares by the hash of their path, a share's files in order into tasks by the running
    sum of their sizes; a larger file has a task of its own. So no task sums all sizes.
    """
    count, total = files.agg(F.count("*"), F.sum("size")).first()
    shares = -(-count // FILES_PER_PLAN) or 1
    weight = F.col("size") + 4096  # opening a file counts, too
    share = F.pmod(F.xxhash64("path"), F.lit(shares)).cast("int")
    before = Window.partitionBy("share").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    filled = files.withColumn("share", share).withColumn("_at", F.coalesce(F.sum(weight).over(before), F.lit(0)))
    slots = filled.withColumn("_slot", F.floor(F.col("_at") / bytes_per_task).cast("int"))
    most = -(-((total or 0) + 4096 * count) // (shares * bytes_per_task)) or 1
    # Shares differ a little in size, so their numbers are spread and wrap around.
    tasks = shares * most
    return slots.select("path", "size", F.pmod(F.col("share") * most + F.col("_slot"), F.lit(tasks)).alias("task")), tasks


def read_files(files: DataFrame, largest: int = LARGEST_FILE) -> DataFrame:
    """``path`` and ``content`` bytes of listed files.

    A file above ``largest`` bytes stops the job before anything is read, and is named: leave those of
    :func:`too_large` out first, if the rest is to be read.
    """
    big = [r["path"] for r in too_large(files, largest).limit(5).collect()]
    if big:
        raise ValueError(f"files above {largest} bytes: {', '.join(big)}")
    dealt, tasks = planned(files)
    cores = files.sparkSession.sparkContext.defaultParallelism
    if tasks < cores:  # little to read is still read by all cores
        dealt, tasks = dealt.withColumn("task", F.pmod(F.xxhash64("path"), F.lit(cores)).cast("int")), cores
    return dealt.repartitionById(tasks, F.col("task")).select("path", "size").mapInArrow(_contents, "path string, content binary")
