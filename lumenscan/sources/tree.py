"""Folders of source files, listed and read by executors.

A tree is listed level by level: a task lists its folders, writes what is in them, and the folders
among it are the next level.  So the driver holds the root's name and one count for each level, and
there are as many jobs as levels.  Files are then dealt out by their sizes and read where they are
needed.  Paths are those of ``pyarrow.fs``: local ones, or URIs of the file systems it knows.

A folder's names are held by the task that lists it, and a file is one row, of less than 2 GB.
Hidden files and such with a leading underscore are files like others; links to folders are not
followed on a local disk.  A file that goes away or cannot be opened stops the job.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenscan.session import write_stage
from lumenscan.sources.files import SUFFIXES, decode_source

# Bytes of files that one task reads, and that one Arrow batch holds unless a single file has more.
TASK_BYTES = 128 << 20
BATCH_BYTES = 16 << 20
# Folders listed by a task.
TASK_FOLDERS = 200

_LISTED = "path string, is_folder boolean, size bigint"
_FILES = "path string, content binary"


def _opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path in it, and what stands in front of that in a full path."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), os.path.abspath(path), ""
    fs, inner = pafs.FileSystem.from_uri(path)
    local = isinstance(fs, pafs.LocalFileSystem)
    return fs, inner, "" if local else path[: len(path) - len(inner)]


def _entries(folder: str) -> Iterator[tuple[str, bool, int]]:
    fs, inner, front = _opened(folder)
    local = isinstance(fs, pafs.LocalFileSystem)
    for info in fs.get_file_info(pafs.FileSelector(inner)):
        is_folder = info.type == pafs.FileType.Directory
        if is_folder and local and os.path.islink(info.path):
            continue
        if is_folder or (info.type == pafs.FileType.File and info.path.endswith(SUFFIXES)):
            yield front + info.path, is_folder, info.size or 0


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            rows = list(_entries(folder))
            for at in range(0, len(rows), 10_000):
                paths, folders, sizes = zip(*rows[at : at + 10_000])
                yield pa.record_batch([pa.array(paths), pa.array(folders), pa.array(sizes, pa.int64())], ["path", "is_folder", "size"])


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """path and size of all source files below ``root``."""
    level, found = spark.createDataFrame([(root,)], "path string"), None
    folders = 1
    while folders:
        tasks = -(-folders // TASK_FOLDERS)
        listed = write_stage(level.repartition(tasks).mapInArrow(_list, _LISTED), "listed")
        files = listed.filter("not is_folder").select("path", "size")
        found = files if found is None else found.unionByName(files)
        level = listed.filter("is_folder").select("path")
        folders = level.count()
    return found


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths, contents, size = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    for rows in batches:
        for path in rows.column(0).to_pylist():
            fs, inner, _ = _opened(path)
            with fs.open_input_stream(inner) as stream:
                content = stream.read()
            if paths and size + len(content) > BATCH_BYTES:
                yield batch()
                paths, contents, size = [], [], 0
            paths.append(path)
            contents.append(content)
            size += len(content)
    if paths:
        yield batch()


def read_files(files: DataFrame) -> DataFrame:
    """Source units of ``files`` (path, size, a stored table)."""
    size, count = files.agg(F.sum("size"), F.count("*")).first()
    tasks = max(1, -(-(size or 0) // TASK_BYTES), -(-count // 10_000))
    rows = files.select("path").repartition(tasks, "path").mapInArrow(_read, _FILES)
    return decode_source(rows.select(F.col("path").alias("unit_id"), F.col("path").alias("location"), "content"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All ``.luau``/``.lua`` files below ``root`` as source units; an error when there are none."""
    files = list_tree(spark, root)
    if files.isEmpty():
        raise ValueError(f"no .luau/.lua files found under: {root}")
    return read_files(files)


def _write(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top, _ = _opened(root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{top}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                # Under a name of its own first, so that no attempt of a task leaves half a file.
                part = f"{target}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as stream:
                    stream.write(content)
                fs.move(part, target)
            yield pa.record_batch([batch.column(0)], ["path"])

    return write


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write each row (path below ``root``, content) as a file; the table of paths written.  Null contents are empty files."""
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    return write_stage(files.select("path", content.alias("content")).mapInArrow(_write(root), "path string"), "written")
