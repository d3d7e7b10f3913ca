"""Audio files as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_audio_path
from ..operators.tracks import input_union, stored


def audio_inventory(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """(arg_ord, path, length) of the audio files that the inputs name, in their order, sorted by path within each.

    An input is a file, a directory (read with all below it) or a glob (not read below). Files that several inputs name
    stay as often. Contents are never read. Spark's driver lists the files, in any store that Spark reads; for large
    trees see `tree_inventory`.
    """
    tables = []
    for one in inputs:
        glob = any(c in one for c in "*?[{")
        found = spark.read.format("binaryFile").option("recursiveFileLookup", str(not glob).lower()).load(one)
        tables.append(found.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"), "length").where(is_audio_path(F.col("path"))))
    return input_union(*tables).select("arg_ord", "path", "length").orderBy("arg_ord", "path")


def store(path: str) -> tuple:
    """The store that holds a path or URI, and the path in it."""
    import pyarrow.fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is in each folder (arg_ord, path): arg_ord, path, length, folder."""
    import pyarrow.fs

    for b in batches:
        for arg, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
            fs, at = store(path)
            prefix = path.removesuffix(at)
            found = fs.get_file_info(pyarrow.fs.FileSelector(at))
            for n in range(0, len(found), 10_000):
                part = found[n : n + 10_000]
                folder = [x.type == pyarrow.fs.FileType.Directory for x in part]
                yield pa.RecordBatch.from_arrays([pa.array([arg] * len(part), pa.int32()), pa.array([prefix + x.path for x in part]), pa.array([x.size or 0 for x in part], pa.int64()), pa.array(folder)], ["arg_ord", "path", "length", "folder"])


def tree_inventory(spark: SparkSession, roots: list[str], tasks: int | None = None) -> DataFrame:
    """(arg_ord, path, length) of the audio files below the folders `roots`, in their order, sorted by path within each.

    Tasks list the folders, level by level: those found on a level are dealt out evenly for the next one, so that neither
    a wide tree nor one branch with most of the files is the work of one process, and no list of files goes to the driver.
    A level is stored compressed; a folder's own entries are listed by one task. Stores are those that Arrow reaches (local,
    HDFS, S3, GCS). A root that isn't there is an error, an empty one gives no rows; a root given twice counts twice.
    """
    levels = []
    folders = spark.createDataFrame([(i, r.rstrip("/") or "/") for i, r in enumerate(roots)], "arg_ord int, path string")
    n = tasks or spark.sparkContext.defaultParallelism
    while True:
        found = folders.repartition(n, F.xxhash64("arg_ord", "path")).mapInArrow(_entries, "arg_ord int, path string, length long, folder boolean")
        found = stored(found.where(F.col("folder") | is_audio_path(F.col("path"))))
        levels.append(found.where(~F.col("folder")).select("arg_ord", "path", "length"))
        folders = found.where("folder").select("arg_ord", "path")
        if folders.isEmpty():
            break
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.select("arg_ord", F.regexp_replace("path", r"^file:/+", "/").alias("path"), "length").orderBy("arg_ord", "path")
