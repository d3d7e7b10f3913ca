"""Tracks: libraries, paths and attributes. A track's key is `library_id` and the path in Unicode normal form C."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, CueConfig
from ..functions.beats import track_bpm
from ..functions.text import is_audio_path, nfc_path
from ..sources.files import without_shuffles

KEY = ["library_id", "nfc_path"]
#: A longer list of first rows is cut from the whole order instead of being chosen by one task.
TOP = 100_000


def with_key(df: DataFrame, path: str = "path") -> DataFrame:
    """`df` with `nfc_path`; a null path's is empty. Never null, so that no join asks for it twice to look for nulls."""
    return df.withColumn("nfc_path", F.coalesce(nfc_path(F.col(path)), F.lit("")))


def input_union(*inputs: DataFrame) -> DataFrame:
    """Path tables one after another, duplicates kept; `arg_ord` numbers the tables."""
    numbered = [d.withColumn("arg_ord", F.lit(i)) for i, d in enumerate(inputs)]
    out = numbered[0]
    for d in numbered[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def audio_only(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.where(is_audio_path(F.col(path)))


def tracks_in_library(inventory: DataFrame, library: DataFrame, on: list[str] = KEY) -> DataFrame:
    return inventory.join(library.where(F.col(on[-1]) != ""), on, "left_semi")


def tracks_missing(inventory: DataFrame, library: DataFrame, on: list[str] = KEY) -> DataFrame:
    return inventory.join(library.where(F.col(on[-1]) != ""), on, "left_anti")


def first_song(library: DataFrame, on: list[str] = KEY) -> DataFrame:
    """Of songs with the same path the first in document order, which takes edits."""
    ranked = library.withColumn("__rn", F.row_number().over(Window.partitionBy(*on).orderBy("song_ord")))
    return ranked.where("__rn = 1").drop("__rn")


def _number(text: Column) -> Column:
    return text.try_cast("double")


def attributes(library: DataFrame, on: list[str], marks: Sequence[str] = ()) -> DataFrame:
    """Length, BPM and grid start for each key: each from the first song (by `song_ord`) that has a usable one; `first_ord`
    is the first song's place. `marks` are columns of numbers that are taken from the first song that has the first of them,
    whose place is `__marked`.

    `library` has song_length, scan_bpm and tags_bpm as text or numbers, and grid_pos.
    """
    length, scan, tags = _number(F.col("song_length")), _number(F.col("scan_bpm")), _number(F.col("tags_bpm"))
    malformed = F.col("scan_bpm").isNotNull() & scan.isNull()
    bpm = track_bpm(scan, tags, malformed)
    # a song whose scan is no number ends the search without a BPM
    usable = bpm.isNotNull() | malformed
    first = lambda value, ok: F.min_by(value, F.when(ok, F.col("song_ord")))
    return library.groupBy(*on).agg(
        first(length, F.col("song_length").isNotNull()).alias("song_length"), first(bpm, usable).alias("bpm"),
        first(_number(F.col("grid_pos")), F.col("grid_pos").isNotNull()).alias("grid_pos"),
        F.min("song_ord").alias("first_ord"), *(first(F.col(m), F.col(marks[0]).isNotNull()).alias(m) for m in marks),
        *([F.min(F.when(F.col(marks[0]).isNotNull(), F.col("song_ord"))).alias("__marked")] if marks else []),
    )


def attribute_maps(library: DataFrame, marks: Sequence[str] = ()) -> DataFrame:
    """Attributes of all spellings of a path, as a map by spelling, so that one join on the key serves all of them.

    Spellings are collected over a window by the key, whose sort the join needs in any case.
    """
    dealt = library.repartition(*KEY)
    by_path = attributes(dealt, [*KEY, "path"], marks)
    entry = F.struct("path", F.struct("song_length", "bpm", "grid_pos"))
    track = Window.partitionBy(*KEY)
    ordered = track.orderBy("first_ord")
    told = [F.min_by(m, "__marked").over(track).alias(m) for m in marks]
    rows = by_path.select(*KEY, F.map_from_entries(F.collect_list(entry).over(track)).alias("spellings"), F.min("first_ord").over(track).alias("first_ord"), *told, F.row_number().over(ordered).alias("__rn"))
    return rows.where("__rn = 1").drop("__rn")


def with_attributes(tracks: DataFrame, library: DataFrame, cfg: CueConfig = DEFAULT, marks: Sequence[str] = ()) -> DataFrame:
    """`tracks` (library_id, path, nfc_path) that are in the library, with song_length, bpm, grid_pos and
    first_ord, the place of the first song with the path in whatever spelling, and the track's `marks`.

    A path that isn't spelled as in the library has none of the attributes, unless `attribute_key` is "nfc".
    """
    # by the path as written: a condition on its normal form would be asked of the other side too, normalising twice
    songs = library.where("path <> ''")
    if cfg.attribute_key == "nfc":
        return tracks.join(attributes(songs, KEY, marks), KEY).drop("__marked")
    found = tracks.join(attribute_maps(songs, marks), KEY)
    a = F.try_element_at("spellings", F.col("path"))
    return found.select(*tracks.columns, a["song_length"].alias("song_length"), a["bpm"].alias("bpm"), a["grid_pos"].alias("grid_pos"), "first_ord", *marks)


def _checkpoint_dir(rows: DataFrame) -> str:
    """The folder that `spark.checkpoint.dir` names (a temporary one if unset in local mode)."""
    sc = rows.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tracklark-"))
    return sc.getCheckpointDir()


def checkpointed(rows: DataFrame) -> DataFrame:
    """The rows as they are now, in the checkpoint folder."""
    _checkpoint_dir(rows)
    return rows.checkpoint()


def stored(rows: DataFrame) -> DataFrame:
    """The rows as they are now, compressed, in no order; removed when the driver ends. For what a checkpoint would store
    at many times the size."""
    spark = rows.sparkSession
    path = f"{_checkpoint_dir(rows)}/stored-{uuid.uuid4().hex}"
    with without_shuffles(spark):
        rows.write.option("compression", "zstd").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(rows.schema).parquet(path)


def assign_batches(inventory: DataFrame, order: list[str], size: int = DEFAULT.batch_size, limit: int | None = None) -> DataFrame:
    """`inventory` with `idx` (position in order) and `batch_id` (position // size); the first `limit` rows, if given.

    The sort deals the rows into ranges of about equal size, as many as shuffles have partitions. Rows are numbered within
    their range, and the ranges' counts are summed up. Rows that are equal in `order` stand in the order of a hash of
    all their columns.
    """
    tie = F.xxhash64(*inventory.columns)
    rows = inventory.orderBy(*order, tie)
    if limit and limit <= TOP:  # each task keeps its own first ones, and one task chooses among them
        rows = rows.limit(limit)
    rows = checkpointed(rows.withColumn("__id", F.monotonically_increasing_id()))
    rows = rows.withColumn("__range", F.shiftright("__id", 33))
    counts = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    counts = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rows = rows.join(counts, "__range").withColumn("idx", F.col("__before") + F.col("__id").bitwiseAND((1 << 33) - 1))
    if limit:
        rows = rows.where(F.col("idx") < limit)
    return rows.withColumn("batch_id", F.floor(F.col("idx") / size).cast("long")).drop("__id", "__range", "__before")


def content_hash() -> Column:
    """A number for what an analysis says, which decides between analyses of the same place."""
    return F.xxhash64("measure_changes", "loop_segments")


def latest_analysis(analyses: DataFrame, on: list[str] = KEY, tie: str | None = None) -> DataFrame:
    """Of several analyses of a track the one applied last: the highest batch, and position in it, and then of `tie`."""
    last = Window.partitionBy(*on).orderBy(F.desc("batch_id"), F.desc("idx"), *([F.desc(tie)] if tie else []))
    return analyses.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")
