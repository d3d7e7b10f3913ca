"""Tracks and candidates computed from the driver's order tables, which hold no music."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import without_shuffles

#: Fixed values of the derived views, by remainder.
EXTENSIONS = (".mp3", ".flac", ".WAV", ".m4a", ".aac", ".ogg", ".opus", ".mpeg", ".Mp3", ".txt")
ELEMENTS = ("drums", "percussion", "vocals", "piano", "synth", "strings", "guitar", "bass", "fx", "pad")
NAMES = ("Intro", "Drums In", "Vocal", "Build & Up", "  Break <1>  ")
COLORS = ("blue", "green", "purple", "yellow", "orange")


def texts(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def tracks_sql(pick) -> str:
    """SQL of the tracks; `pick` writes the n-th (from 1) of a list of texts in the engine's dialect."""
    return f"""
      SELECT o_orderkey AS k, '/music/' || cast(o_custkey AS string) || '/' || cast(o_orderkey AS string) || {pick(EXTENSIONS, "o_orderkey % 10 + 1")} AS file_path,
        o_custkey AS custkey,
        CASE o_orderkey % 12 WHEN 0 THEN NULL WHEN 1 THEN 0e0 WHEN 2 THEN 128e0 WHEN 3 THEN 1.5e0 WHEN 4 THEN 0.2e0 WHEN 5 THEN 250e0 ELSE 60e0 / (60 + o_orderkey % 141) END AS scan_bpm,
        CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 130e0 ELSE 60e0 / (70 + o_orderkey % 100) END AS tags_bpm,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 0e0 ELSE 120e0 + o_orderkey % 241 END AS song_length,
        CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 1000) / 1000e0 END AS beatgrid_pos
      FROM orders"""


def candidates_sql(pick, first, more: str = "") -> str:
    """SQL of the candidates; `first` writes the first n of a list of picks, and `more` is SQL of more columns."""
    chosen = [pick(ELEMENTS, f"{c} % 10 + 1") for c in ("l_partkey", "l_suppkey", "cast(l_quantity AS int)")]
    return f"""
      SELECT l_orderkey AS k,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
        CASE WHEN l_returnflag = 'R' THEN 'loop' ELSE 'cue' END AS kind,
        ((l_partkey * 37 + l_suppkey * 11 + l_linenumber * 101) % 36000) / 100e0 AS ts,
        {first(chosen, "l_linenumber % 4")} AS elements,
        CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE {pick(NAMES, "l_suppkey % 5 + 1")} END AS name,
        {pick(COLORS, "l_suppkey % 5 + 1")} AS color,
        CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 16e0 ELSE 32e0 END AS length_beats,
        l_partkey AS partkey, l_suppkey AS suppkey, l_linenumber AS linenumber{more}
      FROM lineitem"""


def _spark_pick(values: tuple[str, ...], n: str) -> str:
    return f"element_at(array({texts(values)}), cast({n} AS int))"


def _spark_first(parts: list[str], n: str) -> str:
    return f"slice(array({', '.join(parts)}), 1, cast({n} AS int))"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return spark.sql(tracks_sql(_spark_pick).replace("FROM orders", "FROM {orders}"), orders=orders)


def candidates(spark: SparkSession, sf_dir: str, more: str = "") -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sql = candidates_sql(_spark_pick, _spark_first, more).replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(sql, lineitem=lineitem).withColumn("pos", F.col("pos").cast("long"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, measure_changes, loop_segments, in the order of pos.

    Lists are collected over a window in the order that pos counts, which is not asked for itself: one sort, and no
    aggregation that would sort lists again by their track.
    """
    c = candidates(spark, sf_dir, ", l_quantity AS quantity, l_extendedprice AS price")
    cue = F.struct(F.col("ts").alias("timestamp"), "elements", F.col("name").alias("cue_name"), "color")
    loop = F.struct(F.col("ts").alias("start"), "length_beats", "elements", F.col("name").alias("loop_name"), "color")
    track = Window.partitionBy("k").orderBy("linenumber", "partkey", "suppkey", "quantity", "price")
    whole = track.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = lambda kind, x: F.collect_list(F.when(F.col("kind") == kind, x)).over(whole)
    rows = c.select("k", listed("cue", cue).alias("measure_changes"), listed("loop", loop).alias("loop_segments"), F.row_number().over(track).alias("__rn"))
    return rows.where("__rn = 1").drop("__rn")


def analysed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with their attributes and candidates: k, bpm, song_length, grid_pos, measure_changes, loop_segments."""
    from ..functions.beats import track_bpm

    t = tracks(spark, sf_dir).select("k", "file_path", track_bpm(F.col("scan_bpm"), F.col("tags_bpm")).alias("bpm"), "song_length", F.col("beatgrid_pos").alias("grid_pos"))
    return t.join(analyses(spark, sf_dir), "k")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracks as songs of four libraries, each with a grid point, a replaceable cue, a kept one and a comment."""
    from ..operators.tracks import with_key
    from ..schemas import POI

    none = F.lit(None).cast("string")
    poi = lambda name, pos, num, color, kind: F.struct(name.alias("_Name"), F.lit(pos).alias("_Pos"), num.alias("_Num"), color.alias("_Color"), F.lit(kind).alias("_Type"), none.alias("_Size"), none.alias("_Slot"))
    pois = F.array(poi(none, "0.05", none, none, "beatgrid"), poi(F.lit("old"), "1.0", F.lit("1"), F.lit("4278190335"), "cue"), poi(F.lit("keep"), "2.0", F.lit("0"), none, "cue")).cast(f"array<{POI}>")
    rows = tracks(spark, sf_dir).select(F.concat(F.lit("lib"), (F.col("k") % 4).cast("string")).alias("library_id"), F.col("k").alias("song_ord"), F.col("file_path").alias("path"), F.col("song_length").cast("string").alias("song_length"), F.col("scan_bpm").cast("string").alias("scan_bpm"), F.col("tags_bpm").cast("string").alias("tags_bpm"), F.col("beatgrid_pos").cast("string").alias("grid_pos"), pois.alias("pois"), F.array(F.lit("old"), F.lit("second")).alias("comments"))
    return with_key(rows)


def song_text_sql(old: str = "OLD", comment: str = "'old'", new: str = "''") -> str:
    """SQL of a track's song as a document has it, with attributes and elements that no schema names. `old` is "OLD" for
    the point that an edit replaces or "" for none, `comment` and `new` are SQL of the first comment and of new points."""
    text = lambda c: f"cast({c} AS string)"
    lines = [
        f"""'<Song FilePath="' || file_path || '" FileSize="' || {text("k * 1000")} || '" Flag="a>b">'""",
        f"""'  <Tags Author="A ' || {text("custkey")} || ' &amp; Co" Year="1999"' || coalesce(' Bpm="' || {text("tags_bpm")} || '"', '') || '/>'""",
        f"""'  <Infos PlayCount="' || {text("k % 7")} || '"' || coalesce(' SongLength="' || {text("song_length")} || '"', '') || '/>'""",
        f"""'  <Scan' || coalesce(' Bpm="' || {text("scan_bpm")} || '"', '') || ' Key="Am"/><!-- <Poi Type="cue" Num="9"/> -->'""",
        f"""'  <Link Kind="grid"/>' || coalesce('<Poi Pos="' || {text("beatgrid_pos")} || '" Type="beatgrid" Extra="x"/>', '')""",
        *(["""'  <Poi Name="old" Pos="1.0" Num="1" Color="4278190335" Type="cue"></Poi>'"""] if old else []),
        """'  <Poi Name="keep" Pos="2.0" Num="0" Type="cue" Odd="1"/>'""",
        f"'  <Comment>' || {comment} || '</Comment>'",
        f"""'  <Comment>second</Comment><Link NetSearch="u' || {text("k")} || '"/>'""",
    ]
    return " || chr(10) || ".join(lines) + f" || chr(10) || ' ' || {new} || '</Song>'"


def write_foreign_library(spark: SparkSession, sf_dir: str, path: str, songs_per_document: int = 50_000) -> None:
    """The tracks as library documents that another program might have written, by library_id and document."""
    t = tracks(spark, sf_dir)
    rows = spark.sql(f"SELECT 'lib' || cast(k % 4 AS string) AS library_id, k div {songs_per_document} AS document, 0 AS part, k, {song_text_sql()} AS value FROM {{t}}", t=t)
    frame = rows.select("library_id", "document").distinct()
    for part, text in ((-1, '<VirtualDJ_Database Version="8.5">\n <!-- kept -->'), (1, "</VirtualDJ_Database>")):
        rows = rows.union(frame.select("library_id", "document", F.lit(part), F.lit(0), F.lit(text)))
    to = ["library_id", "document"]
    with without_shuffles(spark):
        rows.repartition(*to).sortWithinPartitions(*to, "part", "k").select(*to, "value").write.partitionBy(*to).text(path)


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Makes the files (path, size) and tells their number. What is in them doesn't matter: on a local disk they have no
    blocks, and files of a size are names of the same one, as far as the disk allows, so that a file costs its name alone."""
    import pyarrow.fs

    from ..sources.inventory import store

    n, folders, of_size = 0, set(), {}
    for b in batches:
        for path, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
            fs, at = store(path)
            folder = at.rsplit("/", 1)[0]
            if folder not in folders:
                fs.create_dir(folder)
                folders.add(folder)
            if not isinstance(fs, pyarrow.fs.LocalFileSystem):
                with fs.open_output_stream(at) as f:
                    f.write(b"." * size)
            else:
                try:
                    os.link(of_size[size], at)
                except (KeyError, OSError):  # the first of its size, or no more names for one file
                    with open(at, "wb") as f:
                        f.truncate(size)
                    of_size[size] = at
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])


def write_track_tree(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A file for each track, in folders two levels deep."""
    name = F.element_at(F.split("file_path", "/"), -1)
    rows = tracks(spark, sf_dir).select(F.concat(F.lit(f"{path}/"), F.expr("k % 3"), F.lit("/"), F.expr("k % 7"), F.lit("/"), name).alias("path"), (F.col("k") % 100).alias("size"))
    rows.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_files, "n long").agg(F.sum("n")).collect()


def library_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses of the tracks whose number isn't divisible by 3, by library and path."""
    t = tracks(spark, sf_dir).where("k % 3 <> 0").select("k", "file_path")
    a = t.join(analyses(spark, sf_dir), "k")
    return a.select(F.concat(F.lit("lib"), (F.col("k") % 4).cast("string")).alias("library_id"), F.col("file_path").alias("path"), F.expr("k div 5").alias("batch_id"), (F.col("k") % 5).alias("idx"), "measure_changes", "loop_segments")
