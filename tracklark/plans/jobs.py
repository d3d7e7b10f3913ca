"""The jobs that users run, composed from the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, CueConfig
from ..functions.elements import cue_base_name, decode_color, known
from ..functions.splice import spliced_song
from ..functions.text import basename, capitalize, one_decimal
from ..operators.candidates import align, explode_cues, explode_loops, points_of_tracks, select_loops
from ..operators.pois import collected_points, replace_pois
from ..operators.tracks import KEY, content_hash, latest_analysis, with_attributes, with_key


def make_points(tracks: DataFrame, keys: list[str], cfg: CueConfig = DEFAULT) -> DataFrame:
    """New points of tracks (keys, bpm, song_length, grid_pos, measure_changes, loop_segments), in time order (`ord` from 1)."""
    rows = points_of_tracks(tracks, keys, cfg).select(*keys, F.posexplode("points").alias("ord", "p"))
    kind = F.when(F.col("p.looped"), "loop").otherwise("cue").alias("kind")
    return rows.select(*keys, "p.t", kind, "p.made", "p.num", "p.name", "p.color", "p.beats", (F.col("ord") + 1).cast("long").alias("ord"), "p.slot")


def annotate_library(library: DataFrame, analyses: DataFrame, cfg: CueConfig = DEFAULT) -> DataFrame:
    """`library` with the points and comment of every track that has an analysis; other songs pass unchanged.

    `library`: library_id, song_ord, path, nfc_path, song_length, scan_bpm, tags_bpm, grid_pos, pois, comments.
    `analyses`: library_id, path, batch_id, idx, measure_changes, loop_segments; the last one of a track counts
    (by batch_id, idx, and then a hash of what it says).
    Of songs with the same path the first is edited; songs without a path are not. Three exchanges, all on the track's
    key: the analyses, the attributes of the library, and its songs; candidates are exploded and collected between them, in one sort.
    A song that carries its text (`raw`) has it edited too, at its points and first comment alone.
    """
    found = with_key(analyses.select("library_id", "path", "batch_id", "idx", "measure_changes", "loop_segments"))
    latest = latest_analysis(found.withColumn("__hash", content_hash()), tie="__hash").drop("__hash")
    return put_points(library, points_of_analyses(with_attributes(latest, library, cfg), cfg))


def points_of_analyses(tracks: DataFrame, cfg: CueConfig = DEFAULT, marks: Sequence[str] = ()) -> DataFrame:
    """(library_id, nfc_path, first_ord, marks, new_pois, comment) of tracks with their attributes and analysis."""
    keys = [*KEY, "first_ord", *marks]
    return collected_points(points_of_tracks(tracks, keys, cfg), keys)


def put_points(library: DataFrame, new: DataFrame, marks: Sequence[str] = ()) -> DataFrame:
    """`library` with the points and comments that `points_of_analyses` made, at the first song of each track; `marks` are
    columns of both, which that song takes from the points."""
    # old points stay nested in their song's row; songs without a path get keys of their own
    own = F.concat(F.lit("\x00"), F.col("song_ord").cast("string"))
    songs = library.withColumn("__nfc", F.when(F.col("nfc_path") != "", F.col("nfc_path")).otherwise(own))
    songs = songs.join(new.withColumnsRenamed({"nfc_path": "__nfc", **{m: f"__{m}" for m in marks}}), ["library_id", "__nfc"], "left")
    edited = F.coalesce(F.col("first_ord") == F.col("song_ord"), F.lit(False))
    comments = F.concat(F.array(F.coalesce("comment", F.lit(""))), F.filter("comments", lambda c, i: i > 0))
    if "raw" in library.columns:
        songs = songs.withColumn("raw", F.when(edited, spliced_song(F.col("raw"), F.col("new_pois"), F.col("comment"))).otherwise(F.col("raw")))
    for m in marks:
        songs = songs.withColumn(m, F.when(edited, F.col(f"__{m}")).otherwise(F.col(m)))
    return songs.withColumn("pois", F.when(edited, replace_pois(F.col("pois"), F.col("new_pois"))).otherwise(F.col("pois"))).withColumn("comments", F.when(edited, comments).otherwise(F.col("comments"))).select(*library.columns)


def annotated_points(library: DataFrame, analyses: DataFrame, cfg: CueConfig = DEFAULT) -> DataFrame:
    """The points of the annotated library, a row each, in document order."""
    return poi_rows(annotate_library(library, analyses, cfg))


def poi_rows(library: DataFrame) -> DataFrame:
    """A row for each point of a library's songs."""
    rows = library.select("library_id", "path", "song_ord", F.posexplode("pois").alias("poi_ord", "p"))
    return rows.select("library_id", "path", "song_ord", F.col("poi_ord").cast("long").alias("poi_ord"), F.col("p._Type").alias("type"), F.col("p._Num").alias("num"), F.col("p._Slot").alias("slot"), F.col("p._Name").alias("name"), F.col("p._Pos").alias("pos"), F.col("p._Color").alias("color"), F.col("p._Size").alias("size"))


def preview(tracks: DataFrame, keys: list[str], cfg: CueConfig = DEFAULT) -> DataFrame:
    """What would be made, at a glance: first cues and loops in array order, raw times, proposed colours, no filters."""
    n = (F.col("pos") + 1).cast("long")
    shown = capitalize(F.coalesce("proposed", F.lit(cfg.default_color))).alias("color")
    elements = F.array_join(known(F.col("elements")), ",").alias("elements")
    cues = explode_cues(tracks, cfg).select(*keys, F.lit("cue").alias("kind"), n.alias("n"), F.coalesce("name", F.concat(F.lit("cue"), n.cast("string"))).alias("name"), one_decimal(F.col("ts")).alias("at"), shown, F.lit(None).cast("double").alias("beats"), elements)
    loops = explode_loops(tracks.withColumn("loop_segments", F.slice("loop_segments", 1, cfg.max_loops)), cfg)
    loops = loops.select(*keys, F.lit("loop").alias("kind"), n.alias("n"), F.coalesce("name", F.concat(F.lit("loop"), n.cast("string"), F.lit("l"))).alias("name"), one_decimal(F.col("ts")).alias("at"), shown, "beats", elements)
    return cues.unionByName(loops)


def preview_detailed(tracks: DataFrame, keys: list[str], cfg: CueConfig = DEFAULT) -> DataFrame:
    """Aligned times, proposed colours and five-level loop choice, without range and element filters."""
    cfg = replace(cfg, policy="single")
    shown = capitalize(F.coalesce("proposed", F.lit(cfg.default_color))).alias("color")
    n = (F.col("pos") + 1).cast("long")
    cues = align(explode_cues(tracks, cfg), cfg).select(*keys, F.lit("cue").alias("kind"), n.alias("n"), F.coalesce(F.nullif("name", F.lit("")), cue_base_name(F.col("elements"), n)).alias("name"), one_decimal(F.col("t")).alias("at"), shown, F.lit(None).cast("double").alias("beats"))
    loops = select_loops(align(explode_loops(tracks, cfg), cfg), keys, cfg, raw_names=True, filters=False)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("t", "rank")).cast("long")
    return cues.unionByName(loops.select(*keys, F.lit("loop").alias("kind"), at.alias("n"), "name", one_decimal(F.col("t")).alias("at"), shown, "beats"))


def request_table(tracks: DataFrame, cfg: CueConfig = DEFAULT) -> DataFrame:
    """What an analysis is asked for each track: name, length (300 if unknown) and BPM or Unknown."""
    length = F.coalesce(F.when(F.col("song_length") != 0, F.col("song_length")), F.lit(cfg.default_length))
    bpm = F.coalesce(F.when(F.col("bpm") != 0, one_decimal(F.col("bpm"))), F.lit("Unknown"))
    return tracks.withColumn("name", basename(F.col("path"))).withColumn("length_s", length).withColumn("bpm_text", bpm)


def request_batches(requests: DataFrame) -> DataFrame:
    """The lines of each batch's request as one text (batch_id, idx_in_batch from 0)."""
    line = F.format_string("File %d: %s - Length: %ss - BPM: %s", F.col("idx_in_batch") + 1, "name", one_decimal(F.col("length_s")), "bpm_text")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx_in_batch", line.alias("line")))), lambda x: x["line"])
    return requests.groupBy("batch_id").agg(F.array_join(lines, "\n").alias("lines"))


def track_status(inputs: DataFrame, on_disk: DataFrame, library: DataFrame, analyses: DataFrame, on: list[str] = KEY) -> DataFrame:
    """`inputs` with what became of each: not_on_disk, not_in_library, analysis_failed (missing or unparsable) or applied."""
    flag = lambda t, name: t.select(*on).distinct().withColumn(name, F.lit(True))
    rows = inputs.join(flag(on_disk, "__disk"), on, "left").join(flag(library.where(F.col(on[-1]) != ""), "__lib"), on, "left").join(flag(analyses, "__done"), on, "left")
    status = F.when(F.col("__disk").isNull(), "not_on_disk").when(F.col("__lib").isNull(), "not_in_library").when(F.col("__done").isNull(), "analysis_failed").otherwise("applied")
    return rows.withColumn("status", status).drop("__disk", "__lib", "__done")


def run_report(status: DataFrame) -> DataFrame:
    """Tracks and successes by batch, and over all (batch_id null)."""
    return status.rollup("batch_id").agg(F.count("*").alias("tracks"), F.count_if(F.col("status") == "applied").alias("applied"))


def color_index(points: DataFrame, cfg: CueConfig = DEFAULT) -> DataFrame:
    """Points to be searched by colour: color, type, and where they are."""
    return points.where(F.col("type").isin("cue", "loop")).withColumn("color", decode_color(F.col("color"), cfg)).where(F.col("color").isNotNull())


def filter_cues_by_color(index: DataFrame, color: str) -> DataFrame:
    return index.where(F.col("color") == color)


def filter_cues_by_element(candidates: DataFrame, element: str) -> DataFrame:
    return candidates.where(F.array_contains("elements", element))
