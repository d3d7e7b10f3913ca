"""Registered queries: each operator applied to the driver's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .functions import beats, elements, text
from .operators import candidates as ops
from .operators import pois, search, tracks
from .plans import derived, jobs
from .plans.oracles import ORACLE_SQL
from .sources import analyses as responses
from .sources import library as documents
from .sources import published
from .sources.files import delete

SINGLE = replace(DEFAULT, policy="single")
K = ["k"]
#: Songs in a bucket of a stream's library.
BUCKET_SONGS = 250_000


def _bpm():
    return beats.track_bpm(F.col("scan_bpm"), F.col("tags_bpm"))


def _t(spark: SparkSession, d: str) -> DataFrame:
    return derived.tracks(spark, d)


def _c(spark: SparkSession, d: str) -> DataFrame:
    return derived.candidates(spark, d)


def _with_track(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with their track's attributes and aligned time."""
    t = _t(spark, d).select("k", _bpm().alias("bpm"), "song_length", F.col("beatgrid_pos").alias("grid_pos"))
    return ops.align(_c(spark, d).join(t, "k"))


def _cues(spark: SparkSession, d: str) -> DataFrame:
    return ops.align(ops.explode_cues(derived.analysed_tracks(spark, d)))


def _loops(spark: SparkSession, d: str, cfg=DEFAULT) -> DataFrame:
    return ops.align(ops.explode_loops(derived.analysed_tracks(spark, d), cfg), cfg)


def _points(spark: SparkSession, d: str) -> DataFrame:
    return jobs.make_points(derived.analysed_tracks(spark, d), K)


# scalars
def p1_is_audio_path(spark, d):
    return _t(spark, d).select("k", text.is_audio_path(F.col("file_path")).alias("is_audio"))


def p2_basename_size(spark, d):
    return _t(spark, d).select("k", text.basename(F.col("file_path")).alias("name"), text.size_mb(F.col("k") * 1000).alias("mb"))


def p3_nfc_path(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.md5(text.nfc_path(F.col("text")).cast("binary")).alias("nfc"))


def p4_sanitize_xml_text(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.md5(text.sanitize_xml_text(F.concat(F.lit(" \t"), "text", F.lit(" \n"))).cast("binary")).alias("clean"))


def _raw_numbers():
    digits = F.lpad((F.col("suppkey") * 123456789).cast("string"), 12, "0")
    return F.concat(F.lit('{"t": '), F.col("partkey").cast("string"), F.lit("."), digits, F.lit(', "u": '), F.col("linenumber").cast("string"), F.lit(".5}"))


def p5_repair_long_decimals(spark, d):
    return _c(spark, d).select("k", "pos", text.repair_long_decimals(_raw_numbers()).alias("repaired"))


def p6_round_times(spark, d):
    return _c(spark, d).select("k", "pos", text.round_time(F.col("ts") / 3).alias("seconds"))


def p6_round_times_exact(spark, d):
    """Times at and beside the middle between two hundredths, rounded by their binary value."""
    odd = (F.col("partkey") * 10 + 5) / 1000
    return _c(spark, d).select("k", "pos", F.format_string("%.3f", text.round_time(odd, exact=True)).alias("rounded"))


def p7_normalize_bpm(spark, d):
    return _t(spark, d).select("k", beats.normalize_bpm(F.col("scan_bpm")).alias("bpm"))


def p8_track_bpm(spark, d):
    return _t(spark, d).select("k", _bpm().alias("bpm"), beats.working_bpm(_bpm()).alias("working_bpm"))


def p9_classify_color(spark, d):
    return _c(spark, d).select("k", "pos", elements.classify_color(F.col("elements")).alias("color"))


def p10_color_correction(spark, d):
    fix = elements.color_correction(F.col("elements"), F.col("color"))
    return _c(spark, d).select("k", "pos", fix["corrected"].alias("corrected"), fix["reason"].alias("reason"))


def p11_encode_color(spark, d):
    code = elements.encode_color(F.when(F.col("pos") % 4 == 0, "other").otherwise(F.col("color")))
    return _c(spark, d).select("k", "pos", code.alias("code"), elements.decode_color(code).alias("name"))


def p12_cue_name(spark, d):
    return _c(spark, d).select("k", "pos", elements.cue_name(F.col("name"), F.col("elements"), F.col("pos")).alias("cue_name"))


def p13_loop_name(spark, d):
    return _c(spark, d).select("k", "pos", elements.loop_name(F.col("name"), F.col("elements")).alias("loop_name"))


def p14_loop_priority(spark, d):
    rank = lambda policy: elements.loop_priority(F.col("elements"), policy).cast("long")
    return _c(spark, d).select("k", "pos", rank("batch").alias("batch"), rank("single").alias("single"))


def p15_snap_to_downbeat(spark, d):
    return _with_track(spark, d).select("k", "pos", text.format_position(F.col("t")).alias("at"))


def p16_cue_in_range(spark, d):
    return _with_track(spark, d).select("k", "pos", beats.cue_in_range(F.col("t"), F.col("song_length")).alias("inside"))


def p17_loop_in_range(spark, d):
    return _with_track(spark, d).select("k", "pos", beats.loop_in_range(F.col("t"), F.col("song_length")).alias("inside"))


def p18_has_elements(spark, d):
    return _c(spark, d).where(elements.has_elements(F.col("elements"))).select("k", "pos")


def _old_points(spark, d):
    kind = F.element_at(F.array(F.lit("cue"), F.lit("loop"), F.lit("beatgrid")), (F.col("linenumber") % 3 + 1).cast("int"))
    num = F.element_at(F.array(F.lit(None).cast("string"), F.lit("0"), F.lit("-1"), F.lit("2"), F.lit("00")), (F.col("suppkey") % 5 + 1).cast("int"))
    return _c(spark, d).select("k", "pos", kind.alias("type"), num.alias("num"))


def p19_is_replaceable_poi(spark, d):
    return _old_points(spark, d).withColumn("replaceable", pois.is_replaceable_poi(F.col("type"), F.col("num")))


def p20_format_position(spark, d):
    return _c(spark, d).select("k", "pos", text.format_position(F.col("ts") / 7).alias("at"), F.coalesce("length_beats", F.lit(16.0)).cast("string").alias("size"))


def p21_capitalize(spark, d):
    return _c(spark, d).select("k", "pos", text.capitalize(F.col("color")).alias("shown"))


def _index(spark, d):
    return jobs.color_index(jobs.annotated_points(derived.library(spark, d), derived.library_analyses(spark, d)))


def p22_filter_cues_by_color(spark, d):
    return jobs.filter_cues_by_color(_index(spark, d), "purple").select("path", "type", "name", "pos")


def p22_search_color_index(spark, d):
    """Purple points of one folder of tracks, from the written index."""
    path = _scratch(spark, "colors")
    search.write_color_index(_index(spark, d), path)
    return search.search_color_index(spark, path, "purple", "/music/1").select("path", "type", "name", "pos")


def p23_search_elements(spark, d):
    """Tracks with drums and vocals but no synth, from the written index."""
    path = _scratch(spark, "elements")
    search.write_element_index(search.element_index(derived.analyses(spark, d), "k"), path)
    return search.search_elements(spark.read.parquet(path), ["drums", "vocals"], ["synth"]).withColumnRenamed("number", "k")


def p23_filter_cues_by_element(spark, d):
    return jobs.filter_cues_by_element(_c(spark, d), "piano").select("k", "pos", "kind")


# joins
def _some(spark, d):
    return _t(spark, d).where("k % 3 <> 0").select("k", "file_path")


def j1_tracks_in_library(spark, d):
    return tracks.tracks_in_library(_t(spark, d).select("k", "file_path"), _some(spark, d), ["file_path"])


def j2_tracks_missing(spark, d):
    return tracks.tracks_missing(_t(spark, d).select("k", "file_path"), _some(spark, d), ["file_path"])


def j3_first_song(spark, d):
    songs = _t(spark, d).select(F.concat(F.lit("/music/"), F.col("custkey").cast("string")).alias("path"), F.col("k").alias("song_ord"))
    return tracks.first_song(songs, ["path"])


def j4_track_attributes(spark, d):
    songs = _t(spark, d).select("custkey", F.col("k").alias("song_ord"), "song_length", "scan_bpm", "tags_bpm", F.col("beatgrid_pos").alias("grid_pos"))
    return tracks.attributes(songs, ["custkey"]).drop("first_ord")


def j4_malformed_scan(spark, d):
    """A song whose scan is no number ends the search for a BPM, without one."""
    t = _t(spark, d).where("custkey is not null")
    scan = F.when(F.col("k") % 6 == 3, "fast").otherwise(F.col("scan_bpm").cast("string"))
    songs = t.select("custkey", F.col("k").alias("song_ord"), "song_length", scan.alias("scan_bpm"), F.col("tags_bpm").cast("string").alias("tags_bpm"), F.col("beatgrid_pos").alias("grid_pos"))
    return tracks.attributes(songs, ["custkey"]).select("custkey", "bpm", "first_ord")


def j4_nfc_attributes(spark, d):
    """Paths spelled in another normal form than the library's: attributes by the path as written, and by its normal form."""
    library = derived.library(spark, d).withColumn("path", F.concat("path", F.lit("e\u0301")))
    library = tracks.with_key(library)
    asked = tracks.with_key(library.select("library_id", F.concat(F.regexp_replace("path", "e\u0301$", ""), F.lit("\u00e9")).alias("path"), F.col("song_ord").alias("k")))
    found = [tracks.with_attributes(asked, library, replace(DEFAULT, attribute_key=key)).select("k", F.col("song_length").alias(key), F.col("first_ord").alias(f"{key}_ord")) for key in ("exact", "nfc")]
    return found[0].join(found[1], "k")


def j5_analyses_to_tracks(spark, d):
    joined = _t(spark, d).select("k", "file_path").join(derived.analyses(spark, d), "k")
    return joined.select("k", "file_path", F.size("measure_changes").cast("long").alias("cues"), F.size("loop_segments").cast("long").alias("loops"), _seconds())


def j6_batch_position_join(spark, d):
    files = _t(spark, d).select("k", F.expr("k div 5").alias("batch_id"), (F.col("k") % 5).alias("idx_in_batch"))
    results = derived.analyses(spark, d).where("k % 4 <> 0").select(F.expr("k div 5").alias("batch_id"), (F.col("k") % 5).alias("idx"), "measure_changes", "loop_segments")
    return responses.batch_position_join(files, results).select("k", "batch_id", "failed", F.coalesce(F.size("measure_changes"), F.lit(0)).cast("long").alias("cues"), _seconds())


def j7_candidates_before_end(spark, d):
    c = _with_track(spark, d)
    inside = F.when(F.col("kind") == "cue", beats.cue_in_range(F.col("t"), F.col("song_length"))).otherwise(beats.loop_in_range(F.col("t"), F.col("song_length")))
    return c.where(inside).select("k", "pos", "kind")


def j8_nearest_downbeat(spark, d):
    c = _with_track(spark, d)
    return c.groupBy("kind").agg(F.count("*").alias("candidates"), F.count_if(F.col("t") != F.col("ts")).alias("moved"))


# aggregations
def a1_color_comment(spark, d):
    comments = pois.color_comment(_points(spark, d), K)
    return _t(spark, d).select("k").join(comments, "k", "left").select("k", F.coalesce("comment", F.lit("")).alias("comment"))


def a2_cue_loop_counts(spark, d):
    cues = ops.align(ops.explode_cues(derived.analysed_tracks(spark, d))).where(beats.cue_in_range(F.col("t"), F.col("song_length"))).groupBy("k").agg(F.count("*").alias("cues"))
    loops = ops.select_loops(_loops(spark, d), K).groupBy("k").agg(F.count("*").alias("loops"))
    return cues.join(loops, "k", "full").select("k", F.coalesce("cues", F.lit(0)).alias("cues"), F.coalesce("loops", F.lit(0)).alias("loops"))


def a3_analysis_sizes(spark, d):
    return derived.analyses(spark, d).select("k", F.size("measure_changes").cast("long").alias("cues"), F.size("loop_segments").cast("long").alias("loops"))


def a4_batch_totals(spark, d):
    rows = _t(spark, d).select(F.expr("k div 1000").alias("batch_id"), F.col("k"))
    return rows.rollup("batch_id").agg(F.count("*").alias("tracks"), F.sum(F.col("k") * 1000).cast("long").alias("bytes"), F.count_if(F.col("k") % 3 != 0).alias("applied"))


def a5_removed_counts(spark, d):
    return _old_points(spark, d).groupBy("k").agg(F.count_if(pois.is_replaceable_poi(F.col("type"), F.col("num"))).alias("removed"))


def a5_removed_from_songs(spark, d):
    """How many of a song's old points an edit removes, counted in the song's row."""
    one = F.struct(*(F.lit(None).cast("string").alias(f"_{n}") if n not in ("Num", "Type") else F.col(n.lower()).alias(f"_{n}") for n in ("Name", "Pos", "Num", "Color", "Type", "Size", "Slot")))
    songs = _old_points(spark, d).groupBy("k").agg(F.collect_list(one).alias("pois"))
    return songs.select("k", pois.removed_count(F.col("pois")).cast("long").alias("removed"))


def a6_color_usage(spark, d):
    return _points(spark, d).cube("color", "kind").agg(F.count("*").alias("points"), F.count_distinct("k").alias("tracks"))


def a7_correction_rate(spark, d):
    c = _c(spark, d).where(elements.has_elements(F.col("elements")))
    return c.groupBy(F.col("color").alias("proposed"), elements.classify_color(F.col("elements")).alias("final")).agg(F.count("*").alias("candidates"))


# windows
def w1_first_six_cues(spark, d):
    return ops.explode_cues(derived.analyses(spark, d)).select("k", F.col("pos").cast("long").alias("pos"), "ts")


def w2_number_cues(spark, d):
    return ops.number_cues(_cues(spark, d), K).select("k", F.col("pos").cast("long").alias("pos"), "num", "consumed")


def _chosen(loops):
    return loops.select("k", F.col("pos").cast("long").alias("pos"), "name", F.col("rank").cast("long").alias("rank"))


def w3_select_loops(spark, d):
    return _chosen(ops.select_loops(_loops(spark, d), K))


def w3b_select_loops_single(spark, d):
    return _chosen(ops.select_loops(_loops(spark, d, SINGLE), K, SINGLE))


def w4_chronological_pois(spark, d):
    return _points(spark, d).select("k", "ord", "kind", "num", "name", text.format_position(F.col("t")).alias("at"), "color")


def w5_loop_slots(spark, d):
    return _points(spark, d).where("kind = 'loop'").select("k", "slot", "name")


def w6_summary_labels(spark, d):
    return ops.summary_labels(_points(spark, d), K).select("k", "label", text.format_position(F.col("t")).alias("at"))


def w7_assign_batches(spark, d):
    return tracks.assign_batches(_t(spark, d).select("k", "file_path"), ["file_path"]).select("k", "idx", "batch_id")


def w8_latest_analysis(spark, d):
    rows = _c(spark, d).select("partkey", F.expr("k div 5").alias("batch_id"), (F.col("k") * 10 + F.col("pos")).alias("idx"))
    return tracks.latest_analysis(rows, ["partkey"])


# set operations, sources, jobs
def u1_replace_pois(spark, d):
    rows = jobs.annotate_library(derived.library(spark, d), derived.library_analyses(spark, d))
    kept = F.size(F.filter("pois", lambda p: p["_Name"].isin("old", "keep") | (p["_Type"] == "beatgrid")))
    return rows.select("path", F.size("pois").cast("long").alias("points"), kept.cast("long").alias("kept"))


def u2_upsert_library(spark, d):
    rows = jobs.annotate_library(derived.library(spark, d), derived.library_analyses(spark, d))
    return rows.select("library_id", "song_ord", "path", F.array_join("comments", "|").alias("comments"))


def u3_input_union(spark, d):
    t = _t(spark, d).select("k", "file_path")
    return tracks.audio_only(tracks.input_union(t.where("k % 3 <> 0"), t.where("k % 2 = 0 or k % 3 = 0")), "file_path").select(F.col("arg_ord").cast("long").alias("arg_ord"), "k")


def s1_audio_inventory(spark, d):
    """Audio files of a tree with a file for each track, listed by tasks."""
    from .sources.inventory import tree_inventory

    path = _scratch(spark, "tree")
    derived.write_track_tree(spark, d, path)
    found = tree_inventory(spark, [f"{path}/1", path])
    root = path.removeprefix("file:").rstrip("/")
    return found.select(F.col("arg_ord").cast("long").alias("arg_ord"), F.regexp_replace("path", f"^.*{root.rsplit('/', 1)[1]}/", "").alias("path"), "length")


def s2_read_library(spark, d):
    """Songs written as XML and read again, as text throughout."""
    path = _scratch(spark, "library")
    documents.write_library(derived.library(spark, d), path)
    back = documents.read_export(spark, path)
    return back.select("path", "song_length", "grid_pos", _contents().alias("contents"), F.array_join("comments", "|").alias("comments"))


def s3_repair_library_text(spark, d):
    c = _c(spark, d).withColumn("n", F.col("pos").cast("string"))
    damaged = F.concat(F.lit("<VirtualDJ_Database><Song>\x01"), "n", F.lit("</Song>\n</Song></VirtualDJ_Database>\n</VirtualDJ_Database> rest"))
    return c.select("k", "pos", text.repair_library_text(damaged, DEFAULT.root_tag).alias("repaired"))


def _responses(spark, d):
    a = derived.analyses(spark, d)
    raw = F.to_json(F.struct("measure_changes", "loop_segments"))
    return a.select("k", F.when(F.col("k") % 11 == 0, F.lit("not json")).when(F.col("k") % 13 == 0, F.lit("{}")).otherwise(raw).alias("raw"))


def s4_read_analyses(spark, d):
    parsed = responses.read_analyses(_responses(spark, d))
    return parsed.select("k", "failed", F.coalesce(F.size("measure_changes"), F.lit(0)).cast("long").alias("cues"), _seconds())


def s4_strict_times(spark, d):
    """Responses of which some say a time that is null, a text or no number, read strictly, with the reason of failure."""
    a = derived.analyses(spark, d).where(F.size("measure_changes") > 0)
    raw = F.to_json(F.struct("measure_changes", "loop_segments"))
    time = '"timestamp":([0-9.E-]+),'
    said = lambda text: F.regexp_replace(raw, time, text)
    k = F.col("k")
    made = F.when(k % 7 == 0, said('"timestamp":null,')).when(k % 5 == 0, said("")).when(k % 9 == 0, said('"timestamp":"early",')).when(k % 4 == 0, said('"timestamp":"$1",')).otherwise(raw)
    parsed = responses.read_analyses(a.select("k", made.alias("raw")), strict=True)
    return parsed.select("k", "failed", "failure", F.coalesce(F.size("measure_changes"), F.lit(0)).cast("long").alias("cues"), _seconds())


def _seconds():
    """The sum of the cues' times as text."""
    total = F.aggregate("measure_changes", F.lit(0.0), lambda s, c: s + c["timestamp"])
    return F.format_string("%.3f", F.coalesce(total, F.lit(0.0))).alias("seconds")


def s5_read_batch_analyses(spark, d):
    a = derived.analyses(spark, d).withColumn("batch_id", F.expr("k div 5"))
    listed = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", "measure_changes", "loop_segments"))), lambda x: x.dropFields("k")))
    raw = a.groupBy("batch_id").agg(listed.alias("list")).select("batch_id", F.when(F.col("batch_id") % 2 == 0, F.col("list")).otherwise(F.concat(F.lit('{"analyses":'), "list", F.lit("}"))).alias("raw"))
    return responses.read_batch_analyses(raw).select("batch_id", "idx", F.size("measure_changes").cast("long").alias("cues"), F.size("loop_segments").cast("long").alias("loops"), _seconds())


def b1_annotate_library(spark, d):
    return jobs.annotated_points(derived.library(spark, d), derived.library_analyses(spark, d))


def b2_preview(spark, d):
    return jobs.preview(derived.analyses(spark, d), K)


def b3_preview_detailed(spark, d):
    return jobs.preview_detailed(derived.analysed_tracks(spark, d), K)


def b4_request_table(spark, d):
    t = _t(spark, d).select("k", F.col("file_path").alias("path"), "song_length", _bpm().alias("bpm"), F.expr("k div 5").alias("batch_id"), (F.col("k") % 5).alias("idx_in_batch"))
    return jobs.request_batches(jobs.request_table(t))


def _statuses(spark, d):
    t = _t(spark, d).select("k", F.col("file_path"), F.expr("k div 5").alias("batch_id"))
    return jobs.track_status(t, t.where("k % 10 <> 0"), t.where("k % 3 <> 0"), t.where("k % 7 <> 0"), ["file_path"])


def b5_track_status(spark, d):
    return _statuses(spark, d).select("k", "batch_id", "status")


def k4_run_report(spark, d):
    return jobs.run_report(_statuses(spark, d))


def b6_color_index(spark, d):
    return _index(spark, d).select("color", "type", "path", "pos", "name")


def _stream(spark, d):
    """A library after responses that came in files: the newest first, older ones of the same tracks after them, and some
    that can't be used."""
    from .streaming.incremental import RAW, annotate_incremental, write_first_version

    path = _scratch(spark, "incremental")
    # buckets of about the same size, and files of what each task has, whatever the size of the tables
    write_first_version(derived.library(spark, d), f"{path}/library", buckets=8 + derived.tracks(spark, d).count() // BUCKET_SONGS)
    a = tracks.stored(derived.library_analyses(spark, d))
    raw = F.to_json(F.struct("measure_changes", "loop_segments"))
    a.select("library_id", "path", "batch_id", "idx", raw.alias("raw")).write.option("compression", "gzip").json(f"{path}/responses")
    newest = len(spark.read.schema(RAW).json(f"{path}/responses").inputFiles())
    early = F.struct(F.transform("measure_changes", lambda c: c.withField("timestamp", F.lit(1.0))).alias("measure_changes"), F.col("loop_segments"))
    odd = F.col("batch_id") % 10 == 0
    old = a.select("library_id", F.when(F.col("batch_id") % 7 == 0, F.concat(F.lit("/none"), "path")).otherwise(F.col("path")).alias("path"), (F.col("batch_id") - 10**9).alias("batch_id"), "idx", F.when(odd, "{broken").otherwise(F.to_json(early)).alias("raw"))
    old.write.mode("append").option("compression", "gzip").json(f"{path}/responses")
    annotate_incremental(spark, f"{path}/responses", f"{path}/library", f"{path}/checkpoint", files_per_batch=newest).awaitTermination()
    return f"{path}/library"


def t1_annotate_incremental(spark, d):
    """Responses arriving in files, the newest first; the final library, to be equal to that of one batch."""
    from .streaming.incremental import latest_version

    rows = latest_version(spark, _stream(spark, d))
    return rows.select("library_id", "song_ord", "path", F.array_join("comments", "|").alias("comments"), F.size("pois").cast("long").alias("points"), F.array_join(F.transform("pois", lambda p: p["_Pos"]), ",").alias("at"))


def t1_rejected_responses(spark, d):
    """The responses of a stream that couldn't be used, with the reason."""
    from .streaming.incremental import rejected

    return rejected(spark, _stream(spark, d)).select("library_id", "path", "batch_id", "idx", "reason")


def t1_stream_report(spark, d):
    """What became of all responses of a stream."""
    from .streaming.incremental import REASONS, stream_report

    return stream_report(spark, _stream(spark, d)).agg(*(F.sum(c).alias(c) for c in ("responses", "usable", *REASONS)))


def k1_export_library(spark, d):
    """The points of the annotated library after an export and the reading of it."""
    path = _scratch(spark, "export")
    documents.write_library(jobs.annotate_library(derived.library(spark, d), derived.library_analyses(spark, d)), path)
    return jobs.poi_rows(documents.read_export(spark, path)).drop("song_ord")


def s2_read_raw_library(spark, d):
    """Songs of documents from elsewhere, with their text as it stands there."""
    path = _scratch(spark, "foreign")
    derived.write_foreign_library(spark, d, path)
    rows = documents.read_raw_library(spark, path, folders=True)
    return rows.select("library_id", "path", "scan_bpm", "tags_bpm", F.size("pois").cast("long").alias("points"), "raw", (F.length("after") > 0).alias("followed"))


def k1_lossless_edit(spark, d):
    """Documents from elsewhere, annotated and exported; the text of their songs in the export."""
    path = _scratch(spark, "foreign")
    derived.write_foreign_library(spark, d, f"{path}/in")
    library = documents.read_raw_library(spark, f"{path}/in", folders=True)  # stored as parsed; none of these is damaged and read again
    delete(spark, f"{path}/in")
    annotated = tracks.stored(jobs.annotate_library(library, derived.library_analyses(spark, d)))  # its shuffles go before the export
    documents.write_library(annotated, f"{path}/out")
    return documents.read_raw_library(spark, f"{path}/out", folders=True).select("library_id", "path", "raw")


def k2_publish_library(spark, d):
    """The songs and points of a library that was published over an earlier one."""
    path = _scratch(spark, "publish")
    library = derived.library(spark, d)
    for one in (jobs.annotate_library(library, derived.library_analyses(spark, d)), library):
        if not published.publish(tracks.stored(one), spark, path):  # written, and compared with what was
            raise RuntimeError("the export isn't what was written")
    number = lambda c: F.col(c).cast("double").alias(c)
    rows = published.read_published(spark, path)
    return rows.select("path", number("song_length"), number("scan_bpm"), number("tags_bpm"), number("grid_pos"), _contents().alias("contents"), F.array_join("comments", "|").alias("comments"))


def k2_export_differences(spark, d):
    """The documents of an export that no longer hold what the table does: some paths, points and comments have changed."""
    path, cfg = _scratch(spark, "differences"), replace(DEFAULT, songs_per_document=500)
    library = derived.library(spark, d)
    documents.write_library(library, path, cfg)
    k = F.col("song_ord") % 4000
    moved = F.transform("pois", lambda p: p.withField("_Pos", F.lit("9.0")))
    library = library.withColumn("path", F.when(k == 1, F.concat("path", F.lit("x"))).otherwise(F.col("path"))).withColumn("pois", F.when(k == 1002, moved).otherwise(F.col("pois")))
    library = library.withColumn("comments", F.when(k == 2003, F.reverse("comments")).otherwise(F.col("comments")))
    return published.export_differences(library, spark, path, cfg)


def k3_snapshot_library(spark, d):
    path = _scratch(spark, "snapshots")
    documents.snapshot_library(derived.library(spark, d), path, "20250101_000000")
    rows = spark.read.parquet(f"{path}/snapshot=20250101_000000")
    return rows.select("library_id", "song_ord", "path", _contents().alias("contents"), F.array_join("comments", "|").alias("comments"))


def _contents():
    """A song's points as text; what is null is left out."""
    return F.array_join(F.transform("pois", lambda p: F.concat_ws(":", p["_Type"], p["_Num"], p["_Name"], p["_Pos"], p["_Color"])), "|")


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, removed when the driver ends."""
    import tempfile
    import uuid

    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tracklark-")
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


QUERIES = {name: f for name, f in list(globals().items()) if name[0] in "abjkpstuw" and name[1:2].isdigit() and callable(f)}

__all__ = ["ORACLE_SQL", "QUERIES"]
