"""Searches, strict reading of responses, and listing of trees."""

import random

import pytest
from pyspark.sql import functions as F

from tracklark.operators.search import element_index, search_color_index, search_elements, write_color_index, write_element_index
from tracklark.operators.tracks import assign_batches
from tracklark.plans import derived, jobs
from tracklark.sources.analyses import failure, read_analyses
from tracklark.sources.inventory import audio_inventory, tree_inventory

from .conftest import SF


def test_color_index_is_pruned(spark, tmp_path):
    """A search lists one colour's folder, and row groups by the bounds of the path; files are of bounded size."""
    path = str(tmp_path / "index")
    points = jobs.color_index(jobs.annotated_points(derived.library(spark, SF), derived.library_analyses(spark, SF))).persist()
    write_color_index(points, path, file_rows=200)
    found = search_color_index(spark, path, "green", "/music/2")
    want = points.where("color = 'green' and path like '/music/2%'")
    assert sorted(r.path for r in found.collect()) == sorted(r.path for r in want.collect()) and want.count() > 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(color" in plan and "GreaterThanOrEqual(path,/music/2)" in plan and "StringStartsWith(path,/music/2)" in plan
    files = list((tmp_path / "index").glob("color=*/*.parquet"))
    assert len(files) > points.count() / 200
    for f in files:
        paths = [r.path for r in spark.read.parquet(str(f)).collect()]
        assert len(paths) <= 200 and paths == sorted(paths)


NAMES = ["drums", "vocals", "synth", "bass", "a'b"]


def _tracks(r, n):
    def some():
        return [e for e in [*NAMES, None] if r.random() < 0.3] if r.random() < 0.9 else None

    cues = lambda: [(1.0, some(), None, None) for _ in range(r.randrange(3))] if r.random() < 0.9 else None
    loops = lambda: [(1.0, 16.0, some(), None, None) for _ in range(r.randrange(3))] if r.random() < 0.9 else None
    return [(r.choice([i, 10**12 + i, -i]) if i else None, cues(), loops()) for i in range(n)]


def test_element_searches_are_those_of_brute_force(spark, tmp_path):
    r = random.Random(5)
    rows = _tracks(r, 400)
    schema = "n long, measure_changes array<struct<timestamp:double,elements:array<string>,cue_name:string,color:string>>, loop_segments array<struct<start:double,length_beats:double,elements:array<string>,loop_name:string,color:string>>"
    write_element_index(element_index(spark.createDataFrame(rows, schema), "n"), str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    has = {n: {e for c in cues or [] for e in c[1] or []} | {e for c in loops or [] for e in c[2] or []} for n, cues, loops in rows if n is not None}
    for every, none in ((["drums"], []), (["drums", "vocals"], ["synth"]), (["a'b", "bass", "bass"], ["drums", "none such"]), (["none such"], []), (["drums"], ["drums"])):
        got = sorted(x.number for x in search_elements(index, every, none).collect())
        assert got == sorted(n for n, h in has.items() if set(every) <= h and not h & set(none))
    with pytest.raises(ValueError, match="must have"):
        search_elements(index, [])
    plan = search_elements(index, ["drums", "vocals"], ["synth"])._jdf.queryExecution().executedPlan().toString()
    assert "In(element, [drums,synth,vocals])" in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(
    ("said", "loose", "strict", "time"),
    [
        ('[{"timestamp":12.5}]', None, None, 12.5),
        ('[{"timestamp":"12.504"}]', None, None, 12.5),
        ('[{"elements":["drums"]}]', None, None, None),
        ('[{"timestamp":1},{"timestamp":null}]', None, "bad_time", None),
        ('[{"timestamp":"early"}]', None, "bad_time", None),
        ('[{"timestamp":[1]}]', None, "bad_time", None),
        ("null", None, "bad_time", None),
        ('"x"', None, "bad_time", None),
        ("[]", None, None, None),
    ],
)
def test_strict_times(spark, said, loose, strict, time):
    raw = spark.createDataFrame([(f'{{"measure_changes":{said},"loop_segments":[{{"start":3.0}}]}}',)], "raw string")
    assert raw.select(failure(F.col("raw"))).first()[0] == loose
    row = read_analyses(raw, strict=True).first()
    assert (row.failed, row.failure) == (strict is not None, strict)
    if not strict:
        assert row.loop_segments[0].start == 3.0
        assert [c.timestamp for c in row.measure_changes] == ([time] if said != "[]" else [])


def test_strict_failures(spark):
    rows = [("x", "unparsable"), (None, "unparsable"), (" {} ", "empty"), ("[ ]", "empty"), ('{"loop_segments":[{"start":null}]}', "bad_time"), ('{"loop_segments":[{}]}', None), ('{"other":1}', None)]
    got = read_analyses(spark.createDataFrame([(r, w) for r, w in rows], "raw string, want string"), strict=True).collect()
    assert all(r.failure == r.want and r.failed == (r.want is not None) for r in got)


def test_trees_are_listed_by_tasks(spark, tmp_path):
    names = ["a.MP3", "b.txt", "d/c.flac", "d/e/f.ogg", "d/e/g/h/é i.wav", "d/mp3", "z/.hidden.mp3", "w/x.mp3/y.aac"]
    for i, name in enumerate(names):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1" * i)
    (tmp_path / "empty").mkdir()
    roots = [str(tmp_path / "d"), f"file://{tmp_path}", str(tmp_path / "empty"), str(tmp_path / "d")]
    rows = [(r.arg_ord, r.path, r.length) for r in tree_inventory(spark, roots).collect()]
    audio = [(n, i) for i, n in enumerate(names) if n.lower().endswith((".mp3", ".flac", ".wav", ".ogg", ".aac"))]
    want = [(k, f"{tmp_path}/{n}", i) for k, under in enumerate(["d/", "", "empty/", "d/"]) for n, i in sorted(audio) if n.startswith(under)]
    assert rows == want
    assert [r[1:] for r in rows if r[0] == 0] == [(r.path, r.length) for r in audio_inventory(spark, [str(tmp_path / "d")]).collect()]
    with pytest.raises(Exception, match="no such|No such|not exist|not found|PathNotFound|FileNotFound"):
        tree_inventory(spark, [str(tmp_path / "none")]).count()


def test_first_batches_are_chosen_before_they_are_stored(spark, monkeypatch):
    t = spark.createDataFrame([(f"p{i % 7}", i) for i in range(500)], "path string, i long")
    stored = []
    from tracklark.operators import tracks

    checkpoint = tracks.checkpointed
    monkeypatch.setattr(tracks, "checkpointed", lambda rows: stored.append(rows.count()) or checkpoint(rows))
    few = assign_batches(t, ["path", "i"], 5, limit=23).orderBy("idx").collect()
    monkeypatch.setattr(tracks, "TOP", 10)
    assert assign_batches(t, ["path", "i"], 5, limit=23).orderBy("idx").collect() == few
    assert stored == [23, 500] and len(few) == 23




def test_tree_of_tracks_takes_no_blocks(spark, tmp_path):
    """Every track has its file, of its size; together they take hardly any disk."""
    derived.write_track_tree(spark, SF, str(tmp_path / "tree"))
    files = {p.name: p.stat() for p in (tmp_path / "tree").rglob("*.*")}
    want = {r.file_path.rsplit("/", 1)[1]: r.k % 100 for r in derived.tracks(spark, SF).collect()}
    assert {n: s.st_size for n, s in files.items()} == want
    assert sum(s.st_blocks for s in files.values()) == 0


def test_stream_of_any_size_is_dealt_out(spark, monkeypatch):
    """Responses are written by all tasks, buckets are as many as the songs ask for, and two batches take all files."""
    from tracklark import queries
    from tracklark.sources.files import exists, read_text

    monkeypatch.setattr(queries, "BUCKET_SONGS", 100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        at = queries._stream(spark, SF)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = spark.read.text(at.removesuffix("library") + "responses").inputFiles()
    assert len(files) == 8 and read_text(spark, f"{at}/state/latest") == "2"
    assert len(read_text(spark, f"{at}/state/2.json").split(",")) == 8 + derived.tracks(spark, SF).count() // 100
    assert not exists(spark, f"{at}/work/batch=0") and not exists(spark, f"{at}/work/batch=1")


def test_responses_are_parsed_once(spark):
    """The plan of a strict reading has each parser once, whatever asks for their parts."""
    raw = spark.createDataFrame([('{"measure_changes":[{"timestamp":"1.5"}]}', 1)], "raw string, k int")
    rows = read_analyses(raw, strict=True)
    plan = rows.select("k", "failed", "failure", F.size("measure_changes"), F.exists("measure_changes", lambda c: c["timestamp"] > 1))._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.lower().count(name) for name in ("parsejson", "from_json")] == [1, 1] or [plan.lower().count(name) for name in ("parse_json", "from_json")] == [1, 1], plan


def test_published_tables_are_stored(spark, monkeypatch):
    """A table that is published is made once: what `publish` gets has no joins to run again."""
    from tracklark import queries

    plans, publish = [], queries.published.publish
    monkeypatch.setattr(queries.published, "publish", lambda one, *args: plans.append(one._jdf.queryExecution().optimizedPlan().toString()) or publish(one, *args))
    queries.k2_publish_library(spark, SF)
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_candidates_are_collected_in_one_sort(spark):
    """No aggregation of lists, which would sort its rows again for want of room: neither for analyses nor for points."""
    plan = jobs.make_points(derived.analysed_tracks(spark, SF), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_tags_are_counted_in_a_hash_table(spark, tmp_path):
    """Files are looked through for damage without a sort of their tags; the last tag of a file is that of its last block."""
    from tracklark.config import DEFAULT
    from tracklark.sources import library as documents

    (tmp_path / "a.xml").write_text("<VirtualDJ_Database>" + "<Song FilePath='x'><Comment>c</Comment></Song>\n" * 2000 + "</VirtualDJ_Database >\n \n")
    (tmp_path / "b.xml").write_text("<VirtualDJ_Database><Song FilePath='/x/'/ ></Song></VirtualDJ_Database><Song/>")
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.set(f"spark.sql.files.{name}", "4k")
    try:
        counts = documents._tag_counts(spark, str(tmp_path), DEFAULT)
        rows = {r.file[-5:]: r for r in counts.collect()}
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{name}")
    assert "SortAggregate" not in counts._jdf.queryExecution().executedPlan().toString()
    a, b = rows["a.xml"], rows["b.xml"]
    assert a["__end"] == a["__last"] and a["__open"] == 0 and a["__begun"] == 2000 and not a["__control"]
    assert b["__end"] < b["__last"] and b["__ends"] == 1


def test_songs_are_cut_at_their_last_end(spark):
    from tracklark.sources.library import _song

    texts = {' A="x>/"/> <!-- </Song> -->': ' A="x>/"/>', "><a/></Song> x": "><a/></Song>", "></Song></Song >\n": "></Song></Song >", "></Song></Songs>": "></Song>", "><a/>": "", "></Song\n> </Song> y": "></Song\n> </Song>"}
    rows = spark.createDataFrame([(t, w) for t, w in texts.items()], "t string, w string").select("w", _song(F.col("t")).alias("got")).collect()
    assert all(r.got == r.w for r in rows)


def test_edited_documents_are_exported_alone(spark, monkeypatch):
    """When edited documents are exported, those that were read are gone, and no shuffle of the edit is left to be kept."""
    from tracklark import queries
    from tracklark.sources.files import folder_names

    seen, write, scratch = [], queries.documents.write_library, queries._scratch
    monkeypatch.setattr(queries, "_scratch", lambda *args: seen.append(scratch(*args)) or seen[-1])
    monkeypatch.setattr(queries.documents, "write_library", lambda one, *args: seen.append(one._jdf.queryExecution().optimizedPlan().toString()) or write(one, *args))
    queries.k1_lossless_edit(spark, SF)
    path, plan = seen
    assert folder_names(spark, path) == ["out"] and "Join" not in plan


def test_songs_are_cut_once_or_twice_alike(spark):
    """A song that holds the mark of the pieces is searched without it."""
    from tracklark.functions.splice import spliced_song
    from tracklark.schemas import POI

    song = '<Song FilePath="/x$1\\"><!-- a --><Poi Type="cue" Num="1"/> {}<Poi Type="cue" Num="0"/>\n<Comment>c$0</Comment> <Link/></Song >'
    rows = spark.createDataFrame([(song.format(x), [("n$1", "1.0", "1", None, "cue", None, None)]) for x in ("", "\x01", "<Odd/>\x01\x01")], f"raw string, new array<{POI}>")
    want = '<Song FilePath="/x$1\\"><!-- a -->{}<Poi Type="cue" Num="0"/>\n<Comment>blue</Comment> <Link/><Poi Name="n$1" Pos="1.0" Num="1" Type="cue" /></Song >'
    got = [r[0] for r in rows.select(spliced_song(F.col("raw"), F.col("new"), F.lit("blue"))).collect()]
    assert got == [want.format(x) for x in ("", "\x01", "<Odd/>\x01\x01")]
    plain = [r[0] for r in rows.select(spliced_song(F.replace("raw", F.lit("</Song >"), F.lit("</Song>")), F.col("new"), F.lit("blue"))).collect()]
    assert plain == [g.replace("</Song >", "</Song>") for g in got]
