"""Jobs on small libraries: selection, upserts, documents, streams and plans."""

import json
import os
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracklark.config import CueConfig
from tracklark.operators.candidates import align, explode_candidates, new_points, number_cues, select_loops
from tracklark.operators.tracks import assign_batches, first_song, tracks_in_library, tracks_missing
from tracklark.plans import derived, jobs
from tracklark.sources import analyses as responses
from tracklark.sources import library as documents
from tracklark.sources import published
from tracklark.sources.inventory import audio_inventory
from tracklark.streaming import incremental
from tracklark.streaming.incremental import annotate_incremental, latest_version, library_at, write_first_version

from .conftest import SF

ANALYSIS = "k long, bpm double, song_length double, grid_pos double, measure_changes array<struct<timestamp:double,elements:array<string>,cue_name:string,color:string>>, loop_segments array<struct<start:double,length_beats:double,elements:array<string>,loop_name:string,color:string>>"


@pytest.fixture(scope="module")
def golden(spark):
    cues = [(10.0, ["drums"], None, None), (400.0, ["fx"], None, None), (20.0, [], None, None), (30.0, ["synth"], None, "green")]
    loops = [(20.0, None, ["drums"], None, None), (30.0, 8.0, ["synth"], None, None), (40.0, None, ["vocals"], "Xl", None), (50.0, None, ["vocals", "drums"], "Xl", None)]
    return spark.createDataFrame([(1, 250.0, 300.0, None, cues, loops), (2, None, None, None, None, None), (3, 128.0, 0.0, 0.05, [], [])], ANALYSIS)


@pytest.mark.parametrize(("policy", "loops"), [("batch", ["drumsl", "Xl"]), ("single", ["drumsl", "synthl", "Xl"])])
def test_selection(golden, policy, loops):
    rows = jobs.make_points(golden, ["k"], CueConfig(policy=policy)).where("k = 1").orderBy("ord").collect()
    assert [(r.num, r.t) for r in rows if r.kind == "cue"] == [("1", 10.0), ("3", 30.0)]
    found = [r for r in rows if r.kind == "loop"]
    assert [r.name for r in sorted(found, key=lambda r: r.slot)] == loops
    assert [r.slot for r in found] == list(range(1, len(loops) + 1))


XML = """<VirtualDJ_Database Version="8">
 <Song FilePath="/m/a.mp3"><Tags Bpm="0.46"/><Infos SongLength="200.5"/><Scan Bpm="0.468750"/>
  <Poi Pos="0.05" Type="beatgrid"/>
  <Poi Name="old" Pos="1.0" Num="1" Color="4278190335" Type="cue"/>
  <Poi Name="keep" Pos="2.0" Num="0" Type="cue"/><Comment>old</Comment><Comment>mine</Comment></Song></Song>
 <Song FilePath="/m/b.mp3"><Poi Pos="0.05" Type="beatgrid"/></Song><Song FilePath="/m/a.mp3"/><Song><Infos SongLength="1"/></Song>
 <Song FilePath="/m/{accent}.mp3"><Infos SongLength="9"/></Song>
</VirtualDJ_Database></VirtualDJ_Database>junk"""


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lib") / "db.xml"
    path.write_text(XML.replace("{accent}", unicodedata.normalize("NFD", "é")), encoding="utf-8")
    return documents.read_damaged_library(spark, str(path)).cache()


def analyses(spark, library, path, time=45.23, batch=0):
    cue = [(time, ["drums", "synth"], "Drums In", "blue")]
    row = (path, batch, 0, cue, [])
    schema = "path string, batch_id long, idx long, " + ANALYSIS.split("grid_pos double, ")[1]
    return spark.createDataFrame([row], schema).crossJoin(library.select("library_id").distinct())


def test_damaged_library_is_read(library):
    rows = library.orderBy("song_ord").collect()
    assert [r.path for r in rows] == ["/m/a.mp3", "/m/b.mp3", "/m/a.mp3", "", "/m/é.mp3"]
    assert (rows[0].scan_bpm, rows[0].song_length, rows[0].grid_pos, len(rows[0].pois)) == ("0.468750", "200.5", "0.05", 3)


def test_upsert(spark, library):
    both = analyses(spark, library, "/m/a.mp3", 10.0).union(analyses(spark, library, "/m/a.mp3", 45.23, batch=1))
    done = jobs.annotate_library(library, both).orderBy("song_ord")
    rows = done.collect()
    assert [(p._Name, p._Num) for p in rows[0].pois] == [(None, None), ("keep", "0"), ("Drums In", "1")]
    assert rows[0].pois[2]._Pos == "45.050000"
    assert rows[0].comments == ["green", "mine"]
    assert rows[2].pois == [] and rows[2].comments == []
    assert [len(rows[i].pois) for i in (1, 3, 4)] == [1, 0, 0]
    again = jobs.annotate_library(done, both).orderBy("song_ord").collect()
    assert again == rows


def test_path_forms(spark, library):
    """A composed path finds its song, but not its length, unless attributes go by normal form."""
    late = analyses(spark, library, "/m/é.mp3", 100.0)
    points = lambda cfg: jobs.annotate_library(library, late, cfg).where("song_ord = 4").first().pois
    assert len(points(CueConfig())) == 1
    assert points(CueConfig(attribute_key="nfc")) == []


def test_round_trip_and_publish(spark, library, tmp_path):
    target = str(tmp_path / "out")
    assert published.publish(library, spark, target)
    texts = [p.read_bytes() for p in (tmp_path / "out").rglob("part-*")]
    assert all(b"<?xml" not in t and t.count(b"\r\n") == t.count(b"\n") for t in texts)
    back = documents.read_damaged_library(spark, published.published_path(spark, target) + "/*/*").orderBy("song_ord").collect()
    assert [(r.path, r.pois, r.comments, r.scan_bpm) for r in back] == [(r.path, r.pois, r.comments, r.scan_bpm) for r in library.orderBy("song_ord").collect()]
    documents.snapshot_library(library, str(tmp_path / "snap"), "20250101_000000")
    with pytest.raises(Exception, match="exist"):
        documents.snapshot_library(library, str(tmp_path / "snap"), "20250101_000000")


def test_published_again_and_again(spark, library, tmp_path, monkeypatch):
    """Each publish replaces the one before; one that fails its check, or that breaks off at any step, changes nothing."""
    target = str(tmp_path / "out")
    paths = lambda: sorted(r.path for r in published.read_published(spark, target).collect())
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, target)
    renamed = library.withColumn("path", F.concat(F.lit("/n"), "path"))
    assert published.publish(library, spark, target)
    old = paths()
    open_reader = published.read_published(spark, target)
    assert published.publish(renamed, spark, target)
    new = paths()
    assert new != old and sorted(r.path for r in open_reader.collect()) == old
    write = documents.write_library

    def tampered(library, path, cfg):
        write(library, path, cfg)
        f = next(p for p in (tmp_path / "out" / "versions").rglob("part-*") if path.rsplit("/", 1)[1] in str(p))
        f.write_bytes(f.read_bytes().replace(b"/m/b.mp3", b"/m/z.mp3"))
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)

    monkeypatch.setattr(published, "write_library", tampered)
    assert not published.publish(library, spark, target) and paths() == new
    monkeypatch.setattr(published, "write_library", write)
    for step in ("write_library", "verify_export", "replace_text"):
        with monkeypatch.context() as m:
            m.setattr(published, step, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                published.publish(library, spark, target)
        assert paths() == new
    assert len(published.vacuum(spark, target)) == 2 and paths() == new
    assert published.publish(library, spark, target) and published.publish(library, spark, target) and paths() == old
    assert len(list((tmp_path / "out" / "versions").iterdir())) == 2


CHANGES = {
    "path": "regexp_replace(path, 'b.mp3', 'c.mp3')", "song_length": "'1'", "scan_bpm": "'3'", "comments": "array('x')",
    "pois": "transform(pois, p -> named_struct('_Name', p._Name, '_Pos', p._Pos || '0', '_Num', p._Num, '_Color', p._Color, '_Type', p._Type, '_Size', p._Size, '_Slot', p._Slot))",
}


@pytest.mark.parametrize("column", CHANGES)
def test_any_change_is_found(spark, library, tmp_path, column):
    documents.write_library(library, str(tmp_path / "out"))
    assert published.verify_export(library, spark, str(tmp_path / "out"))
    changed = library.withColumn(column, F.when(F.col("song_ord") == 1, F.expr(CHANGES[column])).otherwise(F.col(column)))
    assert not published.verify_export(changed, spark, str(tmp_path / "out"))
    swapped = library.withColumn("song_ord", F.when(F.col("song_ord") < 2, 1 - F.col("song_ord")).otherwise(F.col("song_ord")))
    assert not published.verify_export(swapped, spark, str(tmp_path / "out"))
    assert not published.verify_export(library.where("song_ord < 4"), spark, str(tmp_path / "out"))


FOREIGN_HEAD = '<?xml version="1.0"?>\n<VirtualDJ_Database Version="8.5">\n <!-- mine -->\n <SongList/>\n'


def _foreign(i):
    if i % 5 == 0:
        return f'<Song FilePath="/m/{i}.mp3" New=\'"1"\' />\n  <!-- between -->'
    return f"""<Song FilePath="/m/{i}.mp3" FileSize="{i}" Flag='a>b/>'>
  <Tags Author="A&amp;{i}" Title="é" Bpm="0.46"/><Infos SongLength="200.5" PlayCount="3"/>
  <!-- <Poi Type="cue" Num="3"/> --><![CDATA[<Comment>no</Comment>]]>
  <Poi Pos="0.05" Type="beatgrid" Extra="x"/>
  <Poi Name="old" Pos="1.0" Num="1" Type="cue"><Inner/></Poi>
  <Poi Name="num-less" Pos="1.5" Type='cue'/>
  <Poi Name="keep" Pos="2.0" Num='0' Type="cue" Odd='1'/>
  <Comment>old &amp; x</Comment>
  <Link NetSearch="u{i}"/>
 </Song>\r\n """


@pytest.fixture(scope="module")
def foreign(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("foreign") / "a.xml"
    text = FOREIGN_HEAD + "".join(map(_foreign, range(60))) + "</VirtualDJ_Database>\n"
    path.write_bytes(text.encode())
    return str(path), text


@pytest.mark.parametrize("split", ["128m", "4k"])
def test_unedited_export_is_byte_equal(spark, foreign, tmp_path, split):
    """But for line ends, however many tasks read the document."""
    path, text = foreign
    text = text.replace("\n <SongList/>", "")
    (tmp_path / "a.xml").write_bytes(text.encode())
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.set(f"spark.sql.files.{name}", split)
    try:
        rows = documents.read_raw_library(spark, str(tmp_path / "a.xml"))
        assert rows.count() == 60 and [r.path for r in rows.orderBy("song_ord").collect()] == [f"/m/{i}.mp3" for i in range(60)]
        documents.write_library(rows, str(tmp_path / "out"))
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{name}")
    (made,) = (tmp_path / "out").rglob("part-*")
    want = text.replace("\r\n", "\n").replace("\n", "\r\n").rstrip()
    assert made.read_bytes().decode() == want
    assert published.verify_export(rows, spark, str(tmp_path / "out"))


def test_edit_replaces_points_and_first_comment_alone(spark, foreign, tmp_path):
    path, text = foreign
    (tmp_path / "a.xml").write_bytes(text.replace("\n <SongList/>", "").encode())
    rows = documents.read_raw_library(spark, str(tmp_path / "a.xml"))
    found = analyses(spark, rows, "/m/7.mp3").union(analyses(spark, rows, "/m/5.mp3"))
    done = jobs.annotate_library(rows, found)
    raw = {r.path: (r.raw, r) for r in done.collect()}
    added = '<Poi Name="Drums In" Pos="46.000000" Num="1" Color="4278255360" Type="cue" />'
    gone = '<Poi Name="old" Pos="1.0" Num="1" Type="cue"><Inner/></Poi>\n  '
    near = '<Poi Name="Drums In" Pos="46.050000" Num="1" Color="4278255360" Type="cue" />'
    assert raw["/m/7.mp3"][0] == _foreign(7).rstrip().replace(gone, "").replace("<Comment>old &amp; x</Comment>", "<Comment>green</Comment>").replace("</Song>", f"{near}</Song>")
    assert raw["/m/5.mp3"][0] == f"""<Song FilePath="/m/5.mp3" New='"1"'>{added}<Comment>green</Comment></Song>"""
    assert raw["/m/8.mp3"][0] == _foreign(8).rstrip()
    documents.write_library(done, str(tmp_path / "out"))
    assert published.verify_export(done, spark, str(tmp_path / "out")) and not published.verify_export(rows, spark, str(tmp_path / "out"))
    broken = rows.withColumn("raw", F.regexp_replace("raw", "<Link", "<Link<"))  # written as it stands, but no XML
    documents.write_library(broken, str(tmp_path / "broken"))
    assert not published.verify_export(broken, spark, str(tmp_path / "broken"))
    # the first and the last song carry the frame
    for k, left in enumerate((rows.where("path <> '/m/0.mp3'"), rows.where("path <> '/m/59.mp3'"))):
        documents.write_library(left, str(tmp_path / f"part{k}"))
        assert not published.verify_export(left, spark, str(tmp_path / f"part{k}"))
    again = documents.read_raw_library(spark, str(tmp_path / "out"), folders=True)
    assert [p._Name for p in again.where("path = '/m/7.mp3'").first().pois] == [None, "num-less", "keep", "Drums In"]


def test_raw_text_of_damaged_files(spark, foreign, tmp_path):
    """A file that needs a repair is read whole, and keeps the repaired text."""
    _, text = foreign
    (tmp_path / "a.xml").write_bytes((text.replace("</Song>", "</Song></Song>", 1) + "rest").encode())
    rows = documents.read_raw_library(spark, str(tmp_path / "a.xml")).orderBy("song_ord").collect()
    assert [r.path for r in rows] == [f"/m/{i}.mp3" for i in range(60)]
    assert rows[0].head == FOREIGN_HEAD and rows[1].raw == _foreign(1).rstrip() and rows[-1].after.rstrip().endswith("</VirtualDJ_Database>")


def test_export_in_documents(spark, library, tmp_path):
    """A library is many documents, read by song; only damaged ones are parsed whole."""
    cfg = CueConfig(songs_per_document=2)
    two = library.withColumn("library_id", F.lit("a [b] %41")).union(library.withColumn("library_id", F.lit("c")))
    path = str(tmp_path / "out")
    documents.write_library(two, path, cfg)
    files = sorted((tmp_path / "out").rglob("part-*"))
    assert len(files) == 6
    rows = lambda t: sorted((r.asDict(True) for r in t.select(two.columns).collect()), key=lambda r: (r["library_id"], r["song_ord"]))
    assert documents.damaged_files(spark, path, cfg) == []
    assert rows(documents.read_export(spark, path, cfg)) == rows(two)
    for f, (old, new) in zip(files, [(b"</Song>", b"</Song></Song>"), (b"<Song ", b"<Song \x01"), (b"</VirtualDJ_Database>", b"</VirtualDJ_Database>\n<Song FilePath='x'></Song>"), (b"</VirtualDJ_Database>", b"</VirtualDJ_Database></VirtualDJ_Database>rest")]):
        f.write_bytes(f.read_bytes().replace(old, new))
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert len(documents.damaged_files(spark, path, cfg)) == 4
    assert rows(documents.read_export(spark, path, cfg)) == rows(two)
    assert not published.verify_export(two, spark, path, cfg)  # readable, but not what was written


def test_clean_reader(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<VirtualDJ_Database><Song FilePath="/x.mp3"><Scan Bpm="0.50"/><Comment>c</Comment></Song></VirtualDJ_Database>')
    row = documents.read_library(spark, str(tmp_path / "a.xml")).first()
    assert (row.path, row.scan_bpm, row.comments, row.pois) == ("/x.mp3", "0.50", ["c"], [])


def test_inventory(spark, tmp_path):
    for name in ("a.MP3", "b.txt", "d/c.flac", "d/e/f.ogg"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    rows = audio_inventory(spark, [str(tmp_path / "d"), str(tmp_path / "a.MP3"), str(tmp_path / "d" / "*.flac")]).collect()
    assert [(r.arg_ord, r.path.rsplit("/", 1)[1], r.length) for r in rows] == [(0, "c.flac", 5), (0, "f.ogg", 5), (1, "a.MP3", 5), (2, "c.flac", 5)]


def test_responses(spark):
    raw = spark.createDataFrame([(1, '{"measure_changes":[{"timestamp":12.123456789012,"elements":["drums"]}]}'), (2, "oops"), (3, "{}"), (4, '{"loop_segments":[{"start":1,"length_beats":16.0}]}')], "k long, raw string")
    rows = {r.k: r for r in responses.read_analyses(raw).collect()}
    assert rows[1].measure_changes[0].timestamp == 12.12 and not rows[1].failed
    assert rows[2].failed and rows[3].failed
    assert rows[4].loop_segments[0].length_beats == 16.0
    batch = spark.createDataFrame([(1, '[{"measure_changes":[]},{}]'), (2, ' {"analyses":[{"measure_changes":[{"timestamp":1.239}]}]}'), (3, "{}"), (4, "x")], "batch_id long, raw string")
    rows = responses.read_batch_analyses(batch).collect()
    assert sorted((r.batch_id, r.idx) for r in rows) == [(1, 0), (1, 1), (2, 0)]


def test_batches(spark):
    t = spark.createDataFrame([(f"p{i % 7}", i) for i in range(50)], "path string, i long")
    rows = assign_batches(t, ["path", "i"], 5, limit=23).orderBy("idx").collect()
    assert [r.i for r in rows] == [i for _, i in sorted((f"p{i % 7}", i) for i in range(50))][:23]
    assert [r.batch_id for r in rows] == [i // 5 for i in range(23)]
    assert assign_batches(t.limit(0), ["path", "i"]).count() == 0


def test_membership(spark):
    lib = spark.createDataFrame([("l", "", 0), ("l", "a", 1), ("l", "a", 2)], "library_id string, nfc_path string, song_ord long")
    inv = spark.createDataFrame([("l", ""), ("l", "a"), ("l", "b"), ("l", "a"), ("l", None)], "library_id string, nfc_path string")
    assert tracks_in_library(inv, lib).count() == 2
    assert tracks_missing(inv, lib).count() == 3
    assert [r.song_ord for r in first_song(lib.where("nfc_path = 'a'")).collect()] == [1]


def test_properties(spark):
    rows = jobs.make_points(derived.analysed_tracks(spark, SF), ["k"]).toPandas()
    for _, g in rows.groupby("k"):
        cues, loops = g[g.kind == "cue"], g[g.kind == "loop"].sort_values("slot")
        assert len(cues) <= 6 and len(loops) <= 3
        assert list(loops.slot) == list(range(1, len(loops) + 1)) and list(loops.t) == sorted(loops.t)
        assert loops.name.is_unique


def test_stream_equals_batch(spark, tmp_path):
    library, analysed = derived.library(spark, SF).where("song_ord % 5 = 1"), derived.library_analyses(spark, SF).where("batch_id % 3 = 0")
    write_first_version(library, str(tmp_path / "lib"))
    analysed.select("library_id", "path", "batch_id", "idx", F.to_json(F.struct("measure_changes", "loop_segments")).alias("raw")).repartition(2, "batch_id").write.json(str(tmp_path / "in"))
    (tmp_path / "in" / "bad.json").write_text(json.dumps({"library_id": "lib1", "path": "/music/none.mp3", "batch_id": 9999, "idx": 0, "raw": "broken"}))
    annotate_incremental(spark, str(tmp_path / "in"), str(tmp_path / "lib"), str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    got = latest_version(spark, str(tmp_path / "lib")).select(library.columns).orderBy("library_id", "song_ord").collect()
    assert got == jobs.annotate_library(library, analysed).orderBy("library_id", "song_ord").collect()


def _send(folder, rows, n):
    """A response file, later than those before it."""
    folder.mkdir(exist_ok=True)
    f = folder / f"{n}.json"
    f.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))


def _response(path, time, batch, idx=0, library="lib1", raw=None):
    made = {"measure_changes": [{"timestamp": time, "elements": ["drums", "synth"], "cue_name": f"n{time}"}], "loop_segments": []}
    return {"library_id": library, "path": path, "batch_id": batch, "idx": idx, "raw": raw or json.dumps(made)}


RESPONSES = [(10.0, 1, 0), (20.0, 5, 2), (30.0, 5, 1), (40.0, 2, 9), (50.0, 5, 2), (60.0, None, None)]


@pytest.mark.parametrize(("order", "split"), [([1, 0, 4, 3, 5, 2], 2), ([5, 4, 3, 2, 1, 0], 4)])
def test_any_order_and_split_of_files_gives_what_one_batch_does(spark, tmp_path, order, split):
    library = derived.library(spark, SF).where("song_ord < 40 and library_id = 'lib1'")
    path = library.where("song_ord % 17 <> 0").first().path
    write_first_version(library, str(tmp_path / "lib"), buckets=4)
    rows = [_response(path, *RESPONSES[i]) for i in order]
    for n in range(0, len(rows), split):
        _send(tmp_path / "in", rows[n : n + split], n)
    annotate_incremental(spark, str(tmp_path / "in"), str(tmp_path / "lib"), str(tmp_path / "cp"), files_per_batch=1).awaitTermination()
    got = latest_version(spark, str(tmp_path / "lib")).select(library.columns).orderBy("song_ord").collect()
    every = spark.createDataFrame(rows, "library_id string, path string, batch_id long, idx long, raw string")
    want = jobs.annotate_library(library, responses.read_analyses(every)).orderBy("song_ord").collect()
    assert got == want and sum(len(r.pois) for r in got) > 0


def test_stream_writes_only_what_it_touches(spark, tmp_path):
    """One response reads and writes one bucket; what no version needs is deleted."""
    library = derived.library(spark, SF)
    at = str(tmp_path / "lib")
    write_first_version(library, at, buckets=16)
    paths = [r.path for r in library.where("library_id = 'lib1' and song_ord % 17 <> 0 and song_ord % 19 <> 0").orderBy("song_ord").limit(2).collect()]
    seen = []
    apply = incremental._applier(at, CueConfig())
    for n, path in enumerate(paths):
        batch = spark.createDataFrame([_response(path, 45.0, n)], incremental.RAW)
        apply(batch, n)
        if n:
            apply(batch, n)  # again, as after a failure
        (bucket,) = {p.name for p in (tmp_path / "lib" / "data" / f"v={n + 1}").glob("bucket=*")}
        seen.append((n + 1, bucket))
    left = {(int(p.parent.name[2:]), p.name) for p in (tmp_path / "lib" / "data").glob("v=*/bucket=*")}
    assert {(v, b) for v, b in left if v} == set(seen)
    # version 1, of which a failed second batch would begin anew, is all there
    assert {b for _, b in left} == {f"bucket={i}" for i in range(16)} and (0, seen[-1][1]) in left and (0, seen[0][1]) not in left
    scanned = incremental._buckets(spark, at, incremental._state(spark, at, 2), [5])
    assert scanned.inputFiles() and all("/bucket=5/" in f for f in scanned.inputFiles())
    assert library_at(spark, at, 1).count() == latest_version(spark, at).count() == library.count()
    with pytest.raises(FileNotFoundError):
        library_at(spark, at, 0)
    found = spark.createDataFrame([_response(p, 45.0, n) for n, p in enumerate(paths)], incremental.RAW)
    want = jobs.annotate_library(library, responses.read_analyses(found))
    rows = lambda t: t.select(library.columns).orderBy("library_id", "song_ord").collect()
    assert rows(latest_version(spark, at)) == rows(want)


def test_rejected_responses_are_kept_and_counted(spark, tmp_path):
    library = derived.library(spark, SF).where("library_id = 'lib1'")
    path = library.first().path
    at = str(tmp_path / "lib")
    write_first_version(library, at, buckets=4)
    late = '{"measure_changes":[{"timestamp":null}]}'
    bad = [_response("/gone.mp3", 1.0, 1), _response(path, 1.0, 9, raw="{broken"), _response(path, 1.0, 9, raw="{}"), _response(path, 1.0, 9, raw=late), {"library_id": None, "path": None, "batch_id": None, "idx": None, "raw": None}]
    _send(tmp_path / "in", [_response(path, 45.0, 3), *bad[:2]], 0)
    _send(tmp_path / "in", bad[2:], 1)
    annotate_incremental(spark, str(tmp_path / "in"), at, str(tmp_path / "cp"), 1, CueConfig(strict_times=True)).awaitTermination()
    told = {(r.path, r.raw, r.reason) for r in incremental.rejected(spark, at).collect()}
    assert told == {("/gone.mp3", bad[0]["raw"], "not_in_library"), (path, "{broken", "unparsable"), (path, "{}", "empty"), (path, late, "bad_time"), (None, None, "unparsable")}
    assert [tuple(r) for r in incremental.stream_report(spark, at).orderBy("batch").collect()] == [(0, 3, 1, 1, 0, 0, 1), (1, 3, 0, 1, 1, 1, 0)]
    # sent again once the song is there
    again = library.limit(1).withColumn("path", F.lit("/gone.mp3")).withColumn("nfc_path", F.lit("/gone.mp3"))
    write_first_version(again, str(tmp_path / "new"), buckets=4)
    incremental.rejected(spark, at).where("reason = 'not_in_library'").drop("reason").write.json(str(tmp_path / "resent"))
    annotate_incremental(spark, str(tmp_path / "resent"), str(tmp_path / "new"), str(tmp_path / "cp2")).awaitTermination()
    assert "n1.0" in [p._Name for p in latest_version(spark, str(tmp_path / "new")).first().pois]


def test_plan_shape(spark, tmp_path):
    """Annotating stored tables: one exchange for each of the analyses, the attributes and the songs, and no other."""
    derived.library(spark, SF).write.parquet(str(tmp_path / "library"))
    derived.library_analyses(spark, SF).write.parquet(str(tmp_path / "analyses"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        done = jobs.annotate_library(spark.read.parquet(str(tmp_path / "library")), spark.read.parquet(str(tmp_path / "analyses")))
        plan = done._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange hashpartitioning") == plan.count("Exchange") == 3
    assert plan.count("FileScan") == 3 and plan.count("ArrowEvalPython") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_many_comments_and_loops(spark, library):
    """Nothing is cut off: not comments, nor loops of which the last ranks first."""
    loops = [(float(i % 50), 16.0, ["fx"], f"n{i}", None) for i in range(3000)] + [(20.0, 16.0, ["drums"], "best", None)]
    found = analyses(spark, library, "/m/a.mp3").withColumn("loop_segments", F.lit(None).cast(ANALYSIS.split("loop_segments ")[1]))
    found = found.drop("loop_segments").crossJoin(spark.createDataFrame([(loops,)], "loop_segments " + ANALYSIS.split("loop_segments ")[1]))
    long = library.withColumn("comments", F.transform(F.sequence(F.lit(1), F.lit(70_000)), lambda i: i.cast("string")))
    row = jobs.annotate_library(long, found).where("song_ord = 0").first()
    assert len(row.comments) == 70_000 and row.comments[-1] == "70000"
    assert {p._Name for p in row.pois if p._Type == "loop"} == {"bestl", "n0l", "n1l"}


@pytest.mark.parametrize("policy", ["batch", "single"])
def test_points_in_one_pass_are_those_of_the_operators(spark, policy):
    cfg = CueConfig(policy=policy)
    found = align(explode_candidates(derived.analysed_tracks(spark, SF), cfg), cfg)
    want = new_points(number_cues(found.where("kind = 'cue'"), ["k"]), select_loops(found.where("kind = 'loop'"), ["k"], cfg), ["k"])
    columns = ["k", "ord", "t", "kind", "num", "name", "color", "beats", "slot"]
    rows = lambda t: sorted(map(tuple, t.select(columns).collect()))
    assert [r[:2] for r in rows(want)] == [r[:2] for r in rows(jobs.make_points(derived.analysed_tracks(spark, SF), ["k"], cfg))]
    assert set(rows(want)) == set(rows(jobs.make_points(derived.analysed_tracks(spark, SF), ["k"], cfg)))


def test_older_responses_write_no_bucket(spark, tmp_path):
    """A batch whose responses are all older than those applied reads, reports and rejects, and rewrites nothing."""
    library = derived.library(spark, SF).where("library_id = 'lib1' and song_ord < 400")
    paths = [r.path for r in library.where("song_ord % 17 <> 0 and song_ord % 19 <> 0").orderBy("song_ord").limit(20).collect()]
    at = str(tmp_path / "lib")
    write_first_version(library, at, buckets=4)
    apply = incremental._applier(at, CueConfig())
    apply(spark.createDataFrame([_response(p, 45.0, 9) for p in paths], incremental.RAW), 0)
    once = latest_version(spark, at).orderBy("song_ord").collect()
    apply(spark.createDataFrame([_response(p, 1.0, 8) for p in paths] + [_response("/gone.mp3", 1.0, 9)], incremental.RAW), 1)
    assert not (tmp_path / "lib" / "data" / "v=2").exists() and incremental._state(spark, at, 2) == incremental._state(spark, at, 1)
    assert latest_version(spark, at).orderBy("song_ord").collect() == once
    assert [tuple(r) for r in incremental.stream_report(spark, at).orderBy("batch").collect()] == [(0, 20, 20, 0, 0, 0, 0), (1, 21, 20, 0, 0, 0, 1)]


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from tracklark.operators.tracks import stored

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f for f in files.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = names()
    rows = stored(spark.range(1000).repartition(3, "id"))
    new = names() - before
    for _ in range(20):
        new &= names()
        time.sleep(0.2 if new else 0)
    assert not {f for f in new if f.endswith(".data")} and rows.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_marks_and_spellings_of_a_track(spark):
    """Attributes of each spelling in a map, the place of the first song, and the marks of the first song that has any."""
    from tracklark.operators.tracks import attribute_maps

    rows = [("l", "n", "b", 2, "9", None, None, None, 5, 6), ("l", "n", "a", 1, None, "0.5", None, "0.1", None, 7), ("l", "n", "a", 3, "8", None, None, None, 1, 2), ("l", "m", "c", 4, None, None, None, None, None, None)]
    t = spark.createDataFrame(rows, "library_id string, nfc_path string, path string, song_ord long, song_length string, scan_bpm string, tags_bpm string, grid_pos string, x long, y long")
    got = {r.nfc_path: r for r in attribute_maps(t, ["x", "y"]).collect()}
    assert {p: tuple(a) for p, a in got["n"].spellings.items()} == {"a": (8.0, 120.0, 0.1), "b": (9.0, None, None)}
    assert [(r.first_ord, r.x, r.y) for r in (got["n"], got["m"])] == [(1, 5, 6), (4, None, None)]
    plan = attribute_maps(t)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan


def test_exports_are_parsed_once(spark, library, tmp_path, monkeypatch):
    """A reading or a check of an export parses its songs once, and looks through its tags once; a few tasks list its folders."""
    cfg, path, calls = CueConfig(songs_per_document=2), str(tmp_path / "out"), []
    documents.write_library(library, path, cfg)
    for name in ("songs_of_files", "_tag_counts"):
        f = getattr(documents, name)
        counted = lambda *args, name=name, f=f: calls.append(name) or f(*args)
        monkeypatch.setattr(documents, name, counted)
        if hasattr(published, name):
            monkeypatch.setattr(published, name, counted)
    assert documents.read_export(spark, path, cfg).count() == 5 and sorted(calls) == ["_tag_counts", "songs_of_files"]
    assert published.verify_export(library, spark, path, cfg) and sorted(calls) == 2 * ["_tag_counts"] + 2 * ["songs_of_files"]
    calls.clear()
    assert documents.read_raw_library(spark, path, cfg, folders=True).count() == 5 and calls == []  # surely sound
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


SONG = '<Song FilePath="/x" Flag="a>b"><Infos SongLength="1"/><Comment>c</Comment></Song>'
ODD = {
    "sound": (f'<?xml version="1.0"?>\n<!-- x --><VirtualDJ_Database V="/">\n{SONG}\n<!-- y -->\n{SONG}\r\n<Song FilePath="/y"/></VirtualDJ_Database >\n', 3),
    "comment": (f"<VirtualDJ_Database>{SONG}<!-- </Song> --></VirtualDJ_Database>", None),
    "marked": (f"<VirtualDJ_Database><SongList/>{SONG}</VirtualDJ_Database>", 1),
    "commented": (f"<VirtualDJ_Database><!-- {SONG} -->{SONG}</VirtualDJ_Database>", None),
    "twice": (f"<VirtualDJ_Database>{SONG}</Song></VirtualDJ_Database>", 1),
    "open": (f"<VirtualDJ_Database>{SONG}{SONG}", None),
    "behind": (f"<VirtualDJ_Database>{SONG}</VirtualDJ_Database>{SONG}", 1),
    "control": (f"<VirtualDJ_Database>{SONG}\x01{SONG}</VirtualDJ_Database>", 2),
    "broken": (f'<VirtualDJ_Database>{SONG.replace("<Infos", "<Inf>")}{SONG}</VirtualDJ_Database>', None),
    "other": (f"<VirtualDJ_Database>{SONG}<Other>{SONG}</Other></VirtualDJ_Database>", 2),
    "empty": ("<VirtualDJ_Database></VirtualDJ_Database>", 0),
}


def test_documents_that_may_be_damaged(spark, tmp_path):
    """Only what is surely sound isn't looked through tag by tag; what a reading of all finds is what the reader by songs does."""
    for n, (text, _) in enumerate(ODD.values()):
        folder = tmp_path / "in" / "library_id=l" / f"document={n}"
        folder.mkdir(parents=True)
        (folder / "a.xml").write_bytes(text.encode())
    path, cfg, names = str(tmp_path / "in"), CueConfig(), list(ODD)
    number = lambda f: int(f.split("document=")[1].split("/")[0])
    assert sorted(number(f) for f in documents.suspects(documents.pieces(spark, path, cfg, documents.EXPORT))) == list(range(1, len(ODD)))
    assert number("document=0/") not in {number(f) for f in documents.damaged_files(spark, path, cfg, by_mark=True)}
    for rows in (documents.read_export(spark, path, cfg).withColumn("document", F.expr(f"song_ord div {cfg.songs_per_document}")), documents.read_raw_library(spark, path, cfg, folders=True)):
        got = [r.document for r in rows.where("path in ('/x', '/y')").collect()]
        count = [got.count(n) for n in range(len(ODD))]
        assert all(many in (None, count[n]) for n, (_, many) in enumerate(ODD.values())), dict(zip(names, count, strict=True))
