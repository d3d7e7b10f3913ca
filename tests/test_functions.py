"""Hand-made cases of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from tracklark.functions import beats, elements, text


def one(spark, column, **values):
    types = {str: "string", float: "double", int: "bigint", list: "array<string>"}
    frame = spark.range(1)
    for name, v in values.items():
        if isinstance(v, list):
            lit = F.array(*map(F.lit, v)).cast("array<string>")
        else:
            lit = F.lit(v).cast("double") if v is None else F.lit(v).cast(types[type(v)])
        frame = frame.withColumn(name, lit)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("el", "color"),
    [(["drums"], "purple"), (["drums", "percussion"], "purple"), (["percussion"], "purple"), (["percussion", "percussion"], "blue"), (["percussion", "fx"], "blue"), ([], "blue"), (["drums", "synth"], "green"), (["drums", "vocals", "synth"], "yellow"), (["vocals", "piano"], "orange"), (["bass"], "blue"), (["synth", "percussion"], "blue")],
)
def test_color(spark, el, color):
    assert one(spark, elements.classify_color(F.col("e")), e=el) == color


@pytest.mark.parametrize(("scan", "tags", "bpm"), [(0.46875, None, 128.0), (1.5, None, 180.0), (128.0, None, 128.0), (0.2, None, 24.0), (250.0, None, 120.0), (60.0, None, 120.0), (0.0, 0.5, 120.0), (None, 130.0, 60 / 130), (None, None, None)])
def test_bpm(spark, scan, tags, bpm):
    assert one(spark, beats.track_bpm(F.col("s"), F.col("t")), s=scan, t=tags) == (None if bpm is None else pytest.approx(bpm))


@pytest.mark.parametrize(
    ("ts", "bpm", "grid", "out"),
    [(45.23, 128.0, 0.05, "45.050000"), (92.15, 128.0, 0.05, "91.925000"), (0.9375, 128.0, 0.0, "0.000000"), (2.0, 60.0, 0.0, "2.000000"), (10.0, 250.0, 0.0, "10.000000"), (0.0, 120.0, 0.5, "0.500000"), (0.0, 120.0, 3.4, "1.400000"), (1.0, 60.0, 7.8, "1.000000")],
)
def test_snap(spark, ts, bpm, grid, out):
    assert one(spark, text.format_position(beats.snap_to_downbeat(F.col("t"), F.col("b"), F.col("g"))), t=ts, b=bpm, g=grid) == out


@pytest.mark.parametrize(
    ("el", "cue", "loop"),
    [(["vocals", "bass", "synth"], "vocalsynth", "vocalsynthl"), (["vocals", "fx"], "vocals", "vocalsl"), (["drums", "bass"], "drumsBass", "drumsBassl"), (["drums", "piano"], "piano", "pianol"), (["pad", "fx"], "fxpad", "fxpadl"), (["mixdown"], "mixdown", "loopl"), ([], "mix4", "loopl")],
)
def test_names(spark, el, cue, loop):
    none = F.lit(None).cast("string")
    assert one(spark, elements.cue_name(none, F.col("e"), F.lit(4)), e=el) == cue
    assert one(spark, elements.loop_name(none, F.col("e")), e=el) == loop


@pytest.mark.parametrize(("given", "out"), [("Vocal", "Vocal"), ("Drum Loop", "Drum Loopl"), ("A & B", "A &amp; Bl")])
def test_given_loop_names(spark, given, out):
    assert one(spark, elements.loop_name(F.col("n"), F.array(F.lit("drums"))), n=given) == out


def test_sanitize_and_repairs(spark):
    assert one(spark, text.sanitize_xml_text(F.col("x")), x="  a\x00<b>\x7f ") == "a&lt;b&gt;\x7f"
    assert one(spark, text.repair_long_decimals(F.col("x")), x='{"t": 12.123456789012, "u": 1.5, "v": "3.9999999999999"}') == '{"t": 12.12, "u": 1.5, "v": "4.00"}'
    damaged = "<VirtualDJ_Database><Song>a\x00\x7f</Song></Song><Song/></Song>\n</Song>\n</Song></VirtualDJ_Database></VirtualDJ_Database>rest"
    fixed = one(spark, text.repair_library_text(F.col("x"), "VirtualDJ_Database"), x=damaged)
    assert fixed == "<VirtualDJ_Database><Song>a</Song><Song/></Song>\n</Song></VirtualDJ_Database>"


def test_nfc_and_display(spark):
    assert one(spark, text.nfc_path(F.col("x")), x="/m/é.mp3") == "/m/é.mp3"
    for value in (10.25, 10.35, 0.05, 0.15, 2.675, 119.95, 300.0, 0.0, -10.25, 7.75):
        assert one(spark, text.one_decimal(F.col("x")), x=value) == f"{value:.1f}"
    assert one(spark, text.round_time(F.col("x"), exact=True), x=2.675) == 2.67


def test_capitals_and_paths(spark):
    assert one(spark, text.capitalize(F.col("x")), x="gREEN") == "Green"
    assert one(spark, text.is_audio_path(F.col("x")), x="/a/B.MP3") is True
    assert one(spark, text.is_audio_path(F.col("x")), x="/a/b.txt") is False


def test_song_is_cut_once(spark):
    """No pattern that cuts a song stands within the lambda that goes over its pieces."""
    from tracklark.functions.splice import spliced_song
    from tracklark.schemas import POI

    raw = '<Song><Poi Type="cue" Num="1"/><Comment>a</Comment><Comment>b</Comment></Song>'
    rows = spark.createDataFrame([(raw, [], "c")], f"raw string, new array<{POI}>, comment string")
    done = rows.select(spliced_song(F.col("raw"), F.col("new"), F.col("comment")).alias("raw"))
    assert done.first()[0] == "<Song><Comment>c</Comment><Comment>b</Comment></Song>"
    assert done._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1
