"""From candidates to numbered cues and chosen loops. All windows are by track, and end with the candidate's position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, CueConfig
from ..functions.beats import cue_in_range, loop_in_range, snap_to_downbeat, working_bpm
from ..functions.elements import classify_color, cue_name, encode_color, has_elements, known, loop_name, loop_priority, raw_loop_name
from ..functions.text import format_position

Keys = list[str]


def explode_cues(tracks: DataFrame, cfg: CueConfig = DEFAULT) -> DataFrame:
    """The first candidates of each track, before any filter, with defaults for what is missing."""
    kept = [c for c in tracks.columns if c not in ("measure_changes", "loop_segments")]
    rows = tracks.select(*kept, F.posexplode(F.slice("measure_changes", 1, cfg.max_cues)).alias("pos", "c"))
    return rows.select(*kept, "pos", F.coalesce("c.timestamp", F.lit(0.0)).alias("ts"), known(F.col("c.elements")).alias("elements"), F.col("c.cue_name").alias("name"), F.col("c.color").alias("proposed"))


def explode_loops(tracks: DataFrame, cfg: CueConfig = DEFAULT) -> DataFrame:
    kept = [c for c in tracks.columns if c not in ("measure_changes", "loop_segments")]
    rows = tracks.select(*kept, F.posexplode("loop_segments").alias("pos", "c"))
    return rows.select(*kept, "pos", F.coalesce("c.start", F.lit(0.0)).alias("ts"), known(F.col("c.elements")).alias("elements"), F.col("c.loop_name").alias("name"), F.col("c.color").alias("proposed"), F.coalesce("c.length_beats", F.lit(cfg.default_beats)).alias("beats"))


def explode_candidates(tracks: DataFrame, cfg: CueConfig = DEFAULT) -> DataFrame:
    """Cues (the first of each track) and loops as one table with `kind`. Each track also has one row of kind `track`,
    candidates or not."""
    kept = [c for c in tracks.columns if c not in ("measure_changes", "loop_segments")]

    def one(kind: str, time: str, name: str, beats):
        return lambda c, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("pos"), F.coalesce(c[time], F.lit(0.0)).alias("ts"), known(c["elements"]).alias("elements"),
            c[name].alias("name"), c["color"].alias("proposed"), beats(c).alias("beats"),
        )

    cues = F.transform(F.slice("measure_changes", 1, cfg.max_cues), one("cue", "timestamp", "cue_name", lambda c: F.lit(None).cast("double")))
    loops = F.transform("loop_segments", one("loop", "start", "loop_name", lambda c: F.coalesce(c["length_beats"], F.lit(cfg.default_beats))))
    none = F.array().cast("array<struct<kind:string,pos:int,ts:double,elements:array<string>,name:string,proposed:string,beats:double>>")
    mark = F.transform(F.array(F.lit(0)), lambda i: F.struct(F.lit("track").alias("kind"), i.alias("pos"), *(F.lit(None).cast(t).alias(n) for n, t in (("ts", "double"), ("elements", "array<string>"), ("name", "string"), ("proposed", "string"), ("beats", "double")))))
    both = F.concat(mark, F.coalesce(cues, none), F.coalesce(loops, none))
    return tracks.select(*kept, F.inline(both))


def align(candidates: DataFrame, cfg: CueConfig = DEFAULT) -> DataFrame:
    """`t`: the candidate's time on the track's grid (columns ts, bpm, grid_pos)."""
    return candidates.withColumn("t", snap_to_downbeat(F.col("ts"), working_bpm(F.col("bpm"), cfg), F.col("grid_pos"), cfg))


def number_cues(cues: DataFrame, keys: Keys) -> DataFrame:
    """Cues in range, numbered in array order (`num`); those without elements use a number up and are then dropped.

    `consumed` is how many numbers the track used.
    """
    track = Window.partitionBy(*keys)
    inside = cues.where(cue_in_range(F.col("t"), F.col("song_length")))
    rows = inside.withColumn("num", F.row_number().over(track.orderBy("pos")).cast("long")).withColumn("consumed", F.count("*").over(track))
    return rows.where(has_elements(F.col("elements")))


def select_loops(loops: DataFrame, keys: Keys, cfg: CueConfig = DEFAULT, raw_names: bool = False, filters: bool = True) -> DataFrame:
    """At most three loops a track, with `name`.

    Policy "batch": by rank, the first three; of these, late and element-less ones and repeated names go.
    Policy "single": by rank, the first three different names; of these, late and element-less ones go.
    """
    made = (raw_loop_name if raw_names else loop_name)(F.col("name"), F.col("elements"))
    rows = loops.withColumn("name", made).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(loop_priority(F.col("elements"), cfg.policy), "pos")))
    by_name = Window.partitionBy(*keys, "name").orderBy("__rank")
    fit = loop_in_range(F.col("t"), F.col("song_length"), cfg) & has_elements(F.col("elements")) if filters else F.lit(True)
    if cfg.policy == "batch":
        rows = rows.where((F.col("__rank") <= cfg.max_loops) & fit)
        return rows.withColumn("__first", F.row_number().over(by_name)).where("__first = 1").drop("__first").withColumnRenamed("__rank", "rank")
    rows = rows.withColumn("__first", F.row_number().over(by_name)).where("__first = 1").drop("__first")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__rank")))
    return rows.where((F.col("rank") <= cfg.max_loops) & fit).drop("__rank")


def new_points(cues: DataFrame, loops: DataFrame, keys: Keys) -> DataFrame:
    """Numbered cues and chosen loops as one table in chronological order per track (`ord` from 1).

    Ties: cues before loops, then the order in which they were made. Loops have slots from 1 by time.
    """
    made = ["t", "kind", "made", "num", "name", "color", "beats"]
    c = cues.select(*keys, "t", F.lit("cue").alias("kind"), F.col("num").alias("made"), F.col("num").cast("string").alias("num"), cue_name(F.col("name"), F.col("elements"), F.col("num")).alias("name"), classify_color(F.col("elements")).alias("color"), F.lit(None).cast("double").alias("beats"))
    l = loops.select(*keys, "t", F.lit("loop").alias("kind"), F.col("rank").cast("long").alias("made"), F.lit("-1").alias("num"), "name", classify_color(F.col("elements")).alias("color"), "beats")
    both = c.unionByName(l).select(*keys, *made)
    return chronological_pois(both, keys)


def chronological_pois(points: DataFrame, keys: Keys) -> DataFrame:
    """`ord` over all points of a track and `slot` over its loops, by time, kind and order of making."""
    track, of_kind = Window.partitionBy(*keys), Window.partitionBy(*keys, "kind")
    by = ["t", F.col("kind") == "loop", "made"]
    rows = points.withColumn("ord", F.row_number().over(track.orderBy(*by)).cast("long"))
    return rows.withColumn("slot", F.when(F.col("kind") == "loop", F.row_number().over(of_kind.orderBy("t", "made"))).cast("long"))


def summary_labels(points: DataFrame, keys: Keys) -> DataFrame:
    """`label`: Cue 1, Cue 2, ..., Loop 1, ... by time within the kind."""
    n = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("t", "made"))
    return points.withColumn("label", F.concat(F.when(F.col("kind") == "cue", "Cue ").otherwise("Loop "), n.cast("string")))


def _first_of_each_name(loops: Column, most: int) -> Column:
    """The first `most` elements of an array with different names, in its order; one pass, whatever the array's length."""
    known_name = lambda some, name: F.exists(some, lambda y: y["name"].eqNullSafe(name))
    return F.aggregate(loops, F.slice(loops, 1, 0), lambda some, x: F.when((F.size(some) < most) & ~known_name(some, x["name"]), F.concat(some, F.array(x))).otherwise(some))


def points_of_tracks(tracks: DataFrame, keys: Keys, cfg: CueConfig = DEFAULT) -> DataFrame:
    """(keys, points): the numbered cues and chosen loops of every track, chronological, in one array.

    The same as `number_cues`, `select_loops` and `new_points`, in one pass: scalars are made from exploded candidates,
    which one window over the track collects again, sorted once; numbers, names and order follow within the row. Tracks
    without candidates have an empty array. Points have t, looped, made, num, name, color, beats, at, code, slot.
    """
    found = align(explode_candidates(tracks, cfg), cfg)
    kind, elements = F.col("kind"), F.col("elements")
    fit = has_elements(elements)
    color = classify_color(elements)
    shown = [color.alias("color"), F.col("beats"), format_position(F.col("t")).alias("at"), encode_color(color, cfg).alias("code")]
    cue = F.struct(fit.alias("fit"), "t", cue_name(F.col("name"), elements, F.lit(0)).alias("name"), *shown)
    loop = F.struct((fit & loop_in_range(F.col("t"), F.col("song_length"), cfg)).alias("fit"), "t", loop_name(F.col("name"), elements).alias("name"), *shown)
    track = Window.partitionBy(*keys).orderBy(F.when(kind == "loop", loop_priority(elements, cfg.policy)), "pos", "kind")
    whole = track.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cues = F.collect_list(F.when((kind == "cue") & cue_in_range(F.col("t"), F.col("song_length")), cue)).over(whole)
    loops = F.collect_list(F.when(kind == "loop", loop)).over(whole)
    rows = found.select(*keys, cues.alias("cues"), loops.alias("loops"), F.row_number().over(track).alias("__rn")).where("__rn = 1")

    def point(looped: bool):
        def made(x: Column, i: Column) -> Column:
            n = (i + 1).cast("long")
            return F.struct(x["t"].alias("t"), F.lit(looped).alias("looped"), n.alias("made"), (F.lit("-1") if looped else n.cast("string")).alias("num"), *(x[c].alias(c) for c in ("name", "color", "beats", "at", "code", "fit")))

        return made

    cues = F.filter(F.transform("cues", point(False)), lambda x: x["fit"])
    if cfg.policy == "batch":
        rows = rows.withColumn("loops", F.filter(F.transform(F.slice("loops", 1, cfg.max_loops), point(True)), lambda x: x["fit"]))
        loops = _first_of_each_name(F.col("loops"), cfg.max_loops)
    else:
        loops = F.filter(F.transform(_first_of_each_name(F.col("loops"), cfg.max_loops), point(True)), lambda x: x["fit"])
    none = F.lit(None).cast("long")
    cues = F.transform(cues, lambda x: x.withField("slot", none))
    loops = F.transform(F.sort_array(loops), lambda x, i: x.withField("slot", (i + 1).cast("long")))
    return rows.select(*keys, F.sort_array(F.concat(cues, loops)).alias("points"))
