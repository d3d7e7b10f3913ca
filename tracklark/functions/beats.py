"""Tempo and beat-grid columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, CueConfig


def normalize_bpm(scan: Column, cfg: CueConfig = DEFAULT) -> Column:
    """BPM of a scan value above 0, which is seconds per beat, BPM itself, or half a beat's factor; else null."""
    beats = 60 / scan
    doubled = F.when(scan * 120 > cfg.max_bpm, F.lit(cfg.default_bpm)).otherwise(scan * 120)
    bpm = F.when(beats.between(cfg.min_bpm, cfg.max_bpm), beats).when((scan > cfg.min_bpm) & (scan < cfg.max_bpm), scan).otherwise(doubled)
    return F.when(scan > 0, bpm)


def track_bpm(scan: Column, tags: Column, malformed_scan: Column | None = None) -> Column:
    """BPM by scan, else by tags (seconds per beat, unchecked), else null. A scan that is no number hides the tags."""
    bpm = F.coalesce(normalize_bpm(scan), F.when(tags > 0, 60 / tags))
    return bpm if malformed_scan is None else F.when(~malformed_scan, bpm)


def working_bpm(bpm: Column, cfg: CueConfig = DEFAULT) -> Column:
    return F.coalesce(F.when(bpm != 0, bpm), F.lit(cfg.default_bpm))


def snap_to_downbeat(seconds: Column, bpm: Column, grid: Column, cfg: CueConfig = DEFAULT) -> Column:
    """The nearer of the two downbeats around a time, the earlier on ties, if it is within the tolerance; else the time.

    The grid is regular, so no table of beats is joined. Measures are counted from the grid's start toward zero.
    """
    start = F.coalesce(grid, F.lit(0.0))
    measure = cfg.beats_per_measure * 60 / bpm
    x = (seconds - start) / measure
    whole = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))
    before, after = start + whole * measure, start + (whole + 1) * measure
    nearest = F.when(F.abs(seconds - before) <= F.abs(seconds - after), before).otherwise(after)
    usable = bpm.between(cfg.min_bpm, cfg.max_bpm) & (F.abs(seconds - nearest) <= cfg.snap_tolerance)
    return F.when(usable, nearest).otherwise(seconds)


def _known(length: Column) -> Column:
    return F.coalesce(length, F.lit(0.0)) != 0


def cue_in_range(seconds: Column, length: Column) -> Column:
    """Not at or after the end of a track whose length is known (not null, not 0)."""
    return ~(_known(length) & (seconds >= length))


def loop_in_range(seconds: Column, length: Column, cfg: CueConfig = DEFAULT) -> Column:
    return ~(_known(length) & (seconds >= length - cfg.loop_tail_seconds))
