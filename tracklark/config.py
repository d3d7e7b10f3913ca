"""Settings of the cue and loop rules."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Colour names and their ARGB values in decimal. Fixed values of the library format.
COLORS = {"blue": "4278190335", "green": "4278255360", "purple": "4288020735", "yellow": "4294967040", "orange": "4294934272"}
#: The audio file types that a library may hold.
AUDIO_EXTENSIONS = ("mp3", "flac", "wav", "m4a", "aac", "ogg", "opus", "mpeg")


@dataclass(frozen=True)
class CueConfig:
    max_cues: int = 6
    max_loops: int = 3
    loop_tail_seconds: float = 10.0
    snap_tolerance: float = 1.5
    beats_per_measure: int = 4
    min_bpm: float = 60.0
    max_bpm: float = 200.0
    default_bpm: float = 120.0
    default_length: float = 300.0
    default_beats: float = 16.0
    default_color: str = "green"
    batch_size: int = 5
    #: Range of song_ord in one exported document: about 20 MB of text, which fits a row if it has to be repaired.
    songs_per_document: int = 50_000
    root_tag: str = "VirtualDJ_Database"
    #: "batch": rank, take three, then filter; "single": distinct names first, five levels.
    policy: str = "batch"
    #: "exact" looks attributes up by the path as written, "nfc" by its normal form.
    attribute_key: str = "exact"
    #: Whether a response fails that says a time which is no number (a stream's responses; readers take `strict`).
    strict_times: bool = False
    colors: dict[str, str] = field(default_factory=lambda: dict(COLORS))


DEFAULT = CueConfig()
