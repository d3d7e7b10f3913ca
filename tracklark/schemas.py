"""Schemas of analyses and libraries."""

from __future__ import annotations

CUE = "struct<timestamp:double,elements:array<string>,cue_name:string,color:string>"
LOOP = "struct<start:double,length_beats:double,elements:array<string>,loop_name:string,color:string>"
ANALYSIS = f"struct<measure_changes:array<{CUE}>,loop_segments:array<{LOOP}>>"
BATCH = f"struct<analyses:array<{ANALYSIS}>>"
#: Attributes of a point in a library document; all text, so that what isn't edited stays as written.
POI = "struct<_Name:string,_Pos:string,_Num:string,_Color:string,_Type:string,_Size:string,_Slot:string>"
SONG = f"struct<_FilePath:string,Tags:struct<_Bpm:string>,Infos:struct<_SongLength:string>,Scan:struct<_Bpm:string>,Poi:array<{POI}>,Comment:array<string>>"
