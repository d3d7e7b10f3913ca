"""The registered queries as SQL for DuckDB, written apart from the Spark versions."""

from __future__ import annotations

from ..config import COLORS
from .derived import candidates_sql, song_text_sql, texts, tracks_sql


def _pick(values: tuple[str, ...], n: str) -> str:
    return f"([{texts(values)}])[{n}]"


def _first(parts: list[str], n: str) -> str:
    return f"list_slice([{', '.join(parts)}], 1, {n})"


def _has(name: str) -> str:
    return f"list_contains(elements, '{name}')"


def _any(*names: str) -> str:
    return f"list_has_any(elements, [{texts(names)}])"


SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _clean(x: str) -> str:
    """XML text: control characters, escapes, outer white space."""
    x = rf"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"
    x = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


NORMAL = "CASE WHEN scan_bpm > 0 THEN CASE WHEN 60e0 / scan_bpm BETWEEN 60 AND 200 THEN 60e0 / scan_bpm WHEN scan_bpm > 60 AND scan_bpm < 200 THEN scan_bpm WHEN scan_bpm * 120 > 200 THEN 120e0 ELSE scan_bpm * 120 END END"
BPM = f"coalesce({NORMAL}, CASE WHEN tags_bpm > 0 THEN 60e0 / tags_bpm END)"
COLOR = f"CASE WHEN {_has('drums')} THEN CASE WHEN {_has('vocals')} THEN 'yellow' WHEN len(list_filter(elements, lambda e: e NOT IN ('drums', 'percussion'))) = 0 THEN 'purple' ELSE 'green' END WHEN {_has('vocals')} THEN 'orange' WHEN {_any('piano', 'synth', 'strings', 'guitar', 'bass')} THEN 'blue' WHEN elements = ['percussion'] THEN 'purple' ELSE 'blue' END"
CODE = f"CASE c {' '.join(f"WHEN '{n}' THEN '{v}'" for n, v in COLORS.items())} ELSE '{COLORS['green']}' END"
NAME = "CASE c " + " ".join(f"WHEN '{v}' THEN '{n}'" for n, v in COLORS.items()) + " END"


def _base(number: str) -> str:
    vocal = " ".join(f"WHEN {_has(e)} THEN 'vocal{e}'" for e in ("synth", "piano", "drums", "guitar", "strings", "bass"))
    single = " ".join(f"WHEN {_has(e)} THEN '{e}'" for e in ("piano", "synth", "strings", "guitar", "drums", "bass"))
    return (
        f"CASE WHEN {_has('vocals')} THEN CASE {vocal} ELSE 'vocals' END WHEN {_has('piano')} AND {_has('synth')} THEN 'pianosynth' WHEN {_has('drums')} AND {_has('bass')} THEN 'drumsBass' {single} "
        f"WHEN len(elements) > 0 THEN array_to_string(list_slice(list_sort(elements), 1, 2), '') ELSE 'mix' || {number} END"
    )


def _loop(clean: bool = True) -> str:
    base = _base("'0'")
    name = f"coalesce(nullif(name, ''), CASE WHEN starts_with({base}, 'mix') THEN 'loopl' ELSE {base} || 'l' END)"
    name = f"CASE WHEN ends_with({name}, 'l') THEN {name} ELSE {name} || 'l' END"
    return _clean(name) if clean else name


FEW = "len(elements) <= 2"
PRIORITY = f"CASE WHEN {_any('drums', 'percussion')} AND NOT {_has('vocals')} AND {FEW} THEN 0 WHEN {_has('vocals')} THEN 1 WHEN {_any('piano', 'synth', 'strings', 'guitar')} AND NOT {_any('drums', 'percussion')} THEN 2 ELSE %s END"
BATCH, SINGLE = PRIORITY % "3", PRIORITY % f"CASE WHEN {FEW} THEN 3 ELSE 4 END"
WORKING = "coalesce(nullif(bpm, 0), 120e0)"
CUE_FITS = "NOT (coalesce(song_length, 0) <> 0 AND t >= song_length)"
LOOP_FITS = "NOT (coalesce(song_length, 0) <> 0 AND t >= song_length - 10)"

#: Common tables, in order; each query names the last one that it needs.
TABLES = {
    "tracks": tracks_sql(_pick),
    "candidates": candidates_sql(_pick, _first),
    "timed": f"SELECT c.*, song_length, coalesce(beatgrid_pos, 0e0) AS grid, {BPM} AS bpm FROM candidates c JOIN tracks USING (k)",
    "gridded": f"SELECT *, 240e0 / {WORKING} AS m, trunc((ts - grid) / (240e0 / {WORKING})) AS i FROM timed",
    "near": "SELECT *, CASE WHEN abs(ts - (grid + i * m)) <= abs(ts - (grid + (i + 1) * m)) THEN grid + i * m ELSE grid + (i + 1) * m END AS beat FROM gridded",
    "aligned": f"SELECT *, CASE WHEN {WORKING} BETWEEN 60 AND 200 AND abs(ts - beat) <= 1.5e0 THEN beat ELSE ts END AS t, row_number() OVER (PARTITION BY k, kind ORDER BY pos) - 1 AS place FROM near",
    "cues_in": f"SELECT *, row_number() OVER (PARTITION BY k ORDER BY place) AS num, count(*) OVER (PARTITION BY k) AS consumed FROM aligned WHERE kind = 'cue' AND place < 6 AND {CUE_FITS}",
    "cues": "SELECT * FROM cues_in WHERE len(elements) > 0",
    "ranked": f"SELECT *, row_number() OVER (PARTITION BY k ORDER BY {BATCH}, place) AS rank, {_loop()} AS loop_name FROM aligned WHERE kind = 'loop'",
    "loops": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, loop_name ORDER BY rank) AS again FROM ranked WHERE rank <= 3 AND {LOOP_FITS} AND len(elements) > 0) WHERE again = 1",
    "made": f"SELECT k, t, 'cue' AS kind, num AS made, num::varchar AS num, {_clean(f"coalesce(nullif(name, ''), {_base('num::varchar')})")} AS name, {COLOR} AS color, NULL::double AS beats FROM cues UNION ALL SELECT k, t, 'loop', rank, '-1', loop_name, {COLOR}, coalesce(length_beats, 16e0) FROM loops",
    "points": "SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, kind = 'loop', made) AS ord, CASE WHEN kind = 'loop' THEN row_number() OVER (PARTITION BY k, kind ORDER BY t, made) END AS slot FROM made",
    "comments": "SELECT k, coalesce((SELECT string_agg(DISTINCT color, ' ' ORDER BY color) FROM points p WHERE p.k = tracks.k), '') AS comment FROM tracks",
    "songs": "SELECT *, 'lib' || (k % 4)::varchar AS library_id, k % 3 <> 0 AND k IN (SELECT k FROM candidates) AS edited FROM tracks",
    "old": "SELECT * FROM (VALUES (0, 'beatgrid', NULL, NULL, '0.05', NULL), (1, 'cue', '1', 'old', '1.0', '4278190335'), (2, 'cue', '0', 'keep', '2.0', NULL)) o(n, type, num, name, pos, color)",
    "annotated": f"""SELECT library_id, file_path AS path, k AS song_ord, CASE WHEN edited AND n = 2 THEN 1 ELSE n END AS poi_ord, type, num, NULL::varchar AS slot, name, pos, color, NULL::varchar AS size FROM songs, old WHERE NOT (edited AND n = 1)
      UNION ALL SELECT library_id, file_path, k, 1 + ord, kind, num, slot::varchar, name, printf('%.6f', t), {CODE.replace('CASE c', 'CASE color')}, beats::varchar FROM points JOIN songs USING (k) WHERE edited""",
    "found": f"SELECT {NAME.replace('CASE c', 'CASE color')} AS color, type, path, pos, name FROM annotated WHERE type IN ('cue', 'loop') AND color IS NOT NULL",
    "sized": "SELECT k, count(*) FILTER (kind = 'cue') AS cues, count(*) FILTER (kind = 'loop') AS loops, sum(ts) FILTER (kind = 'cue') AS seconds FROM candidates GROUP BY k",
    "oldpoints": "SELECT k, pos, (['cue', 'loop', 'beatgrid'])[linenumber % 3 + 1] AS type, ([NULL, '0', '-1', '2', '00'])[suppkey % 5 + 1] AS num FROM candidates",
    "statuses": "SELECT k, k // 5 AS batch_id, CASE WHEN k % 10 = 0 THEN 'not_on_disk' WHEN k % 3 = 0 THEN 'not_in_library' WHEN k % 7 = 0 THEN 'analysis_failed' ELSE 'applied' END AS status FROM tracks",
}
def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


TABLES["elements"] = f"""SELECT k, string_agg('<Poi Name="' || {_escaped('name')} || '" Pos="' || printf('%.6f', t) || '" Num="' || num || '" Color="' || {CODE.replace('CASE c', 'CASE color')} || '" Type="' || kind || coalesce('" Size="' || beats::varchar || '" Slot="' || slot::varchar, '') || '" />', '' ORDER BY ord) AS added FROM points GROUP BY k"""
_EDITED = song_text_sql("", "comment", "coalesce(added, '')").replace("'  <Comment>' || comment || '</Comment>'", "'  ' || CASE comment WHEN '' THEN '<Comment />' ELSE '<Comment>' || comment || '</Comment>' END")

#: A song's points before any annotation, as text.
OLD = "beatgrid:0.05|cue:1:old:1.0:4278190335|cue:0:keep:2.0"
REPLACEABLE = "type IN ('cue', 'loop') AND coalesce(num, '0') <> '0'"


def _sql(body: str) -> str:
    """The query with the common tables it needs, found from the names in it."""
    need: list[str] = []
    names = list(TABLES)
    text = body
    for name in reversed(names):
        if f" {name} " in f" {text} ".replace("(", " ").replace(")", " ").replace(",", " ").replace("\n", " ").replace(".", " "):
            need.insert(0, name)
            text += f" {TABLES[name]} "
    return (f"WITH {', '.join(f'{n} AS ({TABLES[n]})' for n in need)} " if need else "") + body


#: The older of two responses for each track with an analysis, and why it can't be used.
REJECTED = "SELECT library_id, CASE WHEN k // 5 % 7 = 0 THEN '/none' ELSE '' END || file_path AS path, k // 5 - 1000000000 AS batch_id, k % 5 AS idx, CASE WHEN k // 5 % 10 = 0 THEN 'unparsable' WHEN k // 5 % 7 = 0 THEN 'not_in_library' END AS reason FROM songs WHERE edited"
C, T = "FROM candidates", "FROM tracks"
SHOWN = "upper(left(x, 1)) || lower(substr(x, 2))"
_SINGLE_FIRST = f"SELECT *, row_number() OVER (PARTITION BY k ORDER BY r0) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY k, ln ORDER BY r0) AS again FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {SINGLE}, place) AS r0, %s AS ln FROM aligned WHERE kind = 'loop')) WHERE again = 1"

ORACLE_SQL = {
    name: _sql(body)
    for name, body in {
        "p1_is_audio_path": rf"SELECT k, regexp_matches(lower(file_path), '\.(mp3|flac|wav|m4a|aac|ogg|opus|mpeg)$') AS is_audio {T}",
        "p2_basename_size": f"SELECT k, string_split(file_path, '/')[-1] AS name, k * 1000 / 1048576 AS mb {T}",
        "p3_nfc_path": "SELECT doc_id, md5(nfc_normalize(text)) AS nfc FROM documents",
        "p4_sanitize_xml_text": f"SELECT doc_id, md5({_clean("(chr(32) || chr(9) || text || chr(32) || chr(10))")}) AS clean FROM documents",
        "p5_repair_long_decimals": rf"""SELECT k, pos, array_to_string(list_transform(list_zip(regexp_split_to_array(raw, '\d+\.\d{{10,}}'), list_concat(list_transform(regexp_extract_all(raw, '\d+\.\d{{10,}}'), lambda x: printf('%.2f', x::double)), [''])), lambda x: x[1] || x[2]), '') AS repaired
          FROM (SELECT k, pos, '{{"t": ' || partkey || '.' || lpad((suppkey * 123456789)::varchar, 12, '0') || ', "u": ' || linenumber || '.5}}' AS raw {C} )""",
        "p6_round_times": f"SELECT k, pos, round(ts / 3, 2) AS seconds {C}",
        "p7_normalize_bpm": f"SELECT k, {NORMAL} AS bpm {T}",
        "p8_track_bpm": f"SELECT k, bpm, {WORKING} AS working_bpm FROM (SELECT k, {BPM} AS bpm {T} )",
        "p9_classify_color": f"SELECT k, pos, {COLOR} AS color {C}",
        "p10_color_correction": f"SELECT k, pos, f <> p AS corrected, CASE WHEN p = 'purple' AND f = 'blue' THEN 'melodic elements without drums' END AS reason FROM (SELECT k, pos, coalesce(color, 'green') AS p, {COLOR} AS f {C} )",
        "p11_encode_color": f"SELECT k, pos, c AS code, {NAME} AS name FROM (SELECT k, pos, {CODE} AS c FROM (SELECT k, pos, CASE WHEN pos % 4 = 0 THEN 'other' ELSE color END AS c {C} ))",
        "p12_cue_name": f"SELECT k, pos, {_clean(f"coalesce(nullif(name, ''), {_base('pos::varchar')})")} AS cue_name {C}",
        "p13_loop_name": f"SELECT k, pos, {_loop()} AS loop_name {C}",
        "p14_loop_priority": f"SELECT k, pos, ({BATCH})::bigint AS batch, ({SINGLE})::bigint AS single {C}",
        "p15_snap_to_downbeat": "SELECT k, pos, printf('%.6f', t) AS at FROM aligned",
        "p16_cue_in_range": f"SELECT k, pos, {CUE_FITS} AS inside FROM aligned",
        "p17_loop_in_range": f"SELECT k, pos, {LOOP_FITS} AS inside FROM aligned",
        "p18_has_elements": f"SELECT k, pos {C} WHERE len(elements) > 0",
        "p19_is_replaceable_poi": f"SELECT *, {REPLACEABLE} AS replaceable FROM oldpoints",
        "p20_format_position": f"SELECT k, pos, printf('%.6f', ts / 7) AS at, coalesce(length_beats, 16e0)::varchar AS size {C}",
        "p21_capitalize": f"SELECT k, pos, {SHOWN.replace('x', 'color')} AS shown {C}",
        "p22_filter_cues_by_color": "SELECT path, type, name, pos FROM found WHERE color = 'purple'",
        "p23_filter_cues_by_element": f"SELECT k, pos, kind {C} WHERE {_has('piano')}",
        "p22_search_color_index": "SELECT path, type, name, pos FROM found WHERE color = 'purple' AND starts_with(path, '/music/1')",
        "p23_search_elements": f"SELECT k {C} GROUP BY k HAVING bool_or({_has('drums')}) AND bool_or({_has('vocals')}) AND NOT bool_or({_has('synth')})",
        "j1_tracks_in_library": f"SELECT k, file_path {T} WHERE k % 3 <> 0",
        "j2_tracks_missing": f"SELECT k, file_path {T} WHERE k % 3 = 0",
        "j3_first_song": f"SELECT '/music/' || custkey AS path, min(k) AS song_ord {T} GROUP BY custkey",
        "j4_track_attributes": f"SELECT custkey, arg_min(song_length, k) FILTER (song_length IS NOT NULL) AS song_length, arg_min(bpm, k) FILTER (bpm IS NOT NULL) AS bpm, arg_min(beatgrid_pos, k) FILTER (beatgrid_pos IS NOT NULL) AS grid_pos FROM (SELECT *, {BPM} AS bpm {T} ) GROUP BY custkey",
        "j5_analyses_to_tracks": f"SELECT k, file_path, cues, loops, printf('%.3f', coalesce(seconds, 0e0)) AS seconds {T} JOIN sized USING (k)",
        "j6_batch_position_join": f"SELECT k, k // 5 AS batch_id, cues IS NULL OR k % 4 = 0 AS failed, CASE WHEN k % 4 = 0 THEN 0 ELSE coalesce(cues, 0) END AS cues, printf('%.3f', CASE WHEN k % 4 = 0 THEN 0e0 ELSE coalesce(seconds, 0e0) END) AS seconds {T} LEFT JOIN sized USING (k)",
        "j7_candidates_before_end": f"SELECT k, pos, kind FROM aligned WHERE CASE WHEN kind = 'cue' THEN {CUE_FITS} ELSE {LOOP_FITS} END",
        "j8_nearest_downbeat": "SELECT kind, count(*) AS candidates, count(*) FILTER (t <> ts) AS moved FROM aligned GROUP BY kind",
        "a1_color_comment": "SELECT k, comment FROM comments",
        "a2_cue_loop_counts": "SELECT k, coalesce(c.n, 0) AS cues, coalesce(l.n, 0) AS loops FROM (SELECT k, count(*) AS n FROM cues_in GROUP BY k) c FULL JOIN (SELECT k, count(*) AS n FROM loops GROUP BY k) l USING (k)",
        "a3_analysis_sizes": "SELECT k, cues, loops FROM sized",
        "a4_batch_totals": f"SELECT k // 1000 AS batch_id, count(*) AS tracks, sum(k * 1000)::bigint AS bytes, count(*) FILTER (k % 3 <> 0) AS applied {T} GROUP BY ROLLUP (k // 1000)",
        "a5_removed_counts": f"SELECT k, count(*) FILTER ({REPLACEABLE}) AS removed FROM oldpoints GROUP BY k",
        "a6_color_usage": "SELECT color, kind, count(*) AS points, count(DISTINCT k) AS tracks FROM points GROUP BY CUBE (color, kind)",
        "a7_correction_rate": f"SELECT color AS proposed, {COLOR} AS final, count(*) AS candidates {C} WHERE len(elements) > 0 GROUP BY ALL",
        "w1_first_six_cues": "SELECT k, place AS pos, ts FROM aligned WHERE kind = 'cue' AND place < 6",
        "w2_number_cues": "SELECT k, place AS pos, num, consumed FROM cues",
        "w3_select_loops": "SELECT k, place AS pos, loop_name AS name, rank FROM loops",
        "w3b_select_loops_single": f"SELECT k, place AS pos, ln AS name, rank FROM ({_SINGLE_FIRST % _loop()}) WHERE rank <= 3 AND {LOOP_FITS} AND len(elements) > 0",
        "w4_chronological_pois": "SELECT k, ord, kind, num, name, printf('%.6f', t) AS at, color FROM points",
        "w5_loop_slots": "SELECT k, slot, name FROM points WHERE kind = 'loop'",
        "w6_summary_labels": "SELECT k, CASE kind WHEN 'cue' THEN 'Cue ' ELSE 'Loop ' END || row_number() OVER (PARTITION BY k, kind ORDER BY t, made) AS label, printf('%.6f', t) AS at FROM points",
        "w7_assign_batches": f"SELECT k, row_number() OVER (ORDER BY file_path) - 1 AS idx, (row_number() OVER (ORDER BY file_path) - 1) // 5 AS batch_id {T}",
        "w8_latest_analysis": f"SELECT partkey, batch_id, idx FROM (SELECT partkey, k // 5 AS batch_id, k * 10 + pos AS idx {C} ) QUALIFY row_number() OVER (PARTITION BY partkey ORDER BY batch_id DESC, idx DESC) = 1",
        "u1_replace_pois": "SELECT path, count(*) AS points, count(*) FILTER (name IN ('old', 'keep') OR type = 'beatgrid') AS kept FROM annotated GROUP BY path",
        "u2_upsert_library": "SELECT library_id, k AS song_ord, file_path AS path, CASE WHEN edited THEN comment ELSE 'old' END || '|second' AS comments FROM songs JOIN comments USING (k)",
        "u3_input_union": rf"SELECT arg_ord, k FROM (SELECT 0::bigint AS arg_ord, * {T} WHERE k % 3 <> 0 UNION ALL SELECT 1, * {T} WHERE k % 2 = 0 OR k % 3 = 0) WHERE regexp_matches(lower(file_path), '\.(mp3|flac|wav|m4a|aac|ogg|opus|mpeg)$')",
        "s1_audio_inventory": rf"SELECT arg_ord, path, length FROM (SELECT 1::bigint AS arg_ord, (k % 3) || '/' || (k % 7) || '/' || string_split(file_path, '/')[-1] AS path, k % 100 AS length, k {T} UNION ALL SELECT 0, (k % 3) || '/' || (k % 7) || '/' || string_split(file_path, '/')[-1], k % 100, k {T} WHERE k % 3 = 1) WHERE regexp_matches(lower(path), '\.(mp3|flac|wav|m4a|aac|ogg|opus|mpeg)$')",
        "p6_round_times_exact": f"SELECT k, pos, printf('%.3f', printf('%.2f', (partkey * 10 + 5) / 1000e0)::double) AS rounded {C}",
        "j4_malformed_scan": f"SELECT custkey, (list(CASE WHEN k % 6 <> 3 THEN bpm END ORDER BY k) FILTER (bpm IS NOT NULL OR k % 6 = 3))[1] AS bpm, min(k) AS first_ord FROM (SELECT *, {BPM} AS bpm {T} ) GROUP BY custkey",
        "j4_nfc_attributes": f"SELECT k, NULL::double AS exact, k AS exact_ord, song_length AS nfc, k AS nfc_ord {T}",
        "a5_removed_from_songs": f"SELECT k, count(*) FILTER ({REPLACEABLE}) AS removed FROM oldpoints GROUP BY k",
        "s2_read_library": f"SELECT file_path AS path, song_length::varchar AS song_length, '0.05' AS grid_pos, '{OLD}' AS contents, 'old|second' AS comments {T}",
        "k1_export_library": "SELECT library_id, path, poi_ord, type, num, slot, name, pos, color, size FROM annotated",
        "k2_publish_library": f"SELECT file_path AS path, song_length, scan_bpm, tags_bpm, 0.05e0 AS grid_pos, '{OLD}' AS contents, 'old|second' AS comments {T}",
        "s2_read_raw_library": f"SELECT 'lib' || (k % 4)::varchar AS library_id, file_path AS path, scan_bpm::varchar AS scan_bpm, tags_bpm::varchar AS tags_bpm, 2 + (beatgrid_pos IS NOT NULL)::bigint AS points, {song_text_sql()} AS raw, true AS followed {T}",
        "k1_lossless_edit": f"SELECT library_id, file_path AS path, replace(CASE WHEN edited THEN {_EDITED} ELSE {song_text_sql()} END, chr(10), chr(13) || chr(10)) AS raw FROM songs JOIN comments USING (k) LEFT JOIN elements USING (k)",
        "k2_export_differences": f"SELECT 'lib' || (k % 4)::varchar AS library_id, k // 500 AS document, count(*) AS songs, 3 * count(*) AS points, count(*) AS songs_read, 3 * count(*) AS points_read {T} GROUP BY ALL HAVING count(*) FILTER (k % 4000 IN (1, 1002, 2003)) > 0",
        "k3_snapshot_library": f"SELECT 'lib' || (k % 4)::varchar AS library_id, k AS song_ord, file_path AS path, '{OLD}' AS contents, 'old|second' AS comments {T}",
        "s3_repair_library_text": f"SELECT k, pos, '<VirtualDJ_Database><Song>' || pos || '</Song></VirtualDJ_Database>' AS repaired {C}",
        "s4_read_analyses": "SELECT k, k % 11 = 0 OR k % 13 = 0 AS failed, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 0 ELSE cues END AS cues, printf('%.3f', CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 0e0 ELSE coalesce(seconds, 0e0) END) AS seconds FROM sized",
        "s4_strict_times": "SELECT k, reason IS NOT NULL AS failed, reason AS failure, CASE WHEN reason IS NULL THEN cues ELSE 0 END AS cues, printf('%.3f', CASE WHEN reason IS NULL AND k % 5 <> 0 THEN seconds ELSE 0e0 END) AS seconds FROM (SELECT *, CASE WHEN k % 7 = 0 OR (k % 5 <> 0 AND k % 9 = 0) THEN 'bad_time' END AS reason FROM sized WHERE cues > 0)",
        "s5_read_batch_analyses": "SELECT k // 5 AS batch_id, row_number() OVER (PARTITION BY k // 5 ORDER BY k) - 1 AS idx, cues, loops, printf('%.3f', coalesce(seconds, 0e0)) AS seconds FROM sized",
        "b1_annotate_library": "SELECT library_id, path, song_ord, poi_ord, type, num, slot, name, pos, color, size FROM annotated",
        "b2_preview": f"""SELECT k, kind, place + 1 AS n, coalesce(name, CASE kind WHEN 'cue' THEN 'cue' || (place + 1) ELSE 'loop' || (place + 1) || 'l' END) AS name, printf('%.1f', ts) AS at, {SHOWN.replace('x', 'color')} AS color, CASE kind WHEN 'loop' THEN coalesce(length_beats, 16e0) END AS beats, array_to_string(elements, ',') AS elements FROM aligned a WHERE place < CASE kind WHEN 'cue' THEN 6 ELSE 3 END""",
        "b3_preview_detailed": f"SELECT k, 'cue' AS kind, place + 1 AS n, coalesce(nullif(name, ''), {_base("(place + 1)::varchar")}) AS name, printf('%.1f', t) AS at, {SHOWN.replace('x', 'color')} AS color, NULL::double AS beats FROM aligned WHERE kind = 'cue' AND a.place < 6 UNION ALL SELECT k, 'loop', row_number() OVER (PARTITION BY k ORDER BY t, rank), ln, printf('%.1f', t), {SHOWN.replace('x', 'color')}, coalesce(length_beats, 16e0) FROM ({_SINGLE_FIRST % _loop(False)}) WHERE rank <= 3".replace("FROM aligned WHERE kind = 'cue' AND a.place", "FROM aligned a WHERE kind = 'cue' AND a.place"),
        "b4_request_table": f"SELECT batch_id, string_agg(line, chr(10) ORDER BY k) AS lines FROM (SELECT k, k // 5 AS batch_id, 'File ' || (k % 5 + 1) || ': ' || string_split(file_path, '/')[-1] || ' - Length: ' || printf('%.1f', coalesce(nullif(song_length, 0), 300e0)) || 's - BPM: ' || coalesce(printf('%.1f', nullif({BPM}, 0)), 'Unknown') AS line {T} ) GROUP BY batch_id",
        "b5_track_status": "SELECT k, batch_id, status FROM statuses",
        "k4_run_report": "SELECT batch_id, count(*) AS tracks, count(*) FILTER (status = 'applied') AS applied FROM statuses GROUP BY ROLLUP (batch_id)",
        "b6_color_index": "SELECT color, type, path, pos, name FROM found",
        "t1_annotate_incremental": "SELECT library_id, k AS song_ord, file_path AS path, CASE WHEN edited THEN comment ELSE 'old' END || '|second' AS comments, n AS points, times AS \"at\" FROM songs JOIN comments USING (k) JOIN (SELECT song_ord AS k, count(*) AS n, string_agg(pos, ',' ORDER BY poi_ord) AS times FROM annotated GROUP BY song_ord) USING (k)",
        "t1_rejected_responses": f"SELECT library_id, path, batch_id, idx, reason FROM ({REJECTED}) WHERE reason IS NOT NULL",
        "t1_stream_report": f"SELECT 2 * count(*) AS responses, count(*) + count(*) FILTER (reason IS NULL) AS usable, count(*) FILTER (reason = 'unparsable') AS unparsable, 0 AS empty, 0 AS bad_time, count(*) FILTER (reason = 'not_in_library') AS not_in_library FROM ({REJECTED})",
    }.items()
}
