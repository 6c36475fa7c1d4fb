"""Schemas of the tables that readers give and operators take."""

from __future__ import annotations

TOKEN = "struct<kind:string,tag:string,id:string,data_ref:string,equiv:string,text:string>"
TOKENS = f"array<{TOKEN}>"
FILES = "file_id string, name string, original string, format string, xliff_version double, src_lang string, trg_lang string"
UNITS = "file_id string, unit_ord int, unit_id string, attrs map<string,string>"
SEGMENTS = f"file_id string, unit_ord int, seg_ord int, segment_id string, kind string, source {TOKENS}, target {TOKENS}, state string, sub_state string, locked boolean, modified_on string, modified_by string"
ORIGINAL_DATA = "file_id string, unit_ord int, data_id string, xml string"
NOTES = "file_id string, unit_ord int, note_id string, segment_id string, state string, text string, added_at string, added_by string, resolved_at string, resolved_by string"
LQI = "file_id string, unit_ord int, issue_id string, segment_id string, type string, comment string, severity string, added_at string, added_by string, resolved boolean, resolved_at string, resolved_by string"
HISTORY = f"file_id string, unit_ord int, segment_id string, version_ord int, target {TOKENS}, state string, modified_on string, modified_by string"
TM_METADATA = "source string, target string, version string"
TM_MAIN = "id long, source string, target string, state string, time string, submitted_by string"
QA_LETTERS = "letter string"
QA_WORDS = "word string, count long"
