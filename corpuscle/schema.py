"""Record shapes. Everything is read with these, never inferred."""

from __future__ import annotations

LANGS = ("zh", "en", "ja", "es", "bg")

CORPUS = (
    "corpus_id string, name string, version string, created string, languages array<string>, "
    "alignment_units array<struct<id:string, source:struct<museum:string,image:string,title_zh:string,title_en:string>, translations:map<string,string>>>"
)
GLOSSARY = "glossary array<struct<zh:string,en:string,ja:string,es:string,bg:string>>"
BOARD = (
    "board_title struct<zh:string,en:string>, corrections struct<zh_changes:array<string>,en_changes:array<string>>, "
    "paragraphs array<struct<zh:string,en:string,sentences:array<struct<zh:string,en:string>>>>"
)
OCR = "image string, museum string, text string, confidence double"
REVIEWS = "item string, action string, corrected_text string, reviewed_at timestamp"
CANDIDATES = "unit_id string, lang string, model string, text string, score double"
PROGRESS = "item string, stage string, status string, at timestamp"
SPEECH = "unit_id string, lang string, start_s double, end_s double"
TMX_UNIT = "_tuid string, tuv array<struct<`_xml:lang`:string, seg:string>>"
