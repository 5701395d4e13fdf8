"""Schemas of all tables, as DDL strings; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import Store, settled

METADATA = "title string, creators array<string>, language string, identifier string, description string, publisher string, subjects array<string>, date string"
MANIFEST = "id string, href string, media_type string, properties array<string>"
SPINE = "spine_index int, id string, href string, media_type string, linear boolean"
TOC = "Title string, SrcFile string, SrcAnchor string, `Order` int, Depth int, SourceKind string"
BLOCK = "kind string, level int, anchor string, text string, alt string"
BLOCKS = f"array<struct<{', '.join(':'.join(f.rsplit(' ', 1)) for f in BLOCK.split(', '))}>>"
ITEM_BLOCKS = f"spine_index int, item_id string, href string, zip_path string, raw_file string, blocks {BLOCKS}"
CHAPTER = "id int, title string, source string, raw_size long, section_ids array<string>, toc_entry_index int, detection_strategy string, status string"
SKIPPED = "title string, reason string, src_file string, snippet string, strategy string"
INDEX = "chapter_count int, start_id int, strategy string, warnings array<string>"
TERM = "source string, target string, type string, first_seen_chapter int, chapters array<int>"
CHARACTER = "name string, translation string, role string, description string, chapters array<int>"
SUMMARY = "chapter_id int, summary string"
STRESS = "ord int, term string, stressed string, approved boolean, chapters array<int>"
CONFLICT = "term string, variants array<string>"
VIOLATION = "chapter_id int, source_term string, expected_target string, found_in_translation string"
REQUEST = "custom_id string, instructions string, input string, model string, json_mode boolean, max_tokens long"
RESULT = "custom_id string, content string, error string"
EXTRACTION = "characters array<struct<name:string, translation:string, role:string, description:string>>, terms array<struct<source:string, target:string, type:string>>, summary string"
BATCH_STATE = "type string, batch_id string, input_file_id string, output_file_id string, error_file_id string, model string, endpoint string, status string, chapter_ids array<int>, created_at timestamp, completed_at timestamp, total long, completed long, failed long"
#: One line of a batch's output file.
RESULT_LINE = "custom_id string, error struct<code:string, message:string>, response struct<status_code:int, body:string>"
BODY = "output array<struct<type:string, content:array<struct<type:string, text:string>>>>"


def absent_as_empty(spark: SparkSession, path: str, schema: str, fmt: str = "json", **options) -> DataFrame:
    """A stored table; where there is none, an empty one."""
    none = spark.createDataFrame([], schema)
    if not Store(spark, settled(spark, path)).exists(path):
        return none
    # Without the columns of folders that the schema does not name.
    return spark.read.schema(none.schema).options(**options).format(fmt).load(path).select(*none.columns)
