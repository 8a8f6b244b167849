"""Schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STAGE = "struct<name:string,description:string,is_framing:boolean>"
INFERRED = "struct<event_name:string,timeline_anchor:string,location:string,characters_present:array<string>,core_event:string,antecedent_cause:string,consequent_effect:string,source_pages:array<int>>"
INSTRUCTION = f"struct<is_duplicate:boolean,matched_event_name:string,category:string,inferred_event:{INFERRED}>"
ANSWER = "struct<answer:string,used_event_ids:array<string>>"

TABLES = {
    "documents": f"id string, title string, filename string, page_count int, taxonomy array<{STAGE}>, uploaded_at timestamp",
    "pages": "doc_id string, page_no int, content string",
    "chunks": "doc_id string, chunk_index int, page_start int, page_end int, content string, embedding array<float>",
    "events": "id string, doc_id string, event_name string, category string, timeline_anchor string, stage_order int, location string, characters array<string>, core_event string, antecedent_cause string, consequent_effect string, source_pages array<int>, first_page int, merge_count int, embedding array<float>",
    "observations": "doc_id string, window_id string, page_start int, page_end int, raw_text string",
    "instructions": f"doc_id string, batch int, pos int, is_duplicate boolean, matched_event_name string, category string, inferred_event {INFERRED}",
    "job_events": "job_id string, seq long, doc_id string, kind string, status string, stage string, progress float, detail string, error string, at timestamp",
    "query_runs": "doc_id string, question string, naive_answer string, naive_ms int, naive_tokens int, timeline_answer string, timeline_ms int, timeline_tokens int, created_at timestamp",
    "edges": "doc_id string, src string, dst string, confidence double, kind string",
    "appears_in": "doc_id string, character_uid string, name string, event_id string",
}

#: Columns whose combination names a row, for checks of uniqueness.
KEYS = {"documents": ["id"], "pages": ["doc_id", "page_no"], "chunks": ["doc_id", "chunk_index"], "events": ["id"], "edges": ["doc_id", "src", "dst"], "appears_in": ["character_uid", "event_id"]}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """Keys that more than one row has; empty for a valid table."""
    return df.groupBy(*KEYS[table]).count().where("count > 1")


def invalid_categories(events: DataFrame) -> DataFrame:
    """Events whose category is neither major nor minor."""
    return events.where(~F.coalesce(F.col("category").isin("major", "minor"), F.lit(False)))
