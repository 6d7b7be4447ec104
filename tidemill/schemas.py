"""Schemas of the engine's entities, and conforming frames to them.

They replace ordered DDL: a frame either has an entity's columns, of castable types, or conform() says what is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITIES: dict[str, str] = {
    "creator": "creator_id long, name string, country string, status string, quality long, segment string",
    "query": "query_id long, text string, country string, collection string, intent string, reserved_until timestamp",
    "query_run": "run_id long, query_id long, lane string, ordering string, quota double, started_at timestamp, finished_at timestamp",
    "sighting": "run_id long, creator_id long, rank int, page int, was_known boolean, persisted boolean, outcome string, quality long, ts timestamp",
    "page": "run_id long, page int, raw_results long, distinct_results long, new_creators long, duplicate_ratio double",
    "neighborhood": "neighborhood_key string, country string, language string, concept string, lane string",
    "term": "term string, kind string, creators long, communities long, evidence long, executions long, term_yield double",
    "document": "doc_id long, text string, lang string, source string, observed_at timestamp",
    "span": "doc_id long, literal string, normalized string, start_offset int, end_offset int, ngram_size int, occurrence_key string",
    "example": "key long, truth boolean, predicted string, score double, inclusion_bp int, segment string",
    "job": "job_id long, kind string, status string, attempts int, run_after timestamp, locked_at timestamp",
    "edge": "edge_id string, from_id string, to_id string, family string, confidence_bp int, valid_from timestamp, valid_until timestamp, observed_at timestamp, assertion string",
    "action": "action_id long, program_id string, action_type string, priority double, expected_reward double, provider_cost long, review_cost long, cluster_key long, created_at timestamp",
}


def conform(df: DataFrame, entity: str) -> DataFrame:
    """The entity's columns of df, cast and in order; a missing one is an error that names it."""
    schema = T._parse_datatype_string(ENTITIES[entity])
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{entity} lacks {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
