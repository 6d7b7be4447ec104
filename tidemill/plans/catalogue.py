"""Query name -> callable, and query name -> DuckDB SQL."""

from __future__ import annotations

from . import analytics_queries, corpus_queries, decision_queries, relational_queries, report_queries, rule_queries, stream_queries

QUERIES: dict = {}
ORACLE: dict = {}
for _part in (analytics_queries, relational_queries, corpus_queries, decision_queries, report_queries, rule_queries, stream_queries):
    QUERIES |= _part.CATALOGUE.queries
    ORACLE |= _part.CATALOGUE.sql

#: Columns whose SQL sums are wider than the query's: name -> columns cast to BIGINT, and to DOUBLE.
WHOLE = {
    "q02c_run_totals": ["raw_results", "distinct_creators", "new_creators", "confirmed", "duplicates"],
    "q12_segment_health": ["quota", "valuable", "new_creators", "distinct_creators"],
    "q15_arm_comparison": ["quota", "new", "relevant"],
    "q15b_retrieval_evidence": ["pages"],
    "q15c_page_rollup": ["raw_results", "distinct_results"],
    "q38_trust_cohorts": ["distinct_creators", "new_creators", "relevant_new", "quota"],
    "q46_coverage_replay": ["distinct_results"],
    "q64b_frontier_diagnostics": ["quota"],
    "q58_json_payload_agg": ["total"],
    "q60f_revisions": ["choice"],
    "q20_term_decay_lifecycle": ["executions"],
    "q55_streak_continuation": ["streak"],
    "q61g_semantic_votes": ["votes"],
}
REAL = {
    "q23_evidence_decision": ["positive", "negative", "raw", "score"],
    "q61i_creator_quality": ["quality_score"],
}
for _kind, _columns in (("BIGINT", WHOLE), ("DOUBLE", REAL)):
    for _name, _cast in _columns.items():
        _list = ", ".join(f'CAST("{c}" AS {_kind}) AS "{c}"' for c in _cast)
        ORACLE[_name] = f"SELECT * REPLACE ({_list}) FROM (\n{ORACLE[_name]}\n)"
