"""All registered queries of the engine proper and their SQL twins."""

from quarrystone.plans import capture_queries, content_queries, corpus_queries, evidence_queries, gate_queries, graph_queries, index_queries, mail_queries, package_queries, record_queries, response_queries, session_queries, source_queries, text_queries, timeline_queries, walk_queries

_MODULES = (
    graph_queries, timeline_queries, content_queries, mail_queries, text_queries, corpus_queries, walk_queries, record_queries, package_queries,
    capture_queries, gate_queries, source_queries, evidence_queries, index_queries, session_queries, response_queries
)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
