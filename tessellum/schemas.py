"""Declared schemas; nothing is inferred on read."""

EDGE = "node_id string, relation_type string, required boolean, confidence double, reason string, topic string"

DOCUMENTS = "doc_key string, doc_id string, file_name string, file_type string, source_path string, content_hash string, text string"
CHUNKS = (
    "node_id string, doc_key string, doc_id string, chunk_index int, token_size int, heading_path string, text string, summary string, "
    "keywords array<string>, tags array<string>, type string, has_code boolean, coherence string, dependency_topics array<string>"
)
EDGES = "doc_key string, source_id string, edge_pos int, target_id string, relation_type string, required boolean, confidence double, reason string, topic string"
CARDS = (
    "doc_key string, status string, doc_content_hash string, expected_node_count int, processed_node_count int, model string, "
    f"prompt_version string, error string, discarded_edge_count int, node_dependencies map<string, array<struct<{', '.join(f.replace(' ', ':', 1) for f in EDGE.split(', '))}>>>"
)
VECTORS = "route string, node_id string, embedding array<float>, embedding_model string"
POSTINGS = "token string, node_id string"
DOC_STATS = "node_id string, dl int, corpus_pos bigint"
HITS = "query_id bigint, hit_seq bigint, node_id string, route string, rank int, raw_score double, is_rewritten boolean"
ANNOTATION = "struct<summary:string,keywords:array<string>,tags:array<string>,type:string,has_code:boolean,coherence:string,dependency_topics:array<string>>"
ANNOTATION_CACHE = "text_hash string, version string, raw string"
DOC_STATE = "doc_key string, content_hash string, node_ids array<string>, node_count int"
