"""Schemas of the data model's entities, as DDL."""

ELEMENT = "doc_id string, seq bigint, category string, text string, page_number int, text_as_html string, points array<array<double>>"
RAW_CHUNK = "doc_id string, seq bigint, chunk_index int, type string, section string, is_parent boolean, page_number int, content string, table_id string, parent_id string"
BOXED_CHUNK = RAW_CHUNK + ", bbox string"
ENRICHED_CHUNK = (
    "page_content string, metadata struct<section:string,chunk_type:string,source_file:string,tokens:int,created_at:bigint,page_number:int,bbox:string>, "
    "cmetadata struct<company_document_id:string,revision_number:string,revision_code:string,revision_date:bigint,document_type:string>, chunk_id string, parent_id string, doc_id string"
)
VECTOR_ROW = "chunk_id string, company_document_id string, revision_number string, content string, embedding array<float>, meta map<string,string>"
CHAT_MESSAGE = "session_id string, turn bigint, role string, content string, created_at timestamp"
RETRIEVAL_STAT = (
    "session_id string, job_id string, company_document_id string, revision_number string, question string, chunk_count int, chunk_types array<string>, sections array<string>, "
    "avg_score float, max_score float, confidence float, confidence_level string, latency_ms int, created_at timestamp"
)
FEEDBACK = (
    "session_id string, job_id string, company_document_id string, revision_number string, question string, answer string, feedback_label string, feedback_score int, comment string, "
    "chunk_ids array<string>, created_at timestamp"
)
JOB_EVENT = "job_id string, session_id string, seq bigint, action string, metadata map<string,string>, missing array<string>, error string"
UI_CHUNK = "stream_id string, seq bigint, chunk string"
