"""Fixed schemas of the tables that the operators take."""

from __future__ import annotations

PAGES = "doc_id long, page_number int, text string, origin string, ocr_confidence int"
INSPECTIONS = "doc_id long, page_index int, native_text string, image_coverage float, width_pixels int, height_pixels int"
OCR_WORDS = "doc_id long, page_number int, rotation int, seq int, confidence float, word string"
EVIDENCE = "struct<date:string,document_type:string,parties:array<string>>"
PROPOSALS = (
    "doc_id long, document_type string, document_date string, date_role string, parties array<string>, party_relation string, "
    f"description string, confidence float, needs_review boolean, evidence {EVIDENCE}"
)
REPLY = (
    "type_evidence string, document_type string, date_evidence string, document_date string, date_role string, parties array<string>, "
    "party_evidence array<string>, party_relation string, description string, confidence float, needs_review boolean"
)
WORKER_EVENT = (
    "protocol_version int, request_id string, event struct<type:string,stage:string,current:long,total:long,code:string,message:string,retryable:boolean,"
    "document:struct<pages:array<struct<page_number:int,text:string,origin:string,ocr_confidence:double>>,warnings:array<string>,truncated:boolean,"
    "optional_image:struct<page_number:int,media_type:string>>>, _corrupt string"
)
QUEUE_ITEMS = (
    "id long, source_path string, source_path_key string, source_hash string, status string, processing_failures int, error_code string, owner_session string, "
    "lease_expires_at long, previous_status string, active_receipt_id long, reconciliation_receipt_id long, applying_epoch long, created_at long, updated_at long"
)
STORED_PROPOSALS = "queue_item_id long, proposal_json string, created_at long"
RECEIPTS = (
    "id long, queue_item_id long, direction string, source_path string, destination_path string, temporary_path string, pre_hash string, post_hash string, "
    "operation_kind string, stage string, source_exists boolean, destination_exists boolean, temporary_exists boolean, created_at long, updated_at long"
)
SESSIONS = "session_id string, heartbeat_at long"
CLAIMS = (
    "version int, key string, relative_path string, size long, modified_at long, machine_id string, machine_name string, user_name string, state string, claimed_at long, "
    "lease_expires_at long, heartbeat_at long, done_at long, outcome string, result_filename string, _corrupt string"
)
ORIGINS = "version int, key string, relative_path string, machine_id string, machine_name string, user_name string, observed_at long, _corrupt string"
MACHINES = "version int, machine_id string, machine_name string, user_name string, last_seen_at long, _corrupt string"
GOLD = (
    "file string, kind string, document_type string, acceptable_types array<string>, document_date string, acceptable_dates array<string>, forbidden_dates array<string>, "
    "date_role string, parties array<string>, forbidden_parties array<string>, party_relation string, expected_readiness string, expected_error string, ambiguity array<string>, "
    "acceptable_description_facts array<string>, expected_routing string"
)
RESULTS = (
    "file string, pipeline string, status string, ready boolean, filename string, description string, review_reasons array<string>, document_type string, document_date string, "
    "date_role string, parties array<string>, error_code string, extraction_millis long, inference_millis long"
)
