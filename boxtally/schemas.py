"""Declared schemas of the stored tables; nothing is inferred."""

from __future__ import annotations

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
ISSUES = "array<struct<code:string,severity:string,message:string,evidence:string>>"
ITEM = f"struct<barcode_value:string,barcode_format:string,barcode_bbox:{BOX},label_bbox:{BOX},label_index:int,match_basis:string,source_image:int>"

TABLES: dict[str, str] = {
    "runs": f"""
        id string, session_id string, trace_id string, source string, endpoint string, status string,
        filename string, image_ref string, upload_bytes int, image_width int, image_height int,
        scanner_count int, vision_count int, scanner_vision_match boolean, count_delta int,
        found_count int, missing_count int, unassigned_count int, recovery_attempted boolean,
        recovery_labels_tried int, recovery_barcodes_found int, recovery_labels_resolved int,
        recovery_succeeded boolean, latency_ms int, primary_issue string, issue_count int,
        issues {ISSUES}, error_code string, error_message string, error_detail string, pipeline_version string,
        scanner_version string, vision_prompt_version string, vision_model string,
        recovery_version string, provider_message_id string, sender string,
        created_at timestamp, processed_at timestamp, created_month string""",
    "run_items": f"""
        run_id string, label_index int, barcode_value string, barcode_format string,
        barcode_bbox {BOX}, label_bbox {BOX}, match_basis string, status string, created_at timestamp""",
    "annotations": """
        run_id string, status string, reviewed_at timestamp, reviewed_by string,
        expected_barcodes array<string>, expected_outcome string, added_to_dataset boolean,
        created_at timestamp""",
    # The queue store keeps flags as integers and times as text; read_queue casts them.
    "annotation_candidates": """
        id string, run_id string, session_id string, source string, image_ref string, status string,
        scanner_count int, vision_count int, recovery_attempted int, recovery_labels_resolved int,
        issues string, created_at string, reviewed_at string, reviewed_by string,
        expected_barcodes string, expected_outcome string, added_to_dataset int""",
    "customers": "id string, name string, active boolean, created_at timestamp",
    "branches": "id string, customer_id string, name string, active boolean, created_at timestamp",
    "orders": f"""
        session_id string, customer_id string, branch_id string, action string, status string,
        items array<{ITEM}>, created_at timestamp""",
    "sessions": f"""
        id string, status string, expected_count int, found_count int, missing_count int,
        image_count int, channel string, participant_id string, customer_id string, branch_id string,
        action string, source string, message string, candidates array<{ITEM}>,
        created_at timestamp, updated_at timestamp, last_activity_at timestamp,
        completed_at timestamp, closed_at timestamp""",
    "session_items": f"""
        session_id string, line_id long, barcode_value string, barcode_format string,
        barcode_bbox {BOX}, label_bbox {BOX}, label_index int, match_basis string, source_image int,
        created_at timestamp""",
    "session_missing": f"""
        session_id string, line_id long, label_index int, label_bbox {BOX}, barcode_bbox {BOX},
        status string, source_image int, resolved boolean, resolved_by_image int, created_at timestamp""",
}

#: tables stored in folders; files inside are clustered by time, see write_table
PARTITIONS = {"runs": ["created_month"]}

EVENT_PAYLOAD = f"""struct<status:string,source:string,image_ref:string,found_count:int,missing_count:int,
    scanner_count:int,vision_count:int,recovery_attempted:boolean,recovery_labels_resolved:int,
    elapsed_ms:int,issues:{ISSUES}>"""

EVENT = "type string, run_id string, session_id string, timestamp timestamp, payload string"

# The event types.
EVENT_TYPES = (
    "IMAGE_RECEIVED", "SCAN_COMPLETED", "AUDIT_COMPLETED", "RECONCILIATION_COMPLETED",
    "RECOVERY_STARTED", "RECOVERY_COMPLETED", "INGEST_COMPLETED", "USER_RETRY_REQUESTED",
)

NORMALIZED_BOX = "struct<top:int,left:int,bottom:int,right:int>"
GROUND_TRUTH = """
    summary struct<description:string,image_count:long,expected_barcode_symbol_count:long,
        expected_decoded_count:long,expected_outcome:string,images:array<string>>,
    images array<struct<image:string,expected_barcode_symbol_count:long,
        boxes:array<struct<status:string,value:string,format:string,
            bounding_box:struct<x1:int,y1:int,x2:int,y2:int>>>>>"""
