"""Schemas of everything read from files. Nothing is inferred."""

BOX = "struct<x1: double, y1: double, x2: double, y2: double>"

MANIFEST = f"""
    schema_version string, name string, version string, source_url string, source_revision string,
    license struct<name: string, evidence: string, allowed_uses: array<string>,
                   reviewed_by: string, reviewed_on: date>,
    classes array<string>,
    samples array<struct<image: string, sha256: string, width: int, height: int,
                         group_id: string, split: string,
                         annotations: array<struct<class_id: int, bbox: {BOX}>>>>
"""

COCO = """
    images array<struct<id: bigint, file_name: string, width: int, height: int,
                        extra: struct<name: string>>>,
    annotations array<struct<id: bigint, image_id: bigint, category_id: bigint,
                             bbox: array<double>>>,
    categories array<struct<id: bigint, name: string>>
"""

SAVED_PREDICTIONS = """
    source_images array<string>,
    predictions array<struct<image_id: bigint, category_id: bigint, bbox: array<double>,
                             score: double>>
"""

REVIEW_BATCH = """
    schema_version string, packet_sha256 string, reviewer string, reviewed_at string,
    decisions array<struct<case_id: string, answers: map<string, string>, rationale: string>>
"""

SUBJECT_BOX = "struct<category_id: bigint, bbox: array<double>, score: double>"
OVERLAP = "struct<annotation_index: int, iou: double>"
NOTES = f"""
    schema_version string, purpose string, run string, checkpoint_sha256 string,
    manifest_sha256 string, prediction_sha256 string, matching_code_sha256 string,
    exported_at string,
    notes array<struct<image: string, source_sha256: string, `group`: string,
        subject_kind: string, annotation_index: int, annotation: {SUBJECT_BOX},
        prediction_index: int, prediction: {SUBJECT_BOX},
        overlap_context: struct<prediction_index: int, matched_annotation_index: int,
            outcome: string, best_same_class: {OVERLAP}, best_any_class: {OVERLAP}>,
        assessment: string, note: string, score_threshold: double, updated_at: string>>
"""

RESOLUTIONS = """
    schema_version string, adjudicator string, reviewed_at string,
    decisions array<struct<case_id: string, action: string, rationale: string,
        annotation: struct<class_id: int, xyxy: array<double>>>>
"""

INSPECTIONS = """
    id string, owner_id string, queue_backend string, image_key string, width int, height int,
    status string, created_at double, completed_at double, available_at double, attempts int,
    lease_token string, lease_until double, model_version string, error_code string,
    overall_result string, report string
"""

INSPECTION_EVENTS = """
    id string, inspection_id string, event_type string, created_at double, event_data string
"""

SUBMISSION_OUTBOX = """
    id string, inspection_id string, created_at double, available_at double, attempts int,
    published_at double, lease_token string, lease_until double
"""

DETECTIONS = "image_id string, defect_type string, confidence double, x1 double, y1 double, x2 double, y2 double"

HISTORY = """
    pass int, epoch int, pass_complete boolean, step_start bigint, step_end bigint,
    train_steps bigint, train_loss double, elapsed_seconds double,
    train_view_indices array<int>,
    validation struct<ap50_95: double, ap50: double, ar100: double>
"""
