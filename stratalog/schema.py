"""Schemas of the tables that operators take and give, as DDL. Failures are columns, not exceptions."""

SCAN_FILE = "path string, is_dir boolean, readable boolean, size long, mtime long, ctime long, root string, ordinal long, error string"
HASH_ENTRY = "record_id string, hash string, file_path string, file_size long, mtime long, ctime long, status string"
HASH_RECORD = "record_id string, record_name string, created_at long, source_paths array<string>"
MANIFEST = "guid string, version string, author string, games array<string>, encoding string, error string"
PLAN = "ordinal long, old_path string, new_path string, conflict boolean, warn string"
OUTCOME = "ordinal long, old_path string, new_path string, success boolean, error string"
OP_RECORD = "record_id string, domain string, record_name string, extra string, source_paths array<string>, created_at long, rollback_status string, rollback_enabled boolean"
OP_ITEM = "id long, record_id string, old_path string, new_path string, apply_success boolean, apply_error string, rollback_success boolean, rollback_error string, updated_at long"
MOVE_REPORT = "report_id string, task_id string, created_at long, target_dir string, total_selected long, total_success long, total_failed long, released_bytes long"
MOVE_ITEM = "report_id string, src_path string, dst_path string, success boolean, error_code string, error_message string, size long"
TASK_EVENT = "task_id string, seq long, ts timestamp, level string, stage string, message string, processed long, total long"

#: The domains of the operation log and the kinds of each.
DOMAINS = ("suffix_change", "empty_dir", "mod_op", "image_dedup")
KINDS = ("rename", "organize", "modify", "duplicate_delete", "version_delete")
