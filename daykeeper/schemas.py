"""Explicit schemas of the archive's JSON documents. Extra keys are tolerated."""

from __future__ import annotations

# Scalars that rules compare are read as text, so a wrong JSON type fails its rule, not the parse.
MANIFEST_ENTRY = (
    "relative_key STRING, kind STRING, table_name STRING, size_bytes STRING, sha256 STRING, "
    "row_count STRING, schema_sha256 STRING, content_sha256 STRING"
)
MANIFEST = (
    "contract_version STRING, status STRING, retention_delete_allowed STRING, archive_date STRING, "
    f"object_count STRING, row_count STRING, objects ARRAY<STRUCT<{MANIFEST_ENTRY.replace(' STRING', ': STRING')}>>"
)
SIDECAR = "relative_key STRING, size_bytes BIGINT, sha256 STRING"

_IDENTITY = "contract_version STRING, status STRING, profile_id STRING, collector_id STRING, archive_date STRING"
EVIDENCE = {
    "marker": "contract_version STRING, status STRING, archive_date STRING, manifest_sha256 STRING, "
    "object_count BIGINT, row_count BIGINT, tree_sha256 STRING, verified_at STRING",
    "retention": "contract_version STRING, status STRING, archive_date STRING, dropped_at STRING, "
    "partitions ARRAY<STRING>, verified_manifest_sha256 STRING",
    "plan": f"{_IDENTITY}, manifest_sha256 STRING, local_tree_sha256 STRING, object_count BIGINT, "
    "row_count BIGINT, parquet_bytes BIGINT, generated_at STRING",
    "checkpoint": f"{_IDENTITY}, manifest_sha256 STRING, local_tree_sha256 STRING, plan_file STRING, "
    "plan_sha256 STRING, cloudflare_r2_absent BOOLEAN, google_drive_still_present BOOLEAN, "
    "operator_confirmation STRING, verified_at STRING",
    "receipt": f"{_IDENTITY}, manifest_sha256 STRING, local_tree_sha256 STRING, plan_file STRING, "
    "plan_sha256 STRING, r2_checkpoint_file STRING, r2_checkpoint_sha256 STRING, completed_at STRING",
    "cleanup_marker": f"{_IDENTITY}, manifest_sha256 STRING, receipt_file STRING, receipt_sha256 STRING, "
    "completed_at STRING",
    "delete_plan": f"{_IDENTITY}, provider STRING, path STRING, is_dir BOOLEAN, object_count BIGINT, "
    "total_bytes BIGINT, expected_objects MAP<STRING, BIGINT>, target STRING, generated_at STRING",
}
