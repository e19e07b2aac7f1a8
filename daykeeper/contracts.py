"""Document contracts and other fixed values.

Contract names carry the namespace of the archive that wrote the documents, so the namespace is a
parameter: ``Contracts("acme").manifest`` is ``acme-long-term-archive-manifest/v3``.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Contracts:
    namespace: str = "archive"

    # Contract names and file suffixes below the namespace.
    @property
    def manifest(self) -> str:
        return f"{self.namespace}-long-term-archive-manifest/v3"

    @property
    def verification(self) -> str:
        return f"{self.namespace}-windows-archive-verification/v1"

    @property
    def retention(self) -> str:
        return f"{self.namespace}-v3-hot-retention/v1"

    @property
    def cleanup_plan(self) -> str:
        return f"{self.namespace}-windows-cloud-cleanup-plan/v1"

    @property
    def cleanup_checkpoint(self) -> str:
        return f"{self.namespace}-windows-cloud-cleanup-checkpoint/v1"

    @property
    def cleanup_receipt(self) -> str:
        return f"{self.namespace}-windows-cloud-cleanup-receipt/v1"

    @property
    def cleanup_marker(self) -> str:
        return f"{self.namespace}-cloud-cleanup-marker/v1"

    @property
    def file_delete_plan(self) -> str:
        return f"{self.namespace}-cloud-file-delete-plan/v1"

    @property
    def file_delete_receipt(self) -> str:
        return f"{self.namespace}-cloud-file-delete-receipt/v1"

    @property
    def sidecar_suffix(self) -> str:
        return f".{self.namespace}-metadata.json"


DEFAULT_CONTRACTS = Contracts()

# Replica names, kinds and numeric limits of the archive format.
PRIMARY_REPLICA = "google_drive"
SECONDARY_REPLICA = "r2"
BUSINESS_KIND = "business"
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
SHA256_PATTERN = r"^[0-9a-f]{64}\z"
SPACE_RESERVE_BYTES = 256 * 1024 * 1024
FREE_ALLOWANCE_BYTES = 10 * 1024**3
REMOVAL_BATCH_KEYS = 1000
CACHE_SECONDS = 300
DOWNLOAD_SHARE = 7000
SPEED_SAMPLE_SECONDS = 0.4
PUBLISH_SECONDS = 0.2
SPEED_KEEP = 0.7
SPEED_GAIN = 0.3

# Labels shown for replicas, states, kinds and reports.
REPLICA_LABELS = {
    "google_drive": "Google Drive",
    "r2": "Cloudflare R2",
    "mixed": "Google Drive / R2",
}
STATE_LABELS = {
    "loading": "... 读取中",
    "verified": "✓ 已验证",
    "cleaned": "✓ 已清理",
    "missing": "○ 缺失",
    "error": "! 异常",
    "partial": "○ 下载未完成",
    "unverified": "? 未验证",
}
KIND_LABELS = {
    "business": "业务",
    "control": "控制",
    "evidence": "证据",
    "raw": "原始",
}
MATCH_LABELS = {
    "match": "✓ 一致",
    "differ": "! 不一致",
    "cleaned": "✓ 已核准清理",
    "loading": "... 读取中",
    "unknown": "--",
}
REPORT_KIND_LABELS = {
    "verify": "完整校验",
    "plan": "清理计划",
    "checkpoint": "R2 检查点",
    "receipt": "清理回执",
    "other": "JSON 报告",
}
REPORT_STATE_LABELS = {
    "verified": "✓ 已验证",
    "completed": "✓ 已完成",
    "confirmed": "✓ 已确认",
    "pending": "○ 待处理",
    "read": "已读取",
    "broken": "! 异常",
}
DURATION_UNITS = {"second": "秒", "minute": "分", "hour": "小时"}
