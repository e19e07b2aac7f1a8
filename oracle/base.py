"""Derived views as SQL common table expressions."""

from __future__ import annotations

import re


def _sums(sha: str) -> str:
    parts = []
    for start in (1, 16, 31, 46):
        number = f"('0x' || substr({sha}, {start}, 15))::BIGINT"
        parts += [f"sum({number} & 1048575)::BIGINT", f"sum(({number} >> 20) & 1048575)::BIGINT", f"sum({number} >> 40)::BIGINT"]
    return ", ".join(parts)


def ts_text(ts: str) -> str:
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({ts}) % 1000000 <> 0 "
        f"THEN strftime({ts}, '.%f') ELSE '' END || 'Z'"
    )


def _rows(where: str, value: str) -> str:
    return f"""
SELECT *, to_json({{'event_id': event_id, 'event_type': event_type, 'props': props, 'ts': {ts_text('ts')},
  'user_id': user_id, 'value': ({value})::DECIMAL(18,2)::VARCHAR}})::VARCHAR AS payload
FROM ev WHERE {where}"""


def _objects(rows: str, extra: str = "0") -> str:
    return f"""
SELECT *, sha256('schema:' || table_name) AS schema_sha256,
  CASE WHEN kind = 'business' THEN sha256('content:' || sha256) END AS content_sha256
FROM (SELECT collector, archive_date, dom, table_name, kind, relative_key, count(*) AS row_count,
        (sum(strlen(payload)) + max({extra}))::BIGINT AS size_bytes,
        sha256(concat_ws(':', count(*), {_sums('sha256(payload)')})) AS sha256, max(ts) AS modified
      FROM {rows} GROUP BY ALL)"""


_ENTRY = (
    "{'content_sha256': content_sha256, 'kind': kind, 'relative_key': relative_key, 'row_count': row_count, "
    "'schema_sha256': schema_sha256, 'sha256': sha256, 'size_bytes': size_bytes, 'table_name': table_name}"
)


def _bodies(objects: str, replica: str) -> str:
    return f"""
SELECT collector, archive_date, dom, '{replica}' AS replica, archive_date AS doc_date,
  'archive-long-term-archive-manifest/v3' AS contract_version, count(*) AS object_count,
  list({_ENTRY} ORDER BY relative_key) AS objects, true AS retention_delete_allowed,
  (sum(row_count) + CASE WHEN dom % 17 = 0 THEN 1 ELSE 0 END)::BIGINT AS row_count, 'verified' AS status
FROM {objects} GROUP BY collector, archive_date, dom"""


_DOC = (
    "to_json({'archive_date': doc_date, 'contract_version': contract_version, 'object_count': object_count, "
    "'objects': objects, 'retention_delete_allowed': retention_delete_allowed, 'row_count': row_count, "
    "'status': status})::VARCHAR"
)
_IDENTITY = (
    "'p-' || collector AS profile_id, collector, archive_date, 'p-' || collector AS doc_profile_id, "
    "collector AS doc_collector_id, archive_date AS doc_archive_date"
)

CTES: dict[str, str] = {
    "ev": """
SELECT 'c' || (event_id // 4000) AS collector, strftime(ts, '%Y-%m-%d') AS archive_date, day(ts) AS dom,
  event_type AS table_name, k.kind AS kind,
  'date=' || strftime(ts, '%Y-%m-%d') || '/' || k.kind || '/' || event_type || '.parquet' AS relative_key,
  event_id, ts, user_id, event_type, props, value::DECIMAL(18,2) AS value
FROM events JOIN (VALUES ('purchase', 'business'), ('signup', 'business'), ('click', 'raw'), ('view', 'evidence'),
  ('error', 'control')) AS k(name, kind) ON k.name = event_type""",
    "rows_drive": _rows("true", "value"),
    "rows_r2": _rows(
        "dom % 11 <> 0 AND NOT (dom % 7 = 0 AND event_id % 101 = 0)",
        "CASE WHEN dom % 5 = 0 AND event_type = 'view' THEN value + 1 ELSE value END",
    ),
    "rows_local": _rows("dom % 13 <> 0 AND NOT (dom % 9 = 0 AND event_type = 'error')", "value"),
    "objects": _objects("rows_drive"),
    "objects_b": _objects("rows_r2"),
    "observed": _objects("rows_local", "CASE WHEN dom % 8 = 0 THEN 1 ELSE 0 END"),
    "bodies_drive": _bodies("objects", "google_drive"),
    "bodies_r2": _bodies("objects_b", "r2"),
    "manifests": f"""
SELECT *, sha256(raw) AS raw_sha256, strlen(raw)::BIGINT AS raw_size,
  CASE WHEN row_count <> list_sum(list_transform(objects, lambda x: x.row_count)) THEN 'row_total' END AS reason
FROM (SELECT *, {_DOC} AS raw FROM (SELECT * FROM bodies_drive UNION ALL SELECT * FROM bodies_r2))""",
    "drive": "SELECT collector, archive_date, dom, raw_sha256 AS manifest_sha256 FROM manifests WHERE replica = 'google_drive'",
    "days": "SELECT DISTINCT collector, archive_date, dom FROM ev",
    "trees": """
SELECT collector, archive_date, sha256('[' || string_agg(to_json({'relative_key': relative_key, 'row_count': row_count,
  'sha256': sha256, 'size_bytes': size_bytes})::VARCHAR, ',' ORDER BY relative_key) || ']') AS tree_sha256
FROM objects GROUP BY collector, archive_date""",
    "faulty_bodies": """
SELECT * REPLACE (
    CASE WHEN dom = 9 THEN NULL WHEN dom = 13 THEN list_append(bent, objects[1]) ELSE bent END AS objects,
    object_count + CASE WHEN dom IN (10, 13) THEN 1 ELSE 0 END AS object_count,
    CASE WHEN dom = 5 THEN 'other/v1' ELSE contract_version END AS contract_version,
    CASE WHEN dom IN (6, 18) THEN 'pending' ELSE status END AS status,
    dom <> 7 AS retention_delete_allowed,
    CASE WHEN dom = 8 THEN '2024-02-30' ELSE doc_date END AS doc_date)
FROM (SELECT *, list_prepend({'content_sha256': objects[1].content_sha256, 'kind': objects[1].kind,
    'relative_key': CASE WHEN dom = 11 THEN '../' || objects[1].relative_key
      WHEN dom = 12 THEN replace(objects[1].relative_key, 'date=', 'day=') ELSE objects[1].relative_key END,
    'row_count': objects[1].row_count, 'schema_sha256': objects[1].schema_sha256,
    'sha256': CASE WHEN dom = 15 THEN upper(objects[1].sha256) ELSE objects[1].sha256 END,
    'size_bytes': CASE WHEN dom = 14 THEN -1 ELSE objects[1].size_bytes END,
    'table_name': objects[1].table_name}, objects[2:]) AS bent FROM bodies_drive)""",
    "faulty": f"""
SELECT *, CASE WHEN dom = 3 THEN sha256('') ELSE sha256(raw) END AS declared_sha256,
  strlen(raw)::BIGINT + CASE WHEN dom IN (2, 18) THEN 1 ELSE 0 END AS declared_size
FROM (SELECT *, CASE WHEN dom = 4 THEN substr(doc, 1, length(doc) - 1) ELSE doc END AS raw
      FROM (SELECT *, {_DOC} AS doc FROM faulty_bodies))""",
    "faulty_rules": """
SELECT collector, replica, archive_date, list_filter([
  CASE WHEN strlen(raw) <> declared_size THEN 'size' END,
  CASE WHEN sha256(raw) <> declared_sha256 THEN 'sha256' END,
  CASE WHEN NOT json_valid(raw) THEN 'bad_json' END,
  CASE WHEN NOT json_valid(raw) OR contract_version <> 'archive-long-term-archive-manifest/v3' THEN 'contract' END,
  CASE WHEN NOT json_valid(raw) OR status <> 'verified' THEN 'status' END,
  CASE WHEN NOT json_valid(raw) OR NOT retention_delete_allowed THEN 'retention' END,
  CASE WHEN NOT json_valid(raw) OR doc_date <> archive_date THEN 'date' END,
  CASE WHEN NOT json_valid(raw) OR objects IS NULL THEN 'objects' END,
  CASE WHEN json_valid(raw) AND len(objects) <> object_count THEN 'object_count' END], lambda x: x IS NOT NULL) AS reasons
FROM faulty""",
    "faulty_entries": """
SELECT collector, replica, archive_date, pos, item.relative_key AS relative_key, item.size_bytes AS size_bytes,
  CASE WHEN item.relative_key LIKE '../%' THEN 'unsafe_key'
    WHEN NOT starts_with(item.relative_key, 'date=' || archive_date || '/') THEN 'wrong_day'
    WHEN row_number() OVER (PARTITION BY collector, archive_date, item.relative_key ORDER BY pos) > 1 THEN 'duplicate_key'
    WHEN item.size_bytes < 0 THEN 'entry_size'
    WHEN NOT regexp_full_match(item.sha256, '[0-9a-f]{64}') THEN 'entry_sha256' END AS reason
FROM (SELECT collector, replica, archive_date, unnest(objects) AS item, generate_subscripts(objects, 1) - 1 AS pos
      FROM faulty WHERE json_valid(raw))""",
    "listing": """
SELECT collector, replica, 'archive/v3/collector=' || collector || '/' || key AS key, size_bytes, modified FROM (
  SELECT collector, replica, relative_key AS key, size_bytes, modified FROM sided
  UNION ALL SELECT collector, replica, 'date=' || archive_date || '/manifest.json', (sum(row_count) + 100)::BIGINT, max(modified)
    FROM sided GROUP BY collector, replica, archive_date
  UNION ALL SELECT collector, replica, 'date=' || archive_date || '0/stray.parquet', 7, max(modified)
    FROM sided WHERE dom = 1 GROUP BY collector, replica, archive_date)""",
    "sided": """
SELECT 'google_drive' AS replica, collector, archive_date, dom, relative_key, size_bytes, row_count, modified FROM objects
UNION ALL SELECT 'r2', collector, archive_date, dom, relative_key, size_bytes, row_count, modified FROM objects_b""",
    "local_flags": """
SELECT collector, archive_date, CASE
  WHEN dom % 13 = 0 AND dom % 26 = 0 THEN 'partial' WHEN dom % 13 = 0 THEN 'missing'
  WHEN dom % 4 = 0 OR dom % 10 = 0 THEN 'unverified' WHEN dom % 6 <> 0 THEN 'verified' ELSE 'unverified' END AS local_state
FROM days""",
    "markers": """
SELECT collector, archive_date, dom,
  CASE WHEN dom % 10 = 0 THEN 'broken/v0' ELSE 'archive-windows-archive-verification/v1' END AS contract_version,
  CASE WHEN dom % 14 = 0 THEN 'failed' ELSE 'verified' END AS status,
  CASE WHEN dom % 15 = 0 THEN '2024-01-01' ELSE archive_date END AS doc_archive_date,
  CASE WHEN dom % 6 = 0 THEN sha256('stale') ELSE manifest_sha256 END AS manifest_sha256
FROM drive WHERE dom % 13 <> 0""",
    "checked_markers": """
SELECT *, CASE WHEN contract_version <> 'archive-windows-archive-verification/v1' THEN 'contract'
  WHEN status <> 'verified' THEN 'status' WHEN doc_archive_date <> archive_date THEN 'date' END AS reason FROM markers""",
    "checked_retention": """
SELECT *, CASE WHEN status <> 'dropped' THEN 'status' WHEN dropped_at = '' THEN 'dropped_at'
  WHEN no_partitions THEN 'partitions' END AS reason
FROM (SELECT collector, archive_date, CASE WHEN dom % 12 = 0 THEN 'pending' ELSE 'dropped' END AS status,
    CASE WHEN dom % 14 = 0 THEN '' ELSE archive_date || 'T00:00:00Z' END AS dropped_at, dom % 15 = 0 AS no_partitions,
    CASE WHEN dom % 4 = 0 THEN sha256('wrong') ELSE manifest_sha256 END AS verified_manifest_sha256,
    sha256('retention:' || collector || ':' || archive_date) AS file_sha256
  FROM drive WHERE dom % 19 <> 0)""",
    "plans": f"""
SELECT {_IDENTITY}, dom, n, CASE WHEN dom % 6 = 0 AND n = 2 THEN 'other/v1' ELSE 'archive-windows-cloud-cleanup-plan/v1' END AS contract_version,
  CASE WHEN dom % 9 = 0 THEN 'draft' ELSE 'ready' END AS status, manifest_sha256,
  CASE WHEN dom % 16 = 0 THEN sha256('tree') ELSE tree_sha256 END AS local_tree_sha256,
  'plan-' || archive_date || '-' || n || '.json' AS file_name,
  sha256('plan:' || collector || ':plan-' || archive_date || '-' || n || '.json') AS file_sha256
FROM drive JOIN trees USING (collector, archive_date) CROSS JOIN (VALUES (1), (2)) AS t(n) WHERE dom <= 20""",
    "checked_plans": """
SELECT *, CASE WHEN contract_version <> 'archive-windows-cloud-cleanup-plan/v1' THEN 'contract'
  WHEN status <> 'ready' THEN 'status' END AS reason FROM plans""",
    "latest_plans": """
SELECT * FROM checked_plans WHERE reason IS NULL
QUALIFY row_number() OVER (PARTITION BY collector, archive_date ORDER BY file_name DESC) = 1""",
    "checkpoints": f"""
SELECT {_IDENTITY}, CASE WHEN n = 2 AND dom % 5 = 0 THEN 'open' ELSE 'r2_absence_verified' END AS status,
  CASE WHEN dom % 4 = 0 THEN sha256('wrong') ELSE sha256('plan:' || collector || ':plan-' || archive_date || '-' ||
    CASE WHEN dom % 6 = 0 THEN '1' ELSE '2' END || '.json') END AS plan_sha256,
  'checkpoint-r2-' || archive_date || '-' || n || '.json' AS file_name,
  sha256('checkpoint:' || collector || ':checkpoint-r2-' || archive_date || '-' || n || '.json') AS file_sha256
FROM days CROSS JOIN (VALUES (1), (2)) AS t(n) WHERE dom <= 15""",
    "bound": """
SELECT p.profile_id, p.collector, p.archive_date, p.file_name AS plan_file, p.file_sha256 AS plan_sha256,
  c.file_name AS checkpoint_file, c.file_sha256 AS checkpoint_sha256
FROM latest_plans p LEFT JOIN (SELECT * FROM checkpoints WHERE status = 'r2_absence_verified'
    QUALIFY row_number() OVER (PARTITION BY collector, archive_date, plan_sha256 ORDER BY file_name DESC) = 1) c
  ON c.collector = p.collector AND c.archive_date = p.archive_date AND c.plan_sha256 = p.file_sha256""",
    "chain": """
SELECT r.collector, r.archive_date, r.file_name, r.file_sha256, r.manifest_sha256
FROM (SELECT collector, archive_date, dom, manifest_sha256, 'receipt-' || archive_date || '.json' AS file_name,
    sha256('receipt:' || collector || ':' || archive_date) AS file_sha256,
    CASE WHEN dom % 7 = 0 THEN 'open' ELSE 'completed' END AS status FROM drive WHERE dom <= 10) r
JOIN (SELECT collector, archive_date, CASE WHEN dom % 5 = 0 THEN '../' ELSE '' END || 'receipt-' || archive_date || '.json' AS receipt_file,
    CASE WHEN dom % 4 = 0 THEN sha256('wrong') ELSE sha256('receipt:' || collector || ':' || archive_date) END AS receipt_sha256
    FROM days WHERE dom <= 10) m
  ON m.collector = r.collector AND m.archive_date = r.archive_date AND m.receipt_file = r.file_name AND m.receipt_sha256 = r.file_sha256
JOIN markers l ON l.collector = r.collector AND l.archive_date = r.archive_date AND l.manifest_sha256 = r.manifest_sha256
WHERE r.status = 'completed' AND receipt_file NOT LIKE '%/%'""",
    "verified": """
SELECT o.collector, o.archive_date, o.relative_key, o.kind, o.table_name, o.size_bytes, o.sha256, o.row_count,
  s.row_count AS seen_row_count, s.schema_sha256 AS seen_schema_sha256, s.content_sha256 AS seen_content_sha256,
  CASE WHEN s.relative_key IS NULL THEN 'missing' WHEN s.size_bytes <> o.size_bytes THEN 'size'
    WHEN s.sha256 <> o.sha256 THEN 'sha256' WHEN s.row_count <> o.row_count THEN 'rows'
    WHEN s.schema_sha256 <> o.schema_sha256 THEN 'schema'
    WHEN o.kind = 'business' AND coalesce(length(o.content_sha256), 0) <> 64 THEN 'content_absent'
    WHEN o.kind = 'business' AND s.content_sha256 IS DISTINCT FROM o.content_sha256 THEN 'content' END AS reason
FROM objects o LEFT JOIN observed s USING (collector, archive_date, relative_key)""",
    "verdicts": """
SELECT m.collector, m.archive_date, m.raw_sha256 AS manifest_sha256, v.object_count, coalesce(v.row_count, 0) AS row_count,
  v.failed_objects, coalesce(v.first_reason, CASE WHEN v.object_count <> m.object_count THEN 'object_total'
    WHEN coalesce(v.row_count, 0) <> m.row_count THEN 'row_total' END) AS reason, t.tree_sha256 AS tree
FROM manifests m
JOIN (SELECT collector, archive_date, count(*) AS object_count, sum(seen_row_count)::BIGINT AS row_count,
    count(*) FILTER (reason IS NOT NULL) AS failed_objects,
    arg_min(reason, relative_key) FILTER (reason IS NOT NULL) AS first_reason
    FROM verified GROUP BY collector, archive_date) v USING (collector, archive_date)
JOIN trees t USING (collector, archive_date)
WHERE m.replica = 'google_drive'""",
    "presence": """
SELECT d.collector, d.archive_date, d.dom, a.collector IS NOT NULL AS in_drive, b.collector IS NOT NULL AS in_r2, d.dom % 13 <> 0 AS in_local
FROM days d LEFT JOIN (SELECT DISTINCT collector, archive_date FROM objects) a USING (collector, archive_date)
LEFT JOIN (SELECT DISTINCT collector, archive_date FROM objects_b) b USING (collector, archive_date)""",
    "status": """
SELECT p.collector, p.archive_date,
  CASE WHEN NOT in_drive AND c.collector IS NOT NULL THEN 'cleaned' WHEN NOT in_drive THEN 'missing'
    WHEN a.reason IS NULL THEN 'verified' ELSE 'error' END AS drive_state,
  CASE WHEN NOT in_r2 AND c.collector IS NOT NULL THEN 'cleaned' WHEN NOT in_r2 THEN 'missing'
    WHEN b.reason IS NULL THEN 'verified' ELSE 'error' END AS r2_state, l.local_state,
  CASE WHEN in_drive AND in_r2 AND a.reason IS NULL AND b.reason IS NULL THEN a.raw_sha256 = b.raw_sha256 END AS replicas_match
FROM presence p JOIN local_flags l USING (collector, archive_date)
LEFT JOIN (SELECT * FROM manifests WHERE replica = 'google_drive') a USING (collector, archive_date)
LEFT JOIN (SELECT * FROM manifests WHERE replica = 'r2') b USING (collector, archive_date)
LEFT JOIN chain c ON c.collector = p.collector AND c.archive_date = p.archive_date""",
    "progress": """
SELECT user_id AS transfer_id, event_type AS object_name, event_id AS seq, ts, tick_micros,
  CASE WHEN event_id % 97 = 0 THEN reached // 2 ELSE reached END AS bytes,
  20000000 + length(event_type) * 1000000 AS object_total, event_id % 41 = 0 AS completed, event_id % 53 = 0 AS switching
FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 250000 AS tick_micros,
    ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000) * 10 + (event_id % 50) * 1000 AS reached FROM events)""",
    "attempts": """
SELECT 'c' || (o_orderkey % 3) AS collector, strftime(o_orderdate, '%Y-%m-%d') AS archive_date, o_orderkey AS object_pos,
  'order-' || o_orderkey || '.parquet' AS relative_key, attempt,
  CASE WHEN (attempt = 1) = (o_orderkey % 7 <> 0) THEN 'google_drive' ELSE 'r2' END AS source,
  CASE WHEN attempt = 1 THEN o_orderkey % 10 <> 0 ELSE o_orderkey % 50 <> 0 END AS ok,
  coalesce(n, 0) * 1000 * attempt AS network_bytes
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
CROSS JOIN (VALUES (1), (2)) AS t(attempt)""",
    "fallback": """
SELECT collector, archive_date, object_pos, relative_key, arg_min(source, attempt) FILTER (ok) AS source,
  string_agg(source, ',' ORDER BY attempt) FILTER (attempt <= done) AS attempted,
  (count(*) FILTER (attempt <= done) - 1) AS fallbacks, (sum(network_bytes) FILTER (attempt <= done))::BIGINT AS network_bytes,
  CASE WHEN bool_or(ok) THEN 'completed' ELSE 'failed' END AS status
FROM (SELECT *, coalesce(min(CASE WHEN ok THEN attempt END) OVER (PARTITION BY object_pos), 9) AS done FROM attempts)
GROUP BY collector, archive_date, object_pos, relative_key""",
    "reports": """
SELECT 'reports/collector=' || collector || '/' || prefix || '-' || archive_date || '.json' AS path,
  epoch(archive_date::DATE)::BIGINT + dom AS seconds, prefix, collector, archive_date AS day, dom, object_count, row_count, objects
FROM bodies_drive CROSS JOIN (VALUES ('verify'), ('plan'), ('checkpoint-r2'), ('receipt'), ('note')) AS t(prefix)""",
    "broken_reports": """
SELECT 'reports/pages/page-' || page_id || '.json' AS path, 1700000000 + page_id AS seconds, 'bad_json' AS reason FROM pages
UNION ALL SELECT 'reports/chats/verify-2024-03-05-' || conv_id || '-' || turn || '.json', 1710000000 + conv_id * 100 + turn, 'not_object' FROM conversations""",
}


def sql(select: str) -> str:
    """``select`` with the views it needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"(?:FROM|JOIN)\s+\(?\s*{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(select)
    if not needed:
        return select
    return "WITH " + ",\n".join(f"{name} AS ({CTES[name]})" for name in needed) + "\n" + select
