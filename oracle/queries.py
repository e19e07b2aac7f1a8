"""One SQL statement per registered query."""

from __future__ import annotations

from oracle.base import sql, ts_text

_LINE = (
    "to_json({'l_discount': l_discount::DECIMAL(18,2)::VARCHAR, 'l_extendedprice': l_extendedprice::DECIMAL(18,2)::VARCHAR, "
    "'l_linenumber': l_linenumber, 'l_linestatus': l_linestatus, 'l_orderkey': l_orderkey, 'l_partkey': l_partkey, "
    "'l_quantity': l_quantity::DECIMAL(18,2)::VARCHAR, 'l_returnflag': l_returnflag, "
    f"'l_shipdate': {ts_text('l_shipdate')}, 'l_suppkey': l_suppkey, 'l_tax': l_tax::DECIMAL(18,2)::VARCHAR}})::VARCHAR"
)
_ORDER = (
    "to_json({'o_custkey': o_custkey, 'o_orderdate': " + ts_text("o_orderdate") + ", 'o_orderkey': o_orderkey, "
    "'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus, 'o_totalprice': o_totalprice})::VARCHAR"
)


def _chain(payload: str, order: str) -> str:
    return (
        f"sha256(unhex(string_agg(printf('%016X', strlen({payload})) || hex(encode({payload})), '' ORDER BY {order})))"
    )


def _fingerprint(rows: str, keys: str, payload: str, digits: int) -> str:
    sums = []
    for start in (1, 16, 31, 46):
        number = f"('0x' || substr(h, {start}, 15))::BIGINT"
        sums += [f"sum({number} & 1048575)::BIGINT", f"sum(({number} >> 20) & 1048575)::BIGINT", f"sum({number} >> 40)::BIGINT"]
    return f"""
SELECT {keys}, sum(n)::BIGINT AS row_count, sha256(string_agg(line, '|' ORDER BY line)) AS fingerprint
FROM (SELECT {keys}, count(*) AS n, concat_ws(':', substr(h, 61, {digits}), count(*), {', '.join(sums)}) AS line
      FROM (SELECT {keys}, sha256({payload}) AS h FROM {rows}) GROUP BY {keys}, substr(h, 61, {digits}))
GROUP BY {keys}"""


_URLS = """
(SELECT page_id, CASE page_id % 8 WHEN 0 THEN bare WHEN 1 THEN '/' || bare || '/' WHEN 2 THEN 'a/../' || bare
  WHEN 3 THEN 'a\\' || bare WHEN 4 THEN 'a//b/./' || bare WHEN 5 THEN 'date=2024-01-02/' || bare
  WHEN 6 THEN './...' || bare ELSE '///' END AS path
FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS bare FROM pages))"""
_SAFE = "(stripped <> '' AND NOT list_contains(string_split(stripped, '/'), '..') AND NOT contains(stripped, '\\'))"
_NORMAL = "array_to_string(list_filter(string_split(stripped, '/'), lambda x: x <> '' AND x <> '.'), '/')"

_BYTES = " ".join(
    f"WHEN ({{0}}) / {1024.0 ** (i + 1)!r} < 1 THEN printf('%.1f {unit}', ({{0}}) / {1024.0 ** i!r})"
    for i, unit in enumerate(["B", "KB", "MB", "GB"])
)
_HUMAN = f"CASE {_BYTES} ELSE printf('%.1f TB', ({{0}}) / {1024.0 ** 4!r}) END"


def _human(expr: str) -> str:
    return _HUMAN.replace("{0}", expr)


_TARGETS = """
(SELECT collector, 'archive/v3/collector=' || collector || '/date=' || archive_date AS target, true AS is_dir FROM days
 UNION ALL SELECT collector, 'archive/v3/collector=' || collector || '/date=' || archive_date || '/manifest.json', false
 FROM days WHERE dom % 2 = 0)"""
_ENTRIES = f"""
(SELECT t.collector, t.target, t.is_dir, l.key, l.size_bytes FROM {_TARGETS} t JOIN listing l
 ON l.collector = t.collector AND l.replica = 'r2'
 AND CASE WHEN t.is_dir THEN starts_with(l.key, t.target || '/') ELSE l.key = t.target END)"""
_PROVIDED = """
(SELECT replica AS provider, key, CASE WHEN key LIKE '%stray.parquet' AND replica = 'r2' THEN -7 ELSE size_bytes END AS size_bytes
 FROM listing)"""
_BATCH = """
(SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS batch_id, strftime(o_orderdate, '%Y-%m-%d') AS archive_date,
  o_orderkey % 3 = 0 AS existing, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey * 10 END AS bytes,
  o_orderkey % 11 = 0 AS bad, o_orderkey % 500 <> 0 AS success FROM orders)"""
_ELIGIBLE = """
(SELECT p.collector, p.archive_date, p.low AS manifest_sha256, CASE WHEN c.collector IS NOT NULL THEN 'already_cleaned'
   WHEN r.collector IS NULL THEN 'retention_missing' WHEN r.reason IS NOT NULL THEN 'retention_invalid'
   WHEN p.valid <> 2 OR p.low <> p.high THEN 'replicas_differ'
   WHEN r.verified_manifest_sha256 IS DISTINCT FROM p.low THEN 'retention_digest'
   WHEN m.collector IS NULL OR m.reason IS NOT NULL THEN 'local_marker'
   WHEN m.manifest_sha256 IS DISTINCT FROM p.low THEN 'local_differs'
   WHEN v.collector IS NULL OR v.reason IS NOT NULL THEN 'verification_failed' END AS reason
 FROM (SELECT collector, archive_date, count(*) FILTER (reason IS NULL) AS valid, min(raw_sha256) FILTER (reason IS NULL) AS low,
     max(raw_sha256) FILTER (reason IS NULL) AS high FROM manifests GROUP BY collector, archive_date) p
 LEFT JOIN chain c ON c.collector = p.collector AND c.archive_date = p.archive_date
 LEFT JOIN checked_retention r ON r.collector = p.collector AND r.archive_date = p.archive_date
 LEFT JOIN checked_markers m ON m.collector = p.collector AND m.archive_date = p.archive_date
 LEFT JOIN verdicts v ON v.collector = p.collector AND v.archive_date = p.archive_date)"""
_GATE = """
(SELECT collector, archive_date, count(*) FILTER (reason IS NULL) AS valid_replicas,
  count(*) FILTER (reason IS NOT NULL) AS warnings, count(DISTINCT raw_sha256) FILTER (reason IS NULL) AS shas
 FROM manifests GROUP BY collector, archive_date)"""
_SELECTED = """
(SELECT collector, archive_date, replica, raw_sha256, replica <> 'r2' AS fell_back FROM manifests WHERE reason IS NULL
 QUALIFY row_number() OVER (PARTITION BY collector, archive_date ORDER BY replica <> 'r2', replica) = 1)"""
_MATCH = """
(SELECT d.collector, d.archive_date, a.raw_sha256 AS left_sha256, b.raw_sha256 AS right_sha256,
   a.raw_sha256 = b.raw_sha256 AS replicas_match
 FROM (SELECT DISTINCT collector, archive_date FROM manifests) d
 LEFT JOIN (SELECT * FROM manifests WHERE replica = 'google_drive') a USING (collector, archive_date)
 LEFT JOIN (SELECT * FROM manifests WHERE replica = 'r2') b USING (collector, archive_date))"""
_HIGH = """
(SELECT *, max(CASE WHEN completed THEN object_total ELSE greatest(least(bytes, object_total), 0) END)
   OVER (PARTITION BY transfer_id, object_name ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS object_bytes FROM progress)"""
# One recursion step per update of a transfer: state is (sample time, sample bytes, speed).
_SPEED = """
SELECT transfer_id, seq, speed, remaining FROM (
  WITH RECURSIVE u AS MATERIALIZED (
    SELECT *, object_total - bytes AS remaining, row_number() OVER (PARTITION BY transfer_id ORDER BY tick_micros, seq) AS rn
    FROM progress),
  r AS (
    SELECT transfer_id, seq, rn, remaining, CASE WHEN switching THEN NULL ELSE tick_micros END AS at,
      CASE WHEN switching THEN 0 ELSE bytes END AS base, NULL::DOUBLE AS speed FROM u WHERE rn = 1
    UNION ALL
    SELECT u.transfer_id, u.seq, u.rn, u.remaining,
      CASE WHEN u.switching THEN NULL WHEN r.at IS NULL OR u.bytes < r.base OR u.tick_micros - r.at >= 400000
        THEN u.tick_micros ELSE r.at END,
      CASE WHEN u.switching THEN r.base WHEN r.at IS NULL OR u.bytes < r.base OR u.tick_micros - r.at >= 400000
        THEN u.bytes ELSE r.base END,
      CASE WHEN u.switching THEN NULL WHEN r.at IS NULL OR u.bytes <= r.base OR u.tick_micros - r.at < 400000 THEN r.speed
        WHEN r.speed IS NULL THEN (u.bytes - r.base) / ((u.tick_micros - r.at) / 1e6)
        ELSE r.speed * 0.7 + (u.bytes - r.base) / ((u.tick_micros - r.at) / 1e6) * 0.3 END
    FROM r JOIN u ON u.transfer_id = r.transfer_id AND u.rn = r.rn + 1)
  SELECT * FROM r)"""
_THROTTLE = """
SELECT transfer_id, object_name, seq, bytes FROM (
  WITH RECURSIVE u AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY transfer_id, object_name ORDER BY tick_micros, seq) AS rn FROM progress),
  r AS (
    SELECT transfer_id, object_name, seq, bytes, rn, tick_micros AS last, true AS kept FROM u WHERE rn = 1
    UNION ALL
    SELECT u.transfer_id, u.object_name, u.seq, u.bytes, u.rn,
      CASE WHEN u.bytes >= u.object_total OR u.tick_micros - r.last >= 200000 THEN u.tick_micros ELSE r.last END,
      u.bytes >= u.object_total OR u.tick_micros - r.last >= 200000
    FROM r JOIN u ON u.transfer_id = r.transfer_id AND u.object_name = r.object_name AND u.rn = r.rn + 1)
  SELECT * FROM r) WHERE kept"""
_LIVE = """
SELECT transfer_id, object_name, max(CASE WHEN completed THEN object_total ELSE greatest(least(bytes, object_total), 0) END) AS object_bytes,
  max(object_total) AS object_total FROM progress GROUP BY transfer_id, object_name"""
# Label texts as the archive shows them.
_STATES = {
    "loading": "... 读取中", "verified": "✓ 已验证", "cleaned": "✓ 已清理", "missing": "○ 缺失",
    "error": "! 异常", "partial": "○ 下载未完成", "unverified": "? 未验证",
}


def _case(column: str, table: dict[str, str], otherwise: str) -> str:
    arms = " ".join(f"WHEN '{key}' THEN '{value}'" for key, value in table.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


_REPORT_TEXT = """
(SELECT path, seconds, prefix, day, dom, row_count,
   CASE WHEN prefix = 'verify' THEN objects END AS objects,
   CASE WHEN prefix = 'verify' AND dom % 3 <> 0 THEN object_count ELSE CASE WHEN prefix = 'verify' THEN len(objects) ELSE 0 END END AS object_count,
   CASE WHEN prefix = 'verify' AND dom % 3 <> 0 THEN object_count::VARCHAR ELSE 'n/a' END AS count_text
 FROM reports)"""

_VERDICT = (
    "to_json({'archive_date': archive_date, 'collector': collector, 'failed_objects': failed_objects, "
    "'manifest_sha256': v.manifest_sha256, 'object_count': v.object_count, 'reason': v.reason, 'row_count': v.row_count, "
    "'status': CASE WHEN v.reason IS NULL THEN 'verified' ELSE 'failed' END, 'tree_sha256': CASE WHEN v.reason IS NULL THEN v.tree END})::VARCHAR"
)
_SCHEMAS = {
    "orders": "o_orderkey:bigint:true,o_custkey:bigint:true,o_orderstatus:string:true,o_totalprice:double:true,"
    "o_orderdate:timestamp_ntz:true,o_orderpriority:string:true",
    "lineitem": "l_orderkey:bigint:true,l_partkey:bigint:true,l_suppkey:bigint:true,l_linenumber:int:true,"
    "l_quantity:double:true,l_extendedprice:double:true,l_discount:double:true,l_tax:double:true,"
    "l_returnflag:string:true,l_linestatus:string:true,l_shipdate:timestamp_ntz:true",
    "events": "event_id:bigint:true,ts:timestamp_ntz:true,user_id:bigint:true,event_type:string:true,value:double:true,props:string:true",
    "documents": "doc_id:bigint:true,text:string:true,lang:string:true,source:string:true,n_chars:bigint:true",
}

STATEMENTS: dict[str, str] = {
    "canonical_payload": "SELECT event_id, payload FROM rows_drive",
    "row_sha256": "SELECT doc_id, sha256(text) AS text_sha256 FROM documents",
    "content_digest": f"""
SELECT collector, archive_date, table_name, count(*) AS row_count, {_chain('payload', 'event_id')} AS content_sha256
FROM rows_drive GROUP BY ALL""",
    "content_digest_exact": f"""
SELECT o_orderkey // 1000 AS block, count(*) AS row_count, {_chain('payload', 'o_orderkey')} AS content_sha256
FROM (SELECT o_orderkey, {_ORDER} AS payload FROM orders) GROUP BY ALL""",
    "content_fingerprint": _fingerprint("lineitem", "l_returnflag, l_linestatus", _LINE, 2),
    "content_fingerprint_documents": _fingerprint("documents", "lang", "text", 1),
    "tree_digest": "SELECT collector, archive_date, tree_sha256 FROM trees",
    "schema_drift": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, sha256('{schema}') AS schema_sha256, count(*) AS row_count FROM {name}"
        for name, schema in _SCHEMAS.items()
    ),
    "check_manifest_doc": "SELECT collector, archive_date, replica, array_to_string(reasons, ',') AS reasons FROM faulty_rules",
    "check_manifest_entries": "SELECT collector, archive_date, pos, relative_key, size_bytes, reason FROM faulty_entries",
    "validate_manifests": """
SELECT f.collector, f.archive_date, sha256(f.raw) AS raw_sha256, strlen(f.raw)::BIGINT AS raw_size, coalesce(r.reasons[1], e.reason,
  CASE WHEN f.row_count <> list_sum(list_transform(f.objects, lambda x: x.row_count)) THEN 'row_total' END) AS reason
FROM faulty f JOIN faulty_rules r USING (collector, archive_date)
LEFT JOIN (SELECT collector, archive_date, arg_min(reason, pos) FILTER (reason IS NOT NULL) AS reason
  FROM faulty_entries GROUP BY collector, archive_date) e USING (collector, archive_date)""",
    "manifest_totals": """
SELECT collector, archive_date, replica, len(objects) AS entries,
  list_sum(list_transform(objects, lambda x: x.row_count))::BIGINT AS entry_rows,
  list_sum(list_transform(objects, lambda x: x.size_bytes))::BIGINT AS entry_bytes,
  object_count AS declared_objects, row_count AS declared_rows FROM manifests""",
    "safe_relative_key": f"""
SELECT page_id, CASE WHEN {_SAFE} THEN stripped END AS any_day,
  CASE WHEN {_SAFE} AND starts_with(stripped, 'date=2024-01-02/') THEN stripped END AS one_day,
  CASE WHEN NOT {_SAFE} THEN 'unsafe_key' WHEN NOT starts_with(stripped, 'date=2024-01-02/') THEN 'wrong_day' END AS reason
FROM (SELECT page_id, trim(path, '/') AS stripped FROM {_URLS})""",
    "safe_path": f"""
SELECT page_id, CASE WHEN stripped = '' THEN '' WHEN {_SAFE} THEN {_NORMAL} END AS path,
  CASE WHEN stripped = '' THEN 'root' WHEN NOT {_SAFE} THEN 'unsafe_path' END AS removal_reason,
  CASE WHEN stripped = '' THEN 'child.txt' WHEN {_SAFE} THEN {_NORMAL} || '/child.txt' END AS child,
  CASE WHEN {_SAFE} AND NOT contains({_NORMAL}, '/') THEN 'top/' || {_NORMAL} END AS below_top
FROM (SELECT page_id, trim(path, '/') AS stripped FROM {_URLS})""",
    "utc_yesterday": "SELECT event_id, strftime(ts::DATE - 1, '%Y-%m-%d') AS day FROM events",
    "strict_dates": """
SELECT o_orderkey, CASE WHEN regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(t AS DATE) IS NOT NULL AND t >= '0001-01-01'
  THEN t END AS archive_date
FROM (SELECT o_orderkey, trim(CASE o_orderkey % 9 WHEN 0 THEN d WHEN 1 THEN ' ' || d || ' ' WHEN 2 THEN d[:8] || '31'
  WHEN 3 THEN replace(d, '-', '') WHEN 4 THEN d[:4] || '-1-5' WHEN 5 THEN '0000' || d[5:10] WHEN 6 THEN ''
  WHEN 7 THEN d[:5] || '02-29' ELSE d || 'T00:00:00' END) AS t
  FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders))""",
    "check_marker": "SELECT collector, archive_date, manifest_sha256, reason FROM checked_markers",
    "check_retention": "SELECT collector, archive_date, dropped_at, verified_manifest_sha256, reason FROM checked_retention",
    "check_plan_identity": "SELECT profile_id, collector, archive_date, file_name, reason FROM checked_plans",
    "check_listing_entries": f"""
SELECT page_id, name, CASE WHEN bare = '' OR contains(bare, '/') OR contains(bare, '\\') THEN 'name'
  WHEN page_id % 5 <> 0 AND page_id - 10 < 0 THEN 'size' END AS reason
FROM (SELECT *, trim(name, '/') AS bare FROM (SELECT page_id,
  CASE WHEN page_id % 3 = 0 THEN string_split(path, '/')[-1] ELSE path END AS name FROM {_URLS}))""",
    "in_prefix": """
SELECT replica, key, 'directory' AS mode FROM listing WHERE starts_with(key, 'archive/v3/collector=c0/date=2024-01-01/')
UNION ALL SELECT replica, key, 'file' FROM listing WHERE key = 'archive/v3/collector=c0/date=2024-01-01/manifest.json'""",
    "nonfinite_check": "SELECT vec_id, vec_id % 50 IN (0, 1) AS non_finite FROM embeddings",
    "check_usage": f"""
SELECT provider, count(*) FILTER (size_bytes < 0) AS negative_sizes,
  CASE WHEN min(size_bytes) < 0 THEN 'negative_size' END AS reason FROM {_PROVIDED} GROUP BY provider""",
    "day_status": "SELECT * FROM status",
    "replica_match": f"SELECT * FROM {_MATCH}",
    "object_meta_match": """
SELECT o.collector, o.archive_date, o.relative_key, b.size_bytes AS meta_size, CASE WHEN b.relative_key IS NULL THEN 'meta_missing'
  WHEN b.size_bytes <> o.size_bytes OR b.sha256 <> o.sha256 THEN 'meta_mismatch' END AS reason
FROM objects o LEFT JOIN objects_b b USING (collector, relative_key)""",
    "verify_objects": "SELECT collector, archive_date, relative_key, seen_row_count, reason FROM verified",
    "removal_eligibility": f"SELECT * FROM {_ELIGIBLE}",
    "listing_drift": """
SELECT coalesce(a.collector, b.collector) AS collector, coalesce(a.key, b.key) AS key, a.size_bytes AS expected_size,
  b.size_bytes AS observed_size, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'resized' END AS drift
FROM (SELECT * FROM listing WHERE replica = 'google_drive') a FULL JOIN (SELECT * FROM listing WHERE replica = 'r2') b
  ON a.collector = b.collector AND a.key = b.key
WHERE a.size_bytes IS DISTINCT FROM b.size_bytes""",
    "select_source": f"SELECT * FROM {_SELECTED}",
    "catch_up_days": f"""
SELECT s.collector, s.archive_date, CASE WHEN m.collector IS NULL THEN 'fetch'
  WHEN m.status = 'verified' AND m.manifest_sha256 = s.raw_sha256 THEN 'already_verified' ELSE 'conflict' END AS action
FROM {_SELECTED} s LEFT JOIN (SELECT * FROM markers WHERE dom % 5 <> 0) m USING (collector, archive_date)""",
    "days_to_fetch": f"""
SELECT collector, archive_date, replica FROM {_SELECTED} s
WHERE NOT EXISTS (SELECT 1 FROM markers m WHERE m.dom % 5 <> 0 AND m.collector = s.collector AND m.archive_date = s.archive_date)""",
    "receipt_chain": "SELECT collector, archive_date, file_name, manifest_sha256 FROM chain",
    "checkpoint_for_plan": "SELECT * FROM bound",
    "compatible_sources": """
SELECT collector, archive_date, first(replica ORDER BY replica) AS selected,
  string_agg(replica, ',' ORDER BY replica) FILTER (raw_sha256 = chosen) AS sources,
  count(*) > 1 AND count(*) FILTER (raw_sha256 = chosen) = 1 AS other_differs
FROM (SELECT *, first_value(raw_sha256) OVER (PARTITION BY collector, archive_date ORDER BY replica) AS chosen
  FROM manifests WHERE reason IS NULL) GROUP BY collector, archive_date""",
    "residual_after_removal": f"""
SELECT t.collector, t.target, count(e.key) AS remaining FROM {_TARGETS} t
LEFT JOIN (SELECT * FROM {_ENTRIES} WHERE NOT contains(key, '/business/') AND NOT contains(key, '-03/')) e
  ON e.collector = t.collector AND e.target = t.target GROUP BY t.collector, t.target""",
    "two_replica_gate": f"""
SELECT collector, archive_date, valid_replicas, warnings, CASE WHEN valid_replicas <> 2 THEN 'replica_missing'
  WHEN shas > 1 THEN 'replicas_differ' END AS reason FROM {_GATE}""",
    "two_replica_gate_relaxed": f"""
SELECT collector, archive_date, valid_replicas, warnings, CASE WHEN valid_replicas = 0 THEN 'no_replica' END AS reason FROM {_GATE}""",
    "verify_days": """
SELECT collector, archive_date, manifest_sha256, object_count, row_count, failed_objects, reason,
  CASE WHEN reason IS NULL THEN 'verified' ELSE 'failed' END AS status, CASE WHEN reason IS NULL THEN tree END AS tree_sha256
FROM verdicts""",
    "dashboard_scan": """
SELECT s.collector, s.archive_date, drive_state, r2_state, local_state, replicas_match,
  CASE WHEN replicas_match = false OR 'error' IN (drive_state, r2_state, local_state) THEN 'error'
    WHEN (replicas_match OR (drive_state = 'cleaned' AND r2_state = 'cleaned')) AND local_state = 'verified' THEN 'ok' ELSE 'warn' END AS severity
FROM status s QUALIFY row_number() OVER (PARTITION BY collector ORDER BY archive_date DESC) <= 45""",
    "fetch_plan": f"""
SELECT g.collector, g.archive_date, CASE WHEN g.valid_replicas = 0 THEN 'no_replica' END AS gate_reason, g.warnings, s.replica,
  CASE WHEN s.collector IS NULL THEN NULL WHEN m.collector IS NULL THEN 'fetch'
    WHEN m.status = 'verified' AND m.manifest_sha256 = s.raw_sha256 THEN 'already_verified' ELSE 'conflict' END AS action,
  b.bytes AS additional_bytes, f.free_bytes >= b.bytes + 268435456 AS fits
FROM {_GATE} g LEFT JOIN (SELECT * FROM manifests WHERE reason IS NULL
    QUALIFY row_number() OVER (PARTITION BY collector, archive_date ORDER BY replica) = 1) s
  ON s.collector = g.collector AND s.archive_date = g.archive_date
LEFT JOIN (SELECT collector, archive_date, replica, list_sum(list_transform(objects, lambda x: x.size_bytes))::BIGINT AS bytes FROM manifests) b
  ON b.collector = s.collector AND b.archive_date = s.archive_date AND b.replica = s.replica
LEFT JOIN (SELECT * FROM markers WHERE dom % 5 <> 0) m ON m.collector = g.collector AND m.archive_date = g.archive_date
LEFT JOIN (SELECT collector, count(*) * 20000000 AS free_bytes FROM days GROUP BY collector) f ON f.collector = g.collector""",
    "audit_days": f"""
SELECT v.collector, v.archive_date, v.manifest_sha256, v.object_count, v.row_count, v.failed_objects, v.reason,
  CASE WHEN v.reason IS NULL THEN 'verified' ELSE 'failed' END AS status, CASE WHEN v.reason IS NULL THEN v.tree END AS tree_sha256,
  m.replicas_match FROM verdicts v JOIN {_MATCH} m USING (collector, archive_date)""",
    "storage_usage": f"""
SELECT provider, count(*) AS bucket_objects, sum(size_bytes)::BIGINT AS bucket_bytes,
  count(*) FILTER (starts_with(key, 'archive/v3/collector=c0/')) AS archive_objects,
  coalesce(sum(size_bytes) FILTER (starts_with(key, 'archive/v3/collector=c0/')), 0)::BIGINT AS archive_bytes,
  count(*) FILTER (size_bytes < 0) AS negative_sizes FROM {_PROVIDED} GROUP BY provider""",
    "account_usage": """
SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN round(c_acctbal * 100)::BIGINT ELSE 0 END AS total_bytes, 1::BIGINT AS used_bytes,
  0::BIGINT AS free_bytes, c_nationkey::BIGINT AS trashed_bytes,
  CASE WHEN c_custkey % 4 <> 0 AND round(c_acctbal * 100) < 0 THEN 'negative' END AS reason FROM customer""",
    "removal_plan": f"""
SELECT t.collector, t.target, t.is_dir, count(e.key) AS object_count, coalesce(sum(e.size_bytes), 0)::BIGINT AS total_bytes,
  's3://archive-bucket/' || t.target || CASE WHEN t.is_dir THEN '/' ELSE '' END AS uri,
  CASE WHEN count(e.key) = 0 THEN 'empty' END AS reason
FROM {_TARGETS} t LEFT JOIN {_ENTRIES} e ON e.collector = t.collector AND e.target = t.target GROUP BY t.collector, t.target, t.is_dir""",
    "removal_entries": f"SELECT * FROM {_ENTRIES}",
    "removal_documents": f"""
SELECT collector, target, string_agg(key || '=' || size_bytes, ',' ORDER BY key) AS expected FROM {_ENTRIES} GROUP BY collector, target""",
    "dashboard_metrics": """
SELECT s.collector, s.days, s.drive_days, s.r2_days, s.local_days, s.matched_days,
  round(CASE WHEN s.collector = 'c1' THEN 0.0 ELSE least(u.drive_used / 1000000.0 * 100.0, 100.0) END, 6) AS drive_percent,
  round(least(u.r2_used / 500000.0 * 100.0, 100.0), 6) AS r2_percent,
  round(CASE WHEN s.collector = 'c2' THEN 0.0 ELSE least(floor(u.drive_used / 2) / 800000.0 * 100.0, 100.0) END, 6) AS local_percent
FROM (SELECT collector, count(*) AS days, count(*) FILTER (drive_state = 'verified') AS drive_days,
    count(*) FILTER (r2_state = 'verified') AS r2_days, count(*) FILTER (local_state = 'verified') AS local_days,
    count(*) FILTER (replicas_match) AS matched_days FROM status GROUP BY collector) s
JOIN (SELECT collector, (sum(size_bytes) FILTER (replica = 'google_drive'))::DOUBLE AS drive_used,
    coalesce(sum(size_bytes) FILTER (replica = 'r2'), 0)::DOUBLE AS r2_used FROM listing GROUP BY collector) u USING (collector)""",
    "batch_summary": f"""
SELECT batch_id, count(*) AS requested, count(*) FILTER (NOT bad AND NOT existing) AS newly_verified,
  count(*) FILTER (NOT bad AND existing) AS already_verified, count(*) FILTER (bad) AS failed,
  coalesce(sum(bytes) FILTER (NOT bad), 0)::BIGINT AS bytes FROM {_BATCH} GROUP BY batch_id""",
    "run_outcome": f"SELECT batch_id, count(*) AS results, bool_and(success) AS success FROM {_BATCH} GROUP BY batch_id",
    "duplicate_keys": "SELECT l_partkey, l_suppkey, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "expected_entries": """
SELECT m.collector, m.archive_date, m.replica,
  CASE WHEN m.replica = 'google_drive' THEN 2 * (len(m.objects) + 1) ELSE len(m.objects) + 1 END AS expected_entries,
  coalesce(l.entries, 0) AS listed_entries, expected_entries = listed_entries AS complete
FROM manifests m LEFT JOIN (SELECT collector, replica, regexp_extract(key, '(?:^|/)date=(\\d{4}-\\d{2}-\\d{2})/', 1) AS archive_date,
    count(*) AS entries FROM listing GROUP BY ALL) l USING (collector, replica, archive_date)""",
    "object_source_fallback": "SELECT * FROM fallback",
    "fallback_warnings": """
SELECT collector, archive_date, object_pos, relative_key, attempt, source, fallback
FROM (SELECT *, lead(source) OVER (PARTITION BY object_pos ORDER BY attempt) AS fallback FROM attempts)
WHERE attempt = 1 AND NOT ok""",
    "transfer_rollup": """
SELECT s.*, a.sources_attempted, c.sources_completed,
  CASE WHEN c.n = 1 THEN c.sources_completed ELSE 'mixed' END AS active_source
FROM (SELECT collector, archive_date, count(*) AS objects, count(*) FILTER (status = 'failed') AS failed_objects,
    sum(network_bytes)::BIGINT AS network_bytes, sum(fallbacks)::BIGINT AS warnings FROM fallback GROUP BY ALL) s
LEFT JOIN (SELECT collector, archive_date, string_agg(source, ',' ORDER BY pos, i) AS sources_attempted
  FROM (SELECT collector, archive_date, source, arg_min(object_pos, object_pos * 10 + i) AS pos, arg_min(i, object_pos * 10 + i) AS i
    FROM (SELECT collector, archive_date, object_pos, unnest(string_split(attempted, ',')) AS source,
      generate_subscripts(string_split(attempted, ','), 1) AS i FROM fallback) GROUP BY ALL) GROUP BY ALL) a USING (collector, archive_date)
LEFT JOIN (SELECT collector, archive_date, string_agg(source, ',' ORDER BY pos) AS sources_completed, count(*) AS n
  FROM (SELECT collector, archive_date, source, min(object_pos) AS pos FROM fallback WHERE status = 'completed' GROUP BY ALL)
  GROUP BY ALL) c USING (collector, archive_date)""",
    "space_preflight": """
SELECT n.collector, n.archive_date, n.additional_bytes, CASE WHEN n.additional_bytes > 0 THEN 268435456 ELSE 0 END AS reserve_bytes,
  f.free_bytes, f.free_bytes >= n.additional_bytes + reserve_bytes AS fits
FROM (SELECT o.collector, o.archive_date, sum(greatest(o.size_bytes - coalesce(s.size_bytes - s.row_count, 0), 0))::BIGINT AS additional_bytes
  FROM objects o LEFT JOIN observed s USING (collector, archive_date, relative_key) GROUP BY ALL) n
JOIN (SELECT collector, count(*) * 20000000 AS free_bytes FROM days GROUP BY collector) f USING (collector)""",
    "verification_report": f"""
SELECT v.collector, v.archive_date, 'archive-windows-archive-verification/v1' AS contract_version, 'verified' AS status, v.manifest_sha256,
  v.object_count, v.row_count, v.tree AS tree_sha256, false AS retention_delete_allowed, m.left_sha256 AS drive_manifest_sha256,
  m.right_sha256 AS r2_manifest_sha256, coalesce(m.replicas_match, false) AS replicas_match, o.objects
FROM verdicts v JOIN {_MATCH} m USING (collector, archive_date)
JOIN (SELECT collector, archive_date, string_agg(concat_ws(':', relative_key, seen_row_count,
    CASE WHEN kind = 'business' THEN seen_content_sha256 END), ',' ORDER BY relative_key) AS objects
  FROM verified GROUP BY ALL) o USING (collector, archive_date) WHERE v.reason IS NULL""",
    "latest_valid_evidence": "SELECT profile_id, collector, archive_date, file_name, file_sha256 FROM latest_plans",
    "transfer_high_water": f"""
SELECT transfer_id, object_name, seq, object_bytes, least(running, bytes_total)::BIGINT AS bytes_completed, bytes_total,
  floor(least(running, bytes_total) / bytes_total * 7000)::BIGINT AS overall
FROM (SELECT *, sum(object_bytes - coalesce(before, 0)) OVER (PARTITION BY transfer_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS running
  FROM (SELECT *, lag(object_bytes) OVER (PARTITION BY transfer_id, object_name ORDER BY ts, seq) AS before FROM {_HIGH}))
CROSS JOIN (SELECT sum(20000000 + length(kind) * 1000000)::BIGINT AS bytes_total FROM (VALUES ('purchase'), ('signup'), ('click'), ('view'), ('error')) AS k(kind))""",
    "transfer_speed": f"""
SELECT transfer_id, seq, round(speed, 3) AS speed, round(greatest(remaining, 0) / speed, 3) AS eta_seconds FROM ({_SPEED})""",
    "removal_batches": """
SELECT collector, relative_key AS key, (row_number() OVER (PARTITION BY collector ORDER BY relative_key) - 1) // 1000 AS batch
FROM attempts WHERE attempt = 1""",
    "first_seen_flag": """
SELECT l_suppkey, l_partkey, l_orderkey * 100 + l_linenumber AS pos,
  l_orderkey * 100 + l_linenumber > min(l_orderkey * 100 + l_linenumber) OVER (PARTITION BY l_suppkey, l_partkey) AS repeated
FROM lineitem""",
    "latest_run": """
SELECT o_orderpriority AS host, 'sync-' || printf('%012d', o_orderkey) || '.json' AS file_name, o_orderkey % 4 <> 0 AS success,
  1::BIGINT AS profiles, CASE WHEN o_orderkey % 4 = 0 THEN 'p-' || o_custkey ELSE '' END AS failed_profiles
FROM orders WHERE epoch(o_orderdate) // 86400 >= 9999
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
    "recent_days": f"""
SELECT collector, archive_date FROM (SELECT DISTINCT batch_id[:4] AS collector, archive_date FROM {_BATCH})
QUALIFY row_number() OVER (PARTITION BY collector ORDER BY archive_date DESC) <= 45""",
    "browse": """
SELECT string_split(rest, '/')[1] AS name, contains(rest, '/') AS is_dir, max(CASE WHEN contains(rest, '/') THEN 0 ELSE size_bytes END) AS size_bytes
FROM (SELECT replace(key, 'archive/v3/collector=c0/date=2024-01-01/', '') AS rest, size_bytes FROM listing
  WHERE starts_with(key, 'archive/v3/collector=c0/date=2024-01-01/')) GROUP BY 1, 2""",
    "browse_collectors": """
SELECT replica, collector, string_split(rest, '/')[1] AS name, contains(rest, '/') AS is_dir,
  max(CASE WHEN contains(rest, '/') THEN 0 ELSE size_bytes END) AS size_bytes
FROM (SELECT replica, collector, replace(key, 'archive/v3/collector=' || collector || '/', '') AS rest, size_bytes FROM listing) GROUP BY 1, 2, 3, 4""",
    "report_index": f"""
SELECT path, string_split(path, '/')[-1] AS name, NULL::VARCHAR AS reason,
  {_case('prefix', {'verify': '完整校验', 'plan': '清理计划', 'checkpoint-r2': 'R2 检查点', 'receipt': '清理回执'}, "'JSON 报告'")} AS kind,
  day AS archive_date,
  {_case('prefix', {'verify': '✓ 已验证', 'plan': '○ 待处理', 'checkpoint-r2': '✓ 已确认', 'receipt': '✓ 已完成'}, "'draft'")} AS state,
  CASE WHEN prefix = 'plan' THEN 'warn' ELSE 'ok' END AS severity, object_count, row_count,
  CASE WHEN prefix IN ('verify', 'plan') THEN day || ' 01:02:03 UTC' ELSE strftime(to_timestamp(seconds) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' UTC' END AS reported_at
FROM {_REPORT_TEXT}
UNION ALL SELECT path, string_split(path, '/')[-1], reason, CASE WHEN reason = 'bad_json' THEN 'JSON 报告' ELSE '完整校验' END,
  CASE WHEN reason = 'bad_json' THEN '--' ELSE '2024-03-05' END, '! 异常', 'error', 0, 0,
  strftime(to_timestamp(seconds) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || ' UTC' FROM broken_reports""",
    "report_index_counts": """
SELECT a.n + b.n AS reports, a.n AS readable, b.n AS broken FROM (SELECT count(*) AS n FROM reports) a, (SELECT count(*) AS n FROM broken_reports) b""",
    "report_objects": f"""
SELECT path, pos, {_case('item.kind', {'business': '业务', 'control': '控制', 'evidence': '证据', 'raw': '原始'}, 'item.kind')} AS kind,
  item.table_name AS table_name, item.relative_key AS relative_key, item.row_count AS row_count, item.size_bytes AS size_bytes,
  item.sha256[:16] || '…' AS digest
FROM (SELECT path, unnest(objects) AS item, generate_subscripts(objects, 1) - 1 AS pos FROM reports WHERE prefix = 'verify')""",
    "report_object_totals": """
SELECT path, len(objects) AS objects, list_sum(list_transform(objects, lambda x: x.size_bytes))::BIGINT AS total_bytes FROM reports WHERE prefix = 'verify'""",
    "report_fields": f"""
SELECT path, field, row_number() OVER (PARTITION BY path ORDER BY field) AS rank, CASE WHEN value IS NULL THEN 'None' WHEN length(value) <= 180 THEN value ELSE value[:177] || '...' END AS value
FROM (SELECT path, pair.f AS field, pair.v AS value FROM (SELECT path, unnest([
    {{'f': 'archive_date', 'v': CASE WHEN prefix <> 'note' THEN day END}},
    {{'f': 'objects', 'v': to_json(objects)::VARCHAR}}, {{'f': 'object_count', 'v': count_text}}, {{'f': 'row_count', 'v': row_count::VARCHAR}},
    {{'f': 'status', 'v': CASE prefix WHEN 'verify' THEN 'verified' WHEN 'note' THEN ' Draft ' END}},
    {{'f': 'verified_at', 'v': CASE WHEN prefix = 'verify' THEN day || 'T01:02:03.000004Z' ELSE '' END}},
    {{'f': 'generated_at', 'v': CASE WHEN prefix = 'plan' THEN day || 'T01:02:03.000004Z' END}}]) AS pair
  FROM {_REPORT_TEXT}))""",
    "all_days": "SELECT collector, archive_date, in_drive, in_r2, in_local FROM presence",
    "list_days": """
SELECT DISTINCT replica, collector, regexp_extract(key, '(?:^|/)date=(\\d{4}-\\d{2}-\\d{2})/', 1) AS archive_date FROM listing
WHERE regexp_matches(key, '(?:^|/)date=(\\d{4}-\\d{2}-\\d{2})/')""",
    "replica_object_diff": """
SELECT coalesce(a.collector, b.collector) AS collector, coalesce(a.archive_date, b.archive_date) AS archive_date,
  coalesce(a.relative_key, b.relative_key) AS relative_key, a.size_bytes AS left_size_bytes, a.sha256 AS left_sha256, a.row_count AS left_row_count,
  b.size_bytes AS right_size_bytes, b.sha256 AS right_sha256, b.row_count AS right_row_count,
  CASE WHEN b.relative_key IS NULL THEN 'only_left' WHEN a.relative_key IS NULL THEN 'only_right' ELSE 'changed' END AS difference
FROM objects a FULL JOIN objects_b b ON a.collector = b.collector AND a.archive_date = b.archive_date AND a.relative_key = b.relative_key
WHERE a.size_bytes IS DISTINCT FROM b.size_bytes OR a.sha256 IS DISTINCT FROM b.sha256 OR a.row_count IS DISTINCT FROM b.row_count""",
    "strip_date": """
SELECT collector, archive_date, relative_key, CASE WHEN dom % 4 <> 0 THEN kind || '/' || table_name || '.parquet' END AS inside FROM objects""",
    "human_sizes": f"""
SELECT o_orderkey, {_human('(o_orderkey % 15000) * (o_orderkey % 15000) * (o_orderkey % 15000) * 7919')} AS shown, {_human('o_orderkey * 32')} AS small,
  CASE WHEN t < 60 THEN t || ' 秒' WHEN t < 3600 THEN (t // 60) || ' 分 ' || (t % 60) || ' 秒'
    ELSE (t // 3600) || ' 小时 ' || (t % 3600 // 60) || ' 分' END AS duration
FROM (SELECT o_orderkey, greatest(trunc(o_orderkey * 7.25 - 100), 0)::BIGINT AS t FROM orders)""",
    "compact_text": "SELECT doc_id, CASE WHEN length(text) <= 180 THEN text ELSE text[:177] || '...' END AS shown FROM documents",
    "safe_int": """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id WHEN 2 THEN event_id ELSE -1 END AS value FROM events""",
    "local_state": "SELECT * FROM local_flags",
    "day_labels": f"""
SELECT collector, archive_date,
  CASE WHEN replicas_match = false OR 'error' IN (drive_state, r2_state, local_state) THEN 'error'
    WHEN (replicas_match OR (drive_state = 'cleaned' AND r2_state = 'cleaned')) AND local_state = 'verified' THEN 'ok' ELSE 'warn' END AS severity,
  CASE WHEN replicas_match THEN '✓ 一致' WHEN NOT replicas_match THEN '! 不一致'
    WHEN drive_state = 'cleaned' AND r2_state = 'cleaned' THEN '✓ 已核准清理' ELSE '--' END AS match_text,
  {_case('drive_state', _STATES, 'drive_state')} AS drive_text, {_case('local_state', _STATES, 'local_state')} AS local_text
FROM status""",
    "source_labels": """
SELECT collector, archive_date, CASE WHEN count(DISTINCT source) <> 1 THEN 'Google Drive / R2' WHEN min(source) = 'r2' THEN 'Cloudflare R2'
  ELSE 'Google Drive' END AS source_text FROM fallback GROUP BY ALL""",
    "target_paths": """
SELECT collector, archive_date, 'archive/v3/collector=' || collector || '/date=' || archive_date AS day_path,
  's3://archive-bucket/' || day_path || CASE WHEN dom % 2 = 0 THEN '/' ELSE '' END AS uri,
  strftime(archive_date::DATE - INTERVAL 1 DAY, '%Y-%m-%d') AS day_before FROM days""",
    "cleanup_plan": f"""
SELECT e.collector, e.archive_date, 'archive-windows-cloud-cleanup-plan/v1' AS contract_version, 'ready' AS status, 'p-' || e.collector AS profile_id,
  e.manifest_sha256, m.object_count, list_sum(list_transform(m.objects, lambda x: x.row_count))::BIGINT AS row_count,
  list_sum(list_transform(m.objects, lambda x: x.size_bytes))::BIGINT AS parquet_bytes, v.tree AS local_tree_sha256,
  r.file_sha256 AS retention_sha256, r.dropped_at, 'drive:archive/v3/collector=' || e.collector || '/date=' || e.archive_date AS drive_target,
  's3://archive-bucket/archive/v3/collector=' || e.collector || '/date=' || e.archive_date || '/' AS r2_target,
  2 * (m.object_count + 1) AS drive_entries, m.object_count + 1 AS r2_entries
FROM {_ELIGIBLE} e JOIN manifests m ON m.collector = e.collector AND m.archive_date = e.archive_date AND m.replica = 'google_drive'
JOIN verdicts v ON v.collector = e.collector AND v.archive_date = e.archive_date
JOIN checked_retention r ON r.collector = e.collector AND r.archive_date = e.archive_date WHERE e.reason IS NULL""",
    "cleanup_stage": """
SELECT p.collector, p.archive_date, p.file_name, b.checkpoint_file, CASE WHEN c.collector IS NOT NULL THEN 'already_cleaned'
  WHEN d.manifest_sha256 <> p.manifest_sha256 THEN 'local_manifest_differs' WHEN t.tree_sha256 <> p.local_tree_sha256 THEN 'local_tree_differs'
  WHEN b.checkpoint_file IS NULL AND s.in_r2 AND s.dom % 3 <> 0 THEN 'stage1_blocked'
  WHEN b.checkpoint_file IS NULL AND s.dom % 6 = 0 THEN 'order_violation' WHEN b.checkpoint_file IS NULL THEN 'r2_absence_verified'
  WHEN s.in_r2 AND s.dom % 3 <> 0 THEN 'r2_reappeared' WHEN s.dom % 6 <> 0 THEN 'stage2_blocked' ELSE 'completed' END AS stage
FROM latest_plans p JOIN bound b USING (collector, archive_date) JOIN drive d USING (collector, archive_date)
JOIN trees t USING (collector, archive_date) JOIN presence s USING (collector, archive_date)
LEFT JOIN chain c ON c.collector = p.collector AND c.archive_date = p.archive_date""",
    "removal_receipt": f"""
SELECT collector, target, CASE WHEN reason IS NULL THEN 'completed' ELSE 'blocked' END AS status, reason,
  CASE WHEN reason IS NULL THEN n END AS deleted_objects, CASE WHEN reason IS NULL THEN b END AS deleted_bytes
FROM (SELECT t.collector, t.target, count(e.key) AS n, sum(e.size_bytes)::BIGINT AS b, CASE WHEN count(e.key) = 0 THEN 'empty'
    WHEN bool_or(contains(e.key, '-05/raw')) THEN 'drift' WHEN bool_or(contains(e.key, '-06/raw')) THEN 'remaining' END AS reason
  FROM {_TARGETS} t LEFT JOIN {_ENTRIES} e ON e.collector = t.collector AND e.target = t.target WHERE t.is_dir GROUP BY t.collector, t.target)""",
    "read_manifests": """
SELECT collector, archive_date, replica, raw_sha256, raw_size, contract_version, status, true AS retention_delete_allowed, object_count,
  len(objects) AS entries FROM manifests""",
    "read_one_day": """
SELECT collector, archive_date, replica, raw_sha256, len(objects) AS entries FROM manifests WHERE collector = 'c0' AND archive_date = '2024-01-03'""",
    "list_day_folders": "SELECT DISTINCT collector, archive_date FROM ev",
    "scan_days": f"""
SELECT collector, archive_date, count(*) AS row_count, {_chain('payload', 'event_id')} AS content_sha256 FROM rows_drive GROUP BY ALL""",
    "list_files": "SELECT collector, archive_date, 1::BIGINT AS files, true AS sized FROM days",
    "read_object_meta": """
SELECT collector, relative_key, size_bytes, sha256, CASE WHEN kind = 'control' THEN 'meta_path' END AS reason FROM objects""",
    "read_reports": f"""
SELECT string_split(path, '/')[-1] AS name, NULL::VARCHAR AS reason,
  {_case('prefix', {'verify': '完整校验', 'plan': '清理计划', 'checkpoint-r2': 'R2 检查点', 'receipt': '清理回执'}, "'JSON 报告'")} AS kind,
  day AS archive_date,
  {_case('prefix', {'verify': '✓ 已验证', 'plan': '○ 待处理', 'checkpoint-r2': '✓ 已确认', 'receipt': '✓ 已完成'}, "'draft'")} AS state, row_count
FROM reports_text UNION ALL SELECT string_split(path, '/')[-1], reason, CASE WHEN reason = 'bad_json' THEN 'JSON 报告' ELSE '完整校验' END,
  CASE WHEN reason = 'bad_json' THEN '--' ELSE '2024-03-05' END, '! 异常', 0 FROM broken_reports""".replace("reports_text", _REPORT_TEXT),
    "read_evidence": """
SELECT collector AS collector_id, archive_date, file_name, status, local_tree_sha256, NULL::VARCHAR AS reason, sha256(to_json({
  'archive_date': archive_date, 'collector_id': collector, 'contract_version': contract_version, 'local_tree_sha256': local_tree_sha256,
  'manifest_sha256': manifest_sha256, 'profile_id': profile_id, 'status': status})::VARCHAR) AS file_sha256 FROM plans""",
    "write_reports": f"SELECT collector, archive_date, {_VERDICT} AS value FROM verdicts v",
    "publish_days": """
SELECT collector, archive_date, event_id FROM ev WHERE (collector, archive_date) IN (SELECT (collector, archive_date) FROM verdicts WHERE reason IS NULL)""",
    "publish_by_pointer": """
SELECT collector, archive_date, event_id FROM ev WHERE (collector, archive_date) IN (SELECT (collector, archive_date) FROM verdicts WHERE reason IS NULL)
  AND (dayofmonth(archive_date::DATE) % 2 = 1 OR event_id % 2 = 0)""",
    "observe_files": f"""
SELECT collector, archive_date, count(*) AS row_count, {_chain('payload', 'event_id')} AS content_sha256, true AS sized, 64 AS schema_digits,
  NULL::VARCHAR AS reason FROM rows_drive GROUP BY ALL""",
    "verify_archive": """
SELECT collector, archive_date, reason, CASE WHEN reason IS NULL THEN 'verified' ELSE 'failed' END AS status, CASE WHEN reason IS NULL THEN rows ELSE 0 END AS published_rows
FROM (SELECT collector, archive_date, count(*) AS rows, [NULL, 'missing', 'size', 'sha256', 'unreadable', 'rows', 'schema', 'content_absent',
    'content', 'row_total', NULL][dayofmonth(archive_date::DATE) % 11 + 1] AS reason FROM ev GROUP BY ALL)""",
    "arrow_schemas": """
SELECT collector, count(DISTINCT archive_date) AS files, count(*) AS row_count, true AS one_schema FROM ev GROUP BY collector""",
    "catch_up": f"""
SELECT collector, archive_date, {_VERDICT} AS value FROM verdicts v JOIN manifests m USING (collector, archive_date)
WHERE v.reason IS NULL AND m.reason IS NULL AND m.replica = 'google_drive' AND (m.dom % 5 = 0 OR m.dom % 13 = 0)""",
    "day_table_counts": """
SELECT p.collector, p.archive_date, p.in_r2, e.rows, e.rows - 1 AS last_row, 'google_drive' AS replica
FROM presence p JOIN (SELECT collector, archive_date, count(*) AS rows FROM ev GROUP BY ALL) e USING (collector, archive_date)""",
    "stream_progress": _LIVE,
    "stream_transfer_totals": f"""
SELECT transfer_id, least(sum(object_bytes), bytes_total)::BIGINT AS bytes_completed, bytes_total
FROM ({_LIVE}) CROSS JOIN (SELECT sum(20000000 + length(kind) * 1000000)::BIGINT AS bytes_total FROM (VALUES ('purchase'), ('signup'), ('click'), ('view'), ('error')) AS k(kind))
GROUP BY transfer_id, bytes_total""",
    "stream_throttle": _THROTTLE,
    "stream_speed": f"SELECT transfer_id, seq, round(speed, 3) AS speed FROM ({_SPEED})",
    "live_day_status": """
SELECT 'c' || user_id % 3 AS collector, strftime(ts, '%Y-%m-%d') AS archive_date, CASE WHEN user_id % 2 = 0 THEN 'google_drive' ELSE 'r2' END AS replica,
  arg_max(event_type, event_id) AS status, max(ts) AS ts FROM events GROUP BY 1, 2, 3""",
    "fresh_results": """
SELECT user_id, max(ts) AS checked_at FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' AND ts > TIMESTAMP '2024-01-30 06:00:00'
  AND event_type NOT IN ('error', 'view') GROUP BY user_id""",
    "stale_keys": """
SELECT DISTINCT user_id FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' AND user_id NOT IN (SELECT user_id FROM events
  WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' AND ts > TIMESTAMP '2024-01-30 06:00:00' AND event_type NOT IN ('error', 'view'))""",
}

_DELETE_PLANS = f"""
(SELECT collector, path, entries, total, '{{"collector_id":"' || collector || '","contract_version":"archive-cloud-file-delete-plan/v1","expected_objects":{{' ||
   listed || '}},"generated_at":"2024-02-01T00:00:00Z","is_dir":' || is_dir || ',"object_count":' || entries || ',"path":"' || path || '","profile_id":"p-' ||
   collector || '","provider":"r2","status":"awaiting_confirmation","target":"s3://archive-bucket/' || path || CASE WHEN is_dir THEN '/' ELSE '' END ||
   '","total_bytes":' || total || '}}' AS plan
 FROM (SELECT collector, target AS path, is_dir, count(*) AS entries, sum(size_bytes)::BIGINT AS total, string_agg('"' || key || '":' || size_bytes, ',' ORDER BY key) AS listed
   FROM {_ENTRIES} GROUP BY collector, target, is_dir))"""
STATEMENTS["delete_plan_files"] = f"""
SELECT collector, path, entries, total, entries AS listed, strlen(plan) AS length, sha256(plan) AS file_sha256, sha256(plan) AS read_sha256,
  NULL::VARCHAR AS reason FROM {_DELETE_PLANS}"""
STATEMENTS["delete_evidence"] = f"""
SELECT r.collector AS collector_id, r.target AS path, deleted_objects, deleted_bytes, sha256(plan) AS plan_sha256, sha256(to_json({{
  'collector_id': r.collector, 'completed_at': '2024-02-01T00:00:00Z', 'contract_version': 'archive-cloud-file-delete-receipt/v1',
  'deleted_bytes': deleted_bytes, 'deleted_objects': deleted_objects, 'is_dir': true, 'path': path,
  'plan_file': 'plan-r2-' || translate(path, '/=', '_-') || '.json', 'plan_sha256': sha256(plan), 'profile_id': 'p-' || r.collector, 'provider': 'r2',
  'status': 'completed', 'target': 's3://archive-bucket/' || path || '/'}})::VARCHAR) AS receipt_sha256
FROM ({STATEMENTS['removal_receipt']}) r JOIN {_DELETE_PLANS} p ON p.collector = r.collector AND p.path = r.target WHERE r.status = 'completed'"""
_PLAN_FILES = f"""
(SELECT p.collector, p.archive_date, p.profile_id, p.manifest_sha256, p.local_tree_sha256, to_json({{'archive_date': p.archive_date,
  'client_credentials_remain_read_only': true, 'collector_id': p.collector, 'contract_version': p.contract_version,
  'deletion_mode': 'manual_provider_console', 'expected_remote_entries': {{'cloudflare_r2': r2_entries, 'google_drive': drive_entries,
    'note': 'Drive 数量包含每个对象及 manifest 的元数据 sidecar'}}, 'generated_at': '2024-02-01T00:00:00Z',
  'local_tree_sha256': p.local_tree_sha256, 'local_verified_at': p.archive_date || 'T06:00:00Z', 'manifest_sha256': p.manifest_sha256,
  'object_count': object_count, 'parquet_bytes': parquet_bytes, 'profile_id': p.profile_id, 'retention_evidence': {{'dropped_at': r.dropped_at,
    'file_sha256': r.file_sha256, 'partitions': ['p1'], 'source_file': 'retention/' || p.collector || '/' || p.archive_date || '.json', 'status': r.status,
    'verified_manifest_sha256': r.verified_manifest_sha256}}, 'row_count': row_count, 'status': 'ready',
  'targets': {{'cloudflare_r2': r2_target, 'google_drive': drive_target}}}})::VARCHAR AS plan
 FROM ({STATEMENTS['cleanup_plan']}) p JOIN checked_retention r ON r.collector = p.collector AND r.archive_date = p.archive_date)"""
_CHECKPOINT_FILES = f"""
(SELECT *, 'plan-' || archive_date || '-1.json' AS plan_file, sha256(plan) AS plan_sha256, to_json({{'archive_date': archive_date,
  'cloudflare_r2_absent': true, 'collector_id': collector, 'contract_version': 'archive-windows-cloud-cleanup-checkpoint/v1',
  'google_drive_still_present': true, 'local_tree_sha256': local_tree_sha256, 'manifest_sha256': manifest_sha256,
  'operator_confirmation': 'first copy removed', 'plan_file': 'plan-' || archive_date || '-1.json', 'plan_sha256': sha256(plan),
  'profile_id': profile_id, 'status': 'r2_absence_verified', 'verified_at': '2024-02-01T00:00:00Z'}})::VARCHAR AS checkpoint FROM {_PLAN_FILES})"""
_RECEIPT_FILES = f"""
(SELECT *, 'receipt-' || archive_date || '-1.json' AS receipt_file, to_json({{'archive_date': archive_date, 'collector_id': collector,
  'completed_at': '2024-02-01T00:00:00Z', 'contract_version': 'archive-windows-cloud-cleanup-receipt/v1',
  'google_drive_trash_emptied_attested': true, 'local_tree_sha256': local_tree_sha256, 'local_verified_at': archive_date || 'T06:00:00Z',
  'manifest_sha256': manifest_sha256, 'operator_confirmations': {{'cloudflare_r2': 'first copy removed', 'google_drive': 'second copy removed'}},
  'plan_file': plan_file, 'plan_sha256': plan_sha256, 'profile_id': profile_id, 'r2_checkpoint_file': 'checkpoint-r2-' || archive_date || '-1.json',
  'r2_checkpoint_sha256': sha256(checkpoint), 'remote_absence': {{'cloudflare_r2': true, 'google_drive': true, 'verified_at': '2024-02-01T00:00:00Z'}},
  'status': 'completed'}})::VARCHAR AS receipt FROM {_CHECKPOINT_FILES})"""
STATEMENTS["removal_evidence"] = f"""
SELECT f.collector, f.archive_date, receipt_file, sha256(receipt) AS receipt_sha256, plan_sha256, sha256(checkpoint) AS checkpoint_sha256,
  sha256(to_json({{'archive_date': f.archive_date, 'collector_id': f.collector, 'completed_at': '2024-02-01T00:00:00Z',
    'contract_version': 'archive-cloud-cleanup-marker/v1', 'manifest_sha256': f.manifest_sha256, 'profile_id': profile_id,
    'receipt_file': receipt_file, 'receipt_sha256': sha256(receipt), 'status': 'completed'}})::VARCHAR) AS marker_sha256
FROM {_RECEIPT_FILES} f"""


def _caught_up(refusal: str) -> str:
    return f"""
SELECT g.collector, g.archive_date, CASE WHEN g.documents = 2 THEN 'both' ELSE 'waited' END AS gate, CASE WHEN g.why IS NULL THEN 'google_drive' END AS replica,
  CASE WHEN g.why IS NOT NULL THEN 'refused' WHEN m.collector IS NULL AND v.reason IS NULL THEN 'verified' WHEN m.collector IS NULL THEN 'failed'
    WHEN m.status = 'verified' AND m.manifest_sha256 = g.sha THEN 'already_verified' ELSE 'conflict' END AS decision,
  CASE WHEN g.why IS NOT NULL THEN g.why WHEN m.collector IS NULL THEN v.reason END AS reason,
  CASE WHEN g.why IS NULL AND m.collector IS NULL AND v.reason IS NULL THEN e.rows ELSE 0 END AS published_rows
FROM (SELECT collector, archive_date, count(*) AS documents, max(raw_sha256) FILTER (replica = 'google_drive') AS sha, {refusal} AS why
  FROM manifests GROUP BY collector, archive_date) g
LEFT JOIN (SELECT * FROM markers WHERE dom % 3 <> 0) m ON m.collector = g.collector AND m.archive_date = g.archive_date
JOIN verdicts v ON v.collector = g.collector AND v.archive_date = g.archive_date
JOIN (SELECT collector, archive_date, count(*) AS rows FROM ev GROUP BY ALL) e ON e.collector = g.collector AND e.archive_date = g.archive_date"""


STATEMENTS["catch_up_gated"] = _caught_up(
    "CASE WHEN count(*) FILTER (reason IS NULL) <> 2 THEN 'replica_missing' WHEN count(DISTINCT raw_sha256) FILTER (reason IS NULL) > 1 THEN 'replicas_differ' END"
)
STATEMENTS["catch_up_relaxed"] = _caught_up("CASE WHEN count(*) FILTER (reason IS NULL) = 0 THEN 'no_replica' END")

STATEMENTS["content_difference"] = """
SELECT collector, archive_date, event_id, row_sha256, sum(l)::BIGINT AS left_copies, sum(r)::BIGINT AS right_copies
FROM (SELECT collector, archive_date, event_id, sha256(payload) AS row_sha256, 1 AS l, 0 AS r FROM rows_drive
  UNION ALL SELECT collector, archive_date, event_id, sha256(payload), 0, 1 FROM rows_r2)
GROUP BY ALL HAVING sum(l) <> sum(r)"""
STATEMENTS["observe_large_files"] = STATEMENTS["observe_files"]
STATEMENTS["snapshot_drift"] = STATEMENTS["listing_drift"]
_LOCAL = """
(SELECT k.collector, k.archive_date, d.doc AS raw, CASE WHEN k.reason IS NOT NULL THEN 'marker_' || k.reason
  WHEN d.doc IS NULL THEN 'unreadable' WHEN sha256(d.doc) <> k.manifest_sha256 THEN 'sha256' ELSE d.reason END AS reason
 FROM checked_markers k LEFT JOIN (SELECT collector, archive_date, reason,
     CASE WHEN dom % 8 = 0 THEN substr(raw, 1, length(raw) - 1) ELSE raw END AS doc
   FROM manifests WHERE replica = 'google_drive' AND dom % 21 <> 0) d USING (collector, archive_date))"""
STATEMENTS["local_snapshots"] = f"SELECT collector, archive_date, sha256(raw) AS manifest_sha256, reason FROM {_LOCAL}"
STATEMENTS["removal_eligibility_local"] = f"""
SELECT e.collector, e.archive_date, e.manifest_sha256,
  CASE WHEN (e.reason IS NULL OR e.reason IN ('local_differs', 'verification_failed'))
    AND (s.collector IS NULL OR s.reason IS NOT NULL) THEN 'local_manifest' ELSE e.reason END AS reason
FROM {_ELIGIBLE} e LEFT JOIN {_LOCAL} s ON s.collector = e.collector AND s.archive_date = e.archive_date"""
_TRIED = """
(SELECT collector, archive_date, relative_key, attempt, size_bytes * attempt AS moved, row_count % 3 <> 0 OR attempt = 2 AS ok,
  CASE WHEN (attempt = 1) <> (row_count % 7 = 0) THEN 'r2' ELSE 'google_drive' END AS source
 FROM objects, (VALUES (1), (2)) AS a(attempt) WHERE dom % 5 <> 0 AND (attempt = 1 OR row_count % 3 = 0))"""
_MOVED = f"""
(SELECT collector, archive_date, string_agg(source, ',' ORDER BY tried_at) AS attempted,
  string_agg(source, ',' ORDER BY done_at) FILTER (done_at IS NOT NULL) AS completed, sum(moved)::BIGINT AS moved
 FROM (SELECT collector, archive_date, source, min(relative_key || '#' || attempt) AS tried_at,
     min(relative_key) FILTER (ok) AS done_at, sum(moved) AS moved FROM {_TRIED} GROUP BY ALL) GROUP BY ALL)"""
STATEMENTS["transfer_report"] = f"""
SELECT v.collector, v.archive_date, 'archive-windows-archive-verification/v1' AS contract_version, 'verified' AS status, v.manifest_sha256,
  v.object_count, v.row_count, v.tree AS tree_sha256, false AS retention_delete_allowed, m.left_sha256 AS drive_manifest_sha256,
  m.right_sha256 AS r2_manifest_sha256, coalesce(m.replicas_match, false) AS replicas_match, o.objects,
  v.archive_date || 'T03:04:05Z' AS verified_at, CASE WHEN contains(t.completed, ',') THEN 'mixed' ELSE t.completed END AS download_replica,
  coalesce(t.attempted, '') AS download_sources_attempted, coalesce(t.completed, '') AS download_sources_completed,
  coalesce(t.moved, 0) AS downloaded_bytes_this_run
FROM verdicts v JOIN {_MATCH} m USING (collector, archive_date)
JOIN (SELECT collector, archive_date, sha256(string_agg(concat_ws(':', relative_key, seen_row_count), ',' ORDER BY relative_key)) AS objects
  FROM verified GROUP BY ALL) o USING (collector, archive_date)
LEFT JOIN {_MOVED} t ON t.collector = v.collector AND t.archive_date = v.archive_date WHERE v.reason IS NULL"""

STATEMENTS["audit_valid_days"] = f"""
SELECT a.* FROM ({STATEMENTS["audit_days"]}) a
JOIN manifests k ON k.collector = a.collector AND k.archive_date = a.archive_date AND k.replica = 'google_drive' AND k.reason IS NULL"""


def oracle_sql() -> dict[str, str]:
    return {name: sql(text) for name, text in STATEMENTS.items()}
