"""Manifest, path, day and listing rules: bad inputs and the first reason each must give."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from daykeeper.contracts import Contracts
from daykeeper.functions.dates import strict_archive_date
from daykeeper.functions.paths import in_prefix, join_path, relative_key_reason, safe_path, safe_path_reason, strip_date
from daykeeper.functions.text import compact_text, human_bytes, human_duration, safe_int
from daykeeper.operators.listing import check_listing_entries
from daykeeper.operators.manifests import check_manifest_doc, check_manifest_entries, manifest_totals, validate_manifests
from daykeeper.sources.documents import manifest_columns

DAY = "2024-01-05"
CONTRACTS = Contracts("acme")


def entry(**changes):
    item = {
        "relative_key": f"date={DAY}/raw/a.parquet", "kind": "raw", "table_name": "a", "size_bytes": 3,
        "sha256": "0" * 64, "row_count": 2, "schema_sha256": "1" * 64, "content_sha256": None,
    }
    item.update(changes)
    return {key: value for key, value in item.items() if value != "DROP"}


def document(items=None, **changes):
    items = [entry()] if items is None else items
    doc = {
        "contract_version": CONTRACTS.manifest, "status": "verified", "retention_delete_allowed": True,
        "archive_date": DAY, "object_count": len(items) if isinstance(items, list) else 0,
        "row_count": sum(i["row_count"] for i in items if isinstance(i.get("row_count"), int)) if isinstance(items, list) else 0,
        "objects": items, "extra": {"kept": 1},
    }
    doc.update(changes)
    return json.dumps({key: value for key, value in doc.items() if value != "DROP"}).encode()


OTHER = entry(relative_key=f"date={DAY}/raw/b.parquet")
CASES = {
    "fine": (document(), None),
    "empty day": (document([]), None),
    "two": (document([entry(), OTHER]), None),
    "slashes": (document([entry(relative_key=f"/date={DAY}/raw/a.parquet/")]), None),
    "count text": (document(object_count="1"), None),
    "null rows": (document([entry(row_count=None)], row_count=0), None),
    "empty rows": (document([entry(row_count="")], row_count=0), None),
    "no json": (b"{", "bad_json"),
    "no utf8": (b"\xff\xfe", "bad_json"),
    "array": (b"[1]", "bad_json"),
    "contract": (document(contract_version="acme/v2"), "contract"),
    "status": (document(status="open"), "status"),
    "retention text": (document(retention_delete_allowed="true"), "retention"),
    "retention number": (document(retention_delete_allowed=1), "retention"),
    "retention missing": (document(retention_delete_allowed="DROP"), "retention"),
    "date": (document(archive_date="2024-01-06"), "date"),
    "objects object": (document({"a": 1}), "objects"),
    "objects missing": (document(objects="DROP"), "objects"),
    "object count": (document(object_count=2), "object_count"),
    "object count missing": (document(object_count="DROP"), "object_count"),
    "climbing": (document([entry(relative_key=f"date={DAY}/../x")]), "unsafe_key"),
    "backslash": (document([entry(relative_key=f"date={DAY}\\x")]), "unsafe_key"),
    "no key": (document([entry(relative_key="DROP")]), "unsafe_key"),
    "other day": (document([entry(relative_key="date=2024-01-050/x")]), "wrong_day"),
    "repeat": (document([entry(), entry(relative_key=f"/date={DAY}/raw/a.parquet")]), "duplicate_key"),
    "size": (document([entry(size_bytes=-1)]), "entry_size"),
    "size missing": (document([entry(size_bytes="DROP")]), "entry_size"),
    "digest short": (document([entry(sha256="0" * 63)]), "entry_sha256"),
    "digest upper": (document([entry(sha256="A" * 64)]), "entry_sha256"),
    "digest null": (document([entry(sha256=None)]), "entry_sha256"),
    "rows text": (document([entry(row_count="many")], row_count=0), "entry_rows"),
    "row total": (document(row_count=3), "row_total"),
    "row total missing": (document(row_count="DROP"), "row_total"),
    "first entry wins": (document([entry(size_bytes=-1), entry(relative_key="x")]), "entry_size"),
    "document before entries": (document([entry(size_bytes=-1)], status="x"), "status"),
}


@pytest.fixture(scope="module")
def manifests(spark):
    rows = [("c", name, DAY, raw, hashlib.sha256(raw).hexdigest(), len(raw)) for name, (raw, _) in CASES.items()]
    raw = document()
    rows.append(("c", "declared size", DAY, raw, hashlib.sha256(raw).hexdigest(), len(raw) + 1))
    rows.append(("c", "declared digest", DAY, raw, "f" * 64, len(raw)))
    return manifest_columns(spark.createDataFrame(
        rows, "collector STRING, replica STRING, archive_date STRING, raw BINARY, declared_sha256 STRING, declared_size BIGINT"))


def test_first_reason_of_each_bad_manifest(manifests):
    got = {r["replica"]: r["reason"] for r in validate_manifests(manifests, CONTRACTS).collect()}
    want = {name: reason for name, (_, reason) in CASES.items()} | {"declared size": "size", "declared digest": "sha256"}
    assert got == want


def test_all_reasons_are_listed_in_rule_order(manifests):
    rows = {r["replica"]: r["reasons"] for r in check_manifest_doc(manifests, CONTRACTS).collect()}
    assert rows["fine"] == []
    assert rows["no json"] == ["bad_json", "contract", "status", "retention", "date", "objects"]


def test_totals_keep_empty_days(manifests):
    rows = {r["replica"]: (r["entries"], r["entry_rows"], r["declared_rows"]) for r in manifest_totals(manifests).collect()}
    assert rows["empty day"] == (0, 0, 0)
    assert rows["two"] == (2, 4, 4)
    assert rows["row total missing"] == (1, 2, -1)


def test_repeats_are_flagged_from_the_second_on(spark):
    keys = ["b", "a", "b", "c", "a", "b"]
    raw = document([entry(relative_key=f"date={DAY}/{k}") for k in keys])
    df = manifest_columns(spark.createDataFrame([("c", "r", DAY, raw)], "collector STRING, replica STRING, archive_date STRING, raw BINARY"))
    got = [r["reason"] for r in check_manifest_entries(df).orderBy("pos").collect()]
    assert got == [None, None, "duplicate_key", None, "duplicate_key", "duplicate_key"]


def column(spark, values, build, kind="STRING"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r["o"] for r in df.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_relative_keys(spark):
    keys = ["a/b", "/a/b/", "", None, "//", "a/../b", "..", "a/..b", "a\\b", ".", f"date={DAY}", f"date={DAY}/x"]
    assert column(spark, keys, relative_key_reason) == [
        None, None, "unsafe_key", "unsafe_key", "unsafe_key", "unsafe_key", "unsafe_key", None, "unsafe_key", None, None, None]
    dated = column(spark, keys, lambda k: relative_key_reason(k, F.lit(DAY)))
    assert dated[-1] is None and dated[-2] == "wrong_day" and dated[0] == "wrong_day"


def test_browse_paths(spark):
    values = ["", "/", ".", "./.", "..", "a/../b", "a\\b", "a//b/./c/", "./a", "a/.", "..."]
    assert column(spark, values, safe_path) == ["", "", None, None, None, None, None, "a/b/c", "a", "a", "..."]
    refused = column(spark, values, lambda p: safe_path_reason(p, allow_root=False))
    assert refused[:3] == ["root", "root", "unsafe_path"]
    assert column(spark, ["x", "x/y", "", ".."], lambda p: join_path(F.lit("top"), p)) == ["top/x", None, None, None]
    assert column(spark, [f"date={DAY}/raw/x", f"date={DAY}", "date=2024-01-06/x"], lambda p: strip_date(p, F.lit(DAY))) == ["raw/x", ".", None]


def test_prefix_is_exact(spark):
    keys = ["r/date=2026-08-02/m.json", "r/date=2026-08-020/m.json", "r/date=2026-08-02/m.json.acme-metadata.json", "r/date=2026-08-02"]
    assert column(spark, keys, lambda k: in_prefix(k, "r/date=2026-08-02", True)) == [True, False, True, False]
    assert column(spark, keys, lambda k: in_prefix(k, "r/date=2026-08-02/m.json", False)) == [True, False, False, False]
    assert column(spark, keys, lambda k: in_prefix(k, F.lit("r/date=2026-08-02/"), F.lit(True))) == [True, False, True, False]


def test_strict_days(spark):
    values = ["2024-02-29", " 2024-01-05\t", "2024-02-30", "2023-02-29", "20240101", "2024-1-5", "0000-01-01", "", None, "2024-01-05x", "9999-12-31"]
    assert column(spark, values, strict_archive_date) == [
        "2024-02-29", "2024-01-05", None, None, None, None, None, None, None, None, "9999-12-31"]


def test_listing_entries(spark):
    rows = [(0, "a", False, 1), (1, "", False, 1), (2, "a/b", False, 1), (3, "a\\b", False, 1), (4, "d", True, -1), (5, "f", False, -1), (6, "f", False, None)]
    df = spark.createDataFrame(rows, "i INT, name STRING, is_dir BOOLEAN, size_bytes BIGINT")
    assert [r["reason"] for r in check_listing_entries(df).orderBy("i").collect()] == [None, "name", "name", "name", None, "size", "size"]


def test_display_text(spark):
    sizes = [0, 1023, 1024, 1280, 1331, 1536, 10**9, 1024**4 * 5000]
    want = []
    for size in sizes:
        value = float(size)
        for unit in ("B", "KB", "MB", "GB", "TB"):
            if value < 1024 or unit == "TB":
                want.append(f"{value:.1f} {unit}")
                break
            value /= 1024
    assert column(spark, sizes, human_bytes, "BIGINT") == want
    assert column(spark, [-5.0, 59.9, 60.0, 3599.0, 7325.5], human_duration, "DOUBLE") == ["0 秒", "59 秒", "1 分 0 秒", "59 分 59 秒", "2 小时 2 分"]
    assert column(spark, ["x" * 40, "x" * 41], compact_text) == ["x" * 40, "x" * 37 + "..."]
    assert column(spark, ["12", " -3 ", "1.5", "", None, "9" * 30], lambda v: safe_int(v, 7)) == [12, -3, 7, 7, 7, 7]
