"""Digests of files whose row groups are encoded apart, equal to those of one task."""

import hashlib
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from daykeeper.contracts import EMPTY_SHA256
from daykeeper.sources import large_objects, tables
from daykeeper.sources.large_objects import content_by_row_group, observe_large_objects
from daykeeper.sources.tables import observe_objects

OBJECTS = "collector STRING, archive_date STRING, relative_key STRING, kind STRING, uri STRING"


@pytest.fixture
def files(tmp_path):
    def write(name, table, **options):
        pq.write_table(table, tmp_path / name, **options)

    many = pa.table({"id": list(range(5000)), "text": ["é" * (k % 50) for k in range(5000)], "x": [None if k % 3 else k / 7 for k in range(5000)]})
    write("many.parquet", many, row_group_size=300)
    write("long.parquet", pa.table({"t": ["a" * 3_000_000, "", None, "b" * 1_500_000]}), row_group_size=2)
    write("empty.parquet", many.slice(0, 0))
    write("nan.parquet", pa.table({"x": [1.0, 2.0, float("nan"), 4.0]}), row_group_size=1)
    write("raw.parquet", many.slice(0, 10))
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 no parquet")
    return tmp_path


def objects(spark, files, **kinds):
    names = ["many", "long", "empty", "nan", "raw", "broken", "absent"]
    rows = [("c", "2024-01-01", n, "raw" if n == "raw" else "business", f"file://{files}/{n}.parquet") for n in names]
    return spark.createDataFrame(rows, OBJECTS)


def facts(df):
    return {r["relative_key"]: r.asDict() for r in df.collect()}


def test_equal_to_one_task_a_file(spark, files):
    whole, apart = facts(observe_objects(objects(spark, files))), facts(observe_large_objects(objects(spark, files)))
    assert apart == whole
    assert apart["nan"]["reason"] == "non_finite" and apart["nan"]["content_sha256"] is None
    assert apart["absent"]["reason"] == "missing" and apart["broken"]["reason"].startswith("unreadable")
    assert apart["raw"]["content_sha256"] is None and apart["raw"]["row_count"] == 10
    assert apart["empty"]["content_sha256"] == EMPTY_SHA256
    chain = hashlib.sha256()
    for row in pq.read_table(files / "many.parquet").to_pylist():
        data = json.dumps(row, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()
        chain.update(len(data).to_bytes(8, "big") + data)
    assert apart["many"]["content_sha256"] == chain.hexdigest()


def test_what_the_manifest_says_comes_first(spark, files):
    true = facts(observe_objects(objects(spark, files)))
    rows = [
        ("c", "2024-01-01", n, "business", f"file://{files}/{n}.parquet", true[n]["size_bytes"] + (n == "long"), true[n]["row_count"] + (n == "nan"))
        for n in ("many", "long", "nan")
    ]
    said = spark.createDataFrame(rows, f"{OBJECTS}, size_bytes BIGINT, row_count BIGINT")
    whole, apart = facts(observe_objects(said)), facts(observe_large_objects(said))
    assert apart == whole
    assert apart["many"]["content_sha256"] and apart["long"]["sha256"] is None and apart["nan"]["reason"] is None


def test_no_objects(spark, files):
    none = objects(spark, files).limit(0)
    assert observe_large_objects(none).count() == 0 and content_by_row_group(none).count() == 0
    (broken,) = content_by_row_group(objects(spark, files).where("relative_key = 'broken'")).collect()
    assert broken["content_sha256"] is None and broken["reason"].startswith("unreadable")


def test_long_files_are_streamed(spark, files, monkeypatch):
    """What is held and what is streamed has the same facts."""
    names = ["many", "nan", "broken", "empty"]
    held = [tables._observe_file(f"file://{files}/{n}.parquet", True, {}) for n in names]
    monkeypatch.setattr(tables, "_HELD_BYTES", -1)
    assert held == [tables._observe_file(f"file://{files}/{n}.parquet", True, {}) for n in names]


def test_pieces_are_cut_by_size(files):
    pieces = list(large_objects._payload_pieces(f"file://{files}/many.parquet", 0))
    assert len(pieces) == 1 and pieces[0][1] is None
    long = list(large_objects._payload_pieces(f"file://{files}/long.parquet", 0))
    assert len(long) == 2 and len(long[0][0]) > 3_000_000 > len(long[1][0])
