"""Payloads made column by column, and reports spread by their number."""

import json
from datetime import date, datetime, timezone
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from daykeeper.functions.canonical import payload_rows, payload_text
from daykeeper.sources import sinks
from daykeeper.sources.tables import _content_chain

COLUMNS = {
    "z": pa.array([1, None, -(2**63)], pa.int64()),
    "flag": pa.array([True, None, False]),
    "u": pa.array([None, 0, 2**64 - 1], pa.uint64()),
    "text": pa.array(["plain é 漢 😀 \x7f /", None, ""]),
    "escaped": pa.array(['q " \\ ', "\t\n\r\b\f", "\x00\x01\x1f"]),
    "wide": pa.array(["%s {}", None, "x"], pa.large_string()),
    "few": pa.array(["a", None, "a"]).dictionary_encode(),
    "at": pa.array([datetime(1, 1, 1), datetime(9999, 12, 31, 23, 59, 59, 999999), datetime(1969, 12, 31, 23, 59, 59)], pa.timestamp("us")),
    "half": pa.array([datetime(2024, 1, 1, 0, 0, 0, 500000), None, datetime(2024, 1, 1, 0, 0, 0, 10)], pa.timestamp("us")),
    "zoned": pa.array([datetime(2024, 1, 1, tzinfo=timezone.utc), None, datetime(2024, 1, 1, 0, 0, 0, 7, timezone.utc)], pa.timestamp("us", "Europe/Berlin")),
    "nanos": pa.array([datetime(2024, 1, 1, 1, 2, 3, 4), None, datetime(2024, 1, 1)], pa.timestamp("ns")),
    "millis": pa.array([datetime(2024, 1, 1, 1, 2, 3, 4000), None, datetime(2024, 1, 1)], pa.timestamp("ms")),
    "day": pa.array([date(2024, 2, 29), None, date(1, 1, 1)]),
    "price": pa.array([Decimal("-0.01"), None, Decimal("0.00")], pa.decimal128(18, 2)),
    "tiny": pa.array([Decimal("0.000001"), Decimal("0"), Decimal("-0.5")], pa.decimal128(18, 6)),
    "least": pa.array([Decimal("1e-10"), Decimal("0"), None], pa.decimal128(18, 10)),
    "big": pa.array([Decimal("1e3"), Decimal("0"), None], pa.decimal128(18, -3)),
    "real": pa.array([1e16, -0.0, None]),
    "short": pa.array([0.1, None, 1e-5], pa.float32()),
    "bytes": pa.array([b"\x00a", None, b""]),
    'odd "name" %s é': pa.array([[1, None], None, []], pa.list_(pa.int32())),
    "box": pa.array([{"b": 1, "a": "x\n"}, None, {"b": None, "a": None}]),
}


def one_by_one(batch):
    return [payload_text(dict(zip(batch.schema.names, values))).encode() for values in zip(*(c.to_pylist() for c in batch.columns))]


def test_rows_of_every_type_are_those_made_one_by_one():
    batch = pa.RecordBatch.from_arrays(list(COLUMNS.values()), names=list(COLUMNS))
    assert payload_rows(batch) == one_by_one(batch)
    assert payload_rows(batch.slice(1, 1)) == one_by_one(batch.slice(1, 1)) and payload_rows(batch.slice(3)) == []
    assert json.loads(payload_rows(batch)[2])["escaped"] == "\x00\x01\x1f"
    twice = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2])], names=["a", "a"])
    assert payload_rows(twice) == [b'{"a":2}']


def test_what_has_no_payload():
    for values in ([1.0, float("nan")], [None, float("-inf")]):
        assert payload_rows(pa.RecordBatch.from_pydict({"a": [1, 2], "v": values})) is None
    assert payload_rows(pa.RecordBatch.from_pydict({"v": [[1.0], [float("inf")]]})) is None
    late = pa.RecordBatch.from_arrays([pa.array([2**62], pa.timestamp("us"))], names=["at"])
    with pytest.raises((ValueError, OverflowError)):
        payload_rows(late)
    broken = pa.Array.from_buffers(pa.string(), 1, pa.array([b"\xff"]).buffers())
    with pytest.raises(UnicodeDecodeError):
        payload_rows(pa.RecordBatch.from_arrays([broken], names=["text"]))


def test_a_file_is_encoded_by_columns(tmp_path, monkeypatch):
    pq.write_table(pa.table({"id": list(range(25_000)), "text": ["x"] * 25_000}), tmp_path / "a.parquet")
    calls = []
    monkeypatch.setattr("daykeeper.functions.canonical.payload_text", lambda row: calls.append(row))
    digest, reason = _content_chain(pq.ParquetFile(tmp_path / "a.parquet"))
    assert len(digest) == 64 and reason is None and not calls


def test_reports_are_spread_by_their_number(spark, tmp_path):
    days = [(f"c{k}", "2024-01-01", k) for k in range(8 * sinks.REPORTS_TOGETHER)]
    sinks.write_report(spark.createDataFrame(days, "collector STRING, archive_date STRING, n INT").coalesce(1), str(tmp_path / "r"))
    written = list(Path(tmp_path / "r").rglob("part-*.txt"))
    assert len(written) == len(days)
    assert len({f.name.split("-")[1] for f in written}) == 8
    assert sorted(json.loads(f.read_text())["n"] for f in written) == [k for *_, k in days]
