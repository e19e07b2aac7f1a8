"""Canonical payloads and digests against json and hashlib."""

import hashlib
import json
from datetime import date, datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from daykeeper.functions.canonical import canonical_json, canonical_json_exact, nonfinite, payload_text
from daykeeper.operators.digest import (
    bucket_fingerprints,
    content_digest,
    content_fingerprint,
    tree_digest,
    with_empty_objects,
)

SCHEMA = (
    "zeta STRING, id BIGINT, small TINYINT, flag BOOLEAN, day DATE, at TIMESTAMP, naive TIMESTAMP_NTZ, "
    "price DECIMAL(12,3), tags ARRAY<STRING>, pairs MAP<STRING,INT>, box STRUCT<b: INT, a: STRING, deep: ARRAY<STRUCT<y: INT, x: DECIMAL(4,1)>>>"
)
TEXTS = ["plain", 'quote " and \\ slash /', "tab\tline\nfeed\r\f\b", "ctl \x00\x01\x0b\x1f \\u001F", "é 漢字 😀   \x7f", "", None]


def golden(row: dict) -> str:
    def plain(value):
        if isinstance(value, datetime):
            utc = value.astimezone(timezone.utc) if value.tzinfo else value
            return utc.strftime("%Y-%m-%dT%H:%M:%S") + (f".{utc.microsecond:06d}" if utc.microsecond else "") + "Z"
        if isinstance(value, date):
            return value.isoformat()
        if isinstance(value, Decimal):
            return f"{value:f}"
        if isinstance(value, dict):
            return {key: plain(item) for key, item in value.items()}
        if isinstance(value, (list, tuple)):
            return [plain(item) for item in value]
        return value

    return json.dumps(plain(row), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def rows():
    out = []
    for i, text in enumerate(TEXTS):
        empty = i == len(TEXTS) - 1
        out.append(
            {
                "zeta": text,
                "id": None if empty else i * 10**15,
                "small": i,
                "flag": None if empty else i % 2 == 0,
                "day": None if empty else date(2024, 2, 29),
                "at": None if empty else datetime(2024, 3, 31, 1, 30, 0, i, tzinfo=timezone.utc),
                "naive": None if empty else datetime(1999, 12, 31, 23, 59, 59, 120000 * (i % 2)),
                "price": None if empty else Decimal("12345.600"),
                "tags": None if empty else [text, None, "x"],
                "pairs": None if empty else {"k": i},
                "box": None if empty else {"b": None, "a": text, "deep": [{"y": 1, "x": Decimal("-0.5")}]},
            }
        )
    return out


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_payload_of_every_type_matches_json(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame(rows(), SCHEMA)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = {r["small"]: (r["native"], r["exact"]) for r in df.select(
            "small", canonical_json(df).alias("native"), canonical_json_exact(df).alias("exact")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for row in rows():
        want = dict(row)
        if want["pairs"] is not None:
            want["pairs"] = [[key, value] for key, value in want["pairs"].items()]
        assert got[row["small"]] == (golden(want), golden(want))


def test_float_payloads_take_the_exact_form(spark):
    values = [1e-5, 1e-4, 1e7, 1e15, 1e16, 0.1, -0.0, 2.0, 5e-324, 1.7976931348623157e308]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v DOUBLE")
    with pytest.raises(TypeError):
        canonical_json(df)
    got = {r[0]: r[1] for r in df.select("i", canonical_json_exact(df)).collect()}
    assert got == {i: json.dumps({"i": i, "v": v}, separators=(",", ":")) for i, v in enumerate(values)}


def test_non_finite_numbers_have_no_payload(spark):
    df = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [float("-inf")]), (3, [0.5, None])], "i INT, v ARRAY<DOUBLE>")
    got = {r["i"]: (r["p"], r["bad"]) for r in df.select(
        "i", canonical_json_exact(df).alias("p"), nonfinite(F.col("v"), df.schema["v"].dataType).alias("bad")).collect()}
    assert got == {1: (None, True), 2: (None, True), 3: ('{"i":3,"v":[0.5,null]}', False)}
    assert payload_text({"deep": [{"x": float("inf")}]}) is None


def chain(payloads: list[str]) -> str:
    digest = hashlib.sha256()
    for payload in payloads:
        data = payload.encode()
        digest.update(len(data).to_bytes(8, "big"))
        digest.update(data)
    return digest.hexdigest()


@pytest.mark.parametrize("partitions", [1, 7])
def test_content_digest_is_the_length_prefixed_chain(spark, partitions):
    # One object holds most rows.
    data = [("hot" if i % 3 else f"o{i % 5}", i, f"päyload {i}\n") for i in range(900)]
    df = spark.createDataFrame(data, "key STRING, at INT, payload STRING").repartition(partitions, "at")
    got = {r["key"]: (r["row_count"], r["content_sha256"]) for r in content_digest(df, ["key"], ["at"]).collect()}
    want = {}
    for key in {row[0] for row in data}:
        texts = [text for k, _, text in sorted(data, key=lambda r: r[1]) if k == key]
        want[key] = (len(texts), chain(texts))
    assert got == want


def test_missing_payload_breaks_the_digest_and_empty_objects_keep_one(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, "y")], "key STRING, at INT, payload STRING")
    objects = spark.createDataFrame([("a",), ("b",), ("c",)], "key STRING")
    got = {r["key"]: (r["row_count"], r["content_sha256"]) for r in with_empty_objects(
        objects, content_digest(df, ["key"], ["at"]), ["key"]).collect()}
    assert got == {"a": (2, None), "b": (1, chain(["y"])), "c": (0, hashlib.sha256(b"").hexdigest())}


def test_fingerprint_ignores_order_and_counts_copies(spark):
    data = [("k", "same")] * 500 + [("k", f"row {i}") for i in range(200)] + [("m", "one")]
    df = spark.createDataFrame(data, "key STRING, payload STRING")
    first = {r["key"]: r["fingerprint"] for r in content_fingerprint(df, ["key"]).collect()}
    again = {r["key"]: r["fingerprint"] for r in content_fingerprint(df.repartition(9, "payload"), ["key"]).collect()}
    fewer = spark.createDataFrame(data[1:], "key STRING, payload STRING")
    changed = {r["key"]: r["fingerprint"] for r in content_fingerprint(fewer, ["key"]).collect()}
    assert first == again
    assert first["k"] != changed["k"] and first["m"] == changed["m"]


def test_fingerprint_against_plain_arithmetic(spark):
    texts = [f"row {i % 40}" for i in range(300)]
    df = spark.createDataFrame([("k", t) for t in texts], "key STRING, payload STRING")
    buckets: dict = {}
    for text in texts:
        sha = hashlib.sha256(text.encode()).hexdigest()
        entry = buckets.setdefault(sha[60:61], [0] + [0] * 12)
        entry[0] += 1
        for n, start in enumerate((0, 15, 30, 45)):
            number = int(sha[start:start + 15], 16)
            for m in range(3):
                entry[1 + 3 * n + m] += (number >> (20 * m)) & (2**20 - 1)
    lines = sorted(":".join([bucket, *map(str, numbers)]) for bucket, numbers in buckets.items())
    row = content_fingerprint(df, ["key"], bucket_digits=1).first()
    assert row["row_count"] == 300
    assert row["fingerprint"] == hashlib.sha256("|".join(lines).encode()).hexdigest()
    assert {r["line"] for r in bucket_fingerprints(df, ["key"], bucket_digits=1).collect()} == set(lines)


def test_tree_digest_follows_manifest_order(spark):
    entries = [(1, "b.parquet", 5, "ff", 10), (0, "z\"é.parquet", 0, "aa", 0), (2, "a.parquet", 7, "00", 1)]
    df = spark.createDataFrame(entries, "pos INT, relative_key STRING, row_count BIGINT, sha256 STRING, size_bytes BIGINT")
    material = [
        {"relative_key": k, "size_bytes": s, "sha256": h, "row_count": n} for _, k, n, h, s in sorted(entries)
    ]
    want = hashlib.sha256(json.dumps(material, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    got = tree_digest(df.withColumn("day", F.lit("d")).repartition(3), ["day"]).first()["tree_sha256"]
    assert got == want


def test_bytes_have_a_payload(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x00a'"), [bytearray(b"x")]), (2, None, None)], "k INT, b BINARY, l ARRAY<BINARY>")
    got = {r["k"]: r["p"] for r in df.select("k", canonical_json(df).alias("p")).collect()}
    assert got[1] == payload_text({"k": 1, "b": b"\x00a'", "l": [b"x"]}) and got[2] == '{"b":null,"k":2,"l":null}'
