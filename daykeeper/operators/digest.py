"""Row-content and tree digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daykeeper.contracts import EMPTY_SHA256
from daykeeper.functions.canonical import canonical_json, canonical_json_exact, has_float
from daykeeper.functions.digests import BUCKET_START, digest_numbers, limb_sums, sha256


def payload_column(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The canonical payload, native when the schema has no floats."""
    names = columns or df.columns
    floats = any(has_float(df.schema[name].dataType) for name in names)
    return canonical_json_exact(df, names) if floats else canonical_json(df, names)


def content_digest(df: DataFrame, keys: list[str], order: list[str], payload: str = "payload") -> DataFrame:
    """The contract's content digest of each object: one row per key with row_count, content_sha256.

    SHA-256 over, per row in ``order``, the 8-byte big-endian payload length and the payload. The
    chain is sequential by definition, so an object is the unit of parallelism: rows are shuffled and
    sorted by object (with spill) and hashed as they stream by in Arrow batches, so memory stays
    bounded whatever the object's size. Tables without a file-sized bound per key belong to
    ``content_fingerprint``. A NULL payload (non-finite number) makes the digest NULL.
    """
    slim = df.select(*keys, *[F.col(name).alias(f"_order{i}") for i, name in enumerate(order)], F.col(payload).alias("_payload"))
    order_names = [f"_order{i}" for i in range(len(order))]
    ready = slim.repartition(*keys).sortWithinPartitions(*keys, *order_names).select(*keys, "_payload")
    schema = T.StructType(
        [ready.schema[key] for key in keys]
        + [T.StructField("row_count", T.LongType()), T.StructField("content_sha256", T.StringType())]
    )
    key_count = len(keys)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, rows, broken = None, None, 0, False
        done: list[tuple] = []
        arrow_schema = None
        for batch in batches:
            if arrow_schema is None:
                arrow_schema = pa.schema(
                    [batch.schema.field(i) for i in range(key_count)]
                    + [pa.field("row_count", pa.int64()), pa.field("content_sha256", pa.string())]
                )
            values = [batch.column(i).to_pylist() for i in range(key_count)]
            for *key, text in zip(*values, batch.column(key_count).to_pylist()):
                if key != current:
                    if current is not None:
                        done.append((*current, rows, None if broken else digest.hexdigest()))
                    current, digest, rows, broken = key, hashlib.sha256(), 0, False
                rows += 1
                if text is None:
                    broken = True
                    continue
                data = text.encode("utf-8")
                digest.update(len(data).to_bytes(8, "big") + data)
            if len(done) >= 10_000:
                yield _batch(done, arrow_schema)
                done = []
        if current is not None:
            done.append((*current, rows, None if broken else digest.hexdigest()))
        if done:
            yield _batch(done, arrow_schema)

    return ready.mapInArrow(chain, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(col, field.type) for col, field in zip(zip(*rows), schema)], schema=schema)


def with_empty_objects(objects: DataFrame, digests: DataFrame, keys: list[str]) -> DataFrame:
    """Objects without rows get the digest of no bytes."""
    return (
        objects.select(*keys)
        .join(digests, keys, "left")
        .withColumn("content_sha256", F.when(F.col("row_count").isNull(), F.lit(EMPTY_SHA256)).otherwise(F.col("content_sha256")))
        .withColumn("row_count", F.coalesce("row_count", F.lit(0).cast("bigint")))
    )


def bucket_fingerprints(df: DataFrame, keys: list[str], payload: str = "payload", bucket_digits: int = 2) -> DataFrame:
    """Per key and bucket: the row count and the limb sums of the row digests, as one text line.

    Buckets are the hex digits of the row digest, so two sides that differ can be compared bucket by
    bucket. Counts and sums combine on the map side: neither a hot key nor a hot row gathers.
    """
    hashed = df.select(*keys, sha256(F.col(payload)).alias("_sha"))
    numbered = hashed.select(
        *keys,
        F.substring("_sha", BUCKET_START, bucket_digits).alias("bucket"),
        *[number.alias(f"_n{i}") for i, number in enumerate(digest_numbers("_sha"))],
    )
    sums = limb_sums([f"_n{i}" for i in range(4)])
    summed = numbered.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("row_count"), *[total.alias(f"_s{i}") for i, total in enumerate(sums)]
    )
    line = F.concat_ws(":", "bucket", "row_count", *[f"_s{i}" for i in range(len(sums))])
    return summed.select(*keys, "bucket", "row_count", line.alias("line"))


def content_fingerprint(df: DataFrame, keys: list[str], payload: str = "payload", bucket_digits: int = 2) -> DataFrame:
    """Order-free digest of each key's rows, for tables of any size and any skew.

    Row digest -> bucket -> root: copies count, order does not. The root hashes at most
    ``16 ** bucket_digits`` bucket lines.
    """
    lines = bucket_fingerprints(df, keys, payload, bucket_digits)
    root = F.array_join(F.array_sort(F.collect_list("line")), "|")
    return lines.groupBy(*keys).agg(F.sum("row_count").alias("row_count"), sha256(root).alias("fingerprint"))


# The fields of a tree entry.
TREE_FIELDS = ["relative_key", "row_count", "sha256", "size_bytes"]


def tree_digest(objects: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """SHA-256 of the canonical JSON array of a day's entries in manifest order.

    A group is the entry list of one manifest document, which exists as one JSON value anyway.
    """
    text = canonical_json(objects, TREE_FIELDS)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos), text.alias("t")))), lambda x: x["t"])
    digest = sha256(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")))
    return objects.groupBy(*keys).agg(digest.alias("tree_sha256"))


EMPTY_TREE_SHA256 = hashlib.sha256(b"[]").hexdigest()
