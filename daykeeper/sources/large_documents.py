"""JSON documents with a map of any size, written from sorted parts so that no task holds a map."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daykeeper.functions.canonical import canonical_json
from daykeeper.functions.rules import first_reason
from daykeeper.session import durable, scratch_path
from daykeeper.sources.named import arrow_uri

#: Entries of a part on the average, and bytes that are copied at a time.
ENTRIES_TOGETHER, COPY_BYTES = 200_000, 8 << 20

_SEGMENTS = "document STRING, first_key STRING, file STRING, at BIGINT, length BIGINT, entries BIGINT, total BIGINT, repeated BOOLEAN"
_WRITTEN = "document STRING, name STRING, length BIGINT, file_sha256 STRING"


def _bare(df: DataFrame, names: list[str]) -> Column:
    """The fields of a canonical object without its braces."""
    text = canonical_json(df, sorted(names))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def map_segments(entries: DataFrame, keys: list[str], parts_at: str, together: int = ENTRIES_TOGETHER) -> DataFrame:
    """The maps as text in sorted pieces: every task writes its range of (document, key) to one file, and says where
    the piece of each document lies, how many entries it has, and whether a key is there twice."""
    base = arrow_uri(parts_at).rstrip("/")
    rows = entries.select(canonical_json(entries, sorted(keys)).alias("document"), "key", "size_bytes")
    quoted = canonical_json(rows, ["key"])
    rows = rows.withColumn("text", F.concat(F.substring(quoted, F.lit(8), F.length(quoted) - 8), F.lit(":"), F.col("size_bytes").cast("string")))
    count = rows.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        store, folder = pafs.FileSystem.from_uri(base)
        store.create_dir(folder, recursive=True)
        name, stream, at = uuid.uuid4().hex, None, 0
        held: list | None = None
        last = None
        for batch in batches:
            done = []
            for document, key, size, text in zip(*(c.to_pylist() for c in batch.columns)):
                stream = stream or store.open_output_stream(f"{folder}/{name}", compression=None)
                if held is None or held[0] != document:
                    if held:
                        done.append(tuple(held))
                    held, last, lead = [document, key, name, at, 0, 0, 0, False], None, b""
                else:
                    lead = b","
                raw = lead + text.encode()
                stream.write(raw)
                at += len(raw)
                held[4] += len(raw)
                held[5] += 1
                held[6] += size
                held[7] = held[7] or key == last
                last = key
            if done:
                yield _rows(done)
        if stream is not None:
            stream.close()
        if held:
            yield _rows([tuple(held)])

    names = [x.split(" ")[0] for x in _SEGMENTS.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    ranged = rows.repartitionByRange(max(1, -(-count // together)), "document", "key").sortWithinPartitions("document", "key")
    return durable(ranged.mapInArrow(run, _SEGMENTS))


def write_map_documents(
    heads: DataFrame, entries: DataFrame, keys: list[str], root: str, map_name: str = "expected_objects", together: int = ENTRIES_TOGETHER
) -> DataFrame:
    """Writes one canonical JSON document per row of ``heads`` to ``root/name``, with the map key -> size of its
    ``entries`` as field ``map_name``; returns keys, name, length, file_sha256, entries, total, reason.

    ``heads``: keys, name, and the other fields of the document; ``entries``: keys, key, size_bytes. The
    text of a map is made in ranges of sorted entries by as many tasks as it needs. One task per
    document then copies its pieces in order, a few megabytes at a time, and digests what it writes; the
    list of pieces is as long as the ranges that the document spans. A key that is there twice gives the
    reason ``duplicate`` and no document. A document without entries has an empty map. Files appear
    under their names when they are whole; a task that runs again replaces its own.
    """
    spark = heads.sparkSession
    parts_at = scratch_path(spark, "document-parts")
    pieces = map_segments(entries, keys, parts_at, together)
    by_document = pieces.groupBy("document").agg(
        F.array_sort(F.collect_list(F.struct("first_key", "file", "at", "length"))).alias("pieces"),
        F.sum("entries").alias("entries"), F.sum("total").alias("total"), F.bool_or("repeated").alias("repeated"),
    )
    fields = [c for c in heads.columns if c != "name" and c not in keys]
    before, after = [c for c in fields if c < map_name], [c for c in fields if c > map_name]
    start = F.concat(F.lit("{"), _bare(heads, before), F.lit(f',"{map_name}":{{' if before else f'"{map_name}":{{'))
    end = F.concat(F.lit("},"), _bare(heads, after), F.lit("}")) if after else F.lit("}}")
    named = heads.select(*keys, "name", canonical_json(heads, sorted(keys)).alias("document"), start.alias("start"), end.alias("end"))
    joined = durable(named.join(by_document, "document", "left"))
    source, target = arrow_uri(parts_at).rstrip("/"), arrow_uri(root).rstrip("/")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        store, folder = pafs.FileSystem.from_uri(target)
        held, parts = pafs.FileSystem.from_uri(source)
        for batch in batches:
            for document, name, start, end, listed in zip(*(c.to_pylist() for c in batch.columns)):
                path, digest, length = f"{folder}/{name}", hashlib.sha256(), 0
                half = f"{path}.{uuid.uuid4().hex}.tmp"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(half, compression=None) as out:
                    for data in _texts(held, parts, start, listed or [], end):
                        out.write(data)
                        digest.update(data)
                        length += len(data)
                store.move(half, path)
                row = [[document], [name], [length], [digest.hexdigest()]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in row], names=["document", "name", "length", "file_sha256"])

    whole = joined.where(~F.coalesce("repeated", F.lit(False))).select("document", "name", "start", "end", "pieces")
    written = durable(whole.repartition("document").mapInArrow(assemble, _WRITTEN)).drop("name")
    zero = F.lit(0).cast("bigint")
    reason = first_reason(("duplicate", F.coalesce("repeated", F.lit(False))))
    return joined.join(written, "document", "left").select(
        *keys, "name", "length", "file_sha256", F.coalesce("entries", zero).alias("entries"), F.coalesce("total", zero).alias("total"), reason.alias("reason")
    )


def _texts(store, folder: str, start: str, pieces: list[dict], end: str) -> Iterator[bytes]:
    yield start.encode()
    for k, piece in enumerate(pieces):
        if k:
            yield b","
        with store.open_input_file(f"{folder}/{piece['file']}") as stream:
            stream.seek(piece["at"])
            left = piece["length"]
            while left:
                data = stream.read(min(left, COPY_BYTES))
                if not data:
                    raise OSError(f"{piece['file']} ends early")
                left -= len(data)
                yield data
    yield end.encode()
