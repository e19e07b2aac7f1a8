"""WARC files with a two-level capture index: compressed blocks of sorted keys and a sparse directory."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daykeeper.session import durable, scratch_path
from daykeeper.sources.named import arrow_uri

from .url_filter import split_url

#: Payloads from this size on may be stored as revisits.
REVISIT_BYTES = 100
#: An archive is closed at this size; lines in an index block; captures in an index file on the average.
ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 1_000
FILE_LINES = 8_000
#: Index files at most: their first keys (each a key and a name) are sent to every executor. With more captures
#: than this many files of FILE_LINES hold, the files grow, and the directories in them.
MOST_FILES = 50_000

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def capture_key(url: str | None, page_id) -> str:
    """Host labels reversed, path and query, then the page: sorts all pages of a host together."""
    host, _ = split_url(url)
    rest = (url or "").partition("://")[2][len(host) :]
    clean = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", ",".join(reversed(host.split("."))) + ")" + rest)
    return f"{clean} {page_id}"


def _page_name(page_id) -> str:
    """A page's name in records; a null page_id has one that no text can have."""
    return "<urn:page>" if page_id is None else f"<urn:page:{page_id}>"


def write_record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One gzip member. A revisit holds the HTTP head alone, whose Content-Length is the full payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_page_name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_CONTROL.sub(lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {_page_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def read_record(raw: bytes) -> dict:
    """Page, type, payload size, digest and, for a revisit, the page referred to. Checks what it reads."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
    digest = named["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = named["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {named['WARC-Record-ID']}")
    page = lambda name: named[name][len("<urn:page:") : -1] if named.get(name, "<urn:page>") != "<urn:page>" else None
    return {"page": page("WARC-Record-ID"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": page("WARC-Refers-To")}


def _marked(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """Pages with payload, digest and, for revisits, refers_to.

    Only digests of several pages are joined back; they come from a checkpoint, so that adaptive
    execution can split the rows of a payload that very many pages have.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= revisit_bytes).select("payload_digest", "page_id")
    groups = large.groupBy("payload_digest").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = durable(groups.select(F.col("payload_digest").alias("digest"), "first_page"))
    joined = rows.join(groups, rows.payload_digest == groups.digest, "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_page")), F.col("first_page")))


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages as WARC files under ``folder``; returns key, file, offset, length of each record.

    Every task attempt writes under names of its own, and only files that a finished task reports are in
    the result, which is a checkpoint; what a lost attempt left is never read.
    """
    base = arrow_uri(folder).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        store, root = pafs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        stream, name, at = None, "", 0
        for batch in batches:
            keys, files, offsets, lengths = [], [], [], []
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None or at >= archive_bytes:
                    if stream is not None:
                        stream.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    stream = store.open_output_stream(f"{root}/{name}", compression=None)
                raw = write_record(page, url, payload, digest, refers, date)
                stream.write(raw)
                keys.append(capture_key(url, page))
                files.append(name)
                offsets.append(at)
                lengths.append(len(raw))
                at += len(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["key", "file", "offset", "length"],
            )
        if stream is not None:
            stream.close()

    chosen = _marked(pages, revisit_bytes).select("page_id", "url", "payload", "payload_digest", "refers_to")
    return durable(chosen.mapInArrow(run, "key string, file string, offset bigint, length bigint"))


def index_files(captures: int, file_lines: int = FILE_LINES, most: int = MOST_FILES) -> int:
    return max(1, min(most, -(-captures // file_lines)))


def write_index(captures: DataFrame, folder: str, file_lines: int = FILE_LINES, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorted index files of compressed blocks, each with a directory of the first key of every block.

    Returns one row per index file: its first key, name, and where its directory lies. The keys hold the
    page, so a range partitioning splits even the pages of a single url.
    """
    base = arrow_uri(folder).rstrip("/")
    parts = index_files(captures.count(), file_lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        store, root = pafs.FileSystem.from_uri(base)
        store.create_dir(root, recursive=True)
        name, at, directory, lines, stream = f"{uuid.uuid4().hex}.cdx", 0, [], [], None

        def flush() -> None:
            nonlocal at, lines
            packed = zlib.compress("\n".join(lines).encode())
            directory.append(f"{lines[0].split(chr(9), 1)[0]}\t{at}\t{len(packed)}")
            stream.write(packed)
            at, lines = at + len(packed), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                stream = stream or store.open_output_stream(f"{root}/{name}", compression=None)
                lines.append("\t".join(map(str, row)))
                if len(lines) >= block_lines:
                    flush()
        if stream is None:
            return
        if lines:
            flush()
        packed = zlib.compress("\n".join(directory).encode())
        stream.write(packed)
        stream.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([directory[0].split("\t", 1)[0]]), pa.array([name]), pa.array([at], pa.int64()), pa.array([len(packed)], pa.int64())],
            names=["first_key", "index_file", "directory_at", "directory_length"],
        )

    ordered = captures.select("key", "file", "offset", "length").repartitionByRange(parts, "key").sortWithinPartitions("key")
    return durable(ordered.mapInArrow(run, "first_key string, index_file string, directory_at bigint, directory_length bigint"))


def look_up(index: DataFrame, lookups: DataFrame, folder: str) -> DataFrame:
    """file, offset, length of every capture of the ``key``s in ``lookups``.

    The first keys of the index files are the top level (``write_index`` makes at most MOST_FILES); a task finds the
    file by binary search, reads its directory, finds the block by binary search and reads that range.
    ``lookups`` are sorted, so that each block is read once per task.
    """
    base = arrow_uri(folder).rstrip("/")
    top = sorted(tuple(r) for r in index.collect())
    shared = lookups.sparkSession.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        store, root = pafs.FileSystem.from_uri(base)
        files = shared.value
        firsts = [f[0] for f in files]
        at_file, directory, block_firsts, at_block, lines = -1, [], [], -1, {}

        def read(name: str, offset: int, length: int) -> list[str]:
            with store.open_input_file(f"{root}/{name}") as stream:
                stream.seek(offset)
                return zlib.decompress(stream.read(length)).decode().split("\n")

        def visit(file: int, block: int, key: str, out: list) -> None:
            nonlocal at_file, directory, block_firsts, at_block, lines
            if file != at_file:
                directory = [d.split("\t") for d in read(files[file][1], files[file][2], files[file][3])]
                block_firsts, at_file, at_block = [d[0] for d in directory], file, -1
            if block < 0:
                block = max(0, bisect_right(block_firsts, key) - 1)
            if block != at_block:
                lines = {}
                for line in read(files[file][1], int(directory[block][1]), int(directory[block][2])):
                    k, *place = line.split("\t")
                    lines.setdefault(k, []).append((place[0], int(place[1]), int(place[2])))
                at_block = block
            out += lines.get(key, [])
            # Equal keys (a page listed twice) lie in one index file, but may begin in the block before.
            if block_firsts[block] == key and block > 0:
                visit(file, block - 1, key, out)

        for batch in batches:
            out: list[tuple[str, int, int]] = []
            for key in batch.column(0).to_pylist():
                if files:
                    visit(max(0, bisect_right(firsts, key) - 1), -1, key, out)
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["file", "offset", "length"]
            )

    return lookups.select("key").mapInArrow(run, "file string, offset bigint, length bigint")


def read_archives(places: DataFrame, folder: str, page_type: str) -> DataFrame:
    """The records at (file, offset, length): page_id, payload_bytes, payload_digest, record_type, refers_to.

    ``places`` should be sorted by file and offset; records that lie side by side are read in one range.
    """
    base = arrow_uri(folder).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        store, root = pafs.FileSystem.from_uri(base)
        name, stream = None, None
        for batch in batches:
            rows, out, k = list(zip(*(c.to_pylist() for c in batch.columns))), [], 0
            while k < len(rows):
                last, size = k, rows[k][2]
                while last + 1 < len(rows) and rows[last + 1][0] == rows[k][0] and rows[last + 1][1] == rows[last][1] + rows[last][2] and size < (4 << 20):
                    last += 1
                    size += rows[last][2]
                if rows[k][0] != name:
                    if stream is not None:
                        stream.close()
                    name = rows[k][0]
                    stream = store.open_input_file(f"{root}/{name}")
                stream.seek(rows[k][1])
                data = stream.read(size)
                for _, offset, length in rows[k : last + 1]:
                    a = offset - rows[k][1]
                    out.append(read_record(data[a : a + length]))
                k = last + 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if stream is not None:
            stream.close()

    schema = pa.schema(
        [("page", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())]
    )
    raw = places.select("file", "offset", "length").mapInArrow(run, "page string, record_type string, payload_bytes bigint, payload_digest string, refers_to string")
    return raw.select(F.col("page").cast(page_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(page_type).alias("refers_to"))


def archive_round_trip(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, file_lines: int = FILE_LINES) -> DataFrame:
    """Archives ``pages`` in the shared folder, indexes them, looks every page up and reads its record.

    One row per page row: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is
    an empty payload, a null url an empty one. Rows that repeat page and url are each written and each
    read; with equal payloads they are all responses where their page is the smallest. A null page_id is
    a response only where no row with a page_id has its payload. Empty tables give no rows.
    """
    spark = pages.sparkSession
    records, index = scratch_path(spark, "warc"), scratch_path(spark, "cdx")
    captures = write_archives(pages, records, revisit_bytes)
    directory = write_index(captures, index, file_lines)
    rows = captures.count()
    parts = index_files(rows, file_lines)
    keys = captures.select("key").distinct()
    keys = keys.repartitionByRange(parts, "key").sortWithinPartitions("key")
    places = durable(look_up(directory, keys, index))
    ordered = places.repartitionByRange(max(1, -(-rows // file_lines)), "file", "offset").sortWithinPartitions("file", "offset")
    return read_archives(ordered, records, dict(pages.dtypes)["page_id"])
