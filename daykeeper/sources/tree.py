"""Listings of large trees: folders are expanded in tasks, level by level, and never on the driver."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daykeeper.session import durable
from daykeeper.sources.named import arrow_uri

#: Rows of an Arrow batch that leaves a task, folders of a task, files whose facts a task looks up.
BATCH_ROWS, FOLDERS_TOGETHER, FILES_TOGETHER = 10_000, 16, 20_000

_LISTED = "key STRING, is_dir BOOLEAN, size_bytes BIGINT, modified TIMESTAMP"
_ARROW = pa.schema([("key", pa.string()), ("is_dir", pa.bool_()), ("size_bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])


def _hidden(name: str) -> bool:
    return name[:1] == "." or (name[:1] == "_" and "=" not in name)


def _children(store, base: str, folder: str) -> Iterator[tuple]:
    """Entries of one folder. A local folder is read as a stream of names, without a call for each; a store's listing
    says size and time itself."""
    import pyarrow.fs as pafs

    place = f"{base}/{folder}".rstrip("/") or "/"
    prefix = f"{folder}/" if folder else ""
    if isinstance(store, pafs.LocalFileSystem):
        with os.scandir(place) as entries:
            for entry in entries:
                yield prefix + entry.name, entry.is_dir(), None, None
    else:
        for info in store.get_file_info(pafs.FileSelector(place)):
            is_dir = info.type == pafs.FileType.Directory
            yield prefix + info.base_name, is_dir, None if is_dir else info.size, None if is_dir else info.mtime


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)


def expand(spark: SparkSession, root: str, keep: Callable[[DataFrame], DataFrame] | None = None, depth: int | None = None, hidden: bool = False) -> DataFrame:
    """Everything below ``root`` as key, is_dir, size_bytes, modified; local files have only their names yet.

    A frontier of folders is listed by as many tasks as it needs, the folders among the entries are the
    next frontier, until there are none or ``depth`` levels are read. ``keep`` may drop folders of a
    frontier (column ``key``), which then are never listed. The driver sees one number a level; a level
    is a checkpoint, so that a lost executor repeats no listing of levels above.
    """
    base = arrow_uri(root).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        store, place = pafs.FileSystem.from_uri(base)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = _children(store, place.rstrip("/"), folder)
                yield from _batches(r for r in rows if hidden or not _hidden(r[0].rsplit("/", 1)[-1]))

    frontier, found, level = spark.createDataFrame([("",)], "key STRING"), None, 0
    while depth is None or level < depth:
        listed = durable(frontier.mapInArrow(run, _LISTED))
        found = listed if found is None else found.unionByName(listed)
        frontier = listed.where("is_dir").select("key")
        frontier = keep(frontier) if keep else frontier
        count, level = frontier.count(), level + 1
        if not count:
            break
        frontier = frontier.repartition(max(1, -(-count // FOLDERS_TOGETHER)))
    return found


def with_facts(files: DataFrame, root: str) -> DataFrame:
    """Size and time of local files, looked up in tasks that each hold a range of names: a folder with most names
    is split as well. Rows that have their facts stay as they are; a file that is gone meanwhile goes."""
    base = arrow_uri(root).rstrip("/")
    if not base.startswith("file:"):
        return files
    count = files.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        store, place = pafs.FileSystem.from_uri(base)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            infos = store.get_file_info([f"{place.rstrip('/')}/{k}" for k in keys])
            yield from _batches((k, False, i.size, i.mtime) for k, i in zip(keys, infos) if i.type == pafs.FileType.File)

    spread = files.select("key").repartitionByRange(max(1, -(-count // FILES_TOGETHER)), "key")
    return spread.mapInArrow(run, _LISTED)


def list_tree(spark: SparkSession, root: str, name_glob: str | None = None, keep: Callable[[DataFrame], DataFrame] | None = None, hidden: bool = False) -> DataFrame:
    """key (below ``root``), size_bytes, modified of every file. Contents are not read.

    Names with a leading dot, or underscore without ``=``, are left out unless ``hidden``; an empty or
    missing root gives no row or the store's error. File names may be matched by a glob.
    """
    files = expand(spark, root, keep, hidden=hidden).where(~F.col("is_dir"))
    if name_glob:
        name = F.element_at(F.split("key", "/"), -1)
        files = files.where(name.rlike(_as_pattern(name_glob)))
    return with_facts(files, root).select("key", "size_bytes", "modified")


def _as_pattern(glob: str) -> str:
    """The glob (``*``, ``?``, everything else as it is) as an anchored pattern."""
    return r"\A" + "".join(".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E" if c not in "\\" else r"\\" for c in glob) + r"\z"


def list_folders(spark: SparkSession, root: str, levels: tuple[str, ...] = ("collector", "date"), keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The values of ``key=value`` folders down to the last of ``levels``, without listing a file: the days that a
    replica has. ``keep`` as in ``expand``."""
    pattern = "/".join(f"{level}=([^/]+)" for level in levels)
    found = expand(spark, root, keep, depth=len(levels)).where("is_dir")
    values = [F.regexp_extract("key", rf"\A{pattern}\z", k + 1).alias(level) for k, level in enumerate(levels)]
    return found.where(F.col("key").rlike(rf"\A{pattern}\z")).select(*values)
