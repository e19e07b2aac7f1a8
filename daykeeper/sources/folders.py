"""Whole documents below ``key=value`` folders, as a data source that prunes folders before a file is opened."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    StringStartsWith,
)

from daykeeper.sources.named import arrow_uri

#: Exact days of one partition, partitions of a folder whose days are not known, bytes of documents in a batch.
DAYS_TOGETHER, SPLITS, BATCH_BYTES = 64, 8, 8_000_000
#: Folders whose days are not known: so many of them are a partition together, once there are ``MANY_FOLDERS``.
FOLDERS_TOGETHER, MANY_FOLDERS = 32, 64

_TESTS = {
    EqualTo: lambda x, v: x == v,
    EqualNullSafe: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
}


@dataclass
class Wanted:
    """What the filters ask of one column: tests by kind, and the exact values where a filter names them."""

    tests: list[tuple[type, object]]

    def takes(self, value: str | None) -> bool:
        return all(value is not None and (kind is IsNotNull or _TESTS[kind](value, given)) for kind, given in self.tests)

    @property
    def exact(self) -> list[str] | None:
        named = [given if kind is In else (given,) for kind, given in self.tests if kind in (EqualTo, EqualNullSafe, In)]
        return sorted(v for v in set(named[0]) if self.takes(v)) if named else None


@dataclass
class Folders(InputPartition):
    """Folders with the values of the levels above the last, and which folders of the last level to read: those
    named, or a share (of ``shares``) of those that are there."""

    places: tuple[tuple[str, tuple[str | None, ...]], ...]
    named: tuple[str, ...] | None
    share: int = 0
    shares: int = 1


class DocumentReader(DataSourceReader):
    """Reads in three steps: levels above the last are walked by the planner (named values without listing),
    folders of the last level by the tasks, files by the tasks only where their name is wanted."""

    def __init__(self, options: dict):
        self.root = options["path"]
        levels = [x.strip() for x in options.get("levels", "replica,collector,date").split(",") if x.strip()]
        self.levels = [x.rstrip("?") for x in levels]
        self.optional = [x.endswith("?") for x in levels]
        self.glob = options.get("glob", "*")
        self.deep = options.get("recursive", "true").lower() == "true"
        self.days = int(options.get("days_together", DAYS_TOGETHER))
        self.splits = int(options.get("splits", SPLITS))
        self.wanted = {name: Wanted([]) for name in (*self.levels, "name")}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802 - Spark's name
        for one in filters:
            column = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
            given = getattr(one, "value", None)
            if column in self.wanted and (type(one) is IsNotNull or (type(one) in _TESTS and given is not None)):
                self.wanted[column].tests.append((type(one), given))
            else:
                yield one

    def _store(self):
        import pyarrow.fs as pafs

        return pafs.FileSystem.from_uri(arrow_uri(self.root).rstrip("/") or "/")

    def _below(self, store, folder: str, level: int) -> list[tuple[str, str | None]]:
        """Folders of a level in a folder, with their value; an optional level that is not there is passed over."""
        import pyarrow.fs as pafs

        key, wanted = self.levels[level], self.wanted[self.levels[level]]
        if wanted.exact is not None:
            infos = store.get_file_info([f"{folder}/{key}={v}" for v in wanted.exact])
            return [(i.path, i.base_name[len(key) + 1 :]) for i in infos if i.type == pafs.FileType.Directory]
        infos = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        found = sorted((i.path, i.base_name[len(key) + 1 :]) for i in infos if i.type == pafs.FileType.Directory and i.base_name.startswith(f"{key}="))
        if not found and self.optional[level]:
            return [(folder, None)] if wanted.takes(None) or not wanted.tests else []
        return [(path, value) for path, value in found if wanted.takes(value)]

    def partitions(self) -> list[Folders]:
        store, base = self._store()
        above: list[tuple[str, tuple[str | None, ...]]] = [(base, ())]
        for level in range(len(self.levels) - 1):
            above = [(path, (*values, value)) for folder, values in above for path, value in self._below(store, folder, level)]
        exact = self.wanted[self.levels[-1]].exact if self.levels else None
        # Few folders are read in shares of their days, many in groups of folders: a task for each share of each
        # folder would have next to nothing to do.
        if not self.levels:
            out = [Folders((place,), None) for place in above]
        elif exact is not None:
            together = max(1, self.days // max(1, len(exact)))
            chosen = [tuple(exact[k : k + self.days]) for k in range(0, len(exact), self.days)]
            out = [Folders(places, days) for places in _together(above, together) for days in chosen]
        elif len(above) < MANY_FOLDERS:
            out = [Folders((place,), None, k, self.splits) for place in above for k in range(self.splits)]
        else:
            # At least as many partitions as a few folders would have.
            together = max(1, min(FOLDERS_TOGETHER, len(above) // MANY_FOLDERS))
            out = [Folders(places, None) for places in _together(above, together)]
        return out or [Folders((), ())]

    def _folders(self, store, part: Folders) -> Iterator[tuple[str, tuple[str | None, ...]]]:
        import zlib

        for folder, values in part.places:
            if not self.levels:
                yield folder, ()
                continue
            for path, value in self._below(store, folder, len(self.levels) - 1):
                wanted = value in part.named if part.named is not None else zlib.crc32((value or "").encode()) % part.shares == part.share
                if wanted:
                    yield path, (*values, value)

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        store, base = self._store()
        rows: list[tuple] = []
        size = 0
        for folder, values in self._folders(store, partition):
            infos = store.get_file_info(pafs.FileSelector(folder, recursive=self.deep, allow_not_found=True))
            for info in sorted(infos, key=lambda i: i.path):
                inside = info.path[len(base.rstrip("/")) + 1 :]
                hidden = any(p[0] in "._" and "=" not in p for p in inside.split("/") if p)
                if info.type != pafs.FileType.File or hidden or not fnmatchcase(info.base_name, self.glob) or not self.wanted["name"].takes(info.base_name) and self.wanted["name"].tests:
                    continue
                content = read_file(store, info.path)
                rows.append((*values, f"{self.root.rstrip('/')}/{inside}", info.base_name, info.mtime, len(content), content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        text = [(name, pa.string()) for name in (*self.levels, "path", "name")]
        fields = [*text, ("modified", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _together(places: list, number: int) -> list[tuple]:
    return [tuple(places[k : k + number]) for k in range(0, len(places), number)]


def read_file(store, path: str) -> bytes:
    with store.open_input_stream(path) as stream:
        return stream.read()


class Documents(DataSource):
    """``spark.read.format("daykeeper_documents")``: a row for each file, with its folder levels.

    Options: ``path``; ``levels``, the ``key=`` folders from the root down (``key?`` may be missing and is
    NULL then); ``glob`` of file names; ``recursive`` below the last level; ``days_together`` (named days) and
    ``splits`` (of a folder, while there are few), which size the partitions. Filters on levels and on ``name`` (equality, IN, comparisons,
    prefix) are pushed down: folders that do not pass are never listed, files never opened.
    """

    @classmethod
    def name(cls) -> str:
        return "daykeeper_documents"

    def schema(self) -> str:
        levels = [x.strip().rstrip("?") for x in self.options.get("levels", "replica,collector,date").split(",") if x.strip()]
        return ", ".join([*[f"{x} STRING" for x in levels], "path STRING, name STRING, modified TIMESTAMP, length BIGINT, content BINARY"])

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(dict(self.options))


def read_documents(spark: SparkSession, path: str, levels: str = "replica?,collector?,date?", glob: str = "*", **options: str) -> DataFrame:
    """The documents below ``path``; turns on the push-down of filters to such sources in the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Documents)
    return spark.read.format("daykeeper_documents").options(levels=levels, glob=glob, **options).load(path)
