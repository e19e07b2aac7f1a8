"""Pruned document readers and listings in tasks: what is read, what is not, and equality with plain walks."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains, StringStartsWith

from daykeeper.sources import folders, tree
from daykeeper.sources.documents import read_evidence, read_manifests, read_object_meta, read_reports
from daykeeper.sources.tables import list_objects


@pytest.fixture
def archive(tmp_path):
    for replica in ("r2", "google_drive"):
        for collector in ("a", "b", "007"):
            for day in range(1, 13):
                place = tmp_path / f"replica={replica}/collector={collector}/date=2024-01-{day:02}"
                (place / "raw").mkdir(parents=True)
                (place / "manifest.json").write_text('{"objects": [], "status": "verified"}')
                (place / "raw/x.parquet.meta").write_text("{}")
                (place / "_temporary").mkdir()
                (place / "_temporary/manifest.json").write_text("half")
    return tmp_path


def opened(reader, filters, monkeypatch):
    """The files that a reader opens under the filters, and the filters that it hands back."""
    seen = []
    plain = folders.read_file
    monkeypatch.setattr(folders, "read_file", lambda store, path: seen.append(path) or plain(store, path))
    back = list(reader.pushFilters(filters))
    rows = sum(batch.num_rows for part in reader.partitions() for batch in reader.read(part))
    monkeypatch.undo()
    assert rows == len(seen)
    return seen, back


def test_one_day_of_one_collector_opens_only_its_files(archive, monkeypatch):
    make = lambda **more: folders.DocumentReader({"path": str(archive), "glob": "manifest.json", **more})
    assert len(opened(make(), [], monkeypatch)[0]) == 72
    day = [EqualTo(("collector",), "a"), EqualTo(("date",), "2024-01-05")]
    seen, back = opened(make(), day, monkeypatch)
    assert sorted(seen) == sorted(str(archive / f"replica={r}/collector=a/date=2024-01-05/manifest.json") for r in ("google_drive", "r2")) and not back
    some = [In(("date",), ("2024-01-02", "2024-01-03", "2024-02-01")), EqualTo(("replica",), "r2")]
    assert len(opened(make(days_together="1"), some, monkeypatch)[0]) == 6
    spans = [GreaterThanOrEqual(("date",), "2024-01-04"), LessThan(("date",), "2024-01-06"), StringContains(("name",), "x")]
    seen, back = opened(make(), spans, monkeypatch)
    assert len(seen) == 12 and back == spans[2:]
    assert opened(make(), [EqualTo(("collector",), "zz")], monkeypatch)[0] == []
    assert opened(make(glob="*"), [StringStartsWith(("name",), "x.")], monkeypatch)[0].__len__() == 72


def test_folders_that_do_not_pass_are_never_listed(archive, monkeypatch):
    import pyarrow.fs as pafs

    reader = folders.DocumentReader({"path": str(archive), "glob": "manifest.json"})
    list(reader.pushFilters([EqualTo(("replica",), "r2"), EqualTo(("collector",), "a"), EqualTo(("date",), "2024-01-05")]))
    listed = []

    class Store:
        def __init__(self, store):
            self.store = store

        def get_file_info(self, what):
            listed.extend([what.base_dir] if isinstance(what, pafs.FileSelector) else [])
            return self.store.get_file_info(what)

        def open_input_stream(self, path):
            return self.store.open_input_stream(path)

    plain = reader._store
    reader._store = lambda: (Store(plain()[0]), plain()[1])
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1
    assert listed == [str(archive / "replica=r2/collector=a/date=2024-01-05")]


def test_filters_reach_the_source_through_the_readers(spark, archive):
    manifests = read_manifests(spark, str(archive))
    assert manifests.count() == 72 and {r["collector"] for r in manifests.collect()} == {"a", "b", "007"}
    one = manifests.where("collector = '007' and archive_date = '2024-01-05' and replica = 'r2'")
    assert [(r["replica"], r["collector"], r["archive_date"], r["is_json"]) for r in one.collect()] == [("r2", "007", "2024-01-05", True)]
    # A file of another day that cannot be opened does no harm.
    broken = archive / "replica=r2/collector=b/date=2024-01-09/manifest.json"
    broken.unlink()
    os.mkfifo(broken)
    broken_day = archive / "replica=r2/collector=b/date=2024-01-10/manifest.json"
    broken_day.unlink()
    assert one.count() == 1 and manifests.where("collector = 'b' and archive_date < '2024-01-03'").count() == 4
    sidecars = read_object_meta(spark, str(archive), ".meta").where("archive_date in ('2024-01-01', '2024-01-02') and collector = 'a'")
    assert sorted((r["replica"], r["relative_key"], r["reason"]) for r in sidecars.collect()) == sorted(
        (r, f"date=2024-01-0{d}/raw/x.parquet", "meta_invalid") for r in ("r2", "google_drive") for d in (1, 2)
    )


def test_reports_of_a_collector_and_a_name(spark, tmp_path):
    for collector in ("a", "b"):
        (tmp_path / f"collector={collector}").mkdir()
        for name in ("plan-2024-01-02-x.json", "plan-2024-01-03-x.json", "receipt-2024-01-02.json"):
            (tmp_path / f"collector={collector}" / name).write_text('{"status": "ready"}')
    assert read_reports(spark, str(tmp_path)).count() == 6
    assert [r["name"] for r in read_reports(spark, str(tmp_path), collector="a", prefix="plan-2024-01-03").collect()] == ["plan-2024-01-03-x.json"]
    assert {(r["file_name"], r["status"]) for r in read_evidence(spark, str(tmp_path), "plan", collector="b", prefix="plan-").collect()} == {
        ("plan-2024-01-02-x.json", "ready"), ("plan-2024-01-03-x.json", "ready")
    }
    assert read_reports(spark, str(tmp_path), collector="c").count() == 0


def plain_walk(root):
    out = []
    for place, names, files in os.walk(root):
        names[:] = [n for n in names if not tree._hidden(n)]
        out += [(os.path.relpath(os.path.join(place, f), root), os.path.getsize(os.path.join(place, f))) for f in files if not tree._hidden(f)]
    return sorted(out)


def test_listings_equal_a_plain_walk(spark, archive, monkeypatch):
    monkeypatch.setattr(tree, "FILES_TOGETHER", 40)
    monkeypatch.setattr(tree, "BATCH_ROWS", 7)
    (archive / "flat").mkdir()
    for k in range(300):
        (archive / "flat" / f"n{k:03}").write_bytes(b"x" * k)
    listed = list_objects(spark, str(archive))
    assert sorted((r["key"], r["size_bytes"]) for r in listed.collect()) == plain_walk(archive)
    assert all(r["modified"] for r in listed.collect())
    # The folder with most names is split by name.
    facts = tree.with_facts(listed.where(F.startswith("key", F.lit("flat/"))), str(archive))
    assert facts.withColumn("part", F.spark_partition_id()).select("part").distinct().count() > 4
    assert list_objects(spark, str(archive), "n0?9").count() == 10 and list_objects(spark, str(archive), "*.json").count() == 72
    kept = tree.list_tree(spark, str(archive), keep=lambda f: f.where(~F.col("key").contains("replica=r2")))
    assert sorted(r["key"] for r in kept.collect()) == [k for k, _ in plain_walk(archive) if not k.startswith("replica=r2")]
    (archive / "none").mkdir()
    assert list_objects(spark, str(archive / "none")).count() == 0


def test_days_from_folder_names(spark, archive):
    got = tree.list_folders(spark, str(archive), ("replica", "collector", "date"))
    assert got.count() == 72 and got.columns == ["replica", "collector", "date"]
    one = tree.list_folders(spark, str(archive), ("replica", "collector", "date"), keep=lambda f: f.where("key not like '%collector=%' or key like '%collector=007%'"))
    assert one.where("collector = '007'").count() == 24
