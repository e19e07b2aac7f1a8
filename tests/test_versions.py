"""Days published by pointer: whole before and after, conflicts, stopped publications, sweeping."""

import pytest

from daykeeper.sources import versions
from daykeeper.sources.versions import VersionConflict, compact_log, current_versions, orphans, publish_versions, read_versions, sweep, write_version

ROWS = "collector STRING, archive_date STRING, v INT"
VERDICT = "collector STRING, archive_date STRING, status STRING"


def of(spark, day, *values):
    return spark.createDataFrame([("007", day, v) for v in values], ROWS)


def good(spark, *days):
    return spark.createDataFrame([("007", d, "verified") for d in days], VERDICT)


def held(spark, root):
    return sorted((r["archive_date"], r["v"]) for r in read_versions(spark, root).collect())


def test_a_publication_that_stops_leaves_the_old_day(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    first = of(spark, "2024-01-01", 1, 2).unionByName(of(spark, "2024-01-02", 3)).unionByName(of(spark, "2024-01-03", 4))
    failed = spark.createDataFrame([("007", "2024-01-03", "failed")], VERDICT)
    assert publish_versions(first, good(spark, "2024-01-01", "2024-01-02").unionByName(failed), root) == 1
    whole = [("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-02", 3)]
    assert held(spark, root) == whole and {r["collector"] for r in read_versions(spark, root).collect()} == {"007"}
    # Rows and pointers are written, the log entry is not.
    write_version(of(spark, "2024-01-01", 9), good(spark, "2024-01-01"), root)
    assert held(spark, root) == whole
    # The claim is there, the entry is not: the next publication takes the next number.
    (tmp_path / "log/.claims/000000000002").touch()
    assert publish_versions(of(spark, "2024-01-02", 30, 31), good(spark, "2024-01-02"), root) == 3
    assert held(spark, root) == [("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-02", 30), ("2024-01-02", 31)]
    assert {r["archive_date"]: r["entry"] for r in current_versions(spark, root).collect()} == {"2024-01-01": 1, "2024-01-02": 3}
    assert all('"status":"verified"' in r["report"] for r in current_versions(spark, root).collect())


def test_conflicts_are_of_days(spark, tmp_path):
    root = str(tmp_path)
    publish_versions(of(spark, "2024-01-01", 1), good(spark, "2024-01-01"), root)
    seen = versions.last_entry(spark, root)
    publish_versions(of(spark, "2024-01-01", 2), good(spark, "2024-01-01"), root, seen)
    with pytest.raises(VersionConflict):
        publish_versions(of(spark, "2024-01-01", 3), good(spark, "2024-01-01"), root, seen)
    publish_versions(of(spark, "2024-01-02", 4), good(spark, "2024-01-02"), root, seen)
    assert held(spark, root) == [("2024-01-01", 2), ("2024-01-02", 4)]
    assert versions._commit(spark, root, 1, "x") is False


def test_orphans_are_swept(spark, tmp_path):
    root = str(tmp_path)
    publish_versions(of(spark, "2024-01-01", 1).unionByName(of(spark, "2024-01-02", 2)), good(spark, "2024-01-01", "2024-01-02"), root)
    publish_versions(of(spark, "2024-01-01", 5), good(spark, "2024-01-01"), root)
    stopped, _ = write_version(of(spark, "2024-01-03", 6), good(spark, "2024-01-03"), root)
    live, _ = write_version(of(spark, "2024-01-04", 7), good(spark, "2024-01-04"), root)
    before = held(spark, root)
    assert sorted(r["archive_date"] for r in orphans(spark, root).collect()) == ["2024-01-01", "2024-01-03", "2024-01-04"]
    assert sweep(spark, root, running=[live]) == 2 and held(spark, root) == before == [("2024-01-01", 5), ("2024-01-02", 2)]
    assert [r["version"] for r in orphans(spark, root).collect()] == [live] and sweep(spark, root) == 1 and sweep(spark, root) == 0
    assert stopped != live


def test_a_compacted_log_points_to_the_same(spark, tmp_path):
    root = str(tmp_path)
    assert current_versions(spark, root).count() == 0
    for k in range(3):
        publish_versions(of(spark, f"2024-01-0{k % 2 + 1}", k), good(spark, f"2024-01-0{k % 2 + 1}"), root)
    before = held(spark, root)
    assert compact_log(spark, root) == 4 and held(spark, root) == before == [("2024-01-01", 2), ("2024-01-02", 1)]
    publish_versions(of(spark, "2024-01-02", 8), good(spark, "2024-01-02"), root)
    assert held(spark, root) == [("2024-01-01", 2), ("2024-01-02", 8)]
