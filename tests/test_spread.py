"""Files are read by as many tasks as their number asks for, not by as few as the bytes of their names fill."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from daykeeper.sources import folders, large_objects, tables
from daykeeper.sources.large_objects import observe_large_objects
from daykeeper.sources.tables import arrow_schema_digest, observe_objects


@pytest.fixture
def held(spark, tmp_path):
    for k in range(100):
        pq.write_table(pa.table({"id": list(range(k % 7))}), tmp_path / f"{k}.parquet", row_group_size=2)
    return spark.range(100).select(
        F.lit("c").alias("collector"), F.lit("2024-01-01").alias("archive_date"), F.col("id").cast("string").alias("relative_key"),
        F.lit("business").alias("kind"), F.concat(F.lit(f"file://{tmp_path}/"), "id", F.lit(".parquet")).alias("uri"),
    )


def most_in_a_task(df):
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def test_observed_objects_are_spread_by_their_number(spark, held):
    seen = observe_objects(held)
    assert seen.rdd.getNumPartitions() == -(-100 // tables.OBJECTS_TOGETHER)
    assert most_in_a_task(seen) < 50
    assert {r["relative_key"]: r["row_count"] for r in seen.collect()} == {str(k): k % 7 for k in range(100)}
    assert arrow_schema_digest(held).count() == 100


def test_row_groups_are_spread_by_their_number(spark, held, monkeypatch):
    together = []
    plain = large_objects.spread_objects

    def spread(named, keys, *more):
        together.append(plain(named, keys, *more))
        return together[-1]

    monkeypatch.setattr(large_objects, "spread_objects", spread)
    whole, apart = observe_objects(held).drop("uri"), observe_large_objects(held)
    assert sorted(map(str, whole.collect())) == sorted(map(str, apart.collect()))
    footers, groups = together
    # Files of 0 to 6 rows in groups of two; an empty file is written with one group.
    assert groups.count() == sum(max(1, -(-(k % 7) // 2)) for k in range(100)) and footers.count() == 100
    assert groups.rdd.getNumPartitions() == -(-groups.count() // tables.OBJECTS_TOGETHER)


@pytest.mark.parametrize("collectors, partitions", [(3, 24), (200, 67)])
def test_many_folders_are_read_together(tmp_path, collectors, partitions):
    for c in range(collectors):
        for day in ("2024-01-01", "2024-01-02"):
            place = tmp_path / f"replica=r2/collector=c{c}/date={day}"
            place.mkdir(parents=True)
            (place / "manifest.json").write_text(f"{c} {day}")
    reader = folders.DocumentReader({"path": str(tmp_path), "glob": "manifest.json"})
    parts = reader.partitions()
    assert len(parts) == partitions
    read = [row for part in parts for batch in reader.read(part) for row in batch.to_pylist()]
    assert sorted((r["collector"], r["date"], r["content"].decode()) for r in read) == sorted(
        (f"c{c}", day, f"{c} {day}") for c in range(collectors) for day in ("2024-01-01", "2024-01-02")
    )
    named = folders.DocumentReader({"path": str(tmp_path), "glob": "manifest.json"})
    assert not list(named.pushFilters([EqualTo(("date",), "2024-01-02")]))
    assert len(named.partitions()) == -(-collectors // folders.DAYS_TOGETHER)
    days = [row["date"] for part in named.partitions() for batch in named.read(part) for row in batch.to_pylist()]
    assert days == ["2024-01-02"] * collectors
