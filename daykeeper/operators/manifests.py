"""Manifest rules and totals.

Entries are checked inside the document's own array, so validation is a narrow projection: no
explode, no shuffle, whatever the number of manifests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daykeeper.contracts import DEFAULT_CONTRACTS, SHA256_PATTERN, Contracts
from daykeeper.functions.paths import relative_key_reason, strip_slashes
from daykeeper.functions.rules import Rule, differs, first_reason, holds, reasons
from daykeeper.functions.text import safe_int


def _number(value: Column, default: int) -> Column:
    return safe_int(value, default)


def _count(value: Column) -> Column:
    """Missing and empty counts are zero."""
    return safe_int(F.nullif(value, F.lit("")), 0)


def manifest_doc_rules(contracts: Contracts = DEFAULT_CONTRACTS) -> list[Rule]:
    """Document rules in their fixed order."""
    return [
        ("size", differs(F.col("raw_size"), F.col("declared_size"))),
        ("sha256", differs(F.col("raw_sha256"), F.col("declared_sha256"))),
        ("bad_json", ~F.col("is_json")),
        ("contract", differs(F.col("contract_version"), F.lit(contracts.manifest))),
        ("status", differs(F.col("status"), F.lit("verified"))),
        ("retention", ~F.col("retention_delete_allowed")),
        ("date", differs(F.col("doc_archive_date"), F.col("archive_date"))),
        ("objects", F.col("objects").isNull()),
        ("object_count", F.size("objects") != _number(F.col("object_count"), -1)),
    ]


def check_manifest_doc(manifests: DataFrame, contracts: Contracts = DEFAULT_CONTRACTS) -> DataFrame:
    """Adds ``reasons``, all failed document rules in rule order."""
    return manifests.withColumn("reasons", reasons(*manifest_doc_rules(contracts)))


def _repeats(keys: Column) -> Column:
    """Indexes (from 0) of keys that occurred before in the array; empty without repeats."""
    ranked = F.array_sort(F.transform(keys, lambda key, i: F.struct(key.alias("k"), i.alias("i"))))
    repeats = F.filter(
        F.transform(
            F.slice(ranked, 2, F.size(ranked)),
            lambda entry, j: F.when(entry["k"] == F.get(ranked, j)["k"], entry["i"]),
        ),
        lambda i: i.isNotNull(),
    )
    none = F.array().cast("array<int>")
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), repeats).otherwise(none)


def _entry_reason(item: Column, index: Column, archive_date: Column, repeats: Column) -> Column:
    row_count = F.nullif(item["row_count"], F.lit(""))
    return F.coalesce(
        relative_key_reason(item["relative_key"], archive_date),
        F.when(F.array_contains(repeats, index), F.lit("duplicate_key"))
        .when(_number(item["size_bytes"], -1) < 0, F.lit("entry_size"))
        .when(~holds(item["sha256"].rlike(SHA256_PATTERN)), F.lit("entry_sha256"))
        .when(row_count.isNotNull() & safe_int(row_count, -1).eqNullSafe(-1) & (row_count != "-1"), F.lit("entry_rows")),
    )


def _stripped_keys() -> Column:
    return F.transform("objects", lambda item: strip_slashes(item["relative_key"]))


def _entry_reasons() -> Column:
    repeats = F.col("_repeats")
    return F.transform("objects", lambda item, i: _entry_reason(item, i, F.col("archive_date"), repeats))


def check_manifest_entries(manifests: DataFrame) -> DataFrame:
    """One row per entry in manifest order, with the entry's first failed rule."""
    marked = manifests.withColumn("_repeats", _repeats(_stripped_keys())).withColumn("_reasons", _entry_reasons())
    exploded = marked.select(
        "collector", "replica", "archive_date", "_reasons", F.posexplode("objects").alias("pos", "item")
    )
    return exploded.select(
        "collector",
        "replica",
        "archive_date",
        F.col("pos").cast("bigint").alias("pos"),
        strip_slashes(F.col("item.relative_key")).alias("relative_key"),
        F.col("item.kind").alias("kind"),
        F.col("item.table_name").alias("table_name"),
        safe_int(F.col("item.size_bytes"), -1).alias("size_bytes"),
        F.col("item.sha256").alias("sha256"),
        _count(F.col("item.row_count")).alias("row_count"),
        F.col("item.schema_sha256").alias("schema_sha256"),
        F.col("item.content_sha256").alias("content_sha256"),
        F.get("_reasons", F.col("pos")).alias("reason"),
    )


def manifest_totals(manifests: DataFrame) -> DataFrame:
    """Entry count, row sum and byte sum of each manifest beside the declared numbers."""

    def total(field: str) -> Column:
        return F.aggregate("objects", F.lit(0).cast("bigint"), lambda acc, item: acc + _count(item[field]))

    return manifests.select(
        "collector",
        "replica",
        "archive_date",
        F.coalesce(F.size("objects"), F.lit(0)).cast("bigint").alias("entries"),
        F.coalesce(total("row_count"), F.lit(0).cast("bigint")).alias("entry_rows"),
        F.coalesce(total("size_bytes"), F.lit(0).cast("bigint")).alias("entry_bytes"),
        _number(F.col("object_count"), -1).alias("declared_objects"),
        _number(F.col("row_count"), -1).alias("declared_rows"),
    )


def validate_manifests(manifests: DataFrame, contracts: Contracts = DEFAULT_CONTRACTS) -> DataFrame:
    """Adds ``reason``, the first failed rule of the whole chain: document, entries, row total."""
    total_rows = F.aggregate(
        "objects", F.lit(0).cast("bigint"), lambda acc, item: acc + _count(item["row_count"])
    )
    first_entry = F.get(F.filter("_reasons", lambda reason: reason.isNotNull()), F.lit(0))
    return (
        manifests.withColumn("_doc_reason", first_reason(*manifest_doc_rules(contracts)))
        .withColumn("_repeats", _repeats(_stripped_keys()))
        .withColumn("_reasons", _entry_reasons())
        .withColumn(
            "reason",
            F.coalesce(
                "_doc_reason",
                first_entry,
                F.when(total_rows != _number(F.col("row_count"), -1), F.lit("row_total")),
            ),
        )
        .drop("_doc_reason", "_repeats", "_reasons")
    )


def manifest_objects(manifests: DataFrame) -> DataFrame:
    """Entries of manifests that were found valid, in manifest order."""
    return check_manifest_entries(manifests).drop("reason")
