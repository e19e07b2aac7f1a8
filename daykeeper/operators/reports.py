"""The report browser as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daykeeper.contracts import KIND_LABELS
from daykeeper.functions.labels import report_date, report_kind, report_severity, report_state, report_time
from daykeeper.functions.text import compact_text, label, safe_int

# Fields that hold a report's time, in the order they are looked at.
STAMPS = ["verified_at", "completed_at", "generated_at", "created_at"]


def _field(name: str, type_name: str = "string") -> Column:
    return F.try_variant_get("payload", f"$.{name}", type_name)


def report_index(reports: DataFrame) -> DataFrame:
    """One row per report, newest file first: kind, day, state, counts, time."""
    broken = F.col("reason").isNotNull()
    kind = report_kind(F.col("name"))
    listed = F.coalesce(F.size(_field("objects", "array<variant>")), F.lit(0)).cast("bigint")
    return reports.select(
        "path",
        "name",
        "modified",
        "reason",
        kind.alias("kind"),
        report_date(_field("archive_date"), F.col("name")).alias("archive_date"),
        report_state(kind, _field("status"), broken).alias("state"),
        report_severity(kind, _field("status"), broken).alias("severity"),
        safe_int(_field("object_count"), listed).alias("object_count"),
        safe_int(_field("row_count"), 0).alias("row_count"),
        report_time([_field(name) for name in STAMPS], F.col("modified")).alias("reported_at"),
    ).orderBy(F.desc("modified"), "path")


def report_index_counts(reports: DataFrame) -> DataFrame:
    broken = F.col("reason").isNotNull()
    return reports.agg(
        F.count(F.lit(1)).alias("reports"),
        F.count_if(~broken).alias("readable"),
        F.count_if(broken).alias("broken"),
    )


def report_objects(reports: DataFrame) -> DataFrame:
    """The objects of readable reports, one row each, with kind label and short digest.

    Entries that are not JSON objects are passed over; the others keep their place in the list.
    """
    listed = reports.where(F.col("reason").isNull()).select(
        "path", F.posexplode(_field("objects", "array<variant>")).alias("pos", "entry")
    )
    parsed = listed.where(F.schema_of_variant("entry").startswith("OBJECT"))

    def item(name: str) -> Column:
        return F.try_variant_get("entry", f"$.{name}", "string")

    digest = F.coalesce(item("sha256"), F.lit(""))
    dash = F.lit("--")
    kind = item("kind")
    return parsed.select(
        "path",
        F.col("pos").cast("bigint").alias("pos"),
        F.coalesce(label(KIND_LABELS, kind), dash).alias("kind"),
        F.coalesce(item("table_name"), dash).alias("table_name"),
        F.coalesce(item("relative_key"), dash).alias("relative_key"),
        safe_int(item("row_count")).alias("row_count"),
        safe_int(item("size_bytes")).alias("size_bytes"),
        F.when(F.length(digest) > 16, F.concat(F.left(digest, F.lit(16)), F.lit("…"))).otherwise(digest).alias("digest"),
    )


def report_object_totals(reports: DataFrame) -> DataFrame:
    return report_objects(reports).groupBy("path").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("size_bytes").alias("total_bytes")
    )


def report_fields(reports: DataFrame, limit: int = 180) -> DataFrame:
    """Key/value rows of each readable document; nested values stay JSON text.

    Booleans and null show as ``True``, ``False`` and ``None``. ``rank`` is the place of the field in the
    order of the document's names, from 1.
    """
    named = F.map_entries(F.from_json("raw", "map<string,string>"))
    fields = F.posexplode(F.array_sort(named)).alias("place", "pair")
    # The text of a JSON boolean and that of the string "true" are the same; the variant tells them apart.
    flags = F.map_filter(F.from_json("raw", "map<string,variant>"), lambda _, v: F.schema_of_variant(v) == "BOOLEAN")
    flags = F.map_keys(flags)
    rows = reports.where(F.col("reason").isNull()).select("path", flags.alias("flags"), fields)
    value = F.when(F.array_contains("flags", F.col("pair.key")), F.initcap("pair.value")).otherwise(F.col("pair.value"))
    shown = compact_text(F.coalesce(value, F.lit("None")), limit)
    return rows.select("path", F.col("pair.key").alias("field"), (F.col("place") + 1).cast("bigint").alias("rank"), shown.alias("value"))
