"""JSON documents read as whole files, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daykeeper.functions.digests import sha256
from daykeeper.functions.paths import file_name
from daykeeper.functions.rules import first_reason
from daykeeper.schemas import EVIDENCE, MANIFEST, SIDECAR
from daykeeper.sources.folders import read_documents


def read_files(spark: SparkSession, path: str, name_glob: str | None = None, recursive: bool = True) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    return reader.load(path)


def utf8(content: Column) -> Column:
    """Text of the bytes, NULL when they are not UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def parse_manifest(raw: Column) -> Column:
    """The manifest document of raw bytes; NULL when the whole text is not JSON."""
    text = utf8(raw)
    return F.from_json(F.when(F.try_parse_json(text).isNotNull(), text), MANIFEST, {"mode": "PERMISSIVE"})


def manifest_columns(files: DataFrame) -> DataFrame:
    """Adds digest, size and parsed document to rows with a binary ``raw`` column."""
    text = utf8(F.col("raw"))
    variant = F.try_parse_json(text)
    with_text = files.withColumns(
        {
            "raw_sha256": sha256(F.col("raw")),
            "raw_size": F.octet_length("raw").cast("bigint"),
            "is_json": F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False)),
            # A string "true" is not the boolean true: the variant keeps the JSON type.
            "retention_delete_allowed": F.coalesce(
                F.schema_of_variant(F.try_variant_get(variant, "$.retention_delete_allowed", "variant")) == "BOOLEAN",
                F.lit(False),
            )
            & F.coalesce(F.try_variant_get(variant, "$.retention_delete_allowed", "boolean"), F.lit(False)),
            "doc": parse_manifest(F.col("raw")),
        }
    )
    return with_text.select(
        *files.columns,
        "raw_sha256",
        "raw_size",
        "is_json",
        "retention_delete_allowed",
        F.col("doc.contract_version").alias("contract_version"),
        F.col("doc.status").alias("status"),
        F.col("doc.archive_date").alias("doc_archive_date"),
        F.col("doc.object_count").alias("object_count"),
        F.col("doc.row_count").alias("row_count"),
        F.col("doc.objects").alias("objects"),
    )


def read_manifests(spark: SparkSession, path: str, name_glob: str = "manifest.json") -> DataFrame:
    """Manifest files with raw bytes, digest, size and parsed document.

    ``replica``, ``collector`` and ``archive_date`` come from the ``replica=``, ``collector=`` and
    ``date=`` folders, in that order, of which any may be missing. Filters on them choose folders before
    any file is opened.
    """
    files = read_documents(spark, path, glob=name_glob)
    return manifest_columns(files.select("collector", "replica", F.col("date").alias("archive_date"), F.col("content").alias("raw")))


def read_object_meta(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """Sidecar files; the embedded key must equal the sidecar's own path below ``path``. Filters on ``replica``,
    ``collector`` and ``archive_date`` choose folders before any file is opened."""
    files = read_documents(spark, path, glob=f"*{suffix}")
    inside = F.regexp_extract(F.col("path"), r"/(date=\d{4}-\d{2}-\d{2}/.*)$", 1)
    meta = F.from_json(utf8(F.col("content")), SIDECAR)
    rows = files.select(
        F.coalesce("collector", F.lit("")).alias("collector"),
        "replica",
        F.col("date").alias("archive_date"),
        F.substring(inside, F.lit(1), F.length(inside) - len(suffix)).alias("relative_key"),
        meta.alias("meta"),
    )
    return rows.select(
        "collector",
        "relative_key",
        F.col("meta.size_bytes").alias("size_bytes"),
        F.col("meta.sha256").alias("sha256"),
        first_reason(
            ("meta_invalid", F.col("meta.relative_key").isNull()),
            ("meta_path", F.col("meta.relative_key") != F.col("relative_key")),
        ).alias("reason"),
        "replica",
        "archive_date",
    )


def _named_documents(spark: SparkSession, path: str, name_glob: str, collector: str | None, prefix: str | None) -> DataFrame:
    files = read_documents(spark, path, "collector?", name_glob)
    files = files if collector is None else files.where(F.col("collector") == collector)
    return files if prefix is None else files.where(F.startswith("name", F.lit(prefix)))


def read_reports(
    spark: SparkSession, path: str, name_glob: str = "*.json", max_bytes: int | None = None, collector: str | None = None, prefix: str | None = None
) -> DataFrame:
    """All reports below ``path``; unreadable ones stay as rows with a reason. ``collector`` and ``prefix`` of the file
    name (as ``plan-2024-01-02``) leave other files unopened."""
    return report_rows(_named_documents(spark, path, name_glob, collector, prefix).select("path", "modified", "length", "content"), max_bytes)


def report_rows(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Rows with path, modified, length, content -> name, payload (VARIANT), raw text and reason.

    Documents of any size are read. ``max_bytes`` is a rule of the caller: longer ones get the reason
    ``too_large`` and keep their payload.
    """
    fits = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    parsed = files.withColumn("raw", utf8(F.col("content"))).withColumn("payload", F.try_parse_json("raw"))
    is_object = F.coalesce(F.schema_of_variant("payload").startswith("OBJECT"), F.lit(False))
    return parsed.select(
        "path",
        file_name(F.col("path")).alias("name"),
        "modified",
        "length",
        F.when(is_object, F.col("raw")).alias("raw"),
        F.when(is_object, F.col("payload")).alias("payload"),
        first_reason(
            ("too_large", ~fits),
            ("bad_json", F.col("payload").isNull()),
            ("not_object", ~is_object),
        ).alias("reason"),
    )


def read_evidence(
    spark: SparkSession, path: str, kind: str, name_glob: str = "*.json", max_bytes: int | None = None, collector: str | None = None, prefix: str | None = None
) -> DataFrame:
    """Evidence documents of one kind: typed columns, file name, file digest and a reason. ``collector`` and ``prefix``
    as in ``read_reports``."""
    rows = _named_documents(spark, path, name_glob, collector, prefix).select("path", "modified", "length", "content")
    return evidence_columns(report_rows(rows, max_bytes), kind)


def evidence_columns(rows: DataFrame, kind: str) -> DataFrame:
    typed = rows.withColumn("_doc", F.from_json("raw", EVIDENCE[kind]))
    return typed.select(
        F.col("name").alias("file_name"), "modified", "reason", sha256(F.col("raw")).alias("file_sha256"), "_doc.*"
    )


def missing_evidence(wanted: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the reason ``missing`` for wanted keys without a document."""
    found = evidence.withColumn("_found", F.lit(True))
    joined = wanted.join(found, keys, "left")
    return joined.withColumn(
        "reason", F.when(F.col("_found").isNull(), F.lit("missing")).otherwise(F.col("reason"))
    ).drop("_found")
