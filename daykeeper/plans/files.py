"""Queries over real files: tables are archived to the shared folder and read back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daykeeper.contracts import DEFAULT_CONTRACTS, PRIMARY_REPLICA
from daykeeper.functions.canonical import canonical_json
from daykeeper.functions.digests import sha256
from daykeeper.functions.labels import report_kind_label
from daykeeper.operators import digest, reports
from daykeeper.operators.manifests import manifest_objects, validate_manifests
from daykeeper.operators.reconcile import DAY, verify_objects
from daykeeper.operators.rollup import verify_days
from daykeeper.plans import views
from daykeeper.plans.catalog import presence, query, verdicts
from daykeeper.session import durable, scratch_path
from daykeeper.sources import documents as docs
from daykeeper.sources.large_objects import observe_large_objects
from daykeeper.sources.named import arrow_uri, write_named
from daykeeper.sources.sinks import publish_verified_days, read_published, write_report
from daykeeper.sources.tables import arrow_schema_digest, list_objects, observe_objects, scan_day_tables
from daykeeper.sources.tree import list_folders
from daykeeper.sources.versions import publish_versions, read_versions, write_version
from daykeeper.streaming.catchup import Cycle, catch_up_stream, gated_catch_up, read_decisions, read_reports_table

ROW = ["event_id", "event_type", "props", "ts", "user_id", "value"]


def archive_rows(spark: SparkSession, sf: str) -> str:
    """Archives the event rows as one Parquet object per collector day, in event order.

    A collector day holds at most ``views.BLOCK`` rows, so one file each is bounded at any scale.
    """
    path = scratch_path(spark, "archive")
    rows = views.event_rows(spark, sf).select("collector", F.col("archive_date").alias("date"), *ROW)
    placed = rows.repartition("collector", "date").sortWithinPartitions("collector", "date", "event_id")
    placed.write.partitionBy("collector", "date").parquet(path)
    return path


@query
def read_manifests(spark, sf):
    root = scratch_path(spark, "manifests")
    documents = views.manifest_documents(spark, sf)
    place = F.concat(F.lit("replica="), "replica", F.lit("/collector="), "collector", F.lit("/date="), "archive_date")
    write_named(documents.select(F.concat(place, F.lit("/manifest.json")).alias("name"), F.col("raw").alias("content")), root)
    found = docs.read_manifests(spark, root)
    return found.select(
        *DAY, "replica", "raw_sha256", "raw_size", "contract_version", "status", "retention_delete_allowed",
        F.col("object_count").cast("bigint").alias("object_count"), F.size("objects").cast("bigint").alias("entries"),
    )


@query
def read_one_day(spark, sf):
    """The manifests of one day of one collector, of which alone the files are opened."""
    root = scratch_path(spark, "manifests")
    documents = views.manifest_documents(spark, sf)
    place = F.concat(F.lit("replica="), "replica", F.lit("/collector="), "collector", F.lit("/date="), "archive_date")
    write_named(documents.select(F.concat(place, F.lit("/manifest.json")).alias("name"), F.col("raw").alias("content")), root)
    found = docs.read_manifests(spark, root).where("collector = 'c0' and archive_date = '2024-01-03'")
    return found.select(*DAY, "replica", "raw_sha256", F.size("objects").cast("bigint").alias("entries"))


@query
def list_day_folders(spark, sf):
    """The days of every collector from folder names alone."""
    return list_folders(spark, archive_rows(spark, sf)).select("collector", F.col("date").alias("archive_date"))


@query
def scan_days(spark, sf):
    rows = scan_day_tables(spark, archive_rows(spark, sf))
    keyed = rows.withColumn("archive_date", F.col("date").cast("string"))
    return digest.content_digest(
        keyed.withColumn("payload", canonical_json(keyed, ROW)), DAY, ["file_path", "row_index"]
    )


@query
def list_files(spark, sf):
    listed = list_objects(spark, archive_rows(spark, sf), "*.parquet")
    parts = listed.select(
        F.regexp_extract("key", "collector=([^/]+)/", 1).alias("collector"),
        F.regexp_extract("key", "date=([^/]+)/", 1).alias("archive_date"),
        "size_bytes",
    )
    return parts.groupBy(*DAY).agg(F.count(F.lit(1)).alias("files"), F.bool_and(F.col("size_bytes") > 0).alias("sized"))


@query
def read_object_meta(spark, sf):
    root = scratch_path(spark, "sidecars")
    held = views.objects(spark, sf)
    # Sidecars of control objects name another object.
    claimed = F.when(F.col("kind") == "control", F.concat("relative_key", F.lit(".old"))).otherwise(F.col("relative_key"))
    meta = held.select("collector", F.col("relative_key").alias("own_key"), claimed.alias("relative_key"), "sha256", "size_bytes")
    text = canonical_json(meta, ["relative_key", "sha256", "size_bytes"])
    suffix = DEFAULT_CONTRACTS.sidecar_suffix
    name = F.concat(F.lit("collector="), "collector", F.lit("/"), "own_key", F.lit(suffix))
    write_named(meta.select(name.alias("name"), text.alias("content")), root)
    return docs.read_object_meta(spark, root, suffix).select("collector", "relative_key", "size_bytes", "sha256", "reason")


@query
def read_reports(spark, sf):
    root = scratch_path(spark, "reports")
    files = views.report_files(spark, sf)
    write_named(files.select(F.col("path").alias("name"), "content"), root)
    index = reports.report_index(docs.read_reports(spark, root))
    return index.select("name", "reason", report_kind_label(F.col("kind")).alias("kind"), "archive_date", "state", "row_count")


@query
def read_evidence(spark, sf):
    root = scratch_path(spark, "evidence")
    plans = views.plans(spark, sf).select(
        "contract_version", "status", "profile_id", F.col("collector").alias("collector_id"), "archive_date",
        "manifest_sha256", "local_tree_sha256", "file_name",
    )
    fields = [name for name in plans.columns if name != "file_name"]
    name = F.concat(F.lit("collector="), "collector_id", F.lit("/"), "file_name")
    write_named(plans.select(name.alias("name"), canonical_json(plans, fields).alias("content")), root)
    found = docs.read_evidence(spark, root, "plan")
    return found.select("collector_id", "archive_date", "file_name", "file_sha256", "status", "local_tree_sha256", "reason")


@query
def write_reports(spark, sf):
    root = scratch_path(spark, "verdicts")
    write_report(verdicts(spark, sf), root)
    return read_reports_table(spark, root)


@query
def publish_days(spark, sf):
    data, written = scratch_path(spark, "published"), scratch_path(spark, "published-reports")
    rows = views.event_rows(spark, sf).select(*DAY, *ROW)
    publish_verified_days(rows, verdicts(spark, sf), data, written)
    return read_published(spark, data, written).select(*DAY, "event_id")


@query
def publish_by_pointer(spark, sf):
    """Verified days, of which some are published again with fewer rows and some stop half-way."""
    root = scratch_path(spark, "versions")
    rows = views.event_rows(spark, sf).select(*DAY, "dom", "event_id")
    judged = durable(verdicts(spark, sf))
    publish_versions(rows.drop("dom"), judged, root)
    publish_versions(rows.where("dom % 2 = 0 and event_id % 2 = 0").drop("dom"), judged.where(F.dayofmonth(F.col("archive_date").cast("date")) % 2 == 0), root)
    write_version(rows.where("event_id % 3 = 0").drop("dom"), judged, root)
    return read_versions(spark, root).select(*DAY, "event_id")


def archived_objects(spark: SparkSession, sf: str) -> DataFrame:
    """The archived files as object rows with a URI."""
    root = archive_rows(spark, sf)
    listed = list_objects(spark, root, "*.parquet")
    return held_objects(
        listed.select(
            F.regexp_extract("key", "collector=([^/]+)/", 1).alias("collector"),
            F.regexp_extract("key", "date=([^/]+)/", 1).alias("archive_date"),
            F.col("key").alias("name"),
        ),
        root,
    )


def held_objects(files: DataFrame, root: str) -> DataFrame:
    """Files named below ``root`` as business objects of their day."""
    return files.select(
        *DAY,
        F.regexp_replace("name", "^collector=[^/]+/", "").alias("relative_key"),
        F.lit("business").alias("kind"),
        F.concat(F.lit(arrow_uri(root) + "/"), "name").alias("uri"),
    )


@query
def observe_files(spark, sf):
    seen = observe_objects(archived_objects(spark, sf))
    return seen.select(
        *DAY, "row_count", "content_sha256", (F.col("size_bytes") > 0).alias("sized"),
        F.length("schema_sha256").alias("schema_digits"), "reason",
    )


@query
def observe_large_files(spark, sf):
    """The same facts with every file's row groups in tasks of their own."""
    seen = observe_large_objects(archived_objects(spark, sf))
    return seen.select(
        *DAY, "row_count", "content_sha256", (F.col("size_bytes") > 0).alias("sized"),
        F.length("schema_sha256").alias("schema_digits"), "reason",
    )


#: What happens to the one file of a day, or to what its manifest says, by day of month modulo 11.
DAMAGE = {
    1: "missing", 2: "size", 3: "sha256", 4: "unreadable", 5: "rows", 6: "schema", 7: "content_absent", 8: "content", 9: "row_total",
}


@query
def verify_archive(spark, sf):
    """End to end over real files: archive, manifests with true digests, damage, observe, verify, publish.

    One row per collector day: what verification found, and how many rows of the day are published.
    """
    pristine, copy, documents = archive_rows(spark, sf), scratch_path(spark, "damaged"), scratch_path(spark, "true-manifests")
    fate = F.create_map(*[F.lit(x) for pair in DAMAGE.items() for x in pair])[F.dayofmonth(F.col("archive_date").cast("date")) % 11]
    listed = docs.read_files(spark, pristine, "*.parquet").select(
        F.regexp_extract("path", "collector=([^/]+)/", 1).alias("collector"),
        F.regexp_extract("path", "date=([^/]+)/", 1).alias("archive_date"),
        F.regexp_extract("path", "/(collector=.*)$", 1).alias("name"),
        "content",
    )
    broken = (
        F.when(fate == "size", F.expr("substring(content, 1, octet_length(content) - 5)"))
        .when(fate == "sha256", F.concat(F.lit(b"PARX"), F.expr("substring(content, 5)")))
        .when(fate == "unreadable", F.lit(b"not a table"))
        .otherwise(F.col("content"))
    )
    files = listed.withColumn("fate", fate).withColumn("content", broken)
    write_named(files.where(~F.col("fate").eqNullSafe(F.lit("missing"))).select("name", "content"), copy)

    true_facts = observe_objects(held_objects(listed.select(*DAY, "name"), pristine)).withColumn("fate", fate)
    lie = lambda name, kind, other: F.when(F.col("fate") == kind, other).otherwise(F.col(name)).alias(name)
    garbage = F.lit(b"not a table")
    entry = F.struct(
        lie("content_sha256", "content", sha256(F.lit("other"))), F.lit("business").alias("kind"), "relative_key",
        lie("row_count", "rows", F.col("row_count") + 1), lie("schema_sha256", "schema", sha256(F.lit("other"))),
        lie("sha256", "unreadable", F.sha2(garbage, 256)), lie("size_bytes", "unreadable", F.octet_length(garbage).cast("bigint")),
        F.lit("events").alias("table_name"),
    )
    absent = F.when(F.col("fate") == "content_absent", entry.withField("content_sha256", F.lit(None).cast("string"))).otherwise(entry)
    said_rows = F.col("row_count") + F.when(F.col("fate").isin("rows"), 1).otherwise(0)
    bodies = true_facts.select(
        *DAY, F.lit(0).alias("dom"), F.lit(PRIMARY_REPLICA).alias("replica"), F.col("archive_date").alias("doc_date"),
        F.lit(DEFAULT_CONTRACTS.manifest).alias("contract_version"), F.lit(1).cast("bigint").alias("object_count"),
        F.array(absent).alias("objects"), F.lit(True).alias("retention_delete_allowed"), said_rows.alias("row_count"), F.lit("verified").alias("status"),
    )
    place = F.concat(F.lit("replica="), "replica", F.lit("/collector="), "collector", F.lit("/date="), "archive_date", F.lit("/manifest.json"))
    write_named(views.as_documents(bodies).select(place.alias("name"), F.col("raw").alias("content")), documents)

    read = docs.read_manifests(spark, documents).withColumns({"declared_sha256": F.col("raw_sha256"), "declared_size": F.col("raw_size")})
    found = durable(validate_manifests(read).where(F.col("reason").isNull()).drop("reason"))
    entries = manifest_objects(found)
    uri = F.concat(F.lit(arrow_uri(copy) + "/collector="), "collector", F.lit("/"), "relative_key")
    seen = durable(observe_objects(entries.withColumn("uri", uri)))
    verified = verify_objects(entries, seen)
    # The total is a rule of the day: here the caller expects a row more than the entries hold.
    extra = F.when(fate == "row_total", 1).otherwise(0)
    days = found.select(
        *DAY, F.col("raw_sha256").alias("manifest_sha256"), F.col("object_count").cast("bigint").alias("object_count"), (F.col("row_count").cast("bigint") + extra).alias("row_count")
    )
    judged = durable(verify_days(days, verified))
    data, reports_at = scratch_path(spark, "verified"), scratch_path(spark, "verified-reports")
    rows = views.event_rows(spark, sf).select(*DAY, *ROW)
    publish_verified_days(rows, judged, data, reports_at)
    published = read_published(spark, data, reports_at).groupBy(*DAY).agg(F.count(F.lit(1)).alias("published_rows"))
    return judged.select(*DAY, "status", "reason").join(published, DAY, "left").withColumn("published_rows", F.coalesce("published_rows", F.lit(0).cast("bigint")))


@query
def arrow_schemas(spark, sf):
    """Row counts from the footers, and whether all files of a collector share one Arrow schema."""
    held = archived_objects(spark, sf)
    footers = arrow_schema_digest(held.withColumn("relative_key", F.col("uri")))
    collector = F.regexp_extract("relative_key", "collector=([^/]+)/", 1).alias("collector")
    return footers.groupBy(collector).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("row_count").alias("row_count"),
        (F.min("schema_sha256") == F.max("schema_sha256")).alias("one_schema"),
    )


@query
def catch_up(spark, sf):
    """The catch-up cycle over a stream of manifest documents."""
    root, written = scratch_path(spark, "documents"), scratch_path(spark, "catch-up-reports")
    views.manifest_documents(spark, sf).write.parquet(root)
    stored = spark.read.parquet(root)
    stream = spark.readStream.schema(stored.schema).parquet(root)
    catch_up_stream(
        stream,
        lambda: views.observed(spark, sf),
        lambda: views.markers(spark, sf).where("dom % 5 <> 0"),
        written,
        scratch_path(spark, "catch-up-state"),
    )
    return read_reports_table(spark, written)


def gated_cycle(spark: SparkSession, sf: str, require_both: bool) -> DataFrame:
    """The gated cycle over three micro-batches: the second replica of a day comes with the first, or later, or never.

    One row per day that was decided on, with the number of its rows that are visible afterwards.
    """
    root = scratch_path(spark, "arrivals")
    documents = views.manifest_documents(spark, sf)
    first = (F.col("replica") == PRIMARY_REPLICA) | (F.col("dom") % 4 == 0)
    step = F.when(first, 0).when(F.col("dom") % 4 == 1, 1).otherwise(2)
    timed = documents.withColumn("step", step).withColumn("arrived", F.timestamp_add("HOUR", F.col("step") * 30, F.lit("2024-03-01 00:00:00").cast("timestamp")))
    arrivals = durable(timed.drop("dom"))
    schema = arrivals.drop("step").schema
    for k in range(3):
        arrivals.where(F.col("step") == k).drop("step").coalesce(1).write.mode("append").parquet(root)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(root)
    rows = views.event_rows(spark, sf).select(*DAY, *ROW)
    # What every cycle looks up is tables; made anew from the events, each cycle would digest all of them again.
    held, marked = durable(views.observed(spark, sf)), durable(views.markers(spark, sf).where("dom % 3 <> 0"))
    cycle = Cycle(
        observed=lambda: held,
        markers=lambda: marked,
        rows=lambda days: rows.join(days.select(*DAY), DAY, "left_semi"),
        data_path=scratch_path(spark, "caught-up"),
        report_path=scratch_path(spark, "caught-up-reports"),
        decisions_path=scratch_path(spark, "caught-up-decisions"),
        contracts=DEFAULT_CONTRACTS,
        require_both=require_both,
    )
    gated_catch_up(stream, cycle, scratch_path(spark, "caught-up-state"), wait_seconds=40 * 3600, keep_seconds=3600)
    published = read_published(spark, cycle.data_path, cycle.report_path).groupBy(*DAY).agg(F.count(F.lit(1)).alias("published_rows"))
    decided = read_decisions(spark, cycle.decisions_path).join(published, DAY, "left")
    return decided.select(*DAY, "gate", "replica", "decision", "reason", F.coalesce("published_rows", F.lit(0).cast("bigint")).alias("published_rows"))


@query
def catch_up_gated(spark, sf):
    return gated_cycle(spark, sf, require_both=True)


@query
def catch_up_relaxed(spark, sf):
    return gated_cycle(spark, sf, require_both=False)


@query
def day_table_counts(spark, sf):
    """Rows per day of archived tables of one replica, against the days either side lists."""
    rows = scan_day_tables(spark, archive_rows(spark, sf))
    counted = rows.groupBy("collector", F.col("date").cast("string").alias("archive_date")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("row_index").alias("last_row")
    )
    return presence(spark, sf).select(*DAY, "in_r2").join(counted, DAY, "left").withColumn("replica", F.lit(PRIMARY_REPLICA))
