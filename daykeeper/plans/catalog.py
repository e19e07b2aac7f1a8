"""The registered queries: each runs one operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daykeeper.contracts import DEFAULT_CONTRACTS, PRIMARY_REPLICA, SECONDARY_REPLICA
from daykeeper.functions import dates, labels, paths, text
from daykeeper.functions.canonical import canonical_json, canonical_json_exact, nonfinite
from daykeeper.functions.dates import day_text, previous_day, strict_archive_date
from daykeeper.functions.digests import schema_fingerprint, sha256
from daykeeper.operators import digest, evidence, listing, manifests, reconcile, reports, rollup, telemetry
from daykeeper.operators.reconcile import DAY, OBJECT
from daykeeper.plans import views
from daykeeper.sources.documents import report_rows
from daykeeper.streaming import progress as live
from daykeeper.streaming import status as live_status
from daykeeper.streaming.sinks import append_to_table, upsert_to_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def joined(items: Column) -> Column:
    return F.array_join(items, ",")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their doubles as two-digit decimals."""
    table = views.table(spark, sf, "lineitem")
    doubles = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return table.withColumns({name: F.col(name).cast("decimal(18,2)") for name in doubles})


# Digests ---------------------------------------------------------------------------------------


@query
def canonical_payload(spark, sf):
    return views.event_rows(spark, sf).select("event_id", "payload")


@query
def row_sha256(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", sha256(F.col("text")).alias("text_sha256"))


@query
def content_digest(spark, sf):
    rows = views.event_rows(spark, sf)
    return digest.content_digest(rows, [*DAY, "table_name"], ["event_id"])


@query
def content_digest_exact(spark, sf):
    """Payloads of rows with floats, made by the Arrow function; digests per block of orders."""
    orders = views.table(spark, sf, "orders")
    keyed = orders.withColumn("payload", canonical_json_exact(orders)).withColumn("block", F.floor(F.col("o_orderkey") / 1000))
    return digest.content_digest(keyed, ["block"], ["o_orderkey"])


@query
def content_fingerprint(spark, sf):
    rows = lines(spark, sf)
    keyed = rows.withColumn("payload", canonical_json(rows))
    return digest.content_fingerprint(keyed, ["l_returnflag", "l_linestatus"])


@query
def content_fingerprint_documents(spark, sf):
    documents = views.table(spark, sf, "documents").withColumnRenamed("text", "payload")
    return digest.content_fingerprint(documents, ["lang"], bucket_digits=1)


@query
def tree_digest(spark, sf):
    return digest.tree_digest(views.objects(spark, sf), DAY, "relative_key")


@query
def schema_drift(spark, sf):
    names = ["orders", "lineitem", "events", "documents"]
    counted = [
        (df := views.table(spark, sf, name)).groupBy(F.lit(name).alias("table_name"), schema_fingerprint(df).alias("schema_sha256")).agg(
            F.count(F.lit(1)).alias("row_count")
        )
        for name in names
    ]
    union = counted[0]
    for more in counted[1:]:
        union = union.unionByName(more)
    return union


# Rules -----------------------------------------------------------------------------------------


@views.shared
def faulty(spark, sf):
    return views.manifest_columns(views.faulty_documents(spark, sf))


@query
def check_manifest_doc(spark, sf):
    checked = manifests.check_manifest_doc(faulty(spark, sf))
    return checked.select(*DAY, "replica", joined(F.col("reasons")).alias("reasons"))


@query
def check_manifest_entries(spark, sf):
    return manifests.check_manifest_entries(faulty(spark, sf)).select(
        *DAY, "pos", "relative_key", "size_bytes", "reason"
    )


@query
def validate_manifests(spark, sf):
    return manifests.validate_manifests(faulty(spark, sf)).select(*DAY, "raw_sha256", "raw_size", "reason")


@query
def manifest_totals(spark, sf):
    return manifests.manifest_totals(views.manifests(spark, sf))


def bent_urls(spark, sf) -> DataFrame:
    """Page URLs without scheme, bent in eight ways."""
    pages = views.table(spark, sf, "pages")
    bare = F.regexp_replace("url", "^https?://", "")
    way = F.col("page_id") % 8
    bent = (
        F.when(way == 0, bare)
        .when(way == 1, F.concat(F.lit("/"), bare, F.lit("/")))
        .when(way == 2, F.concat(F.lit("a/../"), bare))
        .when(way == 3, F.concat(F.lit("a\\"), bare))
        .when(way == 4, F.concat(F.lit("a//b/./"), bare))
        .when(way == 5, F.concat(F.lit("date=2024-01-02/"), bare))
        .when(way == 6, F.concat(F.lit("./..."), bare))
        .otherwise(F.lit("///"))
    )
    return pages.select("page_id", bent.alias("path"))


@query
def safe_relative_key(spark, sf):
    day = F.lit("2024-01-02")
    return bent_urls(spark, sf).select(
        "page_id",
        paths.safe_relative_key(F.col("path")).alias("any_day"),
        paths.safe_relative_key(F.col("path"), day).alias("one_day"),
        paths.relative_key_reason(F.col("path"), day).alias("reason"),
    )


@query
def safe_path(spark, sf):
    return bent_urls(spark, sf).select(
        "page_id",
        paths.safe_path(F.col("path")).alias("path"),
        paths.safe_path_reason(F.col("path"), allow_root=False).alias("removal_reason"),
        paths.join_path(F.col("path"), F.lit("child.txt")).alias("child"),
        paths.join_path(F.lit("top"), F.col("path")).alias("below_top"),
    )


@query
def strict_dates(spark, sf):
    orders = views.table(spark, sf, "orders")
    day = day_text(F.col("o_orderdate"))
    way = F.col("o_orderkey") % 9
    bent = (
        F.when(way == 0, day)
        .when(way == 1, F.concat(F.lit(" "), day, F.lit(" ")))
        .when(way == 2, F.concat(F.left(day, F.lit(8)), F.lit("31")))
        .when(way == 3, F.replace(day, F.lit("-"), F.lit("")))
        .when(way == 4, F.concat(F.left(day, F.lit(4)), F.lit("-1-5")))
        .when(way == 5, F.concat(F.lit("0000"), F.substring(day, 5, 6)))
        .when(way == 6, F.lit(""))
        .when(way == 7, F.concat(F.left(day, F.lit(5)), F.lit("02-29")))
        .otherwise(F.concat(day, F.lit("T00:00:00")))
    )
    return orders.select("o_orderkey", strict_archive_date(bent).alias("archive_date"))


@query
def check_marker(spark, sf):
    return evidence.check_marker(views.markers(spark, sf)).select(*DAY, "manifest_sha256", "reason")


@query
def check_retention(spark, sf):
    return evidence.check_retention(views.retention(spark, sf)).select(*DAY, "dropped_at", "verified_manifest_sha256", "reason")


@views.shared
def checked_plans(spark, sf):
    return evidence.check_plan_identity(views.plans(spark, sf), DEFAULT_CONTRACTS.cleanup_plan, "ready")


@query
def check_plan_identity(spark, sf):
    return checked_plans(spark, sf).select("profile_id", *DAY, "file_name", "reason")


@query
def check_listing_entries(spark, sf):
    entries = bent_urls(spark, sf).select(
        "page_id",
        F.col("path").alias("full"),
        F.when(F.col("page_id") % 3 == 0, F.element_at(F.split("path", "/"), -1)).otherwise(F.col("path")).alias("name"),
        (F.col("page_id") % 5 == 0).alias("is_dir"),
        F.when(F.col("page_id") % 5 == 0, F.lit(-1)).otherwise(F.col("page_id") - 10).alias("size_bytes"),
    )
    return listing.check_listing_entries(entries).select("page_id", "name", "reason")


@query
def in_prefix(spark, sf):
    listed = views.listing(spark, sf)
    folder = f"{views.ROOT}/collector=c0/date=2024-01-01"
    below = listed.where(paths.in_prefix(F.col("key"), folder, True)).select("replica", "key", F.lit("directory").alias("mode"))
    same = listed.where(paths.in_prefix(F.col("key"), f"{folder}/manifest.json", False)).select("replica", "key", F.lit("file").alias("mode"))
    return below.unionByName(same)


@query
def nonfinite_check(spark, sf):
    vectors = views.table(spark, sf, "embeddings")
    spoiled = vectors.withColumn(
        "embedding",
        F.when(F.col("vec_id") % 50 == 0, F.concat("embedding", F.array(F.lit("NaN").cast("float"))))
        .when(F.col("vec_id") % 50 == 1, F.concat("embedding", F.array(F.lit("-Infinity").cast("float"))))
        .otherwise(F.col("embedding")),
    )
    flag = nonfinite(F.col("embedding"), spoiled.schema["embedding"].dataType)
    return spoiled.select("vec_id", flag.alias("non_finite"))


def provider_listing(spark, sf):
    listed = views.listing(spark, sf).withColumnRenamed("replica", "provider")
    stray = F.col("key").endswith("stray.parquet") & (F.col("provider") == SECONDARY_REPLICA)
    return listed.withColumn("size_bytes", F.when(stray, F.lit(-7)).otherwise(F.col("size_bytes")))


@query
def check_usage(spark, sf):
    return rollup.check_usage(provider_listing(spark, sf))


# Joins -----------------------------------------------------------------------------------------


@views.shared
def validated(spark, sf):
    return manifests.validate_manifests(views.manifests(spark, sf))


@views.shared
def presence(spark, sf):
    sides = [
        views.event_rows(spark, sf, side).select(*DAY, F.lit(side).alias("replica")).distinct()
        for side in (PRIMARY_REPLICA, SECONDARY_REPLICA)
    ]
    local = views.event_rows(spark, sf, "local").select(*DAY).distinct()
    return rollup.all_days(sides[0].unionByName(sides[1]), local)


@views.shared
def chained(spark, sf):
    return evidence.receipt_chain(
        views.cleanup_markers(spark, sf), views.receipts(spark, sf), views.markers(spark, sf)
    )


@views.shared
def statuses(spark, sf):
    return rollup.day_status(presence(spark, sf), validated(spark, sf), views.local_flags(spark, sf), chained(spark, sf))


@views.shared
def verified(spark, sf):
    left = views.objects(spark, sf).withColumn("pos", F.col("relative_key"))
    return reconcile.verify_objects(left, views.observed(spark, sf))


@views.shared
def verdicts(spark, sf):
    drive = views.manifests(spark, sf, (PRIMARY_REPLICA,)).select(
        *DAY,
        F.col("raw_sha256").alias("manifest_sha256"),
        F.col("object_count").cast("bigint").alias("object_count"),
        F.col("row_count").cast("bigint").alias("row_count"),
    )
    return rollup.verify_days(drive, verified(spark, sf))


@query
def day_status(spark, sf):
    return statuses(spark, sf)


@query
def replica_match(spark, sf):
    return reconcile.replica_match(views.manifests(spark, sf), raw=True)


@query
def object_meta_match(spark, sf):
    meta = views.objects(spark, sf, SECONDARY_REPLICA).select("collector", "relative_key", "size_bytes", "sha256")
    matched = reconcile.object_meta_match(views.objects(spark, sf), meta)
    return matched.select(*OBJECT, "meta_size", "reason")


@query
def verify_objects(spark, sf):
    return verified(spark, sf).select(*OBJECT, "seen_row_count", "reason")


@query
def removal_eligibility(spark, sf):
    return eligible(spark, sf)


@views.shared
def eligible(spark, sf):
    return evidence.removal_eligibility(
        validated(spark, sf),
        evidence.check_retention(views.retention(spark, sf)),
        evidence.check_marker(views.markers(spark, sf)),
        verdicts(spark, sf),
        chained(spark, sf),
    )


@query
def listing_drift(spark, sf):
    listed = views.listing(spark, sf)
    sides = [listed.where(F.col("replica") == side) for side in (PRIMARY_REPLICA, SECONDARY_REPLICA)]
    return listing.listing_drift(sides[0], sides[1], ["collector"])


@views.shared
def selected(spark, sf):
    return reconcile.select_source(validated(spark, sf), SECONDARY_REPLICA)


@query
def select_source(spark, sf):
    return selected(spark, sf)


@query
def catch_up_days(spark, sf):
    available = selected(spark, sf).select(*DAY, F.col("raw_sha256").alias("manifest_sha256"))
    local = views.markers(spark, sf).where("dom % 5 <> 0")
    return reconcile.catch_up_days(available, local).select(*DAY, "action")


@query
def days_to_fetch(spark, sf):
    available = selected(spark, sf).select(*DAY, "replica")
    return reconcile.days_to_fetch(available, views.markers(spark, sf).where("dom % 5 <> 0"))


@query
def receipt_chain(spark, sf):
    return chained(spark, sf).select(*DAY, "file_name", "manifest_sha256")


@views.shared
def bound_checkpoints(spark, sf):
    newest = evidence.latest_valid_evidence(checked_plans(spark, sf), evidence.PROFILE_DAY)
    found = evidence.check_plan_identity(
        views.checkpoints(spark, sf), DEFAULT_CONTRACTS.cleanup_checkpoint, "r2_absence_verified"
    )
    return evidence.checkpoint_for_plan(newest, found)


@query
def checkpoint_for_plan(spark, sf):
    return bound_checkpoints(spark, sf)


@query
def compatible_sources(spark, sf):
    found = reconcile.compatible_sources(validated(spark, sf))
    return found.select(*DAY, "selected", joined(F.col("sources")).alias("sources"), "other_differs")


@views.shared
def removal_targets(spark, sf):
    """A folder target per collector day and one file target."""
    days = views.collector_days(spark, sf)
    folder = F.concat(F.lit(f"{views.ROOT}/collector="), "collector", F.lit("/date="), "archive_date")
    return days.select("collector", folder.alias("target"), F.lit(True).alias("is_dir")).unionByName(
        days.where("dom % 2 = 0").select("collector", F.concat(folder, F.lit("/manifest.json")).alias("target"), F.lit(False).alias("is_dir"))
    )


def r2_listing(spark, sf):
    return views.listing(spark, sf).where(F.col("replica") == SECONDARY_REPLICA)


@query
def residual_after_removal(spark, sf):
    left = r2_listing(spark, sf).where(~F.col("key").contains("/business/") & ~F.col("key").contains("-03/"))
    return listing.residual_after_removal(left, removal_targets(spark, sf))


@query
def two_replica_gate(spark, sf):
    return reconcile.two_replica_gate(validated(spark, sf))


@query
def two_replica_gate_relaxed(spark, sf):
    return reconcile.two_replica_gate(validated(spark, sf), require_both=False)


# Aggregates ------------------------------------------------------------------------------------


@query
def verify_days(spark, sf):
    return verdicts(spark, sf)


@query
def storage_usage(spark, sf):
    return rollup.storage_usage(provider_listing(spark, sf), f"{views.ROOT}/collector=c0")


@query
def account_usage(spark, sf):
    customers = views.table(spark, sf, "customer")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    accounts = customers.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 4 != 0, cents).alias("total_bytes"),
        F.lit(1).cast("bigint").alias("used_bytes"),
        F.lit(None).cast("bigint").alias("free_bytes"),
        F.col("c_nationkey").cast("bigint").alias("trashed_bytes"),
    )
    return rollup.account_usage(accounts)


@query
def removal_plan(spark, sf):
    return listing.removal_plan(r2_listing(spark, sf), removal_targets(spark, sf), "archive-bucket")


@query
def removal_entries(spark, sf):
    return listing.removal_entries(r2_listing(spark, sf), removal_targets(spark, sf))


@query
def removal_documents(spark, sf):
    entries = listing.removal_entries(r2_listing(spark, sf), removal_targets(spark, sf))
    documents = listing.removal_documents(entries, ["collector", "target"])
    listed = F.transform(F.map_entries("expected_objects"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return documents.select("collector", "target", joined(listed).alias("expected"))


@query
def dashboard_metrics(spark, sf):
    sizes = views.listing(spark, sf).groupBy("collector").agg(
        F.sum(F.when(F.col("replica") == PRIMARY_REPLICA, F.col("size_bytes"))).alias("drive_used"),
        F.sum(F.when(F.col("replica") == SECONDARY_REPLICA, F.col("size_bytes"))).alias("r2_used"),
    )
    usage = sizes.withColumn("drive_total", F.when(F.col("collector") != "c1", F.lit(1_000_000)).otherwise(F.lit(0)).cast("bigint"))
    disk = F.when(F.col("collector") != "c2", F.lit(800_000)).otherwise(F.lit(0)).cast("bigint")
    usage = usage.withColumns({"local_used": F.floor(F.col("drive_used") / 2).cast("bigint"), "local_total": disk})
    metrics = rollup.dashboard_metrics(statuses(spark, sf), usage, allowance=500_000)
    rounded = [F.round(name, 6).alias(name) for name in ("drive_percent", "r2_percent", "local_percent")]
    return metrics.select(*[name for name in metrics.columns if not name.endswith("_percent")], *rounded)


def batch_results(spark, sf):
    orders = views.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return orders.select(
        day_text(F.date_trunc("month", "o_orderdate")).alias("batch_id"),
        day_text(F.col("o_orderdate")).alias("archive_date"),
        F.when(key % 3 == 0, F.lit("already_verified")).otherwise(F.lit("verified")).alias("status"),
        F.when(key % 3 == 0, F.lit(0)).otherwise(key * 10).cast("bigint").alias("bytes"),
        F.when(key % 11 == 0, F.lit("timeout")).alias("error"),
        (key % 500 != 0).alias("success"),
    )


@query
def batch_summary(spark, sf):
    results = batch_results(spark, sf)
    return rollup.batch_summary(results.select("batch_id", "archive_date"), results)


@query
def run_outcome(spark, sf):
    return rollup.run_outcome(batch_results(spark, sf), ["batch_id"])


@query
def duplicate_keys(spark, sf):
    return rollup.duplicate_keys(views.table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query
def expected_entries(spark, sf):
    totals = manifests.manifest_totals(views.manifests(spark, sf))
    return rollup.expected_entries(totals, listing.day_entries(views.listing(spark, sf)))


@query
def object_source_fallback(spark, sf):
    done = telemetry.object_source_fallback(views.attempts(spark, sf))
    return done.withColumn("attempted", joined(F.col("attempted")))


@query
def fallback_warnings(spark, sf):
    return telemetry.fallback_warnings(views.attempts(spark, sf)).drop("error")


@query
def transfer_rollup(spark, sf):
    rolled = telemetry.transfer_rollup(views.attempts(spark, sf))
    lists = {name: joined(F.col(name)) for name in ("sources_attempted", "sources_completed")}
    return rolled.withColumns(lists)


@query
def space_preflight(spark, sf):
    here = views.observed(spark, sf).select(*OBJECT, (F.col("size_bytes") - F.col("row_count")).alias("existing_bytes"))
    free = views.collector_days(spark, sf).groupBy("collector").agg((F.count(F.lit(1)) * 20_000_000).alias("free_bytes"))
    return rollup.space_preflight(views.objects(spark, sf), here, free)


@query
def verification_report(spark, sf):
    report = rollup.verification_report(verdicts(spark, sf), verified(spark, sf), views.manifests(spark, sf))
    keys = F.transform("objects", lambda o: F.concat_ws(":", o["relative_key"], o["row_count"].cast("string"), o["content_sha256"]))
    return report.withColumn("objects", joined(keys))


# Windows ---------------------------------------------------------------------------------------


@query
def latest_valid_evidence(spark, sf):
    newest = evidence.latest_valid_evidence(checked_plans(spark, sf), evidence.PROFILE_DAY)
    return newest.select(*evidence.PROFILE_DAY, "file_name", "file_sha256")


@query
def transfer_high_water(spark, sf):
    return telemetry.transfer_high_water(views.progress(spark, sf), telemetry.planned_bytes(views.transfer_entries(spark, sf)))


def sped_up(spark, sf):
    updates = views.progress(spark, sf)
    return updates.select(
        "transfer_id", "object_name", "seq", F.col("tick").alias("ts"), "stage",
        F.col("bytes").alias("network_bytes"), "bytes", "object_total",
        (F.col("object_total") - F.col("bytes")).alias("remaining_bytes"),
    )


@query
def transfer_speed(spark, sf):
    speeds = telemetry.transfer_speed(sped_up(spark, sf), chunk_seconds=1)
    return speeds.select("transfer_id", "seq", F.round("speed", 3).alias("speed"), F.round("eta_seconds", 3).alias("eta_seconds"))


@query
def removal_batches(spark, sf):
    keys = views.attempts(spark, sf).where("attempt = 1").select("collector", F.col("relative_key").alias("key"))
    return listing.removal_batches(keys, ["collector"])


@query
def first_seen_flag(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        "l_suppkey", "l_partkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos")
    )
    return rollup.first_seen_flag(rows, ["l_suppkey", "l_partkey"])


@query
def latest_run(spark, sf):
    orders = views.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    profile = F.struct(
        F.concat(F.lit("p-"), F.col("o_custkey").cast("string")).alias("profile_id"),
        (key % 4 != 0).alias("success"),
        F.lit("timeout").alias("error"),
    )
    logs = orders.select(
        F.col("o_orderpriority").alias("host"),
        F.concat(F.lit("sync-"), F.lpad(key.cast("string"), 12, "0"), F.lit(".json")).alias("file_name"),
        F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint").alias("modified"),
        (key % 4 != 0).alias("success"),
        F.array(profile).alias("profiles"),
    )
    newest = telemetry.latest_run(logs, F.lit(10_000), ["host"])
    return newest.withColumn("failed_profiles", joined(F.col("failed_profiles")))


# Sorts and sets --------------------------------------------------------------------------------


@query
def recent_days(spark, sf):
    days = batch_results(spark, sf).select(F.substring("batch_id", 1, 4).alias("collector"), "archive_date")
    return listing.recent_days(days, 45)


@query
def browse(spark, sf):
    return listing.browse(views.listing(spark, sf), f"{views.ROOT}/collector=c0/date=2024-01-01").drop("modified")


@query
def browse_collectors(spark, sf):
    """The children of every collector's folder at once."""
    base = F.concat(F.lit(f"{views.ROOT}/collector="), "collector", F.lit("/"))
    return listing.children(views.listing(spark, sf), base, ["replica", "collector"]).drop("modified")


@query
def report_index(spark, sf):
    index = reports.report_index(readable(spark, sf))
    return index.withColumn("kind", labels.report_kind_label(F.col("kind"))).drop("modified")


@views.shared
def readable(spark, sf):
    return report_rows(views.report_files(spark, sf))


@query
def report_index_counts(spark, sf):
    return reports.report_index_counts(readable(spark, sf))


@query
def report_objects(spark, sf):
    return reports.report_objects(readable(spark, sf))


@query
def report_object_totals(spark, sf):
    return reports.report_object_totals(readable(spark, sf))


@query
def report_fields(spark, sf):
    return reports.report_fields(readable(spark, sf))


@query
def all_days(spark, sf):
    return presence(spark, sf)


@query
def list_days(spark, sf):
    return listing.list_days(views.listing(spark, sf), ["replica", "collector"])


@query
def replica_object_diff(spark, sf):
    return reconcile.replica_object_diff(views.objects(spark, sf), views.objects(spark, sf, SECONDARY_REPLICA))


# Scalars ---------------------------------------------------------------------------------------


@query
def strip_date(spark, sf):
    held = views.objects(spark, sf)
    other = F.when(F.col("dom") % 4 == 0, F.lit("2024-02-01")).otherwise(F.col("archive_date"))
    return held.select(*OBJECT, paths.strip_date(F.col("relative_key"), other).alias("inside"))


@query
def human_sizes(spark, sf):
    key = F.col("o_orderkey")
    # Sizes from bytes to tens of petabytes; the remainder keeps the product within 64 bits.
    part = key % 15_000
    size = part * part * part * 7919
    return views.table(spark, sf, "orders").select(
        "o_orderkey",
        text.human_bytes(size).alias("shown"),
        text.human_bytes(key * 32).alias("small"),
        text.human_duration(key * 7.25 - 100).alias("duration"),
    )


@query
def compact_text(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.compact_text(F.col("text"), 180).alias("shown"))


@query
def utc_yesterday(spark, sf):
    return views.table(spark, sf, "events").select("event_id", dates.utc_yesterday(F.col("ts")).alias("day"))


@query
def safe_int(spark, sf):
    way = F.col("event_id") % 5
    raw = (
        F.when(way == 0, F.col("user_id").cast("string"))
        .when(way == 1, F.col("props"))
        .when(way == 2, F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")))
        .when(way == 3, F.lit("99999999999999999999"))
        .otherwise(F.lit(None))
    )
    return views.table(spark, sf, "events").select("event_id", text.safe_int(raw, -1).alias("value"))


@query
def local_state(spark, sf):
    return views.local_flags(spark, sf).select(*DAY, labels.local_state().alias("local_state"))


@query
def day_labels(spark, sf):
    return statuses(spark, sf).select(
        *DAY,
        labels.day_severity().alias("severity"),
        labels.match_label().alias("match_text"),
        labels.state_label(F.col("drive_state")).alias("drive_text"),
        labels.state_label(F.col("local_state")).alias("local_text"),
    )


@query
def source_labels(spark, sf):
    rolled = telemetry.transfer_rollup(views.attempts(spark, sf))
    return rolled.select(*DAY, labels.replica_label(F.col("active_source")).alias("source_text"))


@query
def target_paths(spark, sf):
    day = paths.day_path(views.ROOT, F.col("collector"), F.col("archive_date"))
    return views.collector_days(spark, sf).select(
        *DAY,
        day.alias("day_path"),
        paths.target_uri("archive-bucket", day, F.col("dom") % 2 == 0).alias("uri"),
        previous_day(F.col("archive_date")).alias("day_before"),
    )


# Evidence-gated removal ------------------------------------------------------------------------


@query
def cleanup_plan(spark, sf):
    totals = manifests.manifest_totals(views.manifests(spark, sf, (PRIMARY_REPLICA,)))
    return evidence.cleanup_plan(
        eligible(spark, sf),
        totals,
        verdicts(spark, sf),
        evidence.check_retention(views.retention(spark, sf)),
        F.concat(F.lit("p-"), "collector"),
        f"drive:{views.ROOT}",
        f"s3://archive-bucket/{views.ROOT}",
    )


@query
def cleanup_stage(spark, sf):
    newest = evidence.latest_valid_evidence(checked_plans(spark, sf), evidence.PROFILE_DAY)
    now = views.drive_digests(spark, sf).join(digest.tree_digest(views.objects(spark, sf), DAY, "relative_key"), DAY)
    # Removal seen so far: the second replica lost days % 3 = 0, the first replica days % 6 = 0.
    seen = presence(spark, sf).withColumn("_dom", F.dayofmonth(F.col("archive_date").cast("date")))
    seen = seen.withColumns({"in_r2": F.col("in_r2") & (F.col("_dom") % 3 != 0), "in_drive": F.col("in_drive") & (F.col("_dom") % 6 != 0)})
    return evidence.cleanup_stage(newest, bound_checkpoints(spark, sf), seen, now, chained(spark, sf)).select(
        *DAY, "file_name", "checkpoint_file", "stage"
    )


@query
def removal_receipt(spark, sf):
    targets = removal_targets(spark, sf).where("is_dir")
    listed = r2_listing(spark, sf)
    planned = listing.removal_entries(listed, targets)
    before = planned.where(~F.col("key").contains("-05/raw"))
    after = planned.where(F.col("key").contains("-06/raw"))
    return evidence.removal_receipt(targets, planned, before, after, ["collector", "target"])


# Streams ---------------------------------------------------------------------------------------


def event_stream(spark, sf) -> DataFrame:
    schema = views.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{sf}/events.parquet*")


def progress_stream(spark, sf) -> DataFrame:
    return views.progress_of(event_stream(spark, sf))


def sped_up_stream(spark, sf) -> DataFrame:
    updates = progress_stream(spark, sf)
    return updates.select(
        "transfer_id", "object_name", "seq", F.col("tick").alias("ts"), "stage",
        F.col("bytes").alias("network_bytes"), "bytes", "object_total",
    )


@query
def stream_progress(spark, sf):
    return upsert_to_table(live.stream_progress(progress_stream(spark, sf)), "progress", ["transfer_id", "object_name"])


@query
def stream_transfer_totals(spark, sf):
    return live.transfer_totals(stream_progress(spark, sf), telemetry.planned_bytes(views.transfer_entries(spark, sf)))


@query
def stream_throttle(spark, sf):
    return append_to_table(live.throttle(sped_up_stream(spark, sf)), "throttle")


@query
def stream_speed(spark, sf):
    speeds = append_to_table(live.stream_speed(sped_up_stream(spark, sf)), "speed")
    return speeds.select("transfer_id", "seq", F.round("speed", 3).alias("speed"))


@query
def live_day_status(spark, sf):
    events = event_stream(spark, sf)
    updates = events.select(
        F.concat(F.lit("c"), F.col("user_id") % 3).alias("collector"),
        day_text(F.col("ts")).alias("archive_date"),
        F.when(F.col("user_id") % 2 == 0, F.lit(PRIMARY_REPLICA)).otherwise(F.lit(SECONDARY_REPLICA)).alias("replica"),
        F.col("event_type").alias("status"),
        "ts",
        F.col("event_id").alias("seq"),
    )
    return upsert_to_table(live_status.live_day_status(updates), "status", ["collector", "archive_date", "replica"])


def checks(spark, sf):
    return views.table(spark, sf, "events").select(
        "user_id",
        F.col("ts").alias("checked_at"),
        F.when(F.col("event_type").isin("error", "view"), F.lit("error")).otherwise(F.lit("verified")).alias("state"),
    )


NOW = "2024-01-30 12:00:00"


@query
def fresh_results(spark, sf):
    past = checks(spark, sf).where(F.col("checked_at") <= F.lit(NOW).cast("timestamp_ntz"))
    return live_status.fresh_results(past, F.lit(NOW).cast("timestamp_ntz"), ["user_id"], seconds=6 * 3600)


@query
def stale_keys(spark, sf):
    past = checks(spark, sf).where(F.col("checked_at") <= F.lit(NOW).cast("timestamp_ntz"))
    wanted = past.select("user_id").distinct()
    return live_status.stale_keys(wanted, past, F.lit(NOW).cast("timestamp_ntz"), ["user_id"], seconds=6 * 3600)
