"""Archive tables derived from the given tables, so that every query's work grows with the data.

A collector is a block of consecutive event ids and an object is one event type of one day of a
collector: at any scale an object holds at most ``BLOCK`` rows and a manifest at most five entries,
while the number of collectors, manifests and objects grows with the events.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daykeeper.contracts import DEFAULT_CONTRACTS, PRIMARY_REPLICA, SECONDARY_REPLICA
from daykeeper.functions.canonical import canonical_json, canonical_sql
from daykeeper.functions.dates import day_text
from daykeeper.functions.digests import digest_numbers, limb_sums, sha256
from daykeeper.operators.digest import tree_digest
from daykeeper.operators.reconcile import DAY
from daykeeper.sources.documents import manifest_columns

BLOCK = 4000
KINDS = {"purchase": "business", "signup": "business", "click": "raw", "view": "evidence", "error": "control"}
ROOT = "archive/v3"
PAYLOAD = ["event_id", "event_type", "props", "ts", "user_id", "value"]


def shared(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Keeps a view's definition per session and folder, so that plans built from it share it.

    Only the unevaluated DataFrame is kept; nothing is computed or stored.
    """
    known: dict[tuple, DataFrame] = {}

    @wraps(build)
    def view(spark: SparkSession, sf_dir: str, *args) -> DataFrame:
        key = (spark.sparkContext.applicationId, id(spark), sf_dir, *args)
        if key not in known:
            known[key] = build(spark, sf_dir, *args)
        return known[key]

    return view


@shared
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every(days: int) -> Column:
    """Days of month divisible by ``days``."""
    return F.col("dom") % days == 0


def kind_of(event_type: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for name, kind in KINDS.items():
        chain = chain.when(event_type == name, F.lit(kind))
    return chain


@shared
def event_rows(spark: SparkSession, sf_dir: str, side: str = PRIMARY_REPLICA) -> DataFrame:
    """Archived rows as one side holds them: both replicas and the local copy differ on some days."""
    events = table(spark, sf_dir, "events")
    day = day_text(F.col("ts"))
    kind = kind_of(F.col("event_type"))
    rows = events.select(
        F.concat(F.lit("c"), F.floor(F.col("event_id") / BLOCK).cast("string")).alias("collector"),
        day.alias("archive_date"),
        F.dayofmonth(F.col("ts").cast("date")).alias("dom"),
        F.col("event_type").alias("table_name"),
        kind.alias("kind"),
        F.concat(F.lit("date="), day, F.lit("/"), kind, F.lit("/"), F.col("event_type"), F.lit(".parquet")).alias("relative_key"),
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "props",
        F.col("value").cast("decimal(18,2)").alias("value"),
    )
    if side == SECONDARY_REPLICA:
        rows = rows.where(~every(11) & ~(every(7) & (F.col("event_id") % 101 == 0)))
        raised = F.when(every(5) & (F.col("event_type") == "view"), F.col("value") + 1).otherwise(F.col("value"))
        rows = rows.withColumn("value", raised.cast("decimal(18,2)"))
    elif side == "local":
        rows = rows.where(~every(13) & ~(every(9) & (F.col("event_type") == "error")))
    return rows.withColumn("payload", canonical_json(rows, PAYLOAD))


@shared
def objects(spark: SparkSession, sf_dir: str, side: str = PRIMARY_REPLICA) -> DataFrame:
    """Objects of one side. The digest is a sum over row digests, combined on the map side."""
    rows = event_rows(spark, sf_dir, side)
    hashed = rows.select(
        *DAY, "dom", "table_name", "kind", "relative_key", "ts",
        F.octet_length("payload").cast("bigint").alias("bytes"), sha256(F.col("payload")).alias("sha"),
    )
    numbered = hashed.select("*", *[number.alias(f"n{i}") for i, number in enumerate(digest_numbers("sha"))])
    sums = limb_sums([f"n{i}" for i in range(4)])
    line = F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[total.cast("string") for total in sums])
    grouped = numbered.groupBy(*DAY, "dom", "table_name", "kind", "relative_key").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("bytes").alias("size_bytes"),
        sha256(line).alias("sha256"),
        F.max("ts").alias("modified"),
    )
    if side == "local":
        grouped = grouped.withColumn("size_bytes", F.col("size_bytes") + F.when(every(8), 1).otherwise(0))
    return grouped.withColumn("schema_sha256", sha256(F.concat(F.lit("schema:"), "table_name"))).withColumn(
        "content_sha256", F.when(F.col("kind") == "business", sha256(F.concat(F.lit("content:"), "sha256")))
    )


ENTRY = ["content_sha256", "kind", "relative_key", "row_count", "schema_sha256", "sha256", "size_bytes", "table_name"]


@shared
def manifest_bodies(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Manifest fields per day before they become a document; at most five entries each."""
    entry = F.struct("relative_key", F.struct(*ENTRY).alias("item"))
    grouped = objects(spark, sf_dir, side).groupBy(*DAY, "dom").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["item"]).alias("objects"),
        F.count(F.lit(1)).alias("object_count"),
        F.sum("row_count").alias("row_count"),
    )
    return grouped.select(
        *DAY,
        "dom",
        F.lit(side).alias("replica"),
        F.col("archive_date").alias("doc_date"),
        F.lit(DEFAULT_CONTRACTS.manifest).alias("contract_version"),
        "object_count",
        "objects",
        F.lit(True).alias("retention_delete_allowed"),
        (F.col("row_count") + F.when(every(17), 1).otherwise(0)).alias("row_count"),
        F.lit("verified").alias("status"),
    )


def as_documents(bodies: DataFrame) -> DataFrame:
    """Bodies turned into raw bytes with the declared digest and size."""
    body = bodies.select(
        *DAY,
        "replica",
        "dom",
        F.struct(
            F.col("doc_date").alias("archive_date"),
            "contract_version", "object_count", "objects", "retention_delete_allowed", "row_count", "status",
        ).alias("body"),
    )
    text = F.expr(canonical_sql("body", body.schema["body"].dataType))
    raw = body.select(*DAY, "replica", "dom", text.cast("binary").alias("raw"))
    return raw.withColumn("declared_sha256", sha256(F.col("raw"))).withColumn(
        "declared_size", F.octet_length("raw").cast("bigint")
    )


@shared
def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of both replicas; on days divisible by 17 the declared row count is off by one."""
    both = [as_documents(manifest_bodies(spark, sf_dir, side)) for side in (PRIMARY_REPLICA, SECONDARY_REPLICA)]
    return both[0].unionByName(both[1])


@shared
def manifests(spark: SparkSession, sf_dir: str, sides: tuple[str, ...] = (PRIMARY_REPLICA, SECONDARY_REPLICA)) -> DataFrame:
    """Parsed manifests, through the same columns as manifest files."""
    documents = [as_documents(manifest_bodies(spark, sf_dir, side)) for side in sides]
    union = documents[0]
    for more in documents[1:]:
        union = union.unionByName(more)
    return manifest_columns(union)


@shared
def faulty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one planted fault per day of month, two on the 18th."""
    bodies = manifest_bodies(spark, sf_dir, PRIMARY_REPLICA)
    dom = F.col("dom")
    first = F.get("objects", F.lit(0))
    bent = (
        F.when(dom == 11, first.withField("relative_key", F.concat(F.lit("../"), first["relative_key"])))
        .when(dom == 12, first.withField("relative_key", F.replace(first["relative_key"], F.lit("date="), F.lit("day="))))
        .when(dom == 14, first.withField("size_bytes", F.lit(-1).cast("bigint")))
        .when(dom == 15, first.withField("sha256", F.upper(first["sha256"])))
        .otherwise(first)
    )
    listed = F.concat(F.array(bent), F.slice("objects", F.lit(2), F.size("objects")))
    changed = bodies.withColumns(
        {
            "objects": F.when(dom == 9, F.lit(None))
            .when(dom == 13, F.concat(listed, F.array(first)))
            .otherwise(listed),
            "object_count": F.col("object_count") + F.when(dom.isin(10, 13), 1).otherwise(0),
            "contract_version": F.when(dom == 5, F.lit("other/v1")).otherwise(F.col("contract_version")),
            "status": F.when(dom.isin(6, 18), F.lit("pending")).otherwise(F.col("status")),
            "retention_delete_allowed": dom != 7,
            "doc_date": F.when(dom == 8, F.lit("2024-02-30")).otherwise(F.col("doc_date")),
        }
    )
    documents = as_documents(changed)
    raw = F.col("raw")
    cut = documents.withColumn("raw", F.when(dom == 4, F.substring(raw, F.lit(1), F.octet_length(raw) - 1)).otherwise(raw))
    return cut.withColumn(
        "declared_sha256", F.when(dom == 3, sha256(F.lit(""))).otherwise(sha256(F.col("raw")))
    ).withColumn(
        "declared_size", F.octet_length("raw").cast("bigint") + F.when(dom.isin(2, 18), 1).otherwise(0)
    )


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects(spark, sf_dir, "local")


@shared
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat listing of both replicas with one boundary sibling folder per collector of the first day.

    A day's few objects become its listed names together, so each replica's objects are made once.
    """
    sides = [_listed(objects(spark, sf_dir, side), side) for side in (PRIMARY_REPLICA, SECONDARY_REPLICA)]
    return sides[0].unionByName(sides[1])


def _listed(held: DataFrame, side: str) -> DataFrame:
    days = held.groupBy(*DAY, "dom").agg(
        F.collect_list(F.struct(F.col("relative_key").alias("name"), "size_bytes", "modified")).alias("names"),
        F.max("modified").alias("modified"),
        F.sum("row_count").alias("rows"),
    )
    day = F.concat(F.lit("date="), "archive_date")
    manifest = F.struct(F.concat(day, F.lit("/manifest.json")).alias("name"), (F.col("rows") + 100).alias("size_bytes"), "modified")
    stray = F.struct(F.concat(day, F.lit("0/stray.parquet")).alias("name"), F.lit(7).cast("bigint").alias("size_bytes"), "modified")
    more = F.when(F.col("dom") == 1, F.array(manifest, stray)).otherwise(F.array(manifest))
    return days.select("collector", F.explode(F.concat("names", more)).alias("o")).select(
        "collector",
        F.lit(side).alias("replica"),
        F.concat(F.lit(f"{ROOT}/collector="), "collector", F.lit("/"), F.col("o.name")).alias("key"),
        F.col("o.size_bytes").alias("size_bytes"),
        F.col("o.modified").alias("modified"),
    )


@shared
def collector_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct collector days of the events with their day of month; one scan, no digests."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.concat(F.lit("c"), F.floor(F.col("event_id") / BLOCK).cast("string")).alias("collector"),
        day_text(F.col("ts")).alias("archive_date"),
        F.dayofmonth(F.col("ts").cast("date")).alias("dom"),
    ).distinct()


@shared
def drive_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest digest per day of the first replica."""
    documents = as_documents(manifest_bodies(spark, sf_dir, PRIMARY_REPLICA))
    return documents.select(*DAY, "dom", F.col("declared_sha256").alias("manifest_sha256"))


@shared
def local_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = collector_days(spark, sf_dir)
    return days.select(
        *DAY,
        (~every(13)).alias("has_root"),
        every(26).alias("has_staging"),
        (~every(13) & ~every(4)).alias("has_marker"),
        (~every(10)).alias("marker_is_json"),
        F.when(every(6), F.lit("failed")).otherwise(F.lit("verified")).alias("marker_status"),
    )


@shared
def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markers_of(drive_digests(spark, sf_dir))


def markers_of(digests: DataFrame) -> DataFrame:
    """Local verification markers: stale digest on days % 6, damaged on days % 10."""
    days = digests.where(~every(13))
    return days.select(
        *DAY,
        "dom",
        F.when(every(10), F.lit("broken/v0")).otherwise(F.lit(DEFAULT_CONTRACTS.verification)).alias("contract_version"),
        F.when(every(14), F.lit("failed")).otherwise(F.lit("verified")).alias("status"),
        F.when(every(15), F.lit("2024-01-01")).otherwise(F.col("archive_date")).alias("doc_archive_date"),
        F.when(every(6), sha256(F.lit("stale"))).otherwise(F.col("manifest_sha256")).alias("manifest_sha256"),
    )


@shared
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention_of(drive_digests(spark, sf_dir))


def retention_of(digests: DataFrame) -> DataFrame:
    days = digests.where(~every(19))
    return days.select(
        *DAY,
        F.lit(DEFAULT_CONTRACTS.retention).alias("contract_version"),
        F.when(every(12), F.lit("pending")).otherwise(F.lit("dropped")).alias("status"),
        F.col("archive_date").alias("doc_archive_date"),
        F.when(every(14), F.lit("")).otherwise(F.concat("archive_date", F.lit("T00:00:00Z"))).alias("dropped_at"),
        F.when(every(15), F.lit(None)).otherwise(F.array(F.lit("p1"))).alias("partitions"),
        F.when(every(4), sha256(F.lit("wrong"))).otherwise(F.col("manifest_sha256")).alias("verified_manifest_sha256"),
        sha256(F.concat(F.lit("retention:"), "collector", F.lit(":"), "archive_date")).alias("file_sha256"),
    )


def _identity() -> list[Column]:
    profile = F.concat(F.lit("p-"), "collector")
    return [
        profile.alias("profile_id"),
        *[F.col(name) for name in DAY],
        profile.alias("doc_profile_id"),
        F.col("collector").alias("doc_collector_id"),
        F.col("archive_date").alias("doc_archive_date"),
    ]


@shared
def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two plan files per day up to the 20th; drafts on days % 9, a foreign second file on days % 6."""
    trees = tree_digest(objects(spark, sf_dir), DAY, "relative_key")
    days = drive_digests(spark, sf_dir).where("dom <= 20").join(trees, DAY)
    files = days.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    name = F.concat(F.lit("plan-"), "archive_date", F.lit("-"), F.col("n").cast("string"), F.lit(".json"))
    foreign = every(6) & (F.col("n") == 2)
    return files.select(
        *_identity(),
        "dom",
        "n",
        F.when(foreign, F.lit("other/v1")).otherwise(F.lit(DEFAULT_CONTRACTS.cleanup_plan)).alias("contract_version"),
        F.when(every(9), F.lit("draft")).otherwise(F.lit("ready")).alias("status"),
        "manifest_sha256",
        F.when(every(16), sha256(F.lit("tree"))).otherwise(F.col("tree_sha256")).alias("local_tree_sha256"),
        name.alias("file_name"),
        sha256(F.concat(F.lit("plan:"), "collector", F.lit(":"), name)).alias("file_sha256"),
    )


@shared
def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints up to the 15th for the day's first valid plan name; wrong digest on days % 4."""
    days = collector_days(spark, sf_dir).where("dom <= 15")
    files = days.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    plan_no = F.when(every(6), F.lit("1")).otherwise(F.lit("2"))
    plan = F.concat(F.lit("plan-"), "archive_date", F.lit("-"), plan_no, F.lit(".json"))
    name = F.concat(F.lit("checkpoint-r2-"), "archive_date", F.lit("-"), F.col("n").cast("string"), F.lit(".json"))
    digest = sha256(F.concat(F.lit("plan:"), "collector", F.lit(":"), plan))
    return files.select(
        *_identity(),
        F.lit(DEFAULT_CONTRACTS.cleanup_checkpoint).alias("contract_version"),
        F.when(F.col("n") == 2, F.when(every(5), F.lit("open")).otherwise(F.lit("r2_absence_verified")))
        .otherwise(F.lit("r2_absence_verified"))
        .alias("status"),
        F.when(every(4), sha256(F.lit("wrong"))).otherwise(digest).alias("plan_sha256"),
        name.alias("file_name"),
        sha256(F.concat(F.lit("checkpoint:"), "collector", F.lit(":"), name)).alias("file_sha256"),
    )


@shared
def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts_of(drive_digests(spark, sf_dir))


def receipts_of(digests: DataFrame) -> DataFrame:
    days = digests.where("dom <= 10")
    name = F.concat(F.lit("receipt-"), "archive_date", F.lit(".json"))
    return days.select(
        *_identity(),
        F.lit(DEFAULT_CONTRACTS.cleanup_receipt).alias("contract_version"),
        F.when(every(7), F.lit("open")).otherwise(F.lit("completed")).alias("status"),
        "manifest_sha256",
        name.alias("file_name"),
        sha256(F.concat(F.lit("receipt:"), "collector", F.lit(":"), "archive_date")).alias("file_sha256"),
    )


@shared
def cleanup_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers up to the 10th; wrong receipt digest on days % 4, a path as file name on days % 5."""
    days = collector_days(spark, sf_dir).where("dom <= 10")
    name = F.concat(F.lit("receipt-"), "archive_date", F.lit(".json"))
    digest = sha256(F.concat(F.lit("receipt:"), "collector", F.lit(":"), "archive_date"))
    return days.select(
        *_identity(),
        F.lit(DEFAULT_CONTRACTS.cleanup_marker).alias("contract_version"),
        F.lit("completed").alias("status"),
        F.when(every(5), F.concat(F.lit("../"), name)).otherwise(name).alias("receipt_file"),
        F.when(every(4), sha256(F.lit("wrong"))).otherwise(digest).alias("receipt_sha256"),
    )


@shared
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_of(table(spark, sf_dir, "events"))


@shared
def transfer_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of each transfer: an object of every kind, whether there were updates of it or not."""
    size = lambda name: F.lit(20_000_000 + len(name) * 1_000_000).cast("bigint")
    held = F.array(*[F.struct(F.lit(name).alias("object_name"), size(name).alias("size_bytes")) for name in KINDS])
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("transfer_id")).distinct()
    return users.select("transfer_id", F.explode(held).alias("o")).select("transfer_id", "o.*")


def progress_of(events: DataFrame) -> DataFrame:
    """Progress updates of an event table or stream: a transfer per user, an object per event type.

    ``tick`` is the event time sped up 250,000 times, so that updates come within fractions of a
    second as live ones do.
    """
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", start, F.col("ts").cast("timestamp_ntz"))
    seconds = F.floor(micros / 1_000_000)
    reached = seconds * 10 + (F.col("event_id") % 50) * 1000
    total = (F.lit(20_000_000) + F.length("event_type") * 1_000_000).cast("bigint")
    return events.select(
        F.col("user_id").alias("transfer_id"),
        F.col("event_type").alias("object_name"),
        F.col("event_id").alias("seq"),
        "ts",
        F.timestamp_add("MICROSECOND", F.floor(micros / 250_000), start).alias("tick"),
        F.floor(micros / 250_000).alias("tick_micros"),
        F.when(F.col("event_id") % 97 == 0, F.floor(reached / 2)).otherwise(reached).alias("bytes"),
        total.alias("object_total"),
        (F.col("event_id") % 41 == 0).alias("completed"),
        F.when(F.col("event_id") % 53 == 0, F.lit("switching")).otherwise(F.lit("downloading")).alias("stage"),
    )


@shared
def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transfer attempts per order, bytes by the number of its line items."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", day_text(F.col("o_orderdate")).alias("archive_date"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    both = joined.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    first = F.col("attempt") == 1
    ok = F.when(first, F.col("o_orderkey") % 10 != 0).otherwise(F.col("o_orderkey") % 50 != 0)
    return both.select(
        F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string")).alias("collector"),
        "archive_date",
        F.col("o_orderkey").alias("object_pos"),
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string"), F.lit(".parquet")).alias("relative_key"),
        "attempt",
        F.when(first == (F.col("o_orderkey") % 7 != 0), F.lit("google_drive")).otherwise(F.lit("r2")).alias("source"),
        ok.alias("ok"),
        F.when(~ok, F.lit("timeout")).alias("error"),
        (F.coalesce("lines", F.lit(0)) * 1000 * F.col("attempt")).cast("bigint").alias("network_bytes"),
    )


@shared
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report files as rows: readable ones from manifests, unreadable ones from pages and chats."""
    days = manifest_bodies(spark, sf_dir, PRIMARY_REPLICA)
    stamp = F.concat("archive_date", F.lit("T01:02:03.000004Z"))
    body = days.select(
        *DAY,
        "dom",
        F.explode(F.array(F.lit("verify"), F.lit("plan"), F.lit("checkpoint-r2"), F.lit("receipt"), F.lit("note"))).alias("prefix"),
        "objects",
        "object_count",
        "row_count",
    )
    verify = F.col("prefix") == "verify"
    described = body.select(
        "collector", "prefix", F.col("archive_date").alias("day"), "dom",
        F.when(F.col("prefix") != "note", F.col("archive_date")).alias("archive_date"),
        F.when(verify, F.col("objects")).alias("objects"),
        F.when(verify & (F.col("dom") % 3 != 0), F.col("object_count").cast("string")).otherwise(F.lit("n/a")).alias("object_count"),
        "row_count",
        F.when(verify, F.lit("verified")).when(F.col("prefix") == "note", F.lit(" Draft ")).alias("status"),
        F.when(verify, stamp).otherwise(F.lit("")).alias("verified_at"),
        F.when(F.col("prefix") == "plan", stamp).alias("generated_at"),
    )
    text = canonical_json(described, ["archive_date", "objects", "object_count", "row_count", "status", "verified_at", "generated_at"])
    epoch = F.unix_date(F.col("day").cast("date")) * 86_400
    good = described.select(
        F.concat(F.lit("reports/collector="), "collector", F.lit("/"), "prefix", F.lit("-"), "day", F.lit(".json")).alias("path"),
        (epoch + F.col("dom")).cast("bigint").alias("seconds"),
        text.alias("text"),
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("reports/pages/page-"), F.col("page_id").cast("string"), F.lit(".json")).alias("path"),
        (F.lit(1_700_000_000) + F.col("page_id")).alias("seconds"),
        F.col("html").alias("text"),
    )
    chats = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("reports/chats/verify-2024-03-05-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".json")).alias("path"),
        (F.lit(1_710_000_000) + F.col("conv_id") * 100 + F.col("turn")).alias("seconds"),
        F.concat(F.lit('["'), F.col("role"), F.lit('"]')).alias("text"),
    )
    files = good.unionByName(pages).unionByName(chats)
    content = F.col("text").cast("binary")
    return files.select(
        "path", F.timestamp_seconds("seconds").alias("modified"), F.octet_length(content).cast("bigint").alias("length"), content.alias("content")
    )
