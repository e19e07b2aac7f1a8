"""State, severity and report labels as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daykeeper.contracts import MATCH_LABELS, REPLICA_LABELS, REPORT_KIND_LABELS, REPORT_STATE_LABELS, STATE_LABELS
from daykeeper.functions.text import label


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def local_state() -> Column:
    """From has_root, has_staging, has_marker, marker_is_json and marker_status."""
    return (
        F.when(~_true("has_root") & _true("has_staging"), F.lit("partial"))
        .when(~_true("has_root"), F.lit("missing"))
        .when(~_true("has_marker") | ~_true("marker_is_json"), F.lit("unverified"))
        .when(F.coalesce(F.col("marker_status") == "verified", F.lit(False)), F.lit("verified"))
        .otherwise(F.lit("unverified"))
    )


def state_label(state: Column) -> Column:
    return label(STATE_LABELS, state)


def replica_label(replica: Column) -> Column:
    return label(REPLICA_LABELS, replica)


def _both_cleaned() -> Column:
    return (F.col("drive_state") == "cleaned") & (F.col("r2_state") == "cleaned")


def match_label() -> Column:
    """Text of the replica comparison of a day_status row."""
    loading = (F.col("drive_state") == "loading") | (F.col("r2_state") == "loading")
    return (
        F.when(F.col("replicas_match"), F.lit(MATCH_LABELS["match"]))
        .when(~F.col("replicas_match"), F.lit(MATCH_LABELS["differ"]))
        .when(_both_cleaned(), F.lit(MATCH_LABELS["cleaned"]))
        .when(loading, F.lit(MATCH_LABELS["loading"]))
        .otherwise(F.lit(MATCH_LABELS["unknown"]))
    )


def day_severity() -> Column:
    """error > loading > ok > warn."""
    states = F.array("drive_state", "r2_state", "local_state")
    match = F.col("replicas_match")
    settled = F.coalesce(match, F.lit(False)) | _both_cleaned()
    return (
        F.when(F.coalesce(~match, F.lit(False)) | F.array_contains(states, "error"), F.lit("error"))
        .when(F.array_contains(states, "loading"), F.lit("loading"))
        .when(settled & (F.col("local_state") == "verified"), F.lit("ok"))
        .otherwise(F.lit("warn"))
    )


def report_kind(name: Column) -> Column:
    # File name prefixes of the archive's reports.
    return (
        F.when(F.startswith(name, F.lit("verify-")), F.lit("verify"))
        .when(F.startswith(name, F.lit("plan-")), F.lit("plan"))
        .when(F.startswith(name, F.lit("checkpoint-r2-")), F.lit("checkpoint"))
        .when(F.startswith(name, F.lit("receipt-")), F.lit("receipt"))
        .otherwise(F.lit("other"))
    )


def report_kind_label(kind: Column) -> Column:
    return label(REPORT_KIND_LABELS, kind)


def report_state(kind: Column, status: Column, broken: Column) -> Column:
    """Shown state; a document without a known state shows its own status."""
    text = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    shown = REPORT_STATE_LABELS
    return (
        F.when(broken, F.lit(shown["broken"]))
        .when(text == "verified", F.lit(shown["verified"]))
        .when(kind == "receipt", F.lit(shown["completed"]))
        .when(kind == "checkpoint", F.lit(shown["confirmed"]))
        .when(kind == "plan", F.lit(shown["pending"]))
        .when(text == "", F.lit(shown["read"]))
        .otherwise(text)
    )


def report_severity(kind: Column, status: Column, broken: Column) -> Column:
    verified = F.lower(F.trim(F.coalesce(status, F.lit("")))) == "verified"
    return F.when(broken, F.lit("error")).when(~verified & (kind == "plan"), F.lit("warn")).otherwise(F.lit("ok"))


def report_time(stamps: list[Column], modified: Column) -> Column:
    """The first non-empty stamp as ``YYYY-MM-DD hh:mm:ss UTC``, else the file time."""
    text = F.trim(F.coalesce(*[F.nullif(stamp, F.lit("")) for stamp in stamps], F.lit("")))
    # Fixed value: the form of the reports' time stamps.
    pattern = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})"
    day, clock = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    own = F.when(day != "", F.concat(day, F.lit(" "), clock))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    file_time = F.left(F.timestamp_add("SECOND", F.unix_seconds(modified), epoch).cast("string"), F.lit(19))
    return F.concat(F.coalesce(own, file_time), F.lit(" UTC"))


def report_date(payload_date: Column, name: Column) -> Column:
    found = F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}", 0)
    return F.coalesce(F.nullif(payload_date, F.lit("")), F.nullif(found, F.lit("")), F.lit("--"))
