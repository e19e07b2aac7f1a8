"""Archive keys and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_slashes(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), r"^/+|/+\z", "")


def _climbs(path: Column) -> Column:
    return path.rlike(r"(^|/)\.\.(/|$)")


def _has_backslash(path: Column) -> Column:
    return F.contains(path, F.lit("\\"))


def relative_key_reason(key: Column, archive_date: Column | None = None) -> Column:
    """Why a relative key is refused: ``unsafe_key``, ``wrong_day``, or NULL when it is fine."""
    stripped = strip_slashes(key)
    # A path made only of '.' segments has no parts of its own but is a non-empty key: it is kept.
    verdict = F.when((stripped == "") | _climbs(stripped) | _has_backslash(stripped), F.lit("unsafe_key"))
    if archive_date is not None:
        prefix = F.concat(F.lit("date="), archive_date, F.lit("/"))
        verdict = verdict.when(~F.startswith(stripped, prefix), F.lit("wrong_day"))
    return verdict


def safe_relative_key(key: Column, archive_date: Column | None = None) -> Column:
    """The stripped key, not normalised; NULL when refused."""
    return F.when(relative_key_reason(key, archive_date).isNull(), strip_slashes(key))


def normalise_path(path: Column) -> Column:
    """Collapse ``//`` and drop ``.`` segments."""
    single = F.regexp_replace(path, r"/{2,}", "/")
    inner = F.regexp_replace(single, r"(?<=^|/)\./", "")
    return F.regexp_replace(inner, r"/\.$", "")


def safe_path_reason(path: Column, allow_root: bool = True) -> Column:
    """Why a browse path is refused: ``root``, ``unsafe_path`` or NULL."""
    stripped = strip_slashes(path)
    refused = (stripped == ".") | _climbs(stripped) | _has_backslash(stripped) | stripped.rlike(r"^\.(/+\.)*$")
    verdict = F.when(stripped == "", F.lit(None if allow_root else "root"))
    return verdict.when(refused, F.lit("unsafe_path"))


def safe_path(path: Column, allow_root: bool = True) -> Column:
    """The normalised path, ``''`` for the root; NULL when refused."""
    return F.when(safe_path_reason(path, allow_root).isNull(), normalise_path(strip_slashes(path)))


def join_path(parent: Column, child: Column) -> Column:
    """Parent and one child name; NULL when either is refused or the child has a slash."""
    left, right = safe_path(parent), safe_path(child, allow_root=False)
    joined = F.when(left == "", right).otherwise(F.concat_ws("/", left, right))
    return F.when(left.isNotNull() & right.isNotNull() & ~F.contains(right, F.lit("/")), joined)


def in_prefix(key: Column, target: Column | str, is_dir: bool | Column) -> Column:
    """Directory: keys below ``target/`` exactly. File: the one equal key.

    With a literal target and a Python bool both forms are source filters the scan can push down.
    """
    if isinstance(target, str):
        bare = target.rstrip("/")
        below, same = F.startswith(key, F.lit(bare + "/")), key == F.lit(target)
    else:
        below = F.startswith(key, F.concat(F.regexp_replace(target, r"/+\z", ""), F.lit("/")))
        same = key == target
    if isinstance(is_dir, bool):
        return below if is_dir else same
    return F.when(is_dir, below).otherwise(same)


def strip_date(key: Column, archive_date: Column) -> Column:
    """The path inside the day folder; NULL when the first segment is another one."""
    path = normalise_path(key)
    prefix = F.concat(F.lit("date="), archive_date)
    inside = F.substring(path, F.length(prefix) + 2, F.length(path))
    return F.when(path == prefix, F.lit(".")).when(F.startswith(path, F.concat(prefix, F.lit("/"))), inside)


def day_path(root: Column | str, collector: Column, archive_date: Column) -> Column:
    base = F.lit(root) if isinstance(root, str) else root
    return F.concat(base, F.lit("/collector="), collector, F.lit("/date="), archive_date)


def target_uri(bucket: str, key: Column, is_dir: Column) -> Column:
    return F.concat(F.lit(f"s3://{bucket}/"), key, F.when(is_dir, F.lit("/")).otherwise(F.lit("")))


def listed_day(key: Column) -> Column:
    """The day of a ``date=YYYY-MM-DD/`` segment (pattern only, calendar unchecked), or NULL."""
    found = F.regexp_extract(key, r"(?:^|/)date=(\d{4}-\d{2}-\d{2})/", 1)
    return F.nullif(found, F.lit(""))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
