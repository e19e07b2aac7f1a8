"""Ordered rule lists turned into reason columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def holds(condition: Column) -> Column:
    """Three-valued condition made two-valued: NULL counts as false."""
    return F.coalesce(condition, F.lit(False))


def reasons(*rules: Rule) -> Column:
    """``ARRAY<STRING>`` of the codes whose failure condition holds, in rule order."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(code)) for code, failed in rules]))


def first_reason(*rules: Rule) -> Column:
    """The first failing code or NULL; a plain CASE, so it stays inside whole-stage codegen."""
    chain = F.when(rules[0][1], F.lit(rules[0][0]))
    for code, failed in rules[1:]:
        chain = chain.when(failed, F.lit(code))
    return chain


def differs(left: Column, right: Column) -> Column:
    """True when the values differ, with NULL equal to NULL only."""
    return ~left.eqNullSafe(right)
