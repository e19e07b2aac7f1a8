"""Running values over ordered keys that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_COMBINE = {"max": F.max, "sum": F.sum}


def time_chunk(ts: Column, seconds: int) -> Column:
    """Number of the time slice a timestamp without zone falls in."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("SECOND", epoch, ts.cast("timestamp_ntz")) / seconds)


def chunked_running(
    df: DataFrame, keys: list[str], chunk: str, order: list[str], values: dict[str, tuple[str, Column]]
) -> DataFrame:
    """Running max, sum or last non-null value per key in ``order``, current row included.

    ``values`` maps an output name to ("max" | "sum" | "last", expression); ``<name>_before`` is the
    running value without the current row. ``chunk`` is a column that does not decrease along
    ``order``. Windows run inside (key, chunk), so a hot key is sorted by many tasks; each chunk then
    takes over the combined value of the key's earlier chunks, of which there are few.
    """
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)

    source = df.withColumns({f"_v_{name}": expr for name, (_, expr) in values.items()})
    rows, totals, carries = {}, [], []
    for name, (kind, _) in values.items():
        value = F.col(f"_v_{name}")
        if kind == "last":
            rows[f"_in_{name}"] = F.last(value, ignorenulls=True).over(upto)
            rows[f"_ex_{name}"] = F.last(value, ignorenulls=True).over(before)
            at = F.when(value.isNotNull(), F.struct(*order))
            totals.append(F.max_by(value, at).alias(f"_t_{name}"))
            carries.append(F.last(f"_t_{name}", ignorenulls=True).over(earlier).alias(f"_c_{name}"))
        else:
            combine = _COMBINE[kind]
            rows[f"_in_{name}"] = combine(value).over(upto)
            rows[f"_ex_{name}"] = combine(value).over(before)
            totals.append(combine(value).alias(f"_t_{name}"))
            carries.append(combine(f"_t_{name}").over(earlier).alias(f"_c_{name}"))
    carry = source.groupBy(*keys, chunk).agg(*totals).select(*keys, chunk, *carries)
    joined = source.withColumns(rows).join(carry, [*keys, chunk], "left")

    def merged(kind: str, near: str, far: str) -> Column:
        if kind == "max":
            return F.greatest(near, far)
        if kind == "sum":
            either = F.col(near).isNotNull() | F.col(far).isNotNull()
            nothing = F.lit(0)
            return F.when(either, F.coalesce(near, nothing) + F.coalesce(far, nothing))
        return F.coalesce(near, far)

    outputs = []
    for name, (kind, _) in values.items():
        outputs.append(merged(kind, f"_in_{name}", f"_c_{name}").alias(name))
        outputs.append(merged(kind, f"_ex_{name}", f"_c_{name}").alias(f"{name}_before"))
    return joined.select(*df.columns, *outputs)
